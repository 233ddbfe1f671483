"""Media columns: WAV files, short-time spectra and spectral-peak pair fingerprints.

A text's UTF-8 bytes, padded with zero bytes to a positive multiple of 64, are the 8-bit samples of a mono WAV file
written by the wave module and stored in a binary column. Reading such files back yields samples, padded with silence
until the last of them lies in a frame; a windowed short-time Fourier transform gives magnitudes, the loudest bin of
each band and frame that is no quieter than its neighbours in time is a peak, and each peak is paired with the next
peaks. A fingerprint is one long: frame << 32 | first bin << 16 | second bin << 4 | frame distance, so arrays are ordered
by time. They are stored as a list column beside doc_id; `op7_wav_fingerprints` derives its digest from the stored ones.

Defined results: a null text counts as empty and becomes 64 zero samples with no fingerprint. Equal texts, repeated rows
too, give equal files and fingerprints; of equally loud bins the lowest is the peak. Texts are taken whole: a task holds
one batch of about four megabytes, or one longer text, and transforms 4,096 frames at once. An empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import kept, read_table, scratch, stored
from .arrow import chunks

BLOCK, RATE = 64, 8000
FRAME, HOP = 256, 128
#: First and last bin of each band.
BANDS = ((2, 12), (12, 32), (32, 64), (64, 129))
FAN_OUT, REACH = 3, 15
FRAMES_AT_ONCE = 4096

MEDIA_SCHEMA = "doc_id long, n_bytes long, media binary"
FINGERPRINT_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, fingerprint array<long>"


def to_wav(raw: bytes) -> bytes:
    payload = raw + bytes(-len(raw) % BLOCK or (0 if raw else BLOCK))
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frame, bin) of spectral peaks, by frame and then bin."""
    short = FRAME - len(samples) if len(samples) < FRAME else (FRAME - len(samples)) % HOP
    samples = np.concatenate([samples, np.full(short, 128, dtype=np.uint8)])
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    window = np.hanning(FRAME).astype(np.float32)
    loud, where = [], []
    for i in range(0, len(frames), FRAMES_AT_ONCE):
        spectrum = np.abs(np.fft.rfft((frames[i : i + FRAMES_AT_ONCE].astype(np.float32) - 128) * window, axis=1))
        best = [a + spectrum[:, a:b].argmax(axis=1) for a, b in BANDS]
        where.append(np.stack(best, axis=1))
        loud.append(np.stack([spectrum[np.arange(len(spectrum)), x] for x in best], axis=1))
    level, bins = np.concatenate(loud), np.concatenate(where)
    level = np.round(level, 3)
    edge = np.pad(level, ((1, 1), (0, 0)))
    at, band = np.nonzero((level > 1) & (level >= edge[:-2]) & (level >= edge[2:]))
    return at, bins[at, band]


def fingerprint(samples: np.ndarray) -> np.ndarray:
    at, bins = peaks(samples)
    found = []
    for k in range(1, FAN_OUT + 1):
        distance = at[k:] - at[:-k] if len(at) > k else at[:0]
        near = (distance >= 1) & (distance <= REACH)
        found.append((at[: len(distance)][near] << 32) | (bins[: len(distance)][near] << 16) | (bins[k:][near] << 4) | distance[near])
    return np.sort(np.concatenate(found)).astype(np.int64)


def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        raw = [x or b"" for x in batch.column("text").cast(pa.large_binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), pa.array([to_wav(x) for x in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])


def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "media"):
        media = batch.column("media").to_pylist()
        payload = [from_wav(x) for x in media]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("n_bytes"),
                pa.array([len(x) for x in payload], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in payload], pa.string()),
                pa.array([zlib.crc32(x[-BLOCK:]) for x in payload], pa.int64()),
                pa.array([len(x) for x in media], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in media], pa.string()),
                pa.array([fingerprint(np.frombuffer(x, dtype=np.uint8)) for x in payload], pa.list_(pa.int64())),
            ],
            names=[c.split()[0] for c in FINGERPRINT_SCHEMA.split(", ")],
        )


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id and text -> doc_id, n_bytes and a WAV file as binary column `media`."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(encode, MEDIA_SCHEMA)


def fingerprints(media: DataFrame) -> DataFrame:
    """A media table -> sizes, digests and the time-coded fingerprint array of each file."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(decode, FINGERPRINT_SCHEMA)


def op7_wav_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark):
        media = stored(to_media(read_table(spark, sf_dir, "documents")), "media")
        found = kept(fingerprints(media), "fingerprints")
    feature = F.concat_ws(":", F.size("fingerprint").cast("string"), F.sha2(F.concat_ws(",", F.col("fingerprint").cast("array<string>")), 256))
    return found.withColumn("feature", feature).drop("fingerprint")
