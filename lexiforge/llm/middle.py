"""Fill-in-middle over seekable compressed frames.

A text is stored as independent zstandard frames of about FRAME_BYTES each, cut after a line where there is one, with the
number of units (lines) and of code points that end up to and including each frame. Two cuts, taken from a hash of the
document's id, part it into prefix, middle and suffix: the cumulative counts name the frame of a cut, and only such frames
are decompressed to find its place. The transformed text is written as frames again: frames of the source are streamed in
order, one decompressed at a time, parts separated by marks. Digests and the restored text come from streaming the
output's frames, so apart from the text a row brings in, a task holds compressed frames and one open frame.

Forms: `psm` is <P>prefix<S>suffix<M>middle, `spm` is <S>suffix<P>prefix<M>middle, `plain` is the text as it is: where it
is empty, holds a mark itself, or is not chosen at the given rate.

Defined results: a null text counts as empty, a null doc_id hashes as an empty string. Repeated rows and ids get the same
cuts where their texts are equal. A text of one unit can still be cut before or after it, so parts may be empty; equal
cuts give an empty middle. Texts are taken whole: a task holds a batch of about four megabytes, or one longer text. An
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import kept, read_table, scratch, stored
from .arrow import chunks

#: The marks, and what stands before the id in the hash that decides cuts and form.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
HASH_PREFIX, RATE, SPM_RATE = "7:", 100, 50
FRAME_BYTES, LEVEL = 64 << 10, 3
FRAME_TYPE = pa.list_(pa.struct([("units", pa.int64()), ("chars", pa.int64()), ("data", pa.binary())]))
FRAMES = "array<struct<units:bigint,chars:bigint,data:binary>>"
TEXT_FRAMES = f"doc_id long, n long, chars long, marked boolean, frames {FRAMES}"
OUTPUT_FRAMES = f"doc_id long, n long, form string, prefix_chars long, middle_chars long, frames {FRAMES}"
DIGESTS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


class Frame(NamedTuple):
    """units, chars: those that end up to here; a unit without a newline ends with the text."""

    units: int
    chars: int
    data: bytes


def char_count(raw: bytes) -> int:
    return len(raw.decode("utf-8", "surrogatepass"))


class FrameWriter:
    """Takes bytes in order and makes frames of them."""

    def __init__(self, frame_bytes: int = FRAME_BYTES):
        self.pack = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True).compress
        self.size, self.held, self.units, self.chars, self.frames = frame_bytes, bytearray(), 0, 0, []

    def write(self, raw: bytes) -> None:
        at, size = 0, self.size
        while at < len(raw):
            taken = raw[at : at + 2 * size - len(self.held)]
            self.held += taken
            at += len(taken)
            while len(self.held) >= 2 * size:
                cut = self.held.rfind(b"\n", 0, size) + 1 or size
                while self.held[cut] & 0xC0 == 0x80:  # never inside a character
                    cut -= 1
                self.emit(cut)

    def emit(self, cut: int) -> None:
        piece = bytes(self.held[:cut])
        del self.held[:cut]
        self.units += piece.count(b"\n")
        self.chars += char_count(piece)
        self.frames.append(Frame(self.units, self.chars, self.pack(piece)))

    def close(self) -> list[Frame]:
        while self.held:
            whole = len(self.held) <= self.size
            cut = len(self.held) if whole else self.held.rfind(b"\n", 0, self.size) + 1 or self.size
            while not whole and self.held[cut] & 0xC0 == 0x80:
                cut -= 1
            open_end = whole and not self.held.endswith(b"\n")
            self.emit(cut)
            if open_end:
                self.units += 1
                self.frames[-1] = self.frames[-1]._replace(units=self.units)
        return self.frames


def to_frames(raw: bytes, frame_bytes: int = FRAME_BYTES) -> list[Frame]:
    writer = FrameWriter(frame_bytes)
    writer.write(raw)
    return writer.close()


class FrameReader:
    """Places and parts of a framed text. `opened` counts decompressed frames."""

    def __init__(self, frames: list[Frame]):
        self.frames, self.open, self.opened = frames, zstandard.ZstdDecompressor().decompress, 0
        self.units = [f.units for f in frames]

    def frame(self, i: int) -> bytes:
        self.opened += 1
        return self.open(self.frames[i].data)

    def place(self, unit: int) -> tuple[int, int, int]:
        """(frame, byte in it, code points before) just after so many units; only the cut frame is decompressed."""
        if unit == 0:
            return 0, 0, 0
        i = bisect_left(self.units, unit)
        before = self.units[i - 1] if i else 0
        raw, at = self.frame(i), 0
        for _ in range(unit - before):
            at = raw.find(b"\n", at) + 1 or len(raw)
        return i, at, (self.frames[i - 1].chars if i else 0) + char_count(raw[:at])

    def stream(self, start: tuple[int, ...], stop: tuple[int, ...] | None = None) -> Iterator[bytes]:
        """The bytes between two places, frame by frame in order."""
        last, end = (len(self.frames) - 1, None) if stop is None else stop[:2]
        for i in range(start[0], min(last, len(self.frames) - 1) + 1):
            at, to = start[1] if i == start[0] else 0, end if i == last else None
            if to is None or to > at:
                yield self.frame(i)[at:to]

    def find(self, mark: bytes) -> tuple[int, int]:
        """Where a mark that stands in the text just once begins, whether or not it lies across frames."""
        tail = b""
        for i in range(len(self.frames)):
            raw = self.frame(i)
            at = (tail + raw).find(mark)
            if at >= len(tail):
                return i, at - len(tail)
            if at >= 0:  # begins in an earlier frame
                back, i = len(tail) - at, i - 1
                while back > (size := len(self.frame(i))):
                    back, i = back - size, i - 1
                return i, size - back
            tail = (tail + raw)[-(len(mark) - 1) :]
        raise ValueError("mark not found")

    def forward(self, place: tuple[int, int], steps: int) -> tuple[int, int]:
        i, at = place
        while i < len(self.frames) - 1 and at + steps >= (size := len(self.frame(i))):
            steps -= size - at
            i, at = i + 1, 0
        return i, at + steps


def numbers(doc_id: int | None) -> list[int]:
    digest = hashlib.sha256(f"{HASH_PREFIX}{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def transformed(reader: FrameReader, doc_id: int | None, n: int, marked: bool, rate: int, spm_rate: int, frame_bytes: int = FRAME_BYTES) -> tuple[str, int | None, int | None, list[Frame]]:
    """(form, prefix and middle code points, output frames)."""
    h1, h2, h3, h4 = numbers(doc_id)
    if n == 0 or marked or h3 % 100 >= rate:
        return "plain", None, None, reader.frames
    form = "spm" if h4 % 100 < spm_rate else "psm"
    low, high = (reader.place(k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    parts = {PREFIX: (low[:0] + (0, 0), low), MIDDLE: (low, high), SUFFIX: (high, None)}
    writer = FrameWriter(frame_bytes)
    for mark in (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE):
        writer.write(mark)
        for piece in reader.stream(*parts[mark]):
            writer.write(piece)
    return form, low[2], high[2] - low[2], writer.close()


def restored(reader: FrameReader, form: str) -> Iterator[bytes]:
    """The text in order, from output and form alone."""
    if form == "plain":
        yield from reader.stream((0, 0))
        return
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    begin = {m: reader.find(m) for m in (first, second, MIDDLE)}
    end = {first: begin[second], second: begin[MIDDLE], MIDDLE: None}
    for mark in (PREFIX, MIDDLE, SUFFIX):
        yield from reader.stream(reader.forward(begin[mark], len(mark)), end[mark])


def digest(pieces: Iterator[bytes]) -> str:
    total = hashlib.sha256()
    for piece in pieces:
        total.update(piece)
    return total.hexdigest()


def frame_rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), FRAMES: FRAME_TYPE}
    fields = [f.split(" ", 1) for f in schema.split(", ")]
    columns = [[[f._asdict() for f in r[i]] for r in rows] if kind == FRAMES else [r[i] for r in rows] for i, (_, kind) in enumerate(fields)]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], names=[name for name, _ in fields])


def read_rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
        row["frames"] = [Frame(**f) for f in row["frames"]]
        yield row


def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        rows = []
        for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist(), strict=True):
            raw = raw or b""
            frames = to_frames(raw)
            rows.append((doc_id, frames[-1].units if frames else 0, frames[-1].chars if frames else 0, any(m in raw for m in (PREFIX, SUFFIX, MIDDLE)), frames))
        yield frame_rows(TEXT_FRAMES, rows)


def per_batch(schema: str, make: Callable[[dict], tuple]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A map over rows with frames that lets go of a row's frames in slices of about 4 MB of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for row in read_rows(batch):
                rows.append(make(row))
                held += sum(len(f.data) for f in row["frames"]) + 256
                if held > 4 << 20:
                    yield frame_rows(schema, rows)
                    rows, held = [], 0
            if rows:
                yield frame_rows(schema, rows)

    return run


def text_frames(docs: DataFrame) -> DataFrame:
    """doc_id and text -> the stored table of framed texts."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(encode, TEXT_FRAMES)


def fill_in_middle(framed: DataFrame, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """Framed texts -> n, form, code points of prefix and middle, and the transformed text as frames."""
    def make(row: dict) -> tuple:
        return (row["doc_id"], row["n"], *transformed(FrameReader(row["frames"]), row["doc_id"], row["n"], row["marked"], rate, spm_rate))

    return framed.mapInArrow(per_batch(OUTPUT_FRAMES, make), OUTPUT_FRAMES)


def digests(output: DataFrame) -> DataFrame:
    """Digests of the output and of the text restored from it."""
    def make(row: dict) -> tuple:
        reader = FrameReader(row["frames"])
        return (*[row[c] for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars")], digest(reader.stream((0, 0))), digest(restored(reader, row["form"])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield frame_rows(DIGESTS, [make(row) for row in read_rows(batch)])

    return output.mapInArrow(run, DIGESTS)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark):
        framed = stored(text_frames(read_table(spark, sf_dir, "documents")), "frames")
        return kept(digests(fill_in_middle(framed)), "middle")


#: Lines, cuts and both digests from the plain text, without frames.
OP12_SQL = r"""
WITH given AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), counted AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines,
         length(text) - length(replace(text, chr(10), '')) + CAST(text <> '' AND right(text, 1) <> chr(10) AS INT) AS n,
         [CAST('0x' || h[1:8] AS BIGINT), CAST('0x' || h[9:16] AS BIGINT), CAST('0x' || h[17:24] AS BIGINT), CAST('0x' || h[25:32] AS BIGINT)] AS h FROM given
), placed AS (
  SELECT *, CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 100 THEN 'plain'
                 WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
         least(h[1] % (n + 1), h[2] % (n + 1)) AS u, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS v FROM counted
), cut AS (
  SELECT *, CASE WHEN u = 0 THEN 0 WHEN u = n THEN length(text) ELSE length(array_to_string(lines[1:u], chr(10))) + 1 END AS a,
         CASE WHEN v = 0 THEN 0 WHEN v = n THEN length(text) ELSE length(array_to_string(lines[1:v], chr(10))) + 1 END AS b FROM placed
), parts AS (
  SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM cut
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM parts
"""
