"""Quality rules by repetition coverage.

Rolling hashes of several word n-gram lengths are computed with numpy over whole batches; characters inside repeated
n-grams and repeated lines, as shares of all word characters, decide. The operator is a map over documents: no shuffle.

Defined results: a null or empty text has no words and fails the base rules. Repeated rows get equal values. A share just
at its limit passes. Texts are taken whole: a task holds a batch of about four megabytes, or one longer text. An empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from .arrow import WHITE, chunks, flat_bytes, mix64, word_codes, word_spans

#: Largest allowed share of characters inside n-grams that repeat an earlier one.
MAX_DUPLICATE_SHARE = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest allowed share of lines, and of characters in lines, that repeat an earlier line.
MAX_LINE_SHARE, MAX_LINE_CHARS_SHARE = 0.30, 0.20
#: Symbols counted.
SYMBOLS = "#*$%&|<>"
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, dup_line_chars long, dup_ngram_chars array<long>"


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions whose key occurs twice or more, those of them that are not the first with their key)."""
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    slot = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    at = np.flatnonzero(twice[slot] == keys)
    _, first = np.unique(slot[at], return_index=True)
    later = np.ones(len(at), dtype=bool)
    later[first] = False
    return at, at[later]


def covered(at: np.ndarray, n: int, size: int) -> np.ndarray:
    """Words inside any of the n-grams that start at `at`."""
    step = np.zeros(size + 1, dtype=np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + n, -1)
    return np.cumsum(step[:-1]) > 0


def line_repeats(raw: bytes) -> tuple[int, int, int]:
    """(lines with a word, those equal to an earlier line, characters of the latter)."""
    seen: set[bytes] = set()
    lines = twice = characters = 0
    for line in raw.split(b"\n"):
        if line.strip(b" \t\n\v\f\r"):
            lines += 1
            if line in seen:
                twice += 1
                characters += sum(len(w.decode("utf-8", "replace")) for w in line.split())
            seen.add(line)
    return lines, twice, characters


def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    symbol = np.zeros(256, dtype=bool)
    symbol[list(SYMBOLS.encode())] = True
    for batch in chunks(batches):
        offsets, data = flat_bytes(batch.column("text"))
        starts, ends, row = word_spans(offsets, data, WHITE)
        size, rows = len(starts), batch.num_rows
        first_byte = (data & 0xC0) != 0x80
        count = np.concatenate([[0], np.cumsum(first_byte, dtype=np.int64)])
        chars = count[ends] - count[starts]
        codes, _ = word_codes(data, starts, ends)
        value = mix64(codes)
        salt = mix64(row.astype(np.uint64) + np.uint64(1 << 40))
        rolling, repeat_words, shares = value.copy(), np.zeros(rows, dtype=np.int64), []
        for n in range(2, max(MAX_DUPLICATE_SHARE) + 1):
            if size < n:
                rolling = rolling[:0]
            else:
                rolling = rolling[: size - n + 1] * MULTIPLIER + value[n - 1 :]
            if n != 3 and n not in MAX_DUPLICATE_SHARE:
                continue
            at = np.flatnonzero(row[: len(rolling)] == row[n - 1 :]) if len(rolling) else np.zeros(0, dtype=np.int64)
            twice, later = repeated(rolling[at] ^ salt[at])
            if n == 3:
                repeat_words = np.bincount(row[covered(at[twice], n, size)], minlength=rows)
            if n in MAX_DUPLICATE_SHARE:
                hit = covered(at[later], n, size)
                shares.append(np.bincount(row[hit], weights=chars[hit], minlength=rows).astype(np.int64))
        raw = data.tobytes()
        lines = np.array([line_repeats(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], dtype=np.int64).reshape(rows, 3)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(np.bincount(row, minlength=rows)),
                pa.array(np.bincount(row, weights=chars, minlength=rows).astype(np.int64)),
                pa.array(per_row(symbol[data], offsets)),
                pa.array(lines[:, 1]),
                pa.array(repeat_words.astype(np.int64)),
                pa.array(lines[:, 0]),
                pa.array(lines[:, 2]),
                pa.array(np.stack(shares, axis=1).tolist(), pa.list_(pa.int64())),
            ],
            names=[c.split()[0] for c in SCHEMA.split(", ")],
        )


def quality(docs: DataFrame) -> DataFrame:
    """doc_id and text of any DataFrame -> base counts, coverage counts, base_failed and kept."""
    counts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(measure, SCHEMA)
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    over = F.lit(False)
    for i, share in enumerate(MAX_DUPLICATE_SHARE.values()):
        over = over | (F.col("dup_ngram_chars")[i] > share * F.col("word_chars"))
    over = over | (F.col("n_dup_lines") > MAX_LINE_SHARE * F.col("n_lines")) | (F.col("dup_line_chars") > MAX_LINE_CHARS_SHARE * F.col("word_chars"))
    return counts.withColumn("base_failed", base_failed).withColumn("kept", ~base_failed & ~over)


def op4_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read_table(spark, sf_dir, "documents"))
