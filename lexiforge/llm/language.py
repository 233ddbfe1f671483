"""Language identification by language-bitmask n-gram filters.

One bit-sliced Bloom filter holds, for every slot, a bitmask of languages; the AND of an n-gram's slots names all
languages that contain it. A text's per-language popcounts over all its n-grams are corrected for each language's
false-positive rate, and the largest share decides.

Fitting reads at most about `sample` labelled documents of each language (a documented bound, chosen by a hash of
doc_id) and counts n-grams with a shuffle; a language contains all n-grams that enough of its sampled documents hold and
that are not far commoner elsewhere. Spark sets the bits too, so what reaches the driver is one mask for each slot in
use: at most `SLOTS` of them, whatever the corpus and the number of n-grams.

Defined results: null text, or text without a letter, is `und` with score 0. A text with letters but no known n-gram
gets the commonest learned language with score 0. Languages with equal shares: the first by name. Null or empty lang is
never learned; a null doc_id hashes as empty text. Up to 64 languages, the bits of a mask. Repeated rows get equal
results and count as often as they occur. Texts are taken whole: a task holds one batch of about a million characters,
or one longer text. Without any labelled row every text is `und`; an empty table gives an empty result. Other columns
are kept and not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession, Window

from ..sources.tables import read_table
from .arrow import mix64

SIZES = (3, 4)
SLOTS, HASHES = 1 << 21, 3
SAMPLE = 2000
MIN_SHARE, MIN_RATIO = 0.01, 0.2
CHUNK_CHARS = 1 << 20
UNKNOWN = "und"
WEIGHTS = mix64(np.arange(1, max(SIZES) + 1, dtype=np.uint64)) | np.uint64(1)


@functools.cache
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)], dtype=bool)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each n-gram, its row, whether each row has a letter). Letters are lower-cased, all else is one space."""
    padded = [f" {t.lower()} " for t in texts]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    row = np.repeat(np.arange(len(padded)), [len(t) for t in padded])
    letter = letters()[points]
    keep = np.ones(len(points), dtype=bool)
    keep[1:] = letter[1:] | letter[:-1] | (row[1:] != row[:-1])
    value = np.where(letter, points, 32)[keep].astype(np.uint64)
    has_letter = np.bincount(row, weights=letter, minlength=len(texts)) > 0
    row = row[keep]
    found, rows = [], []
    for n in SIZES:
        if len(value) < n:
            continue
        total = np.zeros(len(value) - n + 1, dtype=np.uint64)
        for i in range(n):
            total += value[i : len(value) - n + 1 + i] * WEIGHTS[i]
        inside = row[: len(total)] == row[n - 1 :]
        found.append(mix64(total[inside] + np.uint64(n)))
        rows.append(row[: len(total)][inside])
    return (np.concatenate(found), np.concatenate(rows), has_letter) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64), has_letter)


def slots(hashes: np.ndarray) -> Iterator[np.ndarray]:
    for i in range(HASHES):
        yield ((hashes >> np.uint64(21 * i)) & np.uint64(SLOTS - 1)).astype(np.int64)


@dataclass
class LanguageFilters:
    """The bit-sliced filter, its languages in bit order, and each language's false-positive rate."""

    languages: list[str]
    table: np.ndarray
    false_positive: np.ndarray
    fallback: str

    @staticmethod
    def build(languages: list[str], table: np.ndarray, fallback: str) -> LanguageFilters:
        fill = np.array([((table >> np.uint64(b)) & np.uint64(1)).mean() for b in range(len(languages))])
        return LanguageFilters(languages, table, fill**HASHES, fallback)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, its part of all corrected shares, its corrected share of the n-grams)."""
        hashes, row, has_letter = grams(texts)
        mask = np.full(len(hashes), np.uint64(0xFFFFFFFFFFFFFFFF))
        for at in slots(hashes):
            mask &= self.table[at]
        total = np.maximum(np.bincount(row, minlength=len(texts)), 1)
        shares = np.zeros((len(texts), max(1, len(self.languages))))
        for b in range(len(self.languages)):
            hits = np.bincount(row, weights=((mask >> np.uint64(b)) & np.uint64(1)).astype(np.float64), minlength=len(texts)) / total
            shares[:, b] = np.clip((hits - self.false_positive[b]) / (1 - self.false_positive[b]), 0, 1)
        best, summed = shares.argmax(axis=1), shares.sum(axis=1)
        top = shares[np.arange(len(texts)), best] * has_letter
        said = [(self.languages[b] if t > 0 else self.fallback) if ok and self.languages else UNKNOWN for b, t, ok in zip(best, top, has_letter, strict=True)]
        return said, np.where(summed > 0, top / np.maximum(summed, 1e-12), 0.0), top


def document_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language, n-gram, documents with it), summed within each batch."""
    for batch in batches:
        held: dict[str, list[np.ndarray]] = {}
        for language, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            held.setdefault(language, []).append(np.unique(grams([text or ""])[0]))
        for language, parts in held.items():
            gram, count = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(gram)), pa.array(gram.view(np.int64)), pa.array(count.astype(np.int64))], names=["lang", "gram", "n"])


def masks(kept: DataFrame, languages: list[str]) -> DataFrame:
    """slot, mask: the languages whose n-grams use each slot."""
    bit = F.create_map(*[F.lit(x) for b, name in enumerate(languages) for x in (name, np.uint64(1 << b).view(np.int64).item())])
    used = F.array(*[F.shiftrightunsigned("gram", 21 * i).bitwiseAND(F.lit(SLOTS - 1)) for i in range(HASHES)])
    return kept.select(F.explode(used).alias("slot"), bit[F.col("lang")].cast("long").alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("mask"))


def fit(docs: DataFrame, sample: int = SAMPLE) -> LanguageFilters:
    """Labelled documents (doc_id, text, lang) -> filters."""
    docs = docs.filter("lang IS NOT NULL AND lang <> '' AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(65).collect()}
    if len(sizes) > 64:
        raise ValueError("more than 64 languages")
    table, languages = np.zeros(SLOTS, dtype=np.uint64), sorted(sizes)
    if not sizes:
        return LanguageFilters([], table, np.zeros(0), UNKNOWN)
    rate = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, sample / n))])
    chosen = docs.filter(F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("language")), F.lit(1_000_000)) < rate[F.col("lang")] * 1_000_000)
    counts = chosen.select("lang", "text").mapInArrow(document_grams, "lang string, gram long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    read = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, float(min(n, sample)))])
    share = counts.filter("n >= 2").select("lang", "gram", (F.col("n") / read[F.col("lang")]).alias("p")).filter(F.col("p") >= MIN_SHARE)
    kept = share.withColumn("most", F.max("p").over(Window.partitionBy("gram"))).filter(F.col("p") >= MIN_RATIO * F.col("most"))
    found = masks(kept, languages).toArrow()
    table[found.column("slot").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
    return LanguageFilters.build(languages, table, next(iter(sizes)))


PREDICTED = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("coverage", pa.float64())])


def predictor(spark: SparkSession, filters: LanguageFilters):
    """A column function: text -> struct(lang_pred, score, coverage). The filter is broadcast: its size is fixed."""
    shared = spark.sparkContext.broadcast(filters)

    @F.arrow_udf("lang_pred string, score double, coverage double")
    def predict(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for column in columns:
            texts = [t or "" for t in column.to_pylist()]
            said, score, coverage, at = [], [], [], 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and (stop == at or size + len(texts[stop]) <= CHUNK_CHARS):
                    size += len(texts[stop])
                    stop += 1
                a, b, c = model.predict(texts[at:stop])
                said += a
                score.append(b)
                coverage.append(c)
                at = stop
            joined = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0))
            yield pa.StructArray.from_arrays([pa.array(said, pa.string()), joined(score), joined(coverage)], names=["lang_pred", "score", "coverage"])

    return lambda text: predict(F.col(text).cast("string"))


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def op3_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    predict = predictor(spark, fit(docs.filter(~held_out())))
    found = docs.select("doc_id", held_out().alias("held_out"), predict("text").alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score", "found.coverage")
