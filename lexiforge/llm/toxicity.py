"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is logistic in its words; the document's score is their noisy-or,
one minus the chance that no sentence is toxic. Word weights and intercept are trained from document labels by the
gradient of the noisy-or likelihood, so blame falls on the sentences that carry it, and scoring can name them.

Training reads at most about `sample` labelled documents of each class (a documented bound; classes are reweighted to
their true sizes) and keeps all words that at least `MIN_DOCS` of them hold. Spark counts and numbers the words, so the
driver gets the number of each kept word in each sentence of the sample, four bytes each, not the texts. The sampled ids
and the kept words are broadcast: their number is bounded by the sample. Scoring is a map over all documents.

Defined results: a null or empty text has no sentence and scores 0. Labels other than 0 and 1 are not learned; a document
with both labels counts as one of each; without both classes every score is 0. A null doc_id hashes as empty text.
Repeated rows get equal scores. Texts are taken whole: a task holds a batch of about four megabytes, or one longer text.
An empty table gives an empty result. Other columns are kept and not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table, scratch, stored
from .arrow import WHITE, chunks, flat_bytes, word_codes, word_spans

SAMPLE, MIN_DOCS = 4000, 4
STEPS, RATE, SHRINK, TRUST, START = 150, 0.1, 1e-5, 30, -6.0
THRESHOLD, OFFENDING = 0.3, 0.5
#: The bytes that end a sentence.
SENTENCE_END = np.zeros(256, dtype=bool)
SENTENCE_END[list(b".!?\n")] = True
PREFIXES = (5, 6, 7)
EDGES = "\"'`.,;:!?()[]{}<>*#$%&|_-=+~/\\"


def features(word: str) -> list[str]:
    """A word and its longer prefixes, so inflected and compounded forms share what their stem has learned."""
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)] if word else []


def words_and_sentences(column: pa.Array):
    """(word codes, distinct words, sentence of each word, row of each sentence, byte start of each sentence, offsets)."""
    offsets, data = flat_bytes(column)
    starts, ends, row = word_spans(offsets, data, WHITE)
    codes, words = word_codes(data, starts, ends)
    passed = np.concatenate([[0], np.cumsum(SENTENCE_END[data], dtype=np.int64)])
    place = passed[starts]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    sentence = np.cumsum(new) - 1
    clean = [w.decode("utf-8", "replace").lower().strip(EDGES) for w in words.to_pylist()]
    return codes, clean, sentence, row[new], starts[new], ends, offsets, data


def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's words, sentence by sentence, as one list of lists."""
    for batch in chunks(batches):
        codes, clean, sentence, owner, *_ = words_and_sentences(batch.column("text"))
        table = np.array(clean, dtype=object)
        parts = np.split(table[codes] if len(codes) else np.zeros(0, dtype=object), np.flatnonzero(np.diff(sentence)) + 1) if len(codes) else []
        made: list[list[list[str]]] = [[] for _ in range(batch.num_rows)]
        for o, p in zip(owner, parts, strict=True):
            made[o].append(sorted({w for w in p if w}))
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("toxic"), pa.array(made, pa.list_(pa.list_(pa.string())))], names=["key", "toxic", "sentences"])


def feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """feature, n0, n1: documents of a batch with it, by label."""
    for batch in batches:
        found: dict[str, list[int]] = {}
        for y, sentences in zip(batch.column("toxic").to_pylist(), batch.column("sentences").to_pylist(), strict=True):
            for f in {f for s in sentences for w in s for f in features(w)}:
                found.setdefault(f, [0, 0])[y] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *(pa.array([n[y] for n in found.values()], pa.int64()) for y in (0, 1))], names=["feature", "n0", "n1"])


def numbered(sentences: list[list[str]], index: dict[str, int]) -> list[list[int]]:
    return [[index[f] for w in s for f in features(w) if f in index] for s in sentences]


@dataclass
class ToxicWords:
    weights: dict[str, float]
    intercept: float

    def sentences(self, column: pa.Array):
        """(score of each sentence, its row, byte start, byte end, offsets, data)."""
        codes, clean, sentence, owner, start, ends, offsets, data = words_and_sentences(column)
        get = self.weights.get
        value = np.array([sum(get(f, 0.0) for f in features(w)) for w in clean])
        # a word counts once in a sentence
        pair = np.unique(sentence * max(1, len(clean)) + codes) if len(codes) else np.zeros(0, np.int64)
        total = np.bincount(pair // max(1, len(clean)), weights=value[pair % max(1, len(clean))] if len(pair) else None, minlength=len(owner))
        last = np.searchsorted(sentence, np.arange(len(owner)), side="right") - 1
        return 1 / (1 + np.exp(-(total + self.intercept))), owner, start, ends[last] if len(last) else start, offsets, data

    def score(self, column: pa.Array):
        p, owner, *rest = self.sentences(column)
        none = np.bincount(owner, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(column))
        return -np.expm1(none), p, owner, *rest


def train(rows: list[tuple[int, list[list[str]]]], class_weight: dict[int, float]) -> ToxicWords:
    """Rows of (label, words sentence by sentence) -> weights."""
    found: dict[str, list[int]] = {}
    for y, sentences in rows:
        for w in {f for s in sentences for w in s for f in features(w)}:
            found.setdefault(w, [0, 0])[y] += 1
    kept = sorted(w for w, n in found.items() if sum(n) >= MIN_DOCS)
    index = {w: i for i, w in enumerate(kept)}
    return learn(kept, np.array([found[w] for w in kept]).reshape(-1, 2), [(y, numbered(s, index)) for y, s in rows], class_weight)


def learn(kept: list[str], counts: np.ndarray, rows: list[tuple[int, list[list[int]]]], class_weight: dict[int, float]) -> ToxicWords:
    """Noisy-or maximum likelihood with a shrunk weight for each word, by Adam over all rows of the bounded sample. counts
    has the documents of each label with each kept word; rows hold word numbers sentence by sentence."""
    labels = np.array([y for y, _ in rows], dtype=np.float64)
    if len(set(labels)) < 2 or not kept:
        return ToxicWords({}, -50.0)
    sizes = [float((labels == c).sum()) for c in (0, 1)]
    sentences = [s for _, doc in rows for s in doc]
    owner = np.repeat(np.arange(len(rows)), [len(doc) for _, doc in rows])
    of = np.repeat(np.arange(len(sentences)), [len(s) for s in sentences])
    feature = np.fromiter((f for s in sentences for f in s), dtype=np.int64, count=len(of))
    odds = np.log((counts[:, 1] + 0.5) / (sizes[1] + 1)) - np.log((counts[:, 0] + 0.5) / (sizes[0] + 1))
    # a weight is its trust times a free value that is shrunk: rare words need more evidence
    held = counts.sum(axis=1)
    trust = held / (held + TRUST)
    w, b = np.where(odds > 1, odds, 0.0), START
    weight = np.array([class_weight[int(y)] for y in labels])
    weight /= weight.mean()
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-(np.bincount(of, weights=(w * trust)[feature], minlength=len(owner)) + b)))
        whole = -np.expm1(np.bincount(owner, weights=np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(rows)))
        slope = weight[owner] * p * (labels[owner] / np.maximum(whole[owner], 1e-9) - 1) / len(rows)
        g = trust * np.bincount(feature, weights=slope[of], minlength=len(kept)) - SHRINK * w
        gb = slope.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        fix, fix2 = 1 - 0.9**step, 1 - 0.99**step
        w = w + RATE * (m / fix) / (np.sqrt(v / fix2) + 1e-4)
        b = b + RATE * (mb / fix) / (np.sqrt(vb / fix2) + 1e-4)
    return ToxicWords({x: float(y) for x, y in zip(kept, w * trust, strict=True) if abs(y) > 1e-3}, float(b))


def bucket() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicWords:
    """docs(doc_id, text) and labels(doc_id, toxic) -> weights, learned from rows whose bucket is not 2."""
    known = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").filter(bucket() != 2).select("doc_id", "toxic").distinct()
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return ToxicWords({}, -50.0)
    rate = F.when(F.col("toxic") == 1, min(1.0, sample / sizes[1])).otherwise(min(1.0, sample / sizes[0]))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1_000_000)) < rate * 1_000_000)
    with scratch(docs.sparkSession):
        text = F.col("text").cast("string")
        texts = docs.select("doc_id", text.alias("text"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("key")).join(F.broadcast(chosen), "doc_id").select("key", "toxic", "text")
        held = stored(texts.mapInArrow(bags, "key string, toxic int, sentences array<array<string>>"), "toxic-bags")
        counted = held.mapInArrow(feature_counts, "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        kept = counted.filter(F.col("n0") + F.col("n1") >= MIN_DOCS).orderBy("feature").toArrow()
        words = kept.column("feature").to_pylist()
        shared = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})

        def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = [numbered(s, shared.value) for s in batch.column("sentences").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("toxic"), pa.array(made, pa.list_(pa.list_(pa.int32())))], names=["key", "toxic", "sentences"])

        rows = held.mapInArrow(number, "key string, toxic int, sentences array<array<int>>").orderBy("key", "toxic").toArrow()
        counts = np.stack([kept.column(c).to_numpy() for c in ("n0", "n1")], axis=1).reshape(-1, 2)
        pairs = list(zip(rows.column("toxic").to_pylist(), rows.column("sentences").to_pylist(), strict=True))
        return learn(words, counts, pairs, {y: max(1.0, n / sample) for y, n in sizes.items()})


def scorer(spark: SparkSession, model: ToxicWords, offending: float = OFFENDING):
    """A column function: text -> struct(score, sentences): spans in code points of sentences at or over `offending`."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("score double, sentences array<struct<start:int,end:int,score:double>>")
    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
        for column in columns:
            scores, spans = [], []
            for part in chunks([pa.RecordBatch.from_arrays([column], names=["text"])]):
                whole, p, owner, start, end, offsets, data = shared.value.score(part.column("text"))
                count = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
                made: list[list[dict]] = [[] for _ in range(part.num_rows)]
                for i in np.flatnonzero(p >= offending):
                    base = count[offsets[owner[i]]]
                    made[owner[i]].append({"start": int(count[start[i]] - base), "end": int(count[end[i]] - base), "score": float(p[i])})
                scores.append(whole)
                spans += made
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(scores) if scores else np.zeros(0)), pa.array(spans, pa.list_(span))], names=["score", "sentences"])

    return lambda text: score(F.col(text).cast("string"))


def op5_multiple_instance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    score = scorer(spark, fit(docs, read_table(spark, sf_dir, "labels")))
    found = docs.select("doc_id", (bucket() == 2).alias("held_out"), score("text").alias("found"))
    spans = F.array_join(F.transform("found.sentences", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", "held_out", "found.score", (F.col("found.score") >= THRESHOLD).cast("int").alias("predicted"), F.size("found.sentences").cast("long").alias("n_offending"), spans.alias("offending"))
