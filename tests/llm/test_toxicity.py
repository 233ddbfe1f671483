import math
import re
import zlib

import numpy as np
import pyarrow as pa

from lexiforge.llm.toxicity import EDGES, features, fit, op5_multiple_instance, scorer, train
from tests.conftest import SMALL

from .data import edge_docs, empty_docs


def test_training_finds_the_sentence_and_words():
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        sentences = [[f"w{x}" for x in rng.integers(0, 80, 8)] for _ in range(int(rng.integers(2, 9)))]
        if i % 4 == 0:
            sentences[int(rng.integers(0, len(sentences)))].append("awful")
        rows.append((int(i % 4 == 0), sentences))
    model = train(rows, {0: 1.0, 1: 1.0})
    assert max(model.weights, key=model.weights.get) == "awful"
    text = "W1 w2 w3 is here. What an AWFUL, w4 thing! w5 w6."
    whole, p, *_ = model.score(pa.array([text, "w1 w2. w3", None, ""]))
    assert p[1] == max(p) and np.isclose(whole[0], 1 - np.prod(1 - p[:3]))
    assert whole[0] > 0.3 > whole[1] and list(whole[2:]) == [0, 0]


def plain_score(model, text):
    """Noisy-or over sentences of distinct words and their prefixes, in loops; spans of offending sentences."""
    none, spans = 1.0, []
    for m in re.finditer(r"[^.!?\n]+[.!?\n]*|[.!?\n]+", text or ""):
        words = list(re.finditer(r"[^\x20\x09-\x0D]+", m[0]))
        if not words:
            continue
        distinct = {w[0].rstrip() for w in words}
        total = sum(model.weights.get(f, 0.0) for w in distinct for f in features(w.lower().strip(EDGES)))
        p = 1 / (1 + math.exp(-(total + model.intercept)))
        none *= 1 - p
        if p >= 0.5:
            spans.append((m.start() + words[0].start(), m.start() + words[-1].end()))
    return 1 - none, spans


def test_query_equals_plain_noisy_or(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    plain_texts = {i: t for i, t in texts.items() if not re.search(r"[^ \n][.!?][^ \n.!?]", t or "")}  # words that sentence ends do not cut
    assert len(plain_texts) > 300
    got = {r.doc_id: r for r in op5_multiple_instance(spark, folder).collect()}
    flagged = 0
    for i, text in plain_texts.items():
        score, spans = plain_score(model, text)
        assert abs(got[i].score - score) < 1e-9 and got[i].predicted == int(score >= 0.3)
        assert got[i].offending == ",".join(f"{a}:{b}" for a, b in spans)
        flagged += len(spans) > 0
    assert flagged > 0


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = [(labels[r.doc_id], r.predicted, r.score) for r in op5_multiple_instance(spark, folder).filter("held_out").collect() if r.doc_id in labels]
    toxic, clean = [p for y, p, _ in got if y == 1], [p for y, p, _ in got if y == 0]
    assert np.mean(toxic) > 0.7 and np.mean(clean) < 0.02
    assert all(0 <= s <= 1 for *_, s in got)


def test_held_out_rows_teach_nothing(spark):
    rows = [(i, "fine words here. bad thing" if i % 2 else "fine words here.") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2], "doc_id long, toxic int")
    assert fit(docs, labels).weights == {}


def test_spans_and_edges(spark):
    docs = edge_docs(spark).unionByName(spark.createDataFrame([(20, "Ünï one. Bad scum here! Fine.", "en", "a", 5, "x", "y")], edge_docs(spark).schema))
    labels = spark.createDataFrame([(1, 0), (20, 1), (None, 1), (6, None)], "doc_id long, toxic int")
    model = fit(docs, labels)
    model.weights, model.intercept = {"scum": 20.0}, -6.0
    made = docs.withColumn("found", scorer(spark, model)("text"))
    rows = {r.doc_id: r for r in made.collect()}
    (span,) = rows[20].found.sentences
    assert rows[20].text[span.start : span.end] == "Bad scum here!"
    assert rows[3].found.score == 0 and rows[2].found.score == 0
    empty = empty_docs(spark)
    assert empty.withColumn("found", scorer(spark, fit(empty, labels))("text")).count() == 0
    assert SMALL
