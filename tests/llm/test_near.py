import collections
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexiforge.llm import near
from lexiforge.llm.near import deduplicate, layout, near_duplicates, op1_bagminhash, shingles, signatures
from lexiforge.operators import joins
from tests.conftest import SMALL

from .data import edge_docs, empty_docs


def bag(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = min(5, len(ws))
    return collections.Counter(tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)) if ws else collections.Counter()


def jaccard(a, b):
    both = sum((a & b).values())
    union = sum(a.values()) + sum(b.values()) - both
    return both / union if union else 1.0


def plain_classes(rows, similarity=0.8):
    bags = {}
    for i, t in rows:
        bags[i] = bag(t)
    ids, parent = sorted(bags), {i: i for i in bags}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    held = collections.defaultdict(set)
    for i in ids:
        for g in bags[i] or [()]:
            held[g].add(i)
    seen = set()
    for group in held.values():
        for a in group:
            for b in group:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    if jaccard(bags[a], bags[b]) >= similarity:
                        x, y = root(a), root(b)
                        parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    texts = []
    for _ in range(60):
        base = [f"w{x}" for x in rng.integers(0, 40, 12)] * int(rng.integers(1, 9))
        other = list(base)
        for at in rng.integers(0, len(base), len(base) // 8):
            other[at] = "edit"
        texts += [" ".join(base), " ".join(other + base[: int(rng.integers(0, 9))])]
    got = signatures(*shingles(pa.array(texts)), len(texts), 252)
    assert got.shape == (120, 252) and np.isfinite(got).all()
    error = [(got[i] == got[i + 1]).mean() - jaccard(bag(texts[i]), bag(texts[i + 1])) for i in range(0, 120, 2)]
    assert abs(np.mean(error)) < 0.015 and np.std(error) < 0.04


def test_classes_equal_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert {r.doc_id: r.class_id for r in op1_bagminhash(spark, SMALL).collect()} == plain_classes(rows)


def test_spread_group(spark):
    """A group without a centre: links run through many different texts."""
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(220):
        words = list(base)
        for at in rng.integers(0, 150, int(rng.integers(0, 12))):
            words[at] = f"e{rng.integers(0, 10**9)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(f"x{rng.integers(0, 10**9)}" for _ in range(60))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_duplicates(docs).collect()}
    assert got == plain_classes(rows)
    assert deduplicate(docs).count() == len(set(got.values()))


def test_layouts():
    assert layout(0.8) == (36, 7, 71) and layout(1.0).bands == 1 and layout(0.8, None).most_apart is None
    for s in (0.3, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95):
        plan = layout(s)
        assert plan.positions <= 256 and (1 - s**plan.rows) ** plan.bands <= 2.2e-4
    with pytest.raises(ValueError):
        layout(0.0)


@pytest.mark.parametrize("similarity", [0.6, 0.8, 0.9])
def test_recall_of_true_pairs_by_similarity(spark, similarity):
    rng = np.random.default_rng(int(similarity * 100))
    rows, pairs = [], []
    for i in range(120):
        words = [f"w{rng.integers(0, 10**9)}" for _ in range(160)]
        other = list(words)
        for at in rng.integers(0, 160, int(rng.integers(1, 22))):
            other[at] = f"e{rng.integers(0, 10**9)}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        pairs.append(jaccard(bag(rows[-2][1]), bag(rows[-1][1])))
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), similarity).collect()}
    caught = [got[2 * i] == got[2 * i + 1] for i in range(120)]
    true = [c for c, p in zip(caught, pairs, strict=True) if p >= similarity]
    close = [c for c, p in zip(caught, pairs, strict=True) if similarity <= p < similarity + 0.1]
    assert len(close) > 5 and np.mean(close) >= 0.9 and np.mean(true) >= 0.9
    assert not any(c for c, p in zip(caught, pairs, strict=True) if p < similarity)


def test_every_pair_verified_without_sketches(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_duplicates(docs, sigmas=None).collect()} == plain_classes(rows)


def test_an_id_shared_by_different_texts(spark):
    rng = np.random.default_rng(5)
    a, b = ([f"{x}{rng.integers(0, 10**9)}" for _ in range(100)] for x in "ab")
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*a, "more"])), (3, " ".join([*b, "more"])), (4, "another text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.class_id) for r in near_duplicates(docs).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4)}
    assert sorted(r.text for r in deduplicate(docs).collect()) == sorted([rows[0][1], rows[1][1], "another text"])


def test_large_buckets_in_parts(spark, monkeypatch):
    """Mixed buckets larger than a part, hot leaders: the classes stay those of brute force."""
    monkeypatch.setattr(near, "MEMBERS_AT_ONCE", 8)
    monkeypatch.setattr(joins, "SPLIT_ROWS", 4)
    rng = np.random.default_rng(7)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for at in rng.integers(0, 120, int(rng.integers(0, 14))):
            words[at] = f"e{rng.integers(0, 10**9)}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_classes(rows)


def test_edges(spark):
    docs = edge_docs(spark)
    got = {(r.doc_id, r.class_id) for r in near_duplicates(docs).collect()}
    assert {(i, c) for i, c in got if i in (2, 3)} == {(2, 2), (3, 2)}
    assert {(i, c) for i, c in got if i not in (2, 3, None)} == {(i, i) for i in (1, 4, 5, 6, 7, 8, 9)}
    kept = deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == 9
    assert near_duplicates(empty_docs(spark)).count() == 0 and deduplicate(empty_docs(spark)).count() == 0


def test_columns_with_clashing_names_survive(spark):
    names = ["row", "row_id", "raw", "__row_id", "text_key", "class"]
    made = deduplicate(edge_docs(spark).select("*", *[F.lit(c).alias(c) for c in names]))
    assert made.columns[-len(names) :] == names and made.count() == 9 and all(r[c] == c for r in made.collect() for c in names)


def test_negative_and_missing_ids(spark):
    """Given ids come back as they are; a class is named by the least id given in it, whatever rows without ids it has."""
    text = "one two three four five six seven eight nine ten"
    rows = [(-5, text), (-7, "other words entirely are here for this row now"), (None, text), (None, ""), (4, ""), (None, "alone without any id at all today")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.class_id) for r in got if r.doc_id is not None)) == [(-7, -7), (-5, -5), (4, 4)]
    nameless = sorted(r.class_id for r in got if r.doc_id is None)
    assert -5 in nameless and 4 in nameless and len(nameless) == 3
    kept = {(r.doc_id, r.text) for r in deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {rows[0], rows[1], rows[4], rows[5]}
