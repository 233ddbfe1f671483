"""Pruned top k, vectors by cells and places along sampled ranges, against plain loops."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiforge.functions.similarity import hashed_deletions
from lexiforge.operators.places import TASK, carried, exact_quantiles, placed, ranged
from lexiforge.operators.topk import alternatives_top_k, pruned_top_k
from lexiforge.operators.vectors import cell_search
from lexiforge.plans.retrieval_queries import bm25_fields, coverage_search, read_vectors, variants, write_vectors


def plain_top(asked, posted, k):
    part = {}
    for doc, token, p in posted:
        part.setdefault(token, {})[doc] = p
    out = {}
    for query in {a[0] for a in asked}:
        best = {}
        for _, slot, token, w in (a for a in asked if a[0] == query):
            for doc, p in part.get(token, {}).items():
                best[doc, slot] = max(best.get((doc, slot), 0), w * p)
        score = Counter()
        for (doc, _), v in best.items():
            score[doc] += v
        out[query] = sorted(((round(v, 9), d) for d, v in score.items()), key=lambda x: (-x[0], x[1]))[:k]
    return out


def test_pruned_top_k_equals_the_plain_join(spark):
    rng = random.Random(5)
    df = [2000, 1500, 700, 60, 40, 25, 12, 8, 5, 3]  # the commonest token is in every document
    posted = [(doc, f"t{t}", rng.uniform(0.5, 1.0)) for t, n in enumerate(df) for doc in rng.sample(range(2000), n)]
    asked = []
    for q in range(12):
        for s, t in enumerate(rng.sample(range(10), rng.randint(1, 7))):
            asked.append((q, f"s{s}", f"t{t}", 8.0 / df[t] ** 0.5))
            if rng.random() < 0.4:  # a second token that can fill the slot
                other = rng.randrange(10)
                if all(a[:3] != (q, f"s{s}", f"t{other}") for a in asked):
                    asked.append((q, f"s{s}", f"t{other}", 4.0 / df[other] ** 0.5))
    asked.append((50, "s0", "nowhere", 1.0))
    moved = {}
    got = pruned_top_k(spark.createDataFrame(asked, "query_id long, slot string, token string, w double"), spark.createDataFrame(posted, "doc_id long, token string, part double"), 5, moved).collect()
    for query, best in plain_top(asked, posted, 5).items():
        mine = sorted(((round(r.score, 9), r.doc_id) for r in got if r.query_id == query), key=lambda x: (-x[0], x[1]))
        assert mine[:5] == best
    assert 0 < moved["pruned"] < moved["plain"] / 2


def test_coverage_search_touches_few_postings(spark):
    docs = [(i, "common shared words everywhere " + (f"rare{'abcdefgh'[i % 8]}{'xyzw'[i % 4]} " if i % 40 == 0 else "")) for i in range(1200)]
    queries = [(1, "common shared words rareax everywhere"), (2, "everywhere shared")]
    moved = {}
    got = coverage_search(spark.createDataFrame(queries, "query_id long, query string"), spark.createDataFrame(docs, "doc_id long, text string"), 3, moved).collect()
    assert [(r.query_id, r.rank, r.doc_id) for r in sorted(got, key=lambda r: (r.query_id, r.rank))] == [(1, 1, 0), (1, 2, 40), (1, 3, 80)] + [(2, i + 1, i) for i in range(3)]
    assert moved["pruned"] < moved["plain"]
    assert all(r.score == 1.0 for r in got if r.query_id == 2)


def test_variants_keep_to_the_edits_of_a_length(spark):
    asked = spark.createDataFrame([(w,) for w in ("ab", "abcd", "abcdef")], "token string")
    words = spark.createDataFrame([(w,) for w in ("ab", "abc", "ba", "abcd", "acbd", "abxx", "bcd", "abcdef", "badcef", "abcxyz", "abcde", "abcdexf", "abcd12")], "word string")
    got = {(r.token, r.word): round(r.factor, 6) for r in variants(asked, words).collect()}
    assert got == {("ab", "ab"): 1.0, ("abcd", "abcd"): 1.0, ("abcd", "acbd"): 0.75, ("abcd", "abc"): 0.666667, ("abcd", "bcd"): 0.666667, ("abcd", "abcde"): 0.75, ("abcdef", "abcdef"): 1.0, ("abcdef", "badcef"): 0.666667, ("abcdef", "abcde"): 0.8, ("abcdef", "abcdexf"): 0.833333, ("abcdef", "abcd"): 0.5, ("abcdef", "abcd12"): 0.666667}


def test_damaged_words_find_their_documents(spark):
    docs = spark.createDataFrame([(1, "wonderful mountains", "src1", "en"), (2, "quiet rivers", "src2", "fr"), (3, None, None, None)], "doc_id long, text string, source string, lang string")
    queries = spark.createDataFrame([(1, "wondreful montains"), (2, "src2"), (3, "zzz")], "query_id long, query string")
    assert {(r.query_id, r.doc_id) for r in bm25_fields(queries, docs, 5).collect()} >= {(1, 1), (2, 2)}


def test_endless_words_do_not_write_out_their_deletions(spark):
    """A word of 3,000 letters becomes 4.5 million strings by two deletions; no token is as long."""
    asked = spark.createDataFrame([("mountain",)], "token string")
    words = spark.createDataFrame([("mountian",), ("ab" * 1500,)], "word string")
    assert [(r.token, r.word) for r in variants(asked, words).collect()] == [("mountain", "mountian")]


def test_hashed_deletions_are_those_of_strings():
    for word in ("a", "ab", "abc", "mississippi", "naïve"):
        kept = {word} | {word[:i] + word[i + 1 :] for i in range(len(word)) if len(word) > 1}
        twice = kept | {w[:i] + w[i + 1 :] for w in kept for i in range(len(w)) if len(w) > 1 and len(word) > 2}
        for depth, strings in ((1, kept), (2, twice)):
            assert set(hashed_deletions([word], depth)[0]) == {hashed_deletions([w], 1)[0][0] for w in strings}


def test_alternatives_in_place_equal_the_plain_join(spark):
    rng = random.Random(9)
    tokens, words = [f"t{i}" for i in range(12)], [f"w{i}" for i in range(60)]
    near = [(t, w, round(rng.random() + 0.1, 3)) for t in tokens for w in rng.sample(words, 15)]
    asked = [(q, t) for q in range(7) for t in rng.sample(tokens, 4)]
    docs = [(i, [rng.choice([*words, "other"]) for _ in range(rng.randrange(0, 30))]) for i in range(700)]
    part = lambda tf, n, mean: tf / (tf + n / mean)
    posted = [(i, w, part(ws.count(w), len(ws), 15.0)) for i, ws in docs for w in set(ws)]
    expected = plain_top([(q, t, w, x) for q, t in asked for s, w, x in near if s == t], posted, 5)
    frames = [spark.createDataFrame(rows, schema).withColumn("field", F.lit("f")) for rows, schema in ((asked, "query_id long, token string"), (near, "token string, word string, w double"))]
    held = spark.createDataFrame(docs, "doc_id long, tokens array<string>").withColumn("field", F.lit("f")).withColumn("mean", F.lit(15.0)).repartition(3)
    rows = alternatives_top_k(*frames, held, 5, part, 1.0).collect()
    for q, best in expected.items():
        assert sorted(((round(r.score, 9), r.doc_id) for r in rows if r.query_id == q), key=lambda x: (-x[0], x[1]))[:5] == best
    assert len(rows) < len({(q, i) for q, _ in asked for i, _ in docs}) / 4


@pytest.mark.parametrize("metric", ["inner", "distance"])
def test_cells_give_the_exact_nearest(spark, metric):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 10, (12, 6))
    rows = [(i, (centres[i % 12] + rng.normal(0, 0.1, 6)).tolist()) for i in range(900)] + [(1000 + i, [1.0] * 6) for i in range(450)]  # a third are equal
    asked = [(i, v) for i, v in rows if i % 150 == 0]
    table = lambda x: spark.createDataFrame(x, "vec_id long, v array<double>")
    compared = {}
    got = {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in cell_search(table([*rows, (5000, None)]), table(asked), 4, metric, compared).collect()}
    for query, v in asked:
        a, b = np.array(v), np.array([x for _, x in rows])
        score = b @ a / np.linalg.norm(a) if metric == "inner" else 1 / (1 + np.linalg.norm(b - a, axis=1) / 2)
        best = sorted(zip(np.round(score, 6), (i for i, _ in rows), strict=True), key=lambda x: (-x[0], x[1]))[:4]
        assert [got[query, k + 1] for k in range(4)] == [(i, pytest.approx(s)) for s, i in best]
    assert compared["cells"] < (0.75 if metric == "inner" else 0.4) * compared["all"]
    assert cell_search(table([]), table(asked), 4, metric).count() == 0


def test_places_under_skew(spark):
    rows = [(None, i) for i in range(5)] + [(7, i) for i in range(1000)] + [(i, 0) for i in range(1000, 3000)] + [(10**15, 0)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(4)
    got = sorted(placed(df, "k", "v").collect(), key=lambda r: r.place)
    assert [r.place for r in got] == list(range(len(rows)))
    assert [(r.k, r.v) for r in got] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = Counter(r[TASK] for r in ranged(df, "k", "v").collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) == 4 and max(tasks.values()) < 0.4 * len(rows)


def test_quantiles_with_an_outlier_and_a_null_key(spark):
    rng = random.Random(1)
    rows = [("a", rng.gauss(0, 1)) for _ in range(700)] + [("a", 1e9), ("b", None), (None, 3.0), (None, 1.0), (None, 2.0)] + [("c", 5.0)] * 300
    got = {r.k: (r.p50, r.p99) for r in exact_quantiles(spark.createDataFrame(rows, "k string, v double"), "k", "v", {"p50": "ceil(0.5 * n)", "p99": "ceil(0.99 * n)"}).collect()}
    mine = sorted(v for k, v in rows if k == "a")
    assert got == {"a": (mine[350], mine[-(-99 * 701 // 100) - 1]), None: (2.0, 3.0), "c": (5.0, 5.0)}


def test_values_are_carried_over_ranges(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(100) if rng.random() < 0.01 else None) for i in range(2000)]
    got = {r.t: r["last"] for r in carried(spark.createDataFrame(rows, "t long, v long").repartition(5), F.col("v"), "t").collect()}
    last = None
    for t, v in rows:
        last = v if v is not None else last
        assert got[t] == last


def test_vector_files(spark, tmp_path):
    rows = spark.createDataFrame([(7, [1.0, 2.0]), (3, [3.0, 4.0]), (3, [0.0, 1.0])], "vec_id long, v array<double>")
    write_vectors(rows, str(tmp_path / "v"))
    assert [tuple(r) for r in read_vectors(spark, str(tmp_path / "v")).orderBy("place").collect()] == [(0, 3, [0.0, 1.0]), (1, 3, [3.0, 4.0]), (2, 7, [1.0, 2.0])]
    with pytest.raises(FileNotFoundError):
        read_vectors(spark, str(tmp_path / "none"))
    rows.limit(1).selectExpr("0L AS place", "v").write.mode("overwrite").parquet(str(tmp_path / "v/vectors"))
    with pytest.raises(ValueError):
        read_vectors(spark, str(tmp_path / "v"))


def test_distances_equal_the_full_comparison(spark):
    from lexiforge.functions.similarity import osa_free_distance
    from lexiforge.plans.retrieval_queries import with_distance

    rng = random.Random(8)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 7))) for _ in range(250)] + ["ca", "abc", "ab", "ba", "abcdef", "badcef", "bacdfe"]
    pairs = [(a, b) for a in set(words) for b in set(words) if a != b]
    df = spark.createDataFrame(pairs, "token string, word string")
    for limit in (1, 2):
        got = {(r.token, r.word): r.distance for r in with_distance(df, F.lit(limit)).collect()}
        assert got == {p: d for p in pairs if (d := osa_free_distance(*p, 2)) <= limit}
