"""Pairs that are made where their document is."""

import random

from pyspark.sql import functions as F

from lexiforge.functions import similarity as S
from lexiforge.functions import text as T
from lexiforge.operators.meeting import meeting, words_holding
from lexiforge.plans import lexical_queries as L
from tests.conftest import SMALL
from tests.test_growth import plan_of


def some(rng, n):
    return ["".join(rng.choices("abcd", k=rng.randint(1, 4))) for _ in range(n)]


def test_pairs_equal_a_join_on_words(spark):
    rng = random.Random(3)
    asked = [(i * 100, some(rng, rng.randint(0, 4)), f"q{i}") for i in range(40)] + [(7, None, "none")]
    docs = [(i, some(rng, rng.randint(0, 9)), i % 50, f"t{i}") for i in range(300)] + [(999, None, 0, "none")]
    a = spark.createDataFrame(asked, "query_id long, words array<string>, q string")
    b = spark.createDataFrame(docs, "doc_id long, words array<string>, chars int, t string")
    for inside in (False, True):
        meets = (lambda x, y: any(w in v for w in x for v in y)) if inside else (lambda x, y: not set(x).isdisjoint(y))
        got = sorted((r.query_id, r.q, r.doc_id, r.t) for r in meeting(a, b, inside).collect())
        assert got == sorted((i, q, j, t) for i, x, q in asked for j, y, _, t in docs if meets(x or (), y or ()))
    assert words_holding({"b c": 1, "bc": 2, "c": 4}, {"abc", "b", "c"}) == {"abc": 6, "c": 4}


def test_pairs_with_texts_are_not_shuffled(spark):
    """Only documents are dealt out; what is made of their pairs stays in the task, down to the result."""
    plan = L.c7_phrase_similarity(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "MapInArrow" in plan and "SortMergeJoin" not in plan


def test_only_numbers_of_script_pairs_are_kept(spark, monkeypatch):
    kept, plain = {}, L.stored
    monkeypatch.setattr(L, "stored", lambda df, name, *a, **b: kept.setdefault(name, plain(df, name, *a, **b)))
    L.g3_script_search(spark, SMALL)
    pairs = kept["script-partials"]
    assert {t for _, t in pairs.dtypes} <= {"bigint", "int", "double"}
    assert pairs.filter((F.col("lexical_base") == 0) & (F.col("partial") < L.LEAST_PARTIAL)).isEmpty()


def test_near_words_are_found_once_for_the_vocabulary(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choices("abcdéش", k=n))
    tokens = sorted({word(rng.randint(0, 12)) for _ in range(200)} | {"ab" * 33, "a" * 64})
    words = sorted({word(rng.randint(0, 14)) for _ in range(500)} | {"ab" * 33 + "b", "a" * 63} | set(tokens[::3]))
    frame = lambda c, values: spark.createDataFrame([(v,) for v in values], f"{c} string")
    for least, shortest in ((0.88, 0), (0.82, 5)):
        got = [(r.token, r.word) for r in S.near_vocabulary(frame("token", tokens), frame("word", words), least, shortest).collect()]
        assert len(got) == len(set(got)) and set(got) == {(t, w) for t in tokens for w in words if t == w or (len(t) >= shortest and S.indel(t, w) >= least)}
    pairs = L.translit_pairs(L.asked_turns(spark, SMALL), L.turns(spark, SMALL))
    both = pairs.select(L.near_flags(pairs, "asked", "held", 0.88).alias("a"), S.near_tokens("asked", "held", F.lit(0.88), F.lit(0)).alias("b"))
    assert pairs.count() > 0 and both.filter("a <> b").isEmpty()


def test_phrases_side_by_side_have_their_own_subsequences():
    rng = random.Random(6)
    text = lambda n: "".join(rng.choices("abc ", k=rng.randint(0, n)))
    pairs = [(a, b) for a in [text(40) for _ in range(30)] for b in [text(90) for _ in range(10)]] + [("", ""), ("x", "")]
    assert S.sorted_ratios(pairs) == [S.indel(a, b) for a, b in pairs]
    for floor in (-1.0, 0.6, 0.84):
        assert [(p, max(w, floor)) for p, w in S.all_weighted(pairs, None, floor)] == [(p, max(w, floor)) for p, w in S.all_weighted(pairs)]


def test_a_text_without_spaces_is_made_once_for_its_grams(spark):
    """Not once for each of its letters."""
    frame = spark.createDataFrame([("ab cd e",), ("",), ("a",), (None,)], "t string")
    made = frame.select(T.char_ngrams(F.col("t")).alias("g"))
    assert [r.g for r in made.collect()] == [["abc", "bcd", "cde"], [], ["a"], []]
    assert plan_of(made).count("replace(") == 1


def test_plain_bm25_keeps_no_row_for_a_word_of_a_document(spark, monkeypatch):
    """Documents are scored where they are: no counts or postings are written and shuffled."""
    from lexiforge.plans import retrieval_queries as R

    kept, plain = [], R.stored
    monkeypatch.setattr(R, "stored", lambda df, name, *a, **b: kept.append(name) or plain(df, name, *a, **b))
    R.bm25(spark, SMALL)
    assert kept == ["asked", "fields", "frequencies"]
