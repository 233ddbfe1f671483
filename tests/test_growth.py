"""What keeps a query's cost in proportion to its input."""

import contextlib
import io
import re

from pyspark.sql import functions as F

from lexiforge.functions import text as T
from lexiforge.operators.vectors import centre_rows
from lexiforge.plans.lexical_queries import spread
from lexiforge.plans.retrieval_queries import bm25_token_score, fused
from lexiforge.plans.search_queries import c15_hint_boost, g3_script_exact, hint_boost, planted
from lexiforge.plans.text_queries import fingerprint
from tests.conftest import SMALL


def plan_of(df):
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        df.explain(True)
    return said.getvalue().split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]


def test_a_fingerprint_takes_its_codes_and_its_length_once(spark):
    plan = plan_of(fingerprint(spark, SMALL)).lower()
    assert plan.count("sqrt(") == 1 and plan.count("ascii(") == 1


def test_costly_pairs_stay_spread(spark):
    """Few bytes of pairs are not put into one task."""
    pairs = spark.range(50).select(F.col("id").alias("query_id"), F.col("id").alias("doc_id"))
    assert spread(pairs, "query_id", "doc_id").rdd.getNumPartitions() >= 4
    assert pairs.repartition("query_id", "doc_id").rdd.getNumPartitions() == 1


def test_few_rows_are_sent_to_the_driver_for_centres(spark):
    """The same centres as of all rows, out of a few times as many, however many tasks hold them."""
    rows = spark.range(0, 20000, 1, 40).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("double")).alias("v"))
    found = centre_rows(rows, 20000, 100)
    plain = rows.select("v", F.xxhash64("vec_id", F.lit("centre")).alias("h")).orderBy("h").limit(100)
    assert found.collect() == plain.collect()
    limit = -(1 << 63) + ((1 << 64) * 4 * 100) // 20000
    assert rows.filter(F.xxhash64("vec_id", F.lit("centre")) < limit).count() < 600 and str(limit) in plan_of(found)


def test_tokens_are_runs_without_stop_words(spark):
    """One pass takes the words out of a text, and stop words are looked up, not walked through for each word."""
    texts = ["The river's edge, don't; x1abc2de ÀB abc-def 'tis", "", None, "ÉTÉ the and of \n\tQuran says mercy'"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    made = frame.select(T.content_tokens(F.col("t"), True).alias("w"))

    def plain(t):
        found = re.findall("[a-z']+", re.sub("[^a-z0-9']+", " ", t.lower()))
        return [w for w in found if len(w) > 2 and w not in {*T.STOP_WORDS, *T.QUERY_WORDS}]

    assert [r.w for r in made.collect()] == [None if t is None else plain(t) for t in texts]
    assert "array_contains" not in plan_of(made) and "regexp_replace" not in plan_of(made)


def test_letters_take_one_table(spark):
    """Forms, marks, folded letters and punctuation go by one table instead of by three and two patterns."""
    frame = spark.createDataFrame([("ﷲ ﻻ اَلْكِتٰبُ، ءآأ!!  ـــ سسسس x é 😀 ۖ ﻼﻼﻼ ۔۔ ",), (None,), ("",)], "t string")
    made = frame.select(T.normalize_arabic(F.col("t")).alias("n"))
    assert [r.n for r in made.collect()] == ["الله لا الكتب اا سس لالالا", None, ""]
    assert plan_of(made).count("regexp_replace(") == 2


def test_hints_are_looked_up_before_texts_meet(spark):
    """The same hints as of every pair's texts, whose texts no join carries."""
    made = c15_hint_boost(spark, SMALL)
    assert "bit_count" in plan_of(made)
    docs, asked = (spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("documents", "benchmark"))
    q = asked.withColumnRenamed("item_id", "query_id").select("query_id", planted(F.col("text"), "query_id", 0).alias("q"))
    pairs = made.join(q, "query_id").join(docs.select("doc_id", planted(F.col("text"), "doc_id", 1).alias("t")), "doc_id")
    assert pairs.count() > 0 and pairs.filter(hint_boost(F.col("q"), F.col("t"))[0] != F.col("met")).count() == 0


def test_ends_of_signals_are_no_windows(spark):
    """Only the k best of a query meet in one task."""
    assert "windowspecdefinition" not in plan_of(fused(spark, SMALL))


def test_pairs_of_a_document_stay_in_its_task(spark):
    """Documents are dealt out by id, and counts by query and document take no shuffle of pairs."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        said = bm25_token_score(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "hashpartitioning(query_id" not in said.split("BroadcastExchange")[0] and "hashpartitioning(doc_id#" in said


def test_script_texts_are_compared_where_all_inner_anchors_stand(spark):
    plan = plan_of(g3_script_exact(spark, SMALL))
    assert "found" in plan and "needed" in plan
