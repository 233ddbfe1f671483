"""Balanced joins, places without one window over all, exact quantiles and scratch tables."""

import os
import random
import statistics

import pytest
from pyspark.sql import functions as F

from lexiforge.operators.joins import join_hot
from lexiforge.operators.places import exact_quantiles
from lexiforge.plans.search_queries import offsets
from lexiforge.plans.table_queries import corpus
from lexiforge.sources import tables


def test_hot_keys_are_dealt_out_and_nothing_is_lost(spark):
    rows = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(3000)] + [(None, -1), (-7, -2)], "k long, v long")
    facts = spark.createDataFrame([(i, f"f{i}") for i in range(3000)], "k long, f string")
    made = join_hot(rows, facts, "k", split_rows=100)
    assert sorted(map(tuple, made.select("k", "v", "f").collect())) == sorted(map(tuple, rows.join(facts, "k").select("k", "v", "f").collect()))
    assert join_hot(rows.limit(0), facts, "k").count() == 0


def test_offsets_are_places(spark):
    keys = random.Random(3).sample(range(-5000, 100_000), 900) + [7, 7, 7]
    got = offsets(spark.createDataFrame([(k,) for k in keys], "k long"), "k").collect()
    assert [r.k for r in sorted(got, key=lambda r: r.offset)] == sorted(keys) and sorted(r.offset for r in got) == list(range(len(keys)))
    assert offsets(spark.createDataFrame([], "k long"), "k").count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_quantiles_are_exact(spark, n):
    rng = random.Random(n)
    rows = [(k, rng.choice([rng.gauss(0, 1), 5.0, 1e6])) for k in "ab" for _ in range(n)]
    got = exact_quantiles(spark.createDataFrame(rows, "k string, v double"), "k", "v", {"low": "floor((n + 1) / 2)", "high": "ceil((n + 1) / 2)", "p95": "ceil(0.95 * n)"})
    for r in got.collect():
        mine = sorted(v for k, v in rows if k == r.k)
        assert ((r.low + r.high) / 2, r.p95) == (statistics.median(mine), mine[-(-95 * n // 100) - 1])


def test_scratch_tables_go_and_kept_ones_stay(spark):
    with tables.scratch(spark):
        inner = tables.stored(spark.range(5), "inner")
        outer = tables.kept(inner.filter("id > 1"), "outer")
        path = inner.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(path) and outer.count() == 3


def test_the_fallback_is_read_where_the_primary_is_missing_or_empty(spark, tmp_path):
    fallback = spark.createDataFrame([(1, "en")], "doc_id long, lang string")
    assert corpus(spark, str(tmp_path / "none"), fallback).first().lang == "en"
    fallback.limit(0).write.parquet(str(tmp_path / "empty"))
    assert corpus(spark, str(tmp_path / "empty"), fallback).first().lang == "en"
    spark.createDataFrame([(2,)], "doc_id long").write.parquet(str(tmp_path / "some"))
    r = corpus(spark, str(tmp_path / "some"), fallback).first()
    assert (r.doc_id, r.lang, r.popularity, r.semantic_id) == (2, "", 0.0, 1)


def test_sources_of_the_library_are_shipped(spark):
    import __spark_entry__ as entry

    entry._ship(spark)
    assert any("lexiforge.zip" in x for x in spark.sparkContext._python_includes)
    assert spark.sql("SELECT 1").select(F.lit(1)).count() == 1
