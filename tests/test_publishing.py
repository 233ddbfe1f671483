"""Versioned publishing under failing writers and failing checks."""

import os

import pytest
from pyspark.sql import functions as F

from lexiforge.plans.table_queries import equivalent_readings, key_errors
from lexiforge.sources.publishing import current, publish, read_published


def rows(spark, *x):
    return spark.createDataFrame(list(x), "a long, b long")


def test_only_sound_stages_replace_the_last_good_version(spark, tmp_path):
    root, check = str(tmp_path), key_errors(["a", "b"])
    with pytest.raises(FileNotFoundError):
        read_published(spark, root)
    assert not publish(rows(spark, (1, None)), root, check) and current(spark, root) is None
    assert publish(rows(spark, (1, 1), (1, 2)), root, check)
    first = current(spark, root)
    assert not publish(rows(spark, (1, 1), (1, 1)), root, check) and current(spark, root) == first
    assert publish(rows(spark, (5, 5)), root, check) and current(spark, root) != first
    assert [tuple(r) for r in read_published(spark, root).collect()] == [(5, 5)]
    kinds = sorted(x.split("-")[0] for x in os.listdir(root) if not x.startswith("."))
    assert kinds == ["CURRENT", "failed", "failed", "version", "version"]
    assert spark.read.parquet(f"{root}/{first}").count() == 2  # readers of the old version can finish


def test_a_writer_that_dies_leaves_readers_where_they_were(spark, tmp_path):
    root, check = str(tmp_path), key_errors(["a", "b"])
    publish(rows(spark, (1, 1)), root, check)
    before = current(spark, root)
    dies = spark.range(0, 100, 1, 4).select(F.col("id").alias("a"), F.when(F.col("id") < 80, F.col("id")).otherwise(F.raise_error(F.lit("lost half-way")).cast("long")).alias("b"))
    with pytest.raises(Exception, match="lost half-way"):
        publish(dies, root, check)
    assert current(spark, root) == before and [tuple(r) for r in read_published(spark, root).collect()] == [(1, 1)]
    assert publish(rows(spark, (2, 2)), root, check) and read_published(spark, root).first().a == 2


def test_equivalent_readings(spark):
    said = {1: ["x", "x", "x"], 2: ["x", "y", "x"], 3: ["x", None, ""], 4: ["x", "x", None], 5: [None, None, None]}
    df = spark.createDataFrame([(k, r, t) for k, ts in said.items() for r, t in enumerate([*ts, "other"])], "key long, reading int, text string")
    got = {(r.key, r.readings): (r.n, r.complete, r.all_equal) for r in equivalent_readings(df, [0, 1, 2]).collect()}
    assert got == {(1, "0,1,2"): (3, True, True), (2, "0,2"): (2, True, False), (2, "1"): (1, True, False), (3, "0"): (1, False, None), (4, "0,1"): (2, False, True)}
