"""Joins that stay balanced when one key holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that one task may get, keys split at most, parts of a key at most.
SPLIT_ROWS, HOT_KEYS, MOST_PARTS = 512, 2000, 4096


def join_hot(rows: DataFrame, facts: DataFrame, key: str, counts: DataFrame | None = None, split_rows: int | None = None, how: str = "inner") -> DataFrame:
    """rows joined with facts on `key`, of which facts holds each value once. The commonest keys of rows (HOT_KEYS of them
    at most, so their table is broadcast; any other key has less than a HOT_KEYS-th of all rows) are dealt out in parts
    by a hash of the row, and their facts are repeated for each part. counts(key, n) may be given. Rows whose key is null
    or not in facts are dropped, or with how='left' kept."""
    split_rows = split_rows or SPLIT_ROWS
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")) if counts is None else counts
    hot = counts.filter(F.col("n") > split_rows).orderBy(F.desc("n"), key).limit(HOT_KEYS)
    hot = F.broadcast(hot.select(key, F.least(F.ceil(F.col("n") / split_rows), F.lit(MOST_PARTS)).cast("int").alias("__parts")))
    deal = F.pmod(F.xxhash64(*rows.columns), F.coalesce("__parts", F.lit(1)).cast("long")).cast("int")
    dealt = rows.join(hot, key, "left").select(*rows.columns, deal.alias("__part"))
    copies = facts.join(hot, key, "left").select(*facts.columns, F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1)).alias("__part"))
    return dealt.join(copies, [key, "__part"], how).drop("__part")
