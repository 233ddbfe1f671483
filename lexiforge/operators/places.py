"""Places, running sums and carried values along one global order, spread by sampled ranges.

Rows are range-partitioned by all columns of the order, so neither a common key nor an outlier gathers them in one task, and
stored with the task that holds them. What crosses tasks are one count, sum or value a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored
from .joins import join_hot

TASK, AT = "__task", "__at"


def ranged(rows: DataFrame, *order: Column | str) -> DataFrame:
    """rows in global order, with __task, the range they are in, and __at, their place in it from 0. Nulls come first."""
    moved = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)
    return stored(moved.select("*", F.spark_partition_id().alias(TASK), at.alias(AT)), "ranged")


def before_tasks(made: DataFrame, value: Column) -> DataFrame:
    """__task, __before: the sum of an aggregate over all tasks before; one row a task."""
    totals = made.groupBy(TASK).agg(value.alias("__total"))
    return totals.select(TASK, (F.sum("__total").over(Window.orderBy(TASK)) - F.col("__total")).alias("__before"))


def placed(rows: DataFrame, *order: Column | str) -> DataFrame:
    """rows with `place`, from 0 along the order."""
    made = ranged(rows, *order)
    joined = made.join(F.broadcast(before_tasks(made, F.count(F.lit(1)))), TASK)
    return joined.select(*rows.columns, (F.col("__before") + F.col(AT)).alias("place"))


def carried(rows: DataFrame, value: Column, *order: Column | str) -> DataFrame:
    """rows with `last`: the last value that is not null at or before each row in the order."""
    made = ranged(rows.withColumn("__value", value), *order)
    seen = F.last("__value", ignorenulls=True)
    inside = seen.over(Window.partitionBy(TASK).orderBy(AT).rowsBetween(Window.unboundedPreceding, 0))
    ends = made.groupBy(TASK).agg(F.max_by("__value", F.when(F.col("__value").isNotNull(), F.col(AT))).alias("__end"))
    ends = ends.select(TASK, F.last("__end", ignorenulls=True).over(Window.orderBy(TASK).rowsBetween(Window.unboundedPreceding, -1)).alias("__carried"))
    return made.withColumn("__inside", inside).join(F.broadcast(ends), TASK).select(*rows.columns, F.coalesce("__inside", "__carried").alias("last"))


def exact_quantiles(rows: DataFrame, key: str, value: str, ranks: dict[str, str]) -> DataFrame:
    """key and, for each name, the value at the rank that its expression of n (rows of the key) gives, from 1. Distinct
    values are counted first; their running count along (key, value) tells which of them holds a rank. Null keys are a key of
    their own, null values no values."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("__c"))
    made = ranged(counts, key, value)
    upto = F.sum("__c").over(Window.partitionBy(TASK).orderBy(AT)) + F.col("__before")
    made = stored(made.join(F.broadcast(before_tasks(made, F.sum("__c"))), TASK).select(F.struct(key).alias("__k"), key, value, "__c", upto.alias("__upto")), "running")
    facts = made.groupBy("__k").agg(F.min(F.col("__upto") - F.col("__c")).alias("__start"), F.sum("__c").alias("n"))
    asked = F.array(*[F.struct(F.lit(name).alias("name"), (F.expr(e).cast("long") + F.col("__start")).alias("rank")) for name, e in ranks.items()])
    facts = facts.select(F.xxhash64("__k").alias("__h"), asked.alias("__asked"))
    held = join_hot(made.withColumn("__h", F.xxhash64("__k")).select("__h", key, value, "__c", "__upto"), facts, "__h")
    hit = held.select(key, value, "__c", "__upto", F.explode("__asked").alias("x")).filter("x.rank > __upto - __c AND x.rank <= __upto")
    return hit.groupBy(key).agg(*[F.max(F.when(F.col("x.name") == name, F.col(value))).alias(name) for name in ranks])
