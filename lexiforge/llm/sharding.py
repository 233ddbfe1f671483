"""Sharding by a two-pass external shuffle, with DataFrame expressions only.

First pass: records are scattered over buckets by a seeded hash of their id and text. Buckets are uniform and sized for
memory: `bucket_rows` records and `bucket_bytes` of text on average, whatever the table's size. Spark's exchange by runs
of neighbouring buckets is the scatter; its files are the external buckets. Second pass: each bucket's records, in the
order of their hash, are given places from a Fisher-Yates shuffle whose draws are seeded hashes of bucket and step, and
are written behind the buckets before them. The places of all records so form one random order of the table, the same on
every run and cluster. Shards are equal ranges of that order (law `rows`: their counts are at most one apart), written as
one folder each, rows by slot.

Places before a bucket are sums of bucket counts, inside groups of buckets and then over groups, so no window spans the
table. Records that repeat exactly would fall into one bucket: where any does so more than `MOST_COPIES` times, copies are
first numbered within each input task and scattered by number too.

Defined results: a null text counts as empty and stays null, a null doc_id hashes as an empty string. Repeated rows are
placed each; equal texts of different ids are scattered like any others, so no group of copies weighs on one bucket. Ties
(same id and text) go by a hash of the other columns. With fewer rows than shards the last shards are empty. A long text
is one record: it is moved, never cut, and a task holds one bucket's records at a time, spilling beyond memory. An empty
table gives an empty result. Extra columns are kept whatever their names; only ones named `shard` or `slot` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import kept, read_table, scratch, stored

SHARDS, SEED, LAW = 8, 13, "rows"
BUCKET_ROWS, BUCKET_BYTES, RUN_BYTES = 512, 32 << 20, 16 << 20
#: Exact repeats of one record that need no numbering; buckets whose counts are summed in one window.
MOST_COPIES, GROUP_BUCKETS = 64, 4096
OUTPUT = ("shard", "slot")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def number(digest: Column) -> Column:
    """The first 48 bits of a hex digest."""
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def fisher_yates(seed: int, bucket: Column, rows: Column) -> Column:
    """The places 0 to rows - 1 of a bucket, shuffled: from the last one down, each is swapped with a drawn one at or
    before it. `head` holds the places still to draw from, `tail` those drawn, last place first."""
    ints = "array<int>"

    def step(acc: Column, i: Column) -> Column:
        drawn = F.pmod(number(F.md5(F.concat_ws(":", F.lit(str(seed)), bucket.cast("string"), i.cast("string")))), i + 1).cast("int")
        last = F.get(acc["head"], i.cast("int"))
        rest = F.concat(F.slice(acc["head"], F.lit(1), drawn), F.array(last), F.slice(acc["head"], drawn + 2, F.greatest(i.cast("int") - drawn - 1, F.lit(0))))
        return F.struct(F.slice(rest, F.lit(1), i.cast("int")).alias("head"), F.concat(acc["tail"], F.array(F.get(acc["head"], drawn))).alias("tail"))

    start = F.struct(F.transform(F.sequence(F.lit(0), rows.cast("int") - 1), lambda x: x.cast("int")).alias("head"), F.array().cast(ints).alias("tail"))
    shuffled = F.aggregate(F.sequence(rows - 1, F.lit(1).cast("long"), F.lit(-1).cast("long")), start, step, lambda acc: F.concat(acc["head"], F.reverse(acc["tail"])))
    return F.when(rows > 1, shuffled).when(rows == 1, F.array(F.lit(0))).otherwise(F.array().cast(ints))


def bucket_table(spark: SparkSession, counts: DataFrame, buckets: int, in_run: int, seed: int) -> DataFrame:
    """run, held: for each bucket of a run the places before it and its shuffled places."""
    table = spark.range(buckets).select(F.col("id").alias("bucket")).join(counts, "bucket", "left").withColumn("rows", F.coalesce("rows", F.lit(0).cast("long")))
    table = table.withColumn("group", F.expr(f"bucket div {GROUP_BUCKETS}"))
    inside = F.sum("rows").over(Window.partitionBy("group").orderBy("bucket")) - F.col("rows")
    groups = table.groupBy("group").agg(F.sum("rows").alias("total"))
    groups = groups.select("group", (F.sum("total").over(Window.orderBy("group")) - F.col("total")).alias("ahead"))
    table = table.withColumn("inside", inside).join(groups, "group")
    one = F.struct("bucket", (F.col("ahead") + F.col("inside")).alias("before"), "rows")
    runs = table.select(F.expr(f"bucket div {in_run}").alias("run"), one.alias("one")).groupBy("run").agg(F.array_sort(F.collect_list("one")).alias("held"))
    # shuffled where the runs are, not where one window has counted thousands of buckets
    return runs.repartition("run").select("run", F.transform("held", lambda x: F.struct(x["before"].alias("before"), fisher_yates(seed, x["bucket"], x["rows"]).alias("places"))).alias("held"))


def shard_records(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES, most_copies: int = MOST_COPIES) -> DataFrame:
    """docs with doc_id and text -> the written shards: docs with shard and slot, in a folder for each shard."""
    spark = docs.sparkSession
    given = docs.select(*[c for c in docs.columns if c not in OUTPUT])
    identity = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text_of())
    copies = given.groupBy(F.xxhash64(identity).alias("record")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text_of())).alias("bytes"))
    facts = copies.agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max("n").alias("most")).first()
    if not facts["n"]:
        return given.select("*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    n, size = facts["n"], facts["bytes"]
    buckets = max(1, -(-n // bucket_rows), -(-size // bucket_bytes))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    in_run = max(1, min(buckets // (2 * tasks), RUN_BYTES * buckets // max(1, size)))

    others = [c for c, kind in given.dtypes if c not in ("doc_id", "text") and "map<" not in kind and "variant" not in kind]
    # the given row travels as one column, so no name inside it can clash
    keyed = given.select(F.struct("*").alias("row"), F.md5(identity.cast("binary")).alias("key"), F.xxhash64(F.lit(0), *others).alias("tie"))
    if facts["most"] > most_copies:
        nth = F.row_number().over(Window.partitionBy("key", "task").orderBy("tie"))
        keyed = keyed.withColumn("task", F.spark_partition_id()).withColumn("nth", nth).drop("task")
        keyed = keyed.withColumn("key", F.when(F.col("nth") == 1, F.col("key")).otherwise(F.md5(F.concat_ws(":", "key", F.col("nth").cast("string"))))).drop("nth")
    keyed = keyed.withColumn("bucket", F.pmod(number(F.col("key")), F.lit(buckets).cast("long")))

    with scratch(spark):
        counts = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"))
        table = stored(bucket_table(spark, counts, buckets, in_run, seed), "buckets")
        scattered = keyed.withColumn("run", F.expr(f"bucket div {in_run}")).repartition("run")
        ranked = scattered.withColumn("at", F.row_number().over(Window.partitionBy("run", "bucket").orderBy("key", "tie")) - 1)
        mine = F.get("held", (F.col("bucket") - F.col("run") * in_run).cast("int"))
        placed = ranked.join(table, "run").select("row", (mine["before"] + F.get(mine["places"], F.col("at"))).alias("place"))
        shard = F.expr(f"CAST(place * {shards} div {n} AS int)")
        placed = placed.select("row", shard.alias("shard"), "place").withColumn("slot", F.expr(f"place - (CAST(shard AS bigint) * {n} + {shards - 1}) div {shards}"))
        rows = placed.select(*[F.col("row").getField(c).alias(c) for c in given.columns], "shard", "slot")
        return kept(rows.sortWithinPartitions("shard", "slot"), "shards", by=("shard",))


def op13_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return shard_records(docs).select(
        "doc_id",
        (F.octet_length(text_of()) + 1).cast("long").alias("size"),
        F.crc32(text_of().cast("binary")).alias("text_crc32"),
        F.lit(LAW).alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


#: The same buckets; the shuffle swaps inside one list for each bucket, a step for each row of the largest.
OP13_SQL = f"""
WITH RECURSIVE given AS (
  SELECT doc_id, coalesce(text, '') AS text, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS key FROM documents
), facts AS (
  SELECT count(*) AS n, greatest(1, CAST(ceil(count(*) / {BUCKET_ROWS}.0) AS BIGINT), CAST(ceil(sum(strlen(text)) / {BUCKET_BYTES}.0) AS BIGINT)) AS b FROM given
), keyed AS (
  SELECT doc_id, text, key, CAST('0x' || key[1:12] AS BIGINT) % b AS bucket FROM given, facts
), sizes AS (
  SELECT bucket, count(*) AS m, CAST(sum(count(*)) OVER (ORDER BY bucket) AS BIGINT) - count(*) AS before FROM keyed GROUP BY bucket
), steps AS (
  SELECT bucket, m - 1 AS i, range(0, m) AS a FROM sizes
  UNION ALL
  SELECT bucket, i - 1, list_transform(a, lambda x, k: CASE WHEN k = i + 1 THEN a[j + 1] WHEN k = j + 1 THEN a[i + 1] ELSE x END)
  FROM (SELECT *, CAST('0x' || md5('{SEED}:' || bucket || ':' || i)[1:12] AS BIGINT) % (i + 1) AS j FROM steps WHERE i > 0)
), bits AS (
  SELECT range AS byte, range AS v, 0 AS k FROM range(256)
  UNION ALL
  SELECT byte, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8
), crc_table AS (
  SELECT list(v ORDER BY byte) AS t FROM bits WHERE k = 8
), placed AS (
  SELECT doc_id, text, before + a[row_number() OVER (PARTITION BY bucket ORDER BY key)] AS place
  FROM keyed JOIN sizes USING (bucket) JOIN (SELECT bucket, a FROM steps WHERE i <= 0) USING (bucket)
)
SELECT doc_id, CAST(strlen(text) + 1 AS BIGINT) AS size,
       xor(list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS text_crc32, '{LAW}' AS law, CAST(place * {SHARDS} // n AS INT) AS shard,
       CAST(place - ((place * {SHARDS} // n) * n + {SHARDS - 1}) // {SHARDS} AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard
FROM placed, facts, crc_table
"""
