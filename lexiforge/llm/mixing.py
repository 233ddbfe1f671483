"""Mixing sources to target weights by Pfair scheduling, with DataFrame expressions only.

Documents of a source are ordered by a hash of their id and cut into blocks. The ideal flow serves each source in
proportion to its target weight until its blocks run out, the rest go on at their own weights; T(x), the sum over
sources of min(weight * x, blocks), is the flow's clock. Block j of a source is released at floor(T(j / weight)) and due
at ceil(T((j + 1) / weight)); earliest-deadline-first fills the slots, and no source is ever a whole block from the flow.
Weights are integers, so windows are exact: targets are taken as decimal fractions of up to 15 digits and never rounded
to a frame. T is concave, so it is the least of its lines; a run of blocks needs only the lines it touches.

Earliest-deadline-first is one long chain, but frames of slots run in parallel. Each frame is first run alone: some of
its blocks it places, some it leaves over. What a run of frames leaves over when blocks are waiting before it follows
from those two sets: waiting blocks may start at any of its slots, so they only drive out the latest deadlines. Runs of
frames are joined in rounds that double their length, after which each frame knows what waits for it and is run once
more. The result equals one run over all slots.

Ranks inside a source come from counts of hash ranges and a window over (source, range), never one window over a
source, so a source with a third of all rows is spread like any other.

Defined results: a null source counts as the source ''. A null doc_id is ordered by its text where there is one; rows
with equal doc_id by a hash of their text; repeated rows are placed each. At most `max_sources` sources (more raise
ValueError: the table of weights is held whole; the bound is a parameter). Targets must be positive; sources without a
target get the smallest one given. An empty table gives an empty result. Texts are only carried. Extra columns are kept
whatever their names; only columns named as an output column are replaced.
"""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction
from math import lcm

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import kept, read_table, scratch, stored
from .native import let

BLOCK_DOCS, MAX_SOURCES, RANGE_ROWS = 16, 1000, 2048
#: Slots of a frame and blocks generated at once.
FRAME_SLOTS, RUN_BLOCKS = 512, 4096
#: Without targets, a source's weight is the square root of its documents, in millionths.
ROOT_UNITS = 1_000_000
MOST_UNITS = 10**15
OUTPUT = ("mix_source", "mix_block", "mix_release", "mix_deadline", "mix_position", "mix_order")
JOBS = "array<struct<due:bigint,i:int,j:bigint,release:bigint>>"


def integer_weights(weights: list[float]) -> list[int]:
    """Whole numbers in exactly the proportion of these decimals; beyond 15 digits in all, the nearest ones."""
    if any(w <= 0 for w in weights):
        raise ValueError("weights must be positive")
    exact = [Fraction(Decimal(str(w))) for w in weights]
    unit = lcm(*(x.denominator for x in exact)) if exact else 1
    if max((x * unit for x in exact), default=0) > MOST_UNITS:
        return [max(1, round(x / max(exact) * MOST_UNITS)) for x in exact]
    return [int(x * unit) for x in exact]


def source_weights(docs: DataFrame, targets: dict[str, float] | None, max_sources: int) -> list[tuple[str, int, int]]:
    """(source, documents, weight) by source. Without targets, weights go by the square root of sizes."""
    counts = docs.groupBy("mix_source").agg(F.count(F.lit(1)).alias("n")).orderBy("mix_source").limit(max_sources + 1).collect()
    if len(counts) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    if targets:
        least = min(targets.values())
        weights = integer_weights([targets.get(r["mix_source"], least) for r in counts])
    else:
        weights = [int(r["n"] ** 0.5 * ROOT_UNITS) for r in counts]
    return [(r["mix_source"], r["n"], w) for r, w in zip(counts, weights, strict=True)]


def windows(spark: SparkSession, sources: list[tuple[int, int]]) -> DataFrame:
    """i, j, release, due of each block j of source i; sources are (weight, blocks)."""
    ends = sorted((Fraction(b, w), w, b) for w, b in sources)
    active, gone, lines = sum(w for w, _ in sources), 0, []
    start = Fraction(0)
    for end, w, b in ends:  # the flow's line until the next source runs out
        if end > start:
            lines.append((active, gone, start, end))
        active, gone, start = active - w, gone + b, end
    whole = lambda x: F.lit(str(x)).cast("decimal(38,0)")
    table = F.array(*[F.struct(whole(a).alias("a"), whole(g).alias("g"), whole(s.numerator).alias("sn"), whole(s.denominator).alias("sd"), whole(e.numerator).alias("en"), whole(e.denominator).alias("ed")) for a, g, s, e in lines])
    given = spark.createDataFrame([(i, w, b) for i, (w, b) in enumerate(sources)], "i int, w long, b long").withColumn("w", F.col("w").cast("decimal(19,0)"))
    runs = given.select("i", "w", "b", F.explode(F.expr(f"sequence(0L, b - 1, {RUN_BLOCKS}L)")).alias("first"))
    runs = runs.withColumn("last", F.expr(f"least(first + {RUN_BLOCKS - 1}L, b - 1)")).repartition("i", "first")
    low, high = F.col("first").cast("decimal(19,0)"), (F.col("last") + 1).cast("decimal(19,0)")
    touched = F.filter(table, lambda x: (x["sn"] * F.col("w") <= high * x["sd"]) & (x["en"] * F.col("w") >= low * x["ed"]))
    blocks = runs.withColumn("lines", touched).select("i", "w", "lines", F.explode(F.expr("sequence(first, last)")).alias("j"))
    clock = lambda k, more: F.expr(f"array_min(transform(lines, x -> (x.a * CAST({k} AS decimal(19,0)) + x.g * w + {more}) div w))")
    return blocks.select("i", "j", clock("j", "0").alias("release"), clock("j + 1", "w - 1").alias("due"))


def placed_blocks(jobs: Column, waiting: Column, first: Column, slots: Column, size: int) -> Column:
    """struct(pending, next, placed): earliest-deadline-first over the slots from `first`, given the blocks that wait.
    jobs are ordered by release, at most one of each source in a slot; an idle slot places null."""
    job = "struct<due:bigint,i:int,j:bigint,release:bigint>"
    start = F.struct(waiting.cast(JOBS).alias("pending"), F.lit(0).alias("next"), F.array().cast(JOBS).alias("placed"))

    def step(acc: Column, t: Column) -> Column:
        def choose(ready: Column) -> Column:
            keep = lambda p: F.filter(ready["pending"], lambda x: ~((x["i"] == p["i"]) & (x["j"] == p["j"])))
            return let(F.array_min(ready["pending"]).cast(job), lambda p: F.struct(F.coalesce(F.when(p.isNull(), ready["pending"]).otherwise(keep(p)), F.array().cast(JOBS)).alias("pending"), ready["next"].alias("next"), F.concat(acc["placed"], F.array(p)).cast(JOBS).alias("placed")))

        fresh = F.filter(F.slice(jobs, acc["next"] + 1, F.lit(size)), lambda x: x["release"] <= first + t)
        fresh = F.transform(fresh, lambda x: F.struct(x["due"].alias("due"), x["i"].alias("i"), x["j"].alias("j"), x["release"].alias("release")))
        return let(fresh, lambda new: let(F.struct(F.concat(acc["pending"], new).cast(JOBS).alias("pending"), (acc["next"] + F.size(new)).alias("next")), choose))

    return F.aggregate(F.sequence(F.lit(0).cast("long"), slots - 1), start, step)


def best_last(jobs: Column, n: Column | int) -> Column:
    """The n blocks with the latest deadlines."""
    return F.slice(F.reverse(F.array_sort(jobs)), F.lit(1), n if isinstance(n, Column) else F.lit(n))


def waiting_blocks(alone: DataFrame, frames: int, size: int) -> DataFrame:
    """f, waiting: what frames 0 to f - 1 leave over. alone: f, slots, n (blocks placed), late (those placed, latest
    deadlines first), over (those left). A run's joined result needs `size` late blocks for each round to come."""
    seg, step = alone, 1
    rounds = max(0, (frames - 1).bit_length())
    while step < frames:
        rounds -= 1
        left = seg.select((F.col("f") + step).alias("f"), F.col("slots").alias("l_slots"), F.col("n").alias("l_n"), F.col("late").alias("l_late"), F.col("over").alias("l_over"))
        both = seg.join(left, "f", "left")
        none = F.array().cast(JOBS)
        l_over = F.coalesce("l_over", none)
        out = F.greatest(F.lit(0).cast("long"), F.size(l_over) + F.col("n") - F.col("slots"))
        pool = F.concat(F.col("late"), l_over)
        both = both.withColumn("out", F.when(F.col("l_n").isNull(), F.lit(0).cast("long")).otherwise(out)).withColumn("pool", F.reverse(F.array_sort(pool)))
        rest = F.slice("pool", F.col("out").cast("int") + 1, F.greatest(F.size("pool"), F.lit(1)))
        seg = both.select(
            "f",
            (F.col("slots") + F.coalesce("l_slots", F.lit(0))).alias("slots"),
            (F.col("n") + F.coalesce("l_n", F.lit(0)) + F.size(l_over) - F.col("out")).alias("n"),
            best_last(F.concat(rest, F.coalesce("l_late", none)), size * (rounds + 1)).alias("late"),
            F.concat("over", F.slice("pool", F.lit(1), F.col("out").cast("int"))).alias("over"),
        )
        seg, step = stored(seg, "mix-frames"), step * 2
    return seg.select((F.col("f") + 1).alias("f"), F.col("over").alias("waiting"))


def schedule(spark: SparkSession, weights: list[tuple[str, int, int]], block_docs: int, frame_slots: int = FRAME_SLOTS) -> DataFrame:
    """mix_source, mix_block, mix_release, mix_deadline, mix_position of every block of every source."""
    blocks = [-(-n // block_docs) for _, n, _ in weights]
    size, whole = len(weights), sum(blocks)
    slots = max(frame_slots, 2 * size)
    frames = -(-whole // slots)
    jobs = windows(spark, [(w, b) for b, (_, _, w) in zip(blocks, weights, strict=True)]).groupBy(F.expr(f"release div {slots}").alias("f"))
    jobs = jobs.agg(F.array_sort(F.collect_list(F.struct("release", "due", "i", "j"))).alias("jobs"))
    table = spark.range(frames).select(F.col("id").alias("f")).join(jobs, "f", "left")
    table = table.select("f", F.coalesce("jobs", F.array().cast("array<struct<release:bigint,due:bigint,i:int,j:bigint>>")).alias("jobs"), F.expr(f"f * {slots}").alias("first"), F.expr(f"least({slots}, {whole} - f * {slots})").alias("slots"))
    table = stored(table, "mix-jobs")
    none = F.array().cast(JOBS)
    alone = table.withColumn("run", placed_blocks(F.col("jobs"), none, F.col("first"), F.col("slots"), size))
    done = F.filter("run.placed", lambda x: x.isNotNull())
    alone = stored(alone.select("f", "slots", F.size(done).cast("long").alias("n"), F.reverse(F.array_sort(done)).alias("late"), F.col("run.pending").alias("over")), "mix-frames")
    table = table.join(waiting_blocks(alone, frames, size), "f", "left").withColumn("run", placed_blocks(F.col("jobs"), F.coalesce("waiting", none), F.col("first"), F.col("slots"), size))
    names = F.array(*[F.lit(s) for s, _, _ in weights])
    return table.select("first", F.posexplode("run.placed").alias("slot", "p")).select(
        names[F.col("p.i")].alias("mix_source"),
        F.col("p.j").alias("mix_block"),
        F.col("p.release").alias("mix_release"),
        F.col("p.due").alias("mix_deadline"),
        (F.col("first") + F.col("slot")).alias("mix_position"),
    )


def mix_sources(docs: DataFrame, targets: dict[str, float] | None = None, block_docs: int = BLOCK_DOCS, max_sources: int = MAX_SOURCES, range_rows: int = RANGE_ROWS, frame_slots: int = FRAME_SLOTS) -> DataFrame:
    """docs with doc_id and source -> docs with their block, its window, its position, and mix_order, a total order."""
    spark = docs.sparkSession
    given = docs.select(*[c for c in docs.columns if c not in OUTPUT])
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    weights = source_weights(given.select(source.alias("mix_source")), targets, max_sources)
    if not weights:
        return given.select("*", source.alias("mix_source"), *[F.lit(0).cast("long").alias(c) for c in OUTPUT[1:]])
    digits = 1
    while max(n for _, n, _ in weights) > range_rows * 16**digits:
        digits += 1
    text = F.col("text").cast("string") if "text" in given.columns else F.lit("")
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), text, F.lit("")).cast("binary"))
    # the given row travels as one column, so no name inside it can clash
    keyed = given.select(F.struct("*").alias("row"), source.alias("mix_source"), key.alias("hash"), F.col("doc_id").alias("id"), F.xxhash64(text).alias("tie")).withColumn("range", F.substring("hash", 1, digits))

    ranges = keyed.groupBy("mix_source", "range").agg(F.count(F.lit(1)).alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("mix_source").orderBy("range")) - F.col("rows")
    ranges = ranges.withColumn("before", before).withColumn("first", F.expr(f"before div {block_docs}")).withColumn("last", F.expr(f"(before + rows - 1) div {block_docs}"))
    with scratch(spark):
        blocks = kept(schedule(spark, weights, block_docs, frame_slots), "mix-schedule")
    needed = ranges.select("mix_source", "range", "before", "first", F.explode(F.expr("sequence(first, last)")).alias("mix_block")).join(blocks, ["mix_source", "mix_block"])
    held = needed.groupBy("mix_source", "range").agg(F.first("before").alias("before"), F.first("first").alias("first"), F.sort_array(F.collect_list(F.struct("mix_block", "mix_release", "mix_deadline", "mix_position"))).alias("held"))

    at = F.row_number().over(Window.partitionBy("mix_source", "range").orderBy("hash", "id", "tie"))
    ranked = keyed.withColumn("at", at).join(held, ["mix_source", "range"]).withColumn("rank", F.expr("before + at - 1"))
    mine = ranked.withColumn("mine", F.expr(f"held[CAST(rank div {block_docs} - first AS int)]"))
    return mine.select(
        *[F.col("row").getField(c).alias(c) for c in given.columns],
        "mix_source",
        "mine.mix_block",
        "mine.mix_release",
        "mine.mix_deadline",
        "mine.mix_position",
        F.expr(f"mine.mix_position * {block_docs} + rank % {block_docs}").alias("mix_order"),
    )


def in_mix_order(mixed: DataFrame) -> DataFrame:
    """Rows in mix order across and inside partitions, without the mixing columns."""
    return mixed.repartitionByRange("mix_order").sortWithinPartitions("mix_order").drop(*OUTPUT)


def op6_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "source")
    return mix_sources(docs).drop("source")


#: The same windows from the flow's clock itself, and one earliest-deadline-first run over all slots.
OP6_SQL = f"""
WITH RECURSIVE keyed AS (
  SELECT doc_id, coalesce(source, '') AS mix_source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), sizes AS (
  SELECT mix_source, CAST(ceil(count(*) / {BLOCK_DOCS}.0) AS BIGINT) AS b, CAST(floor(sqrt(count(*)) * {ROOT_UNITS}) AS BIGINT) AS w FROM keyed GROUP BY 1
), lists AS (
  SELECT list(mix_source ORDER BY mix_source) AS names, list(b ORDER BY mix_source) AS b, list(w ORDER BY mix_source) AS w, count(*) AS size, CAST(sum(b) AS BIGINT) AS l FROM sizes
), clocks AS (
  SELECT names, b, w, l, list_transform(range(1, size + 1), lambda i: list_transform(range(0, b[i] + 1),
           lambda j: CAST(list_sum(list_transform(range(1, size + 1), lambda m: least(w[m]::HUGEINT * j, b[m]::HUGEINT * w[i]))) AS HUGEINT))) AS clock FROM lists
), slots AS (
  SELECT 0::BIGINT AS t, l, b, w, clock, list_transform(b, lambda x: 0::BIGINT) AS done, NULL::STRUCT(due HUGEINT, i BIGINT, j BIGINT, release HUGEINT) AS p FROM clocks
  UNION ALL
  SELECT t + 1, l, b, w, clock, list_transform(done, lambda x, i: CASE WHEN i = p.i THEN x + 1 ELSE x END), p FROM (
    SELECT t, l, b, w, clock, done, list_min(list_transform(list_filter(range(1, len(b) + 1), lambda i: done[i] < b[i] AND clock[i][done[i] + 1] // w[i] <= t),
      lambda i: {{'due': (clock[i][done[i] + 2] + w[i] - 1) // w[i], 'i': i, 'j': done[i], 'release': clock[i][done[i] + 1] // w[i]}})) AS p
    FROM slots WHERE t < l)
), blocks AS (
  SELECT names[p.i] AS mix_source, p.j AS mix_block, p.release AS mix_release, p.due AS mix_deadline, t - 1 AS mix_position FROM slots, lists WHERE t > 0
), ranked AS (
  SELECT doc_id, mix_source, row_number() OVER (PARTITION BY mix_source ORDER BY h, doc_id) - 1 AS r FROM keyed
)
SELECT doc_id, mix_source, CAST(mix_block AS BIGINT) AS mix_block, CAST(mix_release AS BIGINT) AS mix_release,
       CAST(mix_deadline AS BIGINT) AS mix_deadline, CAST(mix_position AS BIGINT) AS mix_position,
       CAST(mix_position * {BLOCK_DOCS} + r % {BLOCK_DOCS} AS BIGINT) AS mix_order
FROM ranked JOIN blocks USING (mix_source) WHERE mix_block = r // {BLOCK_DOCS}
"""
