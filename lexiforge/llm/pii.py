"""Personal data by bootstrapped contextual extraction, with DataFrame expressions only.

Base entities (email, ip, card, phone) are found by patterns and serve as seeds. Words with a digit or an at sign that
lie in no base span are candidate instances; those with the shape of a key (long, letters and digits mixed) are seeds of
lower confidence, but for one in eight, which contexts alone can find. Such seeds count for a pattern and become spans only
where a pattern holds them that is confident without them. A lexical pattern is what stands around an instance: the two words before it, or the word before and the word after. Spark builds the
pattern-instance graph and scores both sides in turn: a pattern's precision is the confident instances' share of
everything that stands in its slot anywhere in the corpus, and it counts once five different confident instances support
it, in a table of any size; an instance's confidence is the noisy-or of its patterns. Instances over the threshold join
the seeds for the next round; at the end they become spans of kind `context`, beside the base spans.

Positions come from pairing the pieces between matches with the matches. Patterns are possessive and anchored so that
their cost stays linear in the text; matches are put together in runs, so many of them in one text stay cheap.

Defined results: a null text counts as empty and has no span. Repeated rows are found alike; a row's spans are keyed by
row, not by doc_id. Spans that start together go by kind as listed, context last. Texts are taken whole. An empty table
gives an empty result. Extra columns are kept by `redact`, whatever their names, and not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import join_hot
from ..sources.tables import kept, read_table, scratch, stored
from .native import let

#: Base kinds in their order, their patterns (possessive forms of the plain ones) and a cheap guard each.
KINDS = ("email", "ip", "card", "phone")
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CONTEXT = "context"
WHITE = r"\x20\x09-\x0D"
CANDIDATE = rf"(?<![^{WHITE}])[^{WHITE}0-9@]*+[0-9@][^{WHITE}]*+"
OCTET = "^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
#: Shape of a key, of which an instance is a seed of this confidence.
KEY_SHAPE = "^(?=[^0-9]*+[0-9])(?=[^a-z]*+[a-z])[a-z0-9_+/=-]{20,}$"
KEY_CONFIDENCE = 0.9
#: One of so many words of a key's shape is no seed, so what contexts discover can be measured on them; a pattern that holds keys
#: alone then has a precision of about 0.9 x 7 / 8, which MIN_CONFIDENCE lies below.
HELD_OUT = 8
ROUNDS, MIN_SUPPORT, MIN_PRECISION, MIN_CONFIDENCE, MIN_LENGTH = 3, 5, 0.5, 0.7, 5
#: A pattern table of at most so many rows is broadcast to the scan that counts slots: 16 bytes of data a row and about 100
#: of the relation built from it, so some 25 MB.
BROADCAST_ROWS = 250_000
#: Slots are counted in one document of so many, then in more of them, at last in all.
PARTS = (64, 8, 1)
#: Matches of one text put together at once.
RUN = 256


def found(text: Column, pattern: str) -> Column:
    """array<struct<start, end, m>> of the non-overlapping matches of a pattern, in code points."""
    pairs = let(
        F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits")),
        lambda v: F.zip_with(F.slice(v["pieces"], 1, F.size(v["hits"])), v["hits"], lambda piece, m: F.struct(F.length(piece).alias("gap"), F.length(m).alias("size"), m.alias("m"))),
    )
    kind = "array<struct<start:int,end:int,m:string>>"

    def step(acc: Column, p: Column) -> Column:
        first = acc["at"] + p["gap"]
        one = F.struct(first.alias("start"), (first + p["size"]).alias("end"), p["m"].alias("m"))
        return F.struct((first + p["size"]).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def run(acc: Column, part: Column) -> Column:
        made = F.aggregate(part, F.struct(acc["at"].alias("at"), F.array().cast(kind).alias("out")), step)
        return let(made, lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    def whole(v: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / RUN).cast("int")), lambda c: F.slice(v, c * RUN + 1, F.lit(RUN)))
        return F.flatten(F.aggregate(runs, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out")), run)["out"])

    return let(pairs, whole)


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, "[.]"), lambda part: part.rlike(OCTET))
    if kind == "card":
        return F.length(digits(m)).between(12, 19) & F.call_function("luhn_check", digits(m))
    if kind == "phone":
        return F.length(digits(m)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct<start, rank, end, kind>> of base entities by start, then kind as listed."""
    guards = {"email": text.contains("@"), "ip": text.rlike("[0-9][.][0-9]"), "card": text.rlike("[0-9]"), "phone": text.contains("+")}
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")

    def spans(rank: int, kind: str) -> Column:
        good = F.filter(found(text, PATTERNS[kind]), lambda x: valid(kind, x["m"]))
        made = F.transform(good, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind")))
        return F.when(guards[kind], made).otherwise(empty)

    return F.array_sort(F.concat(*[spans(rank, kind) for rank, kind in enumerate(KINDS)]))


def word(text: Column) -> Column:
    """A word of a slot, bare and in small letters."""
    return F.lower(F.regexp_replace(text, r"^[^\p{L}\p{N}=:#]+|[^\p{L}\p{N}=:#]+$", ""))


def slot_keys(before2: Column, before1: Column, after: Column) -> Column:
    """Hashes of the two patterns a slot matches."""
    return F.array(F.xxhash64(F.lit("two before"), before2, before1), F.xxhash64(F.lit("around"), before1, after))


def text_words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{WHITE}]+"), lambda w: w != "")


def at(words: Column, i: Column) -> Column:
    return F.coalesce(word(F.get(words, i)), F.lit(""))


def candidate_words(text: Column) -> Column:
    """array<struct<start, end, instance, keys>> of words with a digit or an at sign; keys are their slot's patterns."""
    def keyed(words: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(words)), lambda i: F.coalesce(F.get(words, i).rlike("[0-9@]"), F.lit(False)))
        return F.transform(places, lambda i: slot_keys(at(words, i - 2), at(words, i - 1), at(words, i + 1)))

    made = F.zip_with(
        found(text, CANDIDATE),
        let(text_words(text), keyed),
        lambda x, k: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lower(F.regexp_replace(x["m"], r"^[^\p{L}\p{N}+]+|[^\p{L}\p{N}]+$", "")).alias("instance"), k.alias("keys")),
    )
    kind = "array<struct<start:int,end:int,instance:string,keys:array<bigint>>>"
    return F.when(text.rlike("[0-9@]"), made).otherwise(F.array().cast(kind))


def scan(docs: DataFrame, keep: list[str]) -> DataFrame:
    """One stored row for each document: id, row (the columns to keep), base spans and candidates (whether in a base span)."""
    made = docs.select(F.struct(*keep).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("whole"))
    made = made.select("row", F.monotonically_increasing_id().alias("id"), base_spans(F.col("whole")).alias("base"), candidate_words(F.col("whole")).alias("words"))

    def seed(x: Column) -> Column:
        covers = F.exists("base", lambda b: (b["start"] < x["end"]) & (b["end"] > x["start"]))
        starts = F.exists("base", lambda b: (b["start"] < x["end"]) & (b["start"] >= x["start"]))
        return x.withField("state", F.when(starts, 2).when(covers, 1).otherwise(0))

    return stored(made.withColumn("words", F.transform("words", seed)), "pii")


def slot_totals(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """patterns(key, most) -> key, total: how many words of the whole corpus stand in the slot of each pattern that can be
    precise. `most` bounds a pattern's confident instances, so one whose slot already holds too many words in a part of the
    corpus is out for certain; common slots are thus not counted to the end. The last count is over all documents."""
    for part in PARTS:
        counted = slot_counts(docs if part == 1 else docs.filter(F.pmod(F.xxhash64("text"), F.lit(part)) == 0), patterns.select("key"))
        totals = patterns.join(counted, "key", "left").withColumn("total", F.coalesce("total", F.lit(0)))
        totals = stored(totals.filter(F.col("total") * MIN_PRECISION <= F.col("most")), "totals")
        patterns = totals.select("key", "most")
    return totals.select("key", "total")


def slot_counts(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """key, total: how many words of these documents stand in each pattern's slot."""
    few = patterns.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    words = text_words(F.coalesce(F.col("text").cast("string"), F.lit("")))
    cleaned = docs.select(F.transform(words, word).alias("w"))
    near = lambda i: F.coalesce(F.get("w", i), F.lit(""))
    keys = F.flatten(F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda i: slot_keys(near(i - 2), near(i - 1), near(i + 1))))
    slots = cleaned.filter(F.size("w") > 0).select(F.explode(keys).alias("key"))
    if few:
        return slots.join(F.broadcast(patterns), "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("total"))
    # counted before the join, so a common slot is one row a task
    return slots.groupBy("key").agg(F.count(F.lit(1)).alias("total")).join(patterns, "key", "left_semi")


def bootstrap(edges: DataFrame, seeds: DataFrame, totals: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    """After so many rounds: the confident patterns (key), and found(key, instance): the candidates that such patterns hold.
    Every round takes its patterns anew from all confident instances, so what one round discovers can make patterns of the
    next. An instance never vouches for itself: where it counts as confident already, its own occurrences are left out of
    the support and precision of the patterns that judge it."""
    known, found = seeds, None
    for _ in range(rounds):
        held = join_hot(edges, known, "instance").groupBy("key").agg(F.sum(F.col("n") * F.col("confidence")).alias("good"), F.count(F.lit(1)).alias("support")).filter(F.col("support") >= MIN_SUPPORT)
        sure = stored(held.join(totals, "key").filter(F.col("good") / F.col("total") >= MIN_PRECISION).select("key", "good", "support", "total"), "sure")
        judged = join_hot(join_hot(edges.filter("state = 0"), sure, "key"), known, "instance", how="left")
        own, mine = F.coalesce("confidence", F.lit(0.0)), F.col("confidence").isNotNull()
        rest = F.when(mine, F.col("total") - F.col("n")).otherwise(F.col("total"))
        judged = judged.filter(F.col("support") - mine.cast("int") >= MIN_SUPPORT).withColumn("precision", (F.col("good") - F.col("n") * own) / rest)
        judged = stored(judged.filter(F.col("precision") >= MIN_PRECISION).select("key", "instance", "precision"), "judged")
        miss = F.sum(F.log(F.greatest(1 - F.col("precision"), F.lit(1e-6))))
        scored = judged.groupBy("instance").agg((1 - F.exp(miss)).alias("confidence")).filter(F.col("confidence") >= MIN_CONFIDENCE)
        found = join_hot(judged.select("key", "instance"), scored.select("instance"), "instance")
        known = stored(seeds.unionByName(scored).groupBy("instance").agg(F.max("confidence").alias("confidence")), "known")
    return sure, found


def held_out(instance: Column, share: int) -> Column:
    """Whether a word of a key's shape is kept from the seeds: one of so many, by a hash."""
    return F.pmod(F.xxhash64(instance, F.lit("held out")), F.lit(share).cast("long")) == 0


def discover(docs: DataFrame, scanned: DataFrame, rounds: int = ROUNDS, share: int = HELD_OUT) -> DataFrame:
    """id, start, end, unseen: candidates that confident patterns discover, and whether they were no seeds.

    The words counted for a slot include its candidates, and confidence only grows with precision. So rounds on the graph
    alone, with the candidates as the total, reach every pattern that rounds with the true totals can: only those are
    counted over the corpus."""
    with scratch(docs.sparkSession):
        words = scanned.select("id", F.explode("words").alias("x")).select("id", "x.start", "x.end", "x.instance", "x.keys", "x.state")
        words = stored(words.filter(f"state = 2 OR (state = 0 AND length(instance) >= {MIN_LENGTH})"), "occurrences")
        edges = words.select(F.explode("keys").alias("key"), "instance", "state").groupBy("key", "instance").agg(F.count(F.lit(1)).alias("n"), F.max("state").alias("state"))
        edges = stored(edges, "graph")
        likely = F.col("instance").rlike(KEY_SHAPE) & ~held_out(F.col("instance"), share)
        sure = F.when(F.col("state") == 2, 1.0).when(likely, KEY_CONFIDENCE)
        seeds = words.select("instance", sure.alias("confidence")).filter("confidence IS NOT NULL")
        seeds = stored(seeds.groupBy("instance").agg(F.max("confidence").alias("confidence")), "seeds")
        wide = edges.groupBy("key").agg(F.count(F.lit(1)).alias("instances"), F.sum("n").alias("total")).filter(f"instances >= {MIN_SUPPORT}")
        most = stored(wide.select("key", "total"), "candidates")
        edges = stored(edges.join(most.select("key"), "key", "left_semi"), "edges")
        possible, _ = bootstrap(edges, seeds, most, rounds)
        totals = slot_totals(docs, possible.select("key").join(most.select("key", F.col("total").alias("most")), "key"))
        _, found = bootstrap(edges, seeds, totals, rounds)
        # a pair of pattern and instance is joined by one hash, so no common pattern or instance weighs on one task
        pair = lambda key: F.xxhash64(key, "instance")
        hits = words.filter("state = 0").select("instance", "id", "start", "end", F.explode("keys").alias("key")).withColumn("pair", pair("key"))
        facts = join_hot(found, seeds.select("instance", F.lit(False).alias("seed")), "instance", how="left").select(pair("key").alias("pair"), F.col("seed").isNull().alias("unseen")).distinct()
        hits = join_hot(hits.select("pair", "id", "start", "end"), facts, "pair")
        return kept(hits.groupBy("id", "start", "end").agg(F.max("unseen").alias("unseen")), "discovered")


def with_spans(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """row (the columns of docs to keep, all by default), base and spans: array<struct<start, rank, end, kind>> of base spans,
    and of those and the discovered ones, by start and kind; unseen: how many discovered ones were no seeds."""
    scanned = scan(docs, docs.columns if keep is None else keep)
    extra = discover(docs, scanned).groupBy("id").agg(F.count_if("unseen").alias("unseen"), F.collect_list(F.struct("start", F.lit(len(KINDS)).alias("rank"), "end", F.lit(CONTEXT).alias("kind"))).alias("extra"))
    spans = F.array_sort(F.concat("base", F.coalesce("extra", F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>"))))
    return scanned.join(extra, "id", "left").select("row", "base", spans.alias("spans"), F.coalesce("unseen", F.lit(0).cast("long")).alias("unseen"))


def span_string(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by its kind, as <EMAIL>; n_chars follows where there is one. Overlapping spans
    merge under the first one's kind. Null texts stay null."""
    text = F.col("row.text").cast("string")

    def step(acc: Column, s: Column) -> Column:
        fresh = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    touched = F.size("spans") > 0
    made = with_spans(docs).select("row", F.when(touched, clean).otherwise(text).alias("clean"), touched.alias("touched"))
    fresh = {"text": F.col("clean"), "n_chars": F.when(F.col("touched"), F.length("clean").cast("long")).otherwise(F.col("row").getField("n_chars")) if "n_chars" in docs.columns else None}
    return made.select(*[(fresh[c] if c in fresh else F.col("row").getField(c)).alias(c) for c in docs.columns])


def op8_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = with_spans(docs, ["doc_id"])
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return made.select(
        "row.doc_id",
        *map(count, KINDS),
        F.sha2(span_string(F.col("base")), 256).alias("base_sha256"),
        span_string(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["kind"] == CONTEXT)).cast("long").alias("n_context"),
        F.col("unseen").alias("n_unseen"),
    )
