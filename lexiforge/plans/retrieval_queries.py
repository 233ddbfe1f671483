"""Set-at-a-time retrieval: all queries against all documents by equi-joins on tokens, scored and ranked in one plan.

The query side's vocabulary prunes postings before any shuffle of documents; what moves is (document, token, count) rows
for tokens that some query asks for, with counts summed on the map side.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T
from ..operators.places import placed
from ..operators.topk import alternatives_top_k, pruned_top_k
from ..operators.vectors import cell_search
from ..sources.tables import read_table, shared_dir, stored
from .text_queries import SOUND_KEY_SQL, sql_tokens

UNKNOWN_WEIGHT = 2.0
K1, B = 1.2, 0.75


def passages(spark: SparkSession, d: str) -> DataFrame:
    """Queries: the benchmark passages, whole."""
    return read_table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def query_tokens(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(T.content_tokens(F.col("query"), True))).alias("token"))


def postings(docs: DataFrame, vocabulary: DataFrame | None = None, text: str = "text") -> DataFrame:
    """doc_id, token, tf of content tokens; only those in `vocabulary` where one is given."""
    words = docs.select("doc_id", F.explode(T.content_tokens(F.col(text))).alias("token"))
    if vocabulary is not None:
        words = words.join(vocabulary.select("token").distinct(), "token", "left_semi")
    return words.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("tf"))


def size_of(docs: DataFrame) -> DataFrame:
    return docs.filter("text IS NOT NULL AND text <> ''").agg(F.count(F.lit(1)).alias("n_docs"))


def idf(posted: DataFrame, docs: DataFrame) -> DataFrame:
    """token, df, idf = ln((N + 1) / (1 + df)) + 1, N the documents with text."""
    df = posted.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(size_of(docs))).select("token", "df", (F.log((F.col("n_docs") + 1) / (1 + F.col("df"))) + 1).alias("idf"))


def top_k(scored: DataFrame, k: int, *order: Column) -> DataFrame:
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order, "doc_id")))
    return ranked.filter(F.col("rank") <= k)


def coverage_search(queries: DataFrame, docs: DataFrame, k: int, moved: dict[str, int] | None = None) -> DataFrame:
    """Top k documents by the idf-weighted share of query tokens they hold; common tokens touch only documents that can
    still be among them."""
    asked = query_tokens(queries)
    posted = stored(postings(docs, asked).select("doc_id", "token", F.lit(1.0).alias("part")), "postings")
    weighted = stored(asked.join(idf(posted, docs), "token", "left").select("query_id", "token", F.coalesce("idf", F.lit(UNKNOWN_WEIGHT)).alias("w")), "weighted")
    whole = weighted.groupBy("query_id").agg(F.sum("w").alias("whole"))
    met = pruned_top_k(weighted.select("query_id", F.col("token").alias("slot"), "token", "w"), posted, k, moved)
    scored = met.join(whole, "query_id").select("query_id", "doc_id", F.round(F.col("score") / F.col("whole"), 6).alias("score"), F.col("n_slots").alias("n_tokens"))
    return top_k(scored, k, F.desc("score")).select("query_id", "doc_id", "score", "n_tokens", "rank")


def coverage_top10(spark, d):
    return coverage_search(passages(spark, d), read_table(spark, d, "documents").select("doc_id", "text"), 10)


def document_frequency(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    return idf(postings(docs), docs).select("token", "df", F.round("idf", 6).alias("idf"))


def vocabulary(spark, d):
    return read_table(spark, d, "documents").select(F.explode(T.content_tokens(F.col("text"))).alias("word")).distinct()


def term_frequency(spark, d):
    return postings(read_table(spark, d, "documents").select("doc_id", "text"))


def letters_sorted(word: Column) -> Column:
    return F.array_join(F.array_sort(F.split(word, "")), "")


def with_distance(pairs: DataFrame, limit: Column) -> DataFrame:
    """pairs(token, word, field if any) within `limit` (2 at most) edits or swaps of letters, with distance. Plain edit distance settles
    most pairs where they are: one edit stays one, two are one where neighbours were swapped. Three or four can be two only
    with a swap, which leaves the letters but for one edit; these alone are compared in full."""
    if "field" not in pairs.columns:
        return with_distance(pairs.withColumn("field", F.lit("")), limit).drop("field")
    p = pairs.withColumn("plain", F.levenshtein("token", "word", 4)).filter("plain >= 0")
    swapped = F.exists(F.sequence(F.lit(1), F.greatest(F.length("token") - 1, F.lit(1))), lambda i: F.concat(F.substring("token", F.lit(1), i - 1), F.substring("token", i + 1, F.lit(1)), F.substring("token", i, F.lit(1)), F.substring("token", i + 2, F.length("token"))) == F.col("word"))
    near = p.filter("plain <= 2").select("field", "token", "word", F.when((F.col("plain") == 2) & (F.length("token") == F.length("word")) & (F.length("token") > 1) & swapped, 1).otherwise(F.col("plain")).alias("distance"))
    odd = p.filter((F.col("plain") > 2) & (limit == 2) & (F.levenshtein(letters_sorted(F.col("token")), letters_sorted(F.col("word")), 2) >= 0))
    odd = odd.select("field", "token", "word", S.transposition_distance("token", "word").alias("distance"))
    return near.unionByName(odd).filter(F.col("distance") <= limit)


def sharing_deletions(asked: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """asked(field, token, depth), vocabulary(field, word, depth) -> field, token, word: distinct pairs of a field at most two
    letters apart in length that become one string by deleting up to so many letters each, and few others. Words of a length
    that no token can reach stay out. The number of parts is given, as Spark would else join parts of few bytes to one task,
    whatever it costs to compare their pairs; pairs are stored, as two ways of comparing read them."""
    spark = asked.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    lengths = asked.select("field", F.explode(F.sequence(F.length("token") - 2, F.length("token") + 2)).alias("l")).distinct()
    held = vocabulary.withColumn("l", F.length("word")).join(F.broadcast(lengths), ["field", "l"], "left_semi")
    keyed = S.deletion_keys(asked.select(F.col("token").alias("word"), "depth", "field")).withColumnRenamed("word", "token")
    met = keyed.join(S.deletion_keys(held.repartition(parts, "word")), ["field", "key"]).select("field", "token", "word")
    return stored(met.repartition(parts, "token", "word").distinct(), "near-pairs")


def near_words(asked: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """asked(token), vocabulary(word) -> pairs within distance 1 (up to four letters) or 2, by shared deletions."""
    plain = lambda df, c: df.select(F.lit("").alias("field"), c, F.lit(2).alias("depth"))
    pairs = sharing_deletions(plain(asked, "token"), plain(vocabulary, "word"))
    return with_distance(pairs, F.when(F.length("token") <= 4, 1).otherwise(2)).drop("field")


#: Boosts of the four fields of a document.
FIELDS = {"text": 3.0, "sound": 2.0, "source": 1.0, "lang": 1.0}
#: Longest tokens that need an equal word, and that allow one edit; longer ones allow two.
EXACT_LETTERS, ONE_EDIT_LETTERS = 2, 5


def edits_allowed(token: Column) -> Column:
    return F.when(F.length(token) <= EXACT_LETTERS, 0).when(F.length(token) <= ONE_EDIT_LETTERS, 1).otherwise(2)


def variants(asked: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """asked(token) and vocabulary(word), of a field each where they have one -> token, word, factor: words within the edits
    a token's length allows, found by shared deletions; a word counts for less the more of it was edited."""
    if "field" not in asked.columns:
        return variants(asked.withColumn("field", F.lit("")), vocabulary.withColumn("field", F.lit(""))).drop("field")
    limit = edits_allowed(F.col("token"))
    plain = asked.join(vocabulary.withColumn("token", F.col("word")), ["field", "token"]).select("field", "token", "word", F.lit(1.0).alias("factor"))
    # a word that one edit can reach is no longer than the tokens that allow just one
    held = vocabulary.select("field", "word", F.when(F.length("word") <= ONE_EDIT_LETTERS - 2, 1).otherwise(2).alias("depth"))
    pairs = sharing_deletions(asked.filter(limit > 0).select("field", "token", limit.alias("depth")), held)
    pairs = pairs.filter("token <> word").filter(F.abs(F.length("token") - F.length("word")) <= limit)
    near = with_distance(pairs, limit).select("field", "token", "word", (1 - F.col("distance") / F.least(F.length("token"), F.length("word"))).alias("factor")).filter("factor > 0")
    return plain.unionByName(near)


def whole_words(c: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[ \\t\\n\\r]+"), lambda w: w != "")


def field_tokens(text: Column, source: Column, lang: Column) -> Column:
    """A map-like array of struct(field, tokens) of a document."""
    one = lambda name, tokens: F.struct(F.lit(name).alias("field"), tokens.alias("tokens"))
    return F.array(one("text", T.content_tokens(text)), one("sound", T.content_tokens(T.phonetic_latin(text))), one("source", whole_words(source)), one("lang", whole_words(lang)))


def asked_fields(queries: DataFrame) -> DataFrame:
    """query_id, field, token: a query's tokens for each field, of which source and language take whole words."""
    q = F.col("query")
    one = lambda name, tokens: F.struct(F.lit(name).alias("field"), F.array_distinct(tokens).alias("tokens"))
    fields = F.array(one("text", T.content_tokens(q, True)), one("sound", T.content_tokens(T.phonetic_latin(q), True)), one("source", whole_words(q)), one("lang", whole_words(q)))
    return queries.select("query_id", F.explode(fields).alias("f")).select("query_id", "f.field", F.explode("f.tokens").alias("token"))


def bm25_fields(queries: DataFrame, docs: DataFrame, k: int, fuzzy: bool = True) -> DataFrame:
    """query_id, doc_id, raw: of each query's best documents the best field's score. docs(doc_id, text, source, lang) are
    tokenised once; where fuzzy, tokens may differ from a document's words by the edits that their length allows. A document among the
    k best by its best field is among the k best of that field, so fields are searched as queries of their own."""
    asked = stored(asked_fields(queries), "asked")
    lists = docs.select("doc_id", F.explode(field_tokens(F.col("text"), F.col("source"), F.col("lang"))).alias("f"))
    held = stored(lists.select("doc_id", "f.field", "f.tokens"), "fields")
    facts = held.groupBy("field").agg(F.avg(F.size("tokens")).alias("mean"), F.count_if(F.size("tokens") > 0).alias("n_docs"))
    tokens = asked.select("field", "token").distinct()
    # words that nobody asks for are dropped before they are counted, unless they may be near one
    each = held.select("field", F.explode(F.array_distinct("tokens")).alias("token"))
    each = each if fuzzy else each.join(F.broadcast(tokens), ["field", "token"], "left_semi")
    frequency = stored(each.groupBy("field", "token").agg(F.count(F.lit(1)).alias("df")), "frequencies")
    if fuzzy:
        near = stored(variants(tokens, frequency.select("field", F.col("token").alias("word"))), "variants")
    else:
        near = tokens.select("field", "token", F.col("token").alias("word"), F.lit(1.0).alias("factor"))
    boost = reduce(lambda c, x: c.when(F.col("field") == x[0], x[1]), list(FIELDS.items())[1:], F.when(F.col("field") == "text", FIELDS["text"]))
    weight = boost * F.col("factor") * F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    words = near.join(frequency.withColumnRenamed("token", "word"), ["field", "word"]).join(F.broadcast(facts), "field").select("field", "token", "word", weight.alias("w"))
    value = lambda tf, dl, mean: tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))
    found = alternatives_top_k(asked, words, held.join(F.broadcast(facts), "field"), k, value, K1 + 1)
    return found.withColumnRenamed("score", "raw")


def labelled_passages(spark: SparkSession, d: str) -> DataFrame:
    """Passages, every second one followed by the name of a source and a language."""
    named = F.concat(F.col("query"), F.lit(" SRC"), (F.col("query_id") % 20).cast("string"), F.lit(" en"))
    return passages(spark, d).select("query_id", F.when(F.col("query_id") % 2 == 1, named).otherwise(F.col("query")).alias("query"))


def bm25(spark, d, fuzzy: bool = False):
    """Best of four boosted fields; divided by the query's best."""
    found = bm25_fields(labelled_passages(spark, d), read_table(spark, d, "documents").select("doc_id", "text", "source", "lang"), 20, fuzzy)
    best = F.max("raw").over(Window.partitionBy("query_id"))
    scored = found.withColumn("score", F.round(F.col("raw") / best, 6))
    return top_k(scored, 20, F.desc("score")).select("query_id", "doc_id", "score", "rank")


def bm25_fuzzy(spark, d):
    """The same with tokens that may be edited, by their length."""
    return bm25(spark, d, True)


def met_tokens(asked: DataFrame, docs: DataFrame, *facts: str) -> DataFrame:
    """asked(query_id, token, ...) with docs(doc_id, text, facts): a row for each token of a query that a document holds, with
    tf. Documents are dealt out once, by id, and what they meet stays in their task: counts by document, and by query and
    document, need no further shuffle, as pairs are many more than documents."""
    words = docs.repartition("doc_id").select("doc_id", *facts, T.content_tokens(F.col("text")).alias("tokens"))
    # counted in a step of its own: beside explode they would be counted for each word
    words = words.select("doc_id", *facts, "tokens", F.size("tokens").alias("n_words"), F.size(F.array_distinct("tokens")).alias("n_distinct"))
    words = words.select("doc_id", *facts, "n_words", "n_distinct", F.explode("tokens").alias("token"))
    words = words.join(asked.select("token").distinct(), "token", "left_semi")
    kept = [F.first(c).alias(c) for c in (*facts, "n_words", "n_distinct")]
    return words.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("tf"), *kept).join(asked, "token")


def set_similarities(spark, d):
    """Token Jaccard, overlap and cheap overlap of every query with every document that shares a token."""
    asked = query_tokens(passages(spark, d))
    per = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("nq"))
    met = met_tokens(asked, read_table(spark, d, "documents").select("doc_id", "text"))
    shared = met.groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("m"), F.count_if(F.length("token") >= 6).alias("long"), F.first("n_distinct").alias("nd"))
    return shared.join(per, "query_id").select(
        "query_id",
        "doc_id",
        F.round(F.col("m") / (F.col("nq") + F.col("nd") - F.col("m")), 6).alias("jaccard"),
        F.round(F.col("m") / F.col("nq"), 6).alias("overlap"),
        F.round((F.col("m") + 0.5 * F.col("long")) / F.col("nq"), 6).alias("cheap"),
    )


def bm25_token_score(spark, d):
    """The fixed-length variant: average length 12, idf from the document's own count, capped at 1."""
    asked = query_tokens(passages(spark, d))
    per = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("nq"))
    f, length = F.col("tf"), F.col("n_words").cast("double")
    part = (1 + F.log(1 + 1 / (1 + f))) * f * (K1 + 1) / (f + K1 * (1 - B + B * length / 12.0))
    hit = met_tokens(asked, read_table(spark, d, "documents").select("doc_id", "text")).groupBy("query_id", "doc_id").agg(F.sum(part).alias("s"))
    return hit.join(per, "query_id").select("query_id", "doc_id", F.round(F.least(F.lit(1.0), F.col("s") / (3.5 * F.col("nq"))), 6).alias("score"))


def vectors(spark, d):
    return read_table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"), "label")


def vector_topk(spark, d):
    """Exact inner product over unit vectors; queries are the rows whose id is divisible by 100, against all rows."""
    return cell_search(vectors(spark, d), vectors(spark, d).filter("vec_id % 100 = 0"), 10, "inner")


def fingerprint_search(spark, d):
    """Distance of pooled fingerprints is half the Euclidean distance; similarity 1 / (1 + distance)."""
    return cell_search(vectors(spark, d), vectors(spark, d).filter("vec_id % 100 = 0"), 5, "distance")


VECTOR_FILES = ("vectors", "ids", "meta")


def write_vectors(rows: DataFrame, path: str) -> None:
    """rows(vec_id, v) as three tables: vectors by position, the id of each position, and their count and dimension."""
    spark = rows.sparkSession
    at = placed(rows.select("vec_id", "v"), "vec_id", "v")
    at.select("place", "v").write.parquet(f"{path}/vectors")
    at.select("place", "vec_id").write.parquet(f"{path}/ids")
    spark.read.parquet(f"{path}/vectors").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).cast("long").alias("dim")).write.parquet(f"{path}/meta")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """place, vec_id, v of written vectors. A missing table is a FileNotFoundError; tables that don't fit the count or
    dimension written with them are a ValueError."""
    tables = {}
    for name in VECTOR_FILES:
        try:
            tables[name] = spark.read.parquet(f"{path}/{name}")
        except AnalysisException as e:
            raise FileNotFoundError(f"{path}/{name}") from e
    meta = tables["meta"].first()
    there = tables["vectors"].agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).first()
    if (meta["n"], meta["dim"]) != (there["n"], there["dim"]) or tables["ids"].count() != meta["n"]:
        raise ValueError(f"{path}: tables do not fit their meta table")
    return tables["ids"].join(tables["vectors"], "place").select("place", "vec_id", "v")


def vector_files(spark, d):
    """Vectors written by position and read back."""
    path = f"{shared_dir(spark)}/lexiforge/vectors-{uuid.uuid4().hex}"
    write_vectors(vectors(spark, d), path)
    return read_vectors(spark, path).select("place", "vec_id", F.size("v").cast("long").alias("dim"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def vector_meta(spark, d):
    return vectors(spark, d).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).cast("long").alias("dim"))


def signals(spark: SparkSession, d: str) -> DataFrame:
    """Candidates with three signals and a popularity, from coverage, token Jaccard and label tables."""
    sims = set_similarities(spark, d)
    popular = read_table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("popularity"))
    return sims.join(popular, "doc_id", "left").select("query_id", "doc_id", F.col("cheap").alias("phonetic"), F.col("jaccard").alias("semantic"), F.col("overlap").alias("lexical"), F.coalesce("popularity", F.lit(0.0)).alias("popularity"))


def merge_signals(spark, d):
    """Union of signal rows, the best value of each signal, documents that exist."""
    s = signals(spark, d)
    none = F.lit(0.0)
    each = F.array(F.struct("phonetic", none.alias("semantic"), none.alias("lexical")), F.struct(none.alias("phonetic"), "semantic", "lexical"))
    rows = s.select("query_id", "doc_id", F.explode(each).alias("row")).select("query_id", "doc_id", "row.*")
    merged = rows.groupBy("query_id", "doc_id").agg(*[F.max(c).alias(c) for c in ("phonetic", "semantic", "lexical")])
    return merged.join(read_table(spark, d, "documents").select("doc_id"), "doc_id", "left_semi").select("query_id", "doc_id", "phonetic", "semantic", "lexical")


def scaled(c: str) -> Column:
    w = Window.partitionBy("query_id")
    return scaled_between(c, F.min(c).over(w), F.max(c).over(w))


def scaled_between(c: str, low: Column, high: Column) -> Column:
    return F.when(high - low < 1e-9, F.when(F.col(c) > 0, 1.0).otherwise(0.0)).otherwise((F.col(c) - low) / (high - low))


WEIGHTS = (0.40, 0.35, 0.15)


def fused(spark: SparkSession, d: str) -> DataFrame:
    """Weighted min-max fusion of the three signals and popularity. The ends of a query's signals are aggregates, as a window
    would gather all documents of a query in one task."""
    names = ("phonetic", "semantic", "lexical")
    rows = stored(signals(spark, d), "signals")
    ends = rows.groupBy("query_id").agg(*[f(c).alias(f"{end}_{c}") for c in names for end, f in (("low", F.min), ("high", F.max))])
    p, s, x = (w * scaled_between(c, F.col(f"low_{c}"), F.col(f"high_{c}")) for w, c in zip(WEIGHTS, names, strict=True))
    raw = p + s + x + 0.05 * F.col("popularity")
    return rows.join(ends, "query_id").select("query_id", "doc_id", *names, "popularity", F.round(raw, 6).alias("raw")).withColumn("strength", F.greatest(*names))


def fuse(spark, d):
    return top_k(fused(spark, d).select("query_id", "doc_id", "raw"), 20, F.desc("raw"))


#: Thresholds of result calibration.
EXACT, STRONG, REPEATED, REPEATED_GAP = 0.92, 0.85, 0.86, 0.06
DOMINANT_GAP, DOMINANT_RATIO = 0.08, 1.28
MIN_STRENGTH, CLUSTER_RATIO, CLUSTER_GAP = 0.42, 0.72, 0.14


def with_tops(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.select("*", *[F.first(c).over(w).alias(f"top_{c}") for c in ("strength", "lexical", "raw", "phonetic", "semantic")])


def calibrate(spark, d):
    made = calibrated(top_k(fused(spark, d), 20, F.desc("raw")))
    return made.select("query_id", "doc_id", "rank", "mode", F.round("confidence", 5).alias("confidence"))


def calibrated(ranked: DataFrame) -> DataFrame:
    """Ranked rows with raw, strength and signals -> those presented, with mode and confidence: a repeated prefix, else a
    dominant first row, else a cluster. One shuffle by query."""
    gap = F.col("top_strength") - F.col("strength")
    tie = ((F.col("lexical") >= REPEATED) & (gap <= REPEATED_GAP)) | ((F.col("top_strength") >= EXACT) & (F.col("strength") >= 0.88) & (gap <= 0.04))
    can = (F.col("top_lexical") >= REPEATED) | (F.col("top_strength") >= EXACT)
    whole = Window.partitionBy("query_id")
    running = whole.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = with_tops(ranked).withColumn("broken", F.max(F.when((F.col("rank") > 1) & ~tie, 1).otherwise(0)).over(running))
    rows = rows.withColumn("in_prefix", can & (F.col("broken") == 0)).withColumn("prefix", F.sum(F.col("in_prefix").cast("int")).over(whole))
    second = lambda c: F.max(F.when(F.col("rank") == 2, F.col(c))).over(whole)
    s2, l2, p2, r2 = (second(c) for c in ("strength", "lexical", "phonetic", "raw"))
    top = F.col("top_strength")
    sound = (F.col("top_phonetic") >= 0.85) & (F.col("top_phonetic") >= F.col("top_lexical")) & (F.col("top_phonetic") >= F.col("top_semantic")) & (F.col("top_phonetic") - p2 >= 0.04)
    fusion = F.when(r2 < 1e-9, F.col("top_raw") > 0.05).otherwise(F.col("top_raw") >= DOMINANT_RATIO * r2 + 0.04)
    dominant = s2.isNull() | ((top >= EXACT) & (top - s2 >= DOMINANT_GAP)) | ((F.col("top_lexical") >= EXACT) & (l2 < 0.80)) | ((top >= STRONG) & (top - s2 >= 0.12)) | sound | fusion
    rejected = ((F.col("strength") < MIN_STRENGTH) & (F.col("raw") < F.col("top_raw") * CLUSTER_RATIO)) | ((F.col("raw") < F.col("top_raw") * CLUSTER_RATIO) & (gap > CLUSTER_GAP)) | ((F.col("raw") < F.col("top_raw") - 0.14) & (gap > 0.10))
    rows = rows.withColumn("mode", F.when(F.col("prefix") >= 2, "repeated").when(dominant, "dominant").otherwise("cluster"))
    kept = F.when(F.col("mode") == "repeated", F.col("in_prefix")).when(F.col("mode") == "dominant", F.col("rank") == 1).otherwise(~rejected)
    rows = rows.filter(kept).withColumn("at", F.row_number().over(whole.orderBy("rank")) - 1)
    s = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("strength")))
    high = F.when(s >= 0.96, 0.98).when(s >= 0.90, 0.90 + 0.08 * (s - 0.90) / 0.06).when(s >= 0.82, 0.88 + 0.02 * (s - 0.82) / 0.08).otherwise(0.82 + 0.06 * s / 0.82)
    near = F.when(F.col("top_raw") > 1e-9, F.col("raw") / F.col("top_raw")).otherwise(1.0)
    base = (0.52 + 0.36 * s) * (0.78 + 0.22 * near) * F.pow(F.lit(0.93), F.col("at"))
    lifted = F.when((F.col("at") == 0) & (F.col("strength") >= STRONG), F.greatest(base, high - 0.06)).otherwise(base)
    held = F.least(F.lit(0.94), F.greatest(F.lit(0.38), lifted))
    held = F.when((F.col("mode") == "repeated") & (F.col("strength") >= EXACT), F.greatest(held, high - 0.03 * F.col("at"))).otherwise(held)
    return rows.select("query_id", "doc_id", "rank", "mode", F.when(F.col("mode") == "dominant", high).otherwise(held).alias("confidence"))


BASE_SQL = f"""WITH asked AS (SELECT DISTINCT item_id AS query_id, unnest({sql_tokens('text', True)}) AS token FROM benchmark),
 words AS (SELECT doc_id, unnest({sql_tokens('text')}) AS token FROM documents), posted AS (SELECT doc_id, token, count(*) AS tf FROM words GROUP BY 1, 2),
 size AS (SELECT count(*) AS n FROM documents WHERE text <> ''), dfs AS (SELECT token, count(*) AS df FROM posted GROUP BY 1),
 lens AS (SELECT doc_id, len({sql_tokens('text')})::DOUBLE AS dl, len(list_distinct({sql_tokens('text')})) AS nd FROM documents),
 per AS (SELECT query_id, count(*) AS nq FROM asked GROUP BY 1),
 sims AS (SELECT query_id, doc_id, round(m / (nq + nd - m), 6) AS jaccard, round(m / nq, 6) AS overlap, round((m + 0.5 * long) / nq, 6) AS cheap
   FROM (SELECT query_id, doc_id, count(*)::DOUBLE AS m, count(*) FILTER (WHERE length(token) >= 6) AS long FROM asked JOIN posted USING (token) GROUP BY 1, 2) JOIN per USING (query_id) JOIN lens USING (doc_id)),
 signals AS (SELECT query_id, doc_id, cheap AS phonetic, jaccard AS semantic, overlap AS lexical, coalesce(quality, 0)::DOUBLE AS popularity FROM sims LEFT JOIN labels USING (doc_id))
"""


def sql_scaled(c: str) -> str:
    return f"CASE WHEN max({c}) OVER q - min({c}) OVER q < 1e-9 THEN CASE WHEN {c} > 0 THEN 1.0 ELSE 0.0 END ELSE ({c} - min({c}) OVER q) / (max({c}) OVER q - min({c}) OVER q) END"


FUSED_SQL = (
    BASE_SQL
    + f", fused AS (SELECT *, greatest(phonetic, semantic, lexical) AS strength, round({WEIGHTS[0]} * {sql_scaled('phonetic')} + {WEIGHTS[1]} * {sql_scaled('semantic')} + {WEIGHTS[2]} * {sql_scaled('lexical')} + 0.05 * popularity, 6) AS raw FROM signals WINDOW q AS (PARTITION BY query_id)),"
    + " ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, doc_id) AS rank FROM fused QUALIFY rank <= 20)"
)
VECTOR_SQL = "WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 100 = 0), v AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT query_id, doc_id, {score} AS score FROM v, q) SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= {k}"

WHOLE_WORDS = "list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[ \\t\\n\\r]+'), lambda w: w <> '')"
LABELLED = "(SELECT item_id, CASE WHEN item_id % 2 = 1 THEN text || ' SRC' || (item_id % 20) || ' en' ELSE text END AS text FROM benchmark)"
BM25_SQL = (
    "WITH asked AS ("
    + " UNION ALL ".join(f"SELECT DISTINCT item_id AS query_id, '{f}' AS field, unnest({t}) AS token FROM {LABELLED}" for f, t in (("text", sql_tokens("text", True)), ("sound", sql_tokens(SOUND_KEY_SQL, True)), ("source", WHOLE_WORDS.format("text")), ("lang", WHOLE_WORDS.format("text"))))
    + "), held AS ("
    + " UNION ALL ".join(f"SELECT doc_id, '{f}' AS field, {b}::DOUBLE AS boost, {t} AS ts FROM documents" for (f, b), t in zip(FIELDS.items(), (sql_tokens("text"), sql_tokens(SOUND_KEY_SQL), WHOLE_WORDS.format("source"), WHOLE_WORDS.format("lang")), strict=True))
    + f"""), facts AS (SELECT field, any_value(boost) AS boost, avg(len(ts)) AS mean, count(*) FILTER (WHERE len(ts) > 0) AS n FROM held GROUP BY 1),
 counts AS (SELECT field, doc_id, len(ts) AS dl, unnest(ts) AS word FROM held), posted AS (SELECT field, word, doc_id, dl, count(*) AS tf FROM counts GROUP BY 1, 2, 3, 4), dfs AS (SELECT field, word, count(*) AS df FROM posted GROUP BY 1, 2),
 limits AS (SELECT DISTINCT field, token, EDITS AS edits FROM asked),
 near AS (SELECT field, token, word, df, damerau_levenshtein(token, word) AS e FROM limits JOIN dfs USING (field) WHERE abs(length(token) - length(word)) <= edits AND damerau_levenshtein(token, word) <= edits),
 words AS (SELECT field, token, word, boost * (1 - e / least(length(token), length(word))) * ln(1 + (n - df + 0.5) / (df + 0.5)) AS w FROM near JOIN facts USING (field) WHERE e < least(length(token), length(word))),
 slots AS (SELECT query_id, field, doc_id, token, max(w * tf * {K1 + 1} / (tf + {K1} * (1 - {B} + {B} * dl / mean))) AS v FROM asked JOIN words USING (field, token) JOIN posted USING (field, word) JOIN facts USING (field) GROUP BY 1, 2, 3, 4),
 sums AS (SELECT query_id, field, doc_id, sum(v) AS raw FROM slots GROUP BY 1, 2, 3), u AS (SELECT query_id, doc_id, max(raw) AS raw FROM sums GROUP BY 1, 2), x AS (SELECT query_id, doc_id, round(raw / max(raw) OVER (PARTITION BY query_id), 6) AS score FROM u)
 SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM x QUALIFY rank <= 20"""
)

QUERIES = {
    "g2_d9_f3_coverage_top10": coverage_top10,
    "e1_document_frequency": document_frequency,
    "e2_vocabulary": vocabulary,
    "e8_term_frequency": term_frequency,
    "g4_bm25": bm25,
    "g4_bm25_fuzzy": bm25_fuzzy,
    "c2_c3_c9_set_similarities": set_similarities,
    "c6_bm25_token_score": bm25_token_score,
    "c14_g6_vector_topk": vector_topk,
    "c13_g13_fingerprint_search": fingerprint_search,
    "a6_vector_meta": vector_meta,
    "a6_vector_files": vector_files,
    "d10_merge_signals": merge_signals,
    "f4_g9_fuse": fuse,
    "f5_f8_g10_calibrate": calibrate,
}

SQL = {
    "g2_d9_f3_coverage_top10": BASE_SQL
    + f""", w AS (SELECT query_id, token, coalesce(ln((n + 1) / (1.0 + df)) + 1, {UNKNOWN_WEIGHT}) AS w FROM asked LEFT JOIN dfs USING (token), size),
 s AS (SELECT query_id, doc_id, round(sum(w) / (SELECT sum(w) FROM w x WHERE x.query_id = w.query_id), 6) AS score, count(*) AS n_tokens FROM w JOIN posted USING (token) GROUP BY 1, 2)
 SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 10""",
    "e1_document_frequency": BASE_SQL + "SELECT token, df, round(ln((n + 1) / (1.0 + df)) + 1, 6) AS idf FROM dfs, size",
    "e2_vocabulary": BASE_SQL + "SELECT DISTINCT token AS word FROM words",
    "e8_term_frequency": BASE_SQL + "SELECT * FROM posted",
    "g4_bm25": BM25_SQL.replace("EDITS", "0"),
    "g4_bm25_fuzzy": BM25_SQL.replace("EDITS", f"CASE WHEN length(token) <= {EXACT_LETTERS} THEN 0 WHEN length(token) <= {ONE_EDIT_LETTERS} THEN 1 ELSE 2 END"),
    "c2_c3_c9_set_similarities": BASE_SQL + "SELECT * FROM sims",
    "c6_bm25_token_score": BASE_SQL
    + f"SELECT query_id, doc_id, round(least(1.0, sum((1 + ln(1 + 1 / (1.0 + tf))) * tf * {K1 + 1} / (tf + {K1} * (1 - {B} + {B} * dl / 12.0))) / (3.5 * any_value(nq))), 6) AS score FROM asked JOIN posted USING (token) JOIN lens USING (doc_id) JOIN per USING (query_id) GROUP BY 1, 2",
    "c14_g6_vector_topk": VECTOR_SQL.format(score="round(list_inner_product(v, qv) / sqrt(list_inner_product(qv, qv)), 6)", k=10),
    "c13_g13_fingerprint_search": VECTOR_SQL.format(score="round(1 / (1 + list_distance(v, qv) / 2), 6)", k=5),
    "a6_vector_files": "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS place, vec_id, len(embedding) AS dim, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings",
    "a6_vector_meta": "SELECT count(*) AS n, max(len(embedding)) AS dim FROM embeddings",
    "d10_merge_signals": BASE_SQL + "SELECT query_id, doc_id, phonetic, semantic, lexical FROM signals",
    "f4_g9_fuse": FUSED_SQL + " SELECT query_id, doc_id, raw, rank FROM ranked",
    "f5_f8_g10_calibrate": FUSED_SQL
    + f""", t AS (SELECT *, first(strength) OVER w AS ts, first(lexical) OVER w AS tl, first(raw) OVER w AS tr, first(phonetic) OVER w AS tp, first(semantic) OVER w AS tm,
   nth_value(strength, 2) OVER w AS s2, nth_value(lexical, 2) OVER w AS l2, nth_value(phonetic, 2) OVER w AS p2, nth_value(raw, 2) OVER w AS r2 FROM ranked
   WINDOW w AS (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
 b AS (SELECT *, (tl >= {REPEATED} OR ts >= {EXACT}) AND max(CASE WHEN rank > 1 AND NOT ((lexical >= {REPEATED} AND ts - strength <= {REPEATED_GAP}) OR (ts >= {EXACT} AND strength >= 0.88 AND ts - strength <= 0.04)) THEN 1 ELSE 0 END)
   OVER (PARTITION BY query_id ORDER BY rank) = 0 AS in_prefix FROM t),
 m AS (SELECT *, CASE WHEN sum(in_prefix::INT) OVER (PARTITION BY query_id) >= 2 THEN 'repeated' WHEN s2 IS NULL OR (ts >= {EXACT} AND ts - s2 >= {DOMINANT_GAP}) OR (tl >= {EXACT} AND l2 < 0.8) OR (ts >= {STRONG} AND ts - s2 >= 0.12)
   OR (tp >= 0.85 AND tp >= tl AND tp >= tm AND tp - p2 >= 0.04) OR CASE WHEN r2 < 1e-9 THEN tr > 0.05 ELSE tr >= {DOMINANT_RATIO} * r2 + 0.04 END THEN 'dominant' ELSE 'cluster' END AS mode FROM b),
 k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS pos FROM m WHERE CASE mode WHEN 'repeated' THEN in_prefix WHEN 'dominant' THEN rank = 1
   ELSE NOT ((strength < {MIN_STRENGTH} AND raw < tr * {CLUSTER_RATIO}) OR (raw < tr * {CLUSTER_RATIO} AND ts - strength > {CLUSTER_GAP}) OR (raw < tr - 0.14 AND ts - strength > 0.10)) END),
 c AS (SELECT *, least(1.0, greatest(0.0, strength)) AS s, CASE WHEN tr > 1e-9 THEN raw / tr ELSE 1.0 END AS near FROM k),
 h AS (SELECT *, CASE WHEN s >= 0.96 THEN 0.98 WHEN s >= 0.90 THEN 0.90 + 0.08 * (s - 0.90) / 0.06 WHEN s >= 0.82 THEN 0.88 + 0.02 * (s - 0.82) / 0.08 ELSE 0.82 + 0.06 * s / 0.82 END AS high,
   (0.52 + 0.36 * s) * (0.78 + 0.22 * near) * pow(0.93, pos) AS base FROM c)
 SELECT query_id, doc_id, rank, mode, round(CASE WHEN mode = 'dominant' THEN high ELSE greatest(least(0.94, greatest(0.38, CASE WHEN pos = 0 AND strength >= {STRONG} THEN greatest(base, high - 0.06) ELSE base END)),
   CASE WHEN mode = 'repeated' AND strength >= {EXACT} THEN high - 0.03 * pos ELSE 0 END) END, 5) AS confidence FROM h""",
}
