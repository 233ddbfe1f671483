"""Near-duplicate detection by BagMinHash over word shingles.

A text is the multiset of its five-word shingles (a shorter text is one shingle). Weights, here counts, are discretised
at the integers, and the integers are grouped into blocks 1, 2, 3-4, 5-8, ... Each shingle and block has a Poisson
process whose rate is the block's length; a point carries a level inside its block, found by halving, which counts only
up to the shingle's weight, and one signature position. A signature keeps the earliest point of each position, so two
texts agree in a position with probability equal to their weighted Jaccard similarity. Points are drawn only up to a
time by which all positions are almost surely filled, and further where they are not: about m ln m points a text
instead of m for each shingle.

Signatures are banded; rows and bands follow from the similarity, so that a pair just at it shares a band but for a
chance of about 2 in 10,000. Within a bucket no pairs are listed: members are matched with a few bucket leaders, the
best of them are verified by exact multiset overlap of the texts, and components are taken. Then the pairs of a bucket
whose ends are still in different components are verified too, unless the similarity is out of reach: shingles that no
other such text has bound what a pair can share, exactly; and four-bit sketches estimate it, with a margin of `sigmas`
deviations. At the default, 3.7, they lose a pair just at the similarity with a chance of about 1 in 10,000, half of what
the bands lose; pairs well over it are safe. `sigmas=None` is the exact way for the rest: every such pair is verified.
So every candidate link is verified, ruled out or inside a component already; nothing is capped. Leaders and buckets with
very many members are dealt out over tasks.

Defined results: null and empty texts have no words and are copies of each other. Texts equal in their words are copies
whatever the white space. A null doc_id is replaced by a negative hash of the text inside, and stays null in results; a
class takes the smallest id given in it, and only one of rows without ids is named by such a hash. A
doc_id shared by different texts joins their classes in `near_duplicates`; `deduplicate` keeps both such texts, as neither
copies the other. Repeated rows are copies. Texts are taken whole: a task holds a batch of about two megabytes or one
longer text, and the two texts of a pair. An empty table gives an empty result. Other columns, whatever their names, are
kept by `deduplicate` and not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.joins import join_hot
from ..sources.tables import kept, read_table, scratch, stored
from .arrow import WHITE, chunks, flat_bytes, mix64, word_codes, word_spans

SHINGLE, SIMILARITY = 5, 0.8
#: Most positions of a signature; chance to miss a pair just at the similarity; margin of the sketches.
MOST_POSITIONS, MISS, SIGMAS = 256, 2.2e-4, 3.7
LEADERS_TRIED = 3
#: Masks that give each of a bucket's leaders another order of ids.
ORDERS = (0, 0x2AAAAAAA, 0x5CC33A5C, 0x71E9D64B)
#: Members of a bucket that one task compares with each other or with as many others.
MEMBERS_AT_ONCE, HOT_BUCKETS = 512, 2000
SLACK = 3.0
#: Bits that a sketch keeps of each position, and the longs they fill.
SKETCH_BITS, SKETCH_LONGS = 4, 16
SKETCHES = [f"bit{i}" for i in range(SKETCH_LONGS)]
SKETCH_SCHEMA = "row_id long, raw long, named boolean, text_key binary, size long, bands array<long>, " + ", ".join(f"{c} long" for c in SKETCHES)


class Layout(NamedTuple):
    """How a signature is cut into bands, and over how many differing sketch positions rule a pair out (None: no rule)."""

    bands: int
    rows: int
    most_apart: int | None

    @property
    def positions(self) -> int:
        return self.bands * self.rows


def layout(similarity: float, sigmas: float | None = SIGMAS) -> Layout:
    """The longest bands of which enough fit."""
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be over 0 and at most 1")
    found = (1, MOST_POSITIONS)
    for rows in range(1, MOST_POSITIONS + 1):
        same = similarity**rows
        bands = 1 if same > 1 - MISS else math.ceil(math.log(MISS) / math.log1p(-same))
        if bands * rows <= MOST_POSITIONS:
            found = (rows, bands) if rows > 1 else (1, min(bands, MOST_POSITIONS))
    rows, bands = found
    n, p = rows * bands, (1 - similarity) * (1 - 0.5**SKETCH_BITS)
    return Layout(bands, rows, None if sigmas is None else math.ceil(n * p + sigmas * math.sqrt(n * p * (1 - p))))


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, count) of each distinct shingle of each text, by row and hash."""
    offsets, data = flat_bytes(column)
    starts, ends, row = word_spans(offsets, data, WHITE)
    codes, words = word_codes(data, starts, ends)
    own = np.array([int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little") for w in words.to_pylist()], dtype=np.uint64)
    value = own[codes] if len(codes) else np.zeros(0, np.uint64)
    per = np.bincount(row, minlength=len(column))
    size = np.minimum(per, SHINGLE)[row]  # of the shingle that starts at a word
    first = np.cumsum(per) - per
    left = (first + per)[row] - np.arange(len(row))
    at = np.flatnonzero(left >= size)
    key = np.zeros(len(at), dtype=np.uint64)
    for i in range(SHINGLE):
        inside = size[at] > i
        key[inside] = mix64(key[inside] + value[at[inside] + i])
    rows = row[at]
    order = np.lexsort((key, rows))
    key, rows = key[order], rows[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (rows[1:] != rows[:-1])
    where = np.flatnonzero(new)
    return rows[where], key[where], np.diff(np.concatenate([where, [len(key)]]))


def signatures(rows: np.ndarray, keys: np.ndarray, weights: np.ndarray, n: int, positions: int) -> np.ndarray:
    """n x positions earliest times; infinite for a text without shingles."""
    out = np.full(n * positions, np.inf)
    total = np.bincount(rows, weights=weights, minlength=n)
    until = positions * (np.log(positions) + SLACK) / np.maximum(total, 1)
    open_rows = total > 0
    while open_rows.any():
        use = open_rows[rows]
        low = 0
        while True:  # blocks (0, 1], (1, 2], (2, 4], ...
            mine = use & (weights > low)
            if not mine.any():
                break
            length = max(1, low)
            row, weight = rows[mine], weights[mine]
            state = mix64(keys[mine] + np.uint64(low))
            time = np.zeros(len(row))
            while len(row):
                state = mix64(state)
                time = time - np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / length
                alive = time <= until[row]
                row, weight, state, time = row[alive], weight[alive], state[alive], time[alive]
                other = mix64(state ^ np.uint64(0xD1B54A32D192ED03))
                position = (other % np.uint64(positions)).astype(np.int64)
                level = low + 1 + ((other >> np.uint64(32)) & np.uint64(length - 1)).astype(np.int64)
                counts = level <= weight
                np.minimum.at(out, row[counts] * positions + position[counts], time[counts])
            low = max(1, low * 2)
        filled = np.isfinite(out.reshape(n, positions)).all(axis=1)
        open_rows &= ~filled
        until *= 2
    return out.reshape(n, positions)


def sketch(batches: Iterator[pa.RecordBatch], plan: Layout) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, limit=2 << 20):
        n = batch.num_rows
        column = batch.column("text")
        keys = [hashlib.blake2b(b" ".join((x or b"").split()), digest_size=16).digest() for x in column.cast(pa.large_binary()).to_pylist()]
        found = shingles(column)
        times = signatures(*found, n, plan.positions).astype(np.float32)
        size = np.bincount(found[0], weights=found[2], minlength=n).astype(np.int64)
        value = mix64(times.view(np.uint32).astype(np.uint64))
        bands = np.zeros((n, plan.bands), dtype=np.uint64) + np.arange(1, plan.bands + 1, dtype=np.uint64)
        for i in range(plan.rows):
            bands = mix64(bands + value[:, i :: plan.rows])
        bits = np.zeros((n, MOST_POSITIONS), dtype=np.uint8)
        bits[:, : plan.positions] = value & np.uint64((1 << SKETCH_BITS) - 1)
        packed = np.ascontiguousarray(bits[:, ::2] << SKETCH_BITS | bits[:, 1::2]).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("row_id"), batch.column("raw"), batch.column("named"), pa.array(keys, pa.binary()), pa.array(size), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * plan.bands), pa.array(bands.view(np.int64).reshape(-1)))] + [pa.array(np.ascontiguousarray(packed[:, i])) for i in range(SKETCH_LONGS)],
            names=[c.split()[0] for c in SKETCH_SCHEMA.split(", ")],
        )


def overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact weighted Jaccard similarity of the texts of each pair."""
    for whole in batches:
        for batch in chunks([whole], "text_a"):
            n, parts = batch.num_rows, []
            for name in ("text_a", "text_b"):
                rows, keys, counts = shingles(batch.column(name))
                parts.append((mix64(keys + mix64(rows.astype(np.uint64))), rows, counts))
            (ka, ra, ca), (kb, rb, cb) = parts
            _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
            both = np.bincount(ra[ia], weights=np.minimum(ca[ia], cb[ib]), minlength=n)
            union = np.bincount(ra, weights=ca, minlength=n) + np.bincount(rb, weights=cb, minlength=n) - both
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(np.where(union > 0, both / np.maximum(union, 1), 1.0))], names=["a", "b", "similarity"])


def listed_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        rows, keys, counts = shingles(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("row_id").take(pa.array(rows)), pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], names=["rep", "shingle", "n"])


def shareable(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """node, own: how much of each of these texts lies in shingles that none of the other texts has."""
    listed = texts.join(ids.select(F.col("node").alias("row_id")), "row_id", "left_semi").mapInArrow(listed_shingles, "rep long, shingle long, n long")
    alone = listed.groupBy("shingle").agg(F.count(F.lit(1)).alias("texts"), F.min("rep").alias("node"), F.sum("n").alias("n")).filter("texts = 1")
    return alone.groupBy("node").agg(F.sum("n").alias("own"))


def row_keys(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """(row_id, raw): the id, or a negative hash of the text without one, and a hash that tells texts of one id apart."""
    raw = F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))
    return F.coalesce(doc_id.cast("long"), -1 - raw.bitwiseAND(F.lit(2**62 - 1))), raw


def verified(pairs: DataFrame, texts: DataFrame, similarity: float, name: str) -> DataFrame:
    """pairs(a, b) of nodes whose texts(row_id, text) reach the similarity."""
    # stored, so that finding the hot ends makes neither the pairs nor the first join anew
    both = given = stored(pairs.select("a", "b"), f"{name}-pairs")
    for side in ("a", "b"):
        counts = given.groupBy(side).agg(F.count(F.lit(1)).alias("n"))
        both = join_hot(both, texts.select(F.col("row_id").alias(side), F.col("text").alias(f"text_{side}")), side, counts)
    both = both.select("a", "b", "text_a", "text_b")
    return stored(both.mapInArrow(overlaps, "a long, b long, similarity double").filter(F.col("similarity") >= similarity), name)


def positions_apart(xor: Column) -> Column:
    """How many of the four-bit positions of a long hold any bit."""
    any_bit = xor.bitwiseOR(F.shiftright(xor, 1)).bitwiseOR(F.shiftright(xor, 2)).bitwiseOR(F.shiftright(xor, 3))
    return F.bit_count(any_bit.bitwiseAND(F.lit(0x1111111111111111)))


def apart(left: DataFrame, similarity: float, plan: Layout) -> DataFrame:
    """a, b: pairs of members of a bucket in different components that may reach the similarity, each in the first bucket
    it shares. A large bucket is cut into parts, and each two parts meet in a task of their own."""
    sizes = left.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MEMBERS_AT_ONCE).orderBy(F.desc("n"), "bucket").limit(HOT_BUCKETS)
    sizes = F.broadcast(sizes.select("bucket", F.ceil(F.col("n") / MEMBERS_AT_ONCE).cast("int").alias("parts")))
    dealt = left.join(sizes, "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("node", F.lit("part")), F.col("parts").cast("long")).cast("int"))
    x = dealt.withColumn("u", F.col("part")).withColumn("v", F.explode(F.expr("sequence(part, parts - 1)"))).alias("x")
    y = dealt.withColumn("v", F.col("part")).withColumn("u", F.explode(F.expr("sequence(0, part)"))).alias("y")
    same = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.u") == F.col("y.u")) & (F.col("x.v") == F.col("y.v"))
    other = ((F.col("x.u") < F.col("x.v")) | (F.col("x.node") < F.col("y.node"))) & (F.col("x.component") != F.col("y.component"))
    common = F.least("x.most", "y.most")
    reachable = common * (1 + similarity) >= similarity * (F.col("x.size") + F.col("y.size")) - 1e-6
    met = same & other & reachable
    if plan.most_apart is not None:
        differ = sum((positions_apart(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in SKETCHES), F.lit(0))
        met = met & (differ <= plan.most_apart)
    once = F.get(F.array_intersect("x.bands", "y.bands"), F.lit(0)) == F.col("x.bucket")
    return x.join(y, met & once).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))


def text_classes(docs: DataFrame, similarity: float, sigmas: float | None, join_ids: bool) -> tuple[DataFrame, DataFrame]:
    """(row_id, raw, text_key of each row; text_key, class_id, first: each different text, its class and its first row)."""
    plan = layout(similarity, sigmas)
    row_id, raw = row_keys(F.col("doc_id"), F.col("text"))
    given = docs.select(row_id.alias("row_id"), raw.alias("raw"), F.col("doc_id").isNotNull().alias("named"), F.col("text").cast("string").alias("text"))
    made = stored(given.mapInArrow(lambda batches: sketch(batches, plan), SKETCH_SCHEMA), "sketches")
    facts = [F.first(c).alias(c) for c in ("bands", "size", *SKETCHES)]
    unique = made.groupBy("text_key").agg(F.min(F.struct((~F.col("named")).alias("nameless"), "row_id", "raw")).alias("first"), *facts)
    unique = stored(unique.withColumn("node", F.monotonically_increasing_id()), "texts")

    held = unique.select("node", F.col("first.row_id").alias("rep"), F.explode("bands").alias("bucket"))
    # by id: the first of a group of copies is likely what the others were made from
    orders = [F.min(F.struct(F.col("rep").bitwiseXOR(F.lit(m)), "node"))["node"].alias(f"l{i}") for i, m in enumerate(ORDERS)]
    buckets = held.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *orders).filter("n > 1")
    shared = stored(held.drop("rep").join(buckets.drop("n"), "bucket"), "shared")

    leaders = shared.select("node", F.explode(F.array_distinct(F.array(*[f"l{i}" for i in range(len(ORDERS))]))).alias("leader")).filter("node <> leader")
    met = leaders.groupBy("node", "leader").agg(F.count(F.lit(1)).alias("met"))
    best = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("met"), "leader"))
    stars = stored(met.withColumn("at", best).filter(F.col("at") <= LEADERS_TRIED).select(F.col("node").alias("b"), F.col("leader").alias("a"), "at"), "stars")

    involved = shared.select("node").distinct().join(unique.select("node", "first.row_id", "first.raw"), "node")
    texts = given.join(involved, ["row_id", "raw"]).select(F.col("node").alias("row_id"), "text").dropDuplicates(["row_id"])
    texts = stored(texts, "involved")
    # the leader met most often first; others only for members that it does not take in
    links = verified(stars.filter("at = 1").select("a", "b"), texts, similarity, "stars").select("a", "b")
    others = stars.filter("at > 1").select("a", "b").join(links.select("b"), "b", "left_anti").select("a", "b")
    links = links.unionByName(verified(others, texts, similarity, "stars").select("a", "b"))
    component = connected_components(links, "first")

    labelled = shared.select("bucket", "node").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    labelled = stored(labelled, "labelled")
    mixed = labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("bucket")
    left = stored(labelled.join(mixed, "bucket", "left_semi"), "mixed")
    ids = left.select("node").distinct()
    facts = unique.select("node", "size", "bands", *SKETCHES).join(ids, "node", "left_semi").join(shareable(texts, ids), "node", "left")
    left = stored(left.join(facts.withColumn("most", F.col("size") - F.coalesce("own", F.lit(0))).drop("own"), "node"), "left")
    links = verified(apart(left, similarity, plan), texts, similarity, "rest").select("a", "b")
    if join_ids:
        several = made.groupBy("row_id").agg(F.min("text_key").alias("low"), F.max("text_key").alias("high")).filter("low <> high").select("row_id")
        nodes = made.join(several, "row_id", "left_semi").select("row_id", "text_key").join(unique.select("text_key", "node"), "text_key")
        links = links.unionByName(nodes.select(F.min("node").over(Window.partitionBy("row_id")).alias("a"), F.col("node").alias("b")).filter("a <> b"))
    # the later links join components, of which each is one node now
    for side in ("a", "b"):
        links = join_hot(links, component.select(F.col("node").alias(side), F.col("component").alias("to")), side, how="left")
        links = links.withColumn(side, F.coalesce("to", side)).select("a", "b")
    joined = connected_components(links.distinct(), "classes").select(F.col("node").alias("component"), F.col("component").alias("whole"))

    named = unique.select("text_key", "first", "node").join(component, "node", "left").select("text_key", "first", F.coalesce("component", "node").alias("component"))
    named = join_hot(named, joined, "component", how="left").select("text_key", "first", F.coalesce("whole", "component").alias("component"))
    named = stored(named, "named")
    lowest = named.groupBy("component").agg(F.min("first").alias("class"))
    return made.select("row_id", "raw", "named", "text_key"), join_hot(named, lowest, "component").select("text_key", "first", "class")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, sigmas: float | None = SIGMAS) -> DataFrame:
    """doc_id and text -> row_id, doc_id, class_id: the smallest id of each class of near copies."""
    with scratch(docs.sparkSession):
        rows, classes = text_classes(docs, similarity, sigmas, join_ids=True)
        found = join_hot(rows.select("row_id", "named", "text_key"), classes.select("text_key", F.col("class.row_id").alias("class_id")), "text_key")
        return kept(found.select("row_id", F.when(F.col("named"), F.col("row_id")).alias("doc_id"), "class_id"), "near-classes")


def deduplicate(docs: DataFrame, similarity: float = SIMILARITY, sigmas: float | None = SIGMAS) -> DataFrame:
    """One document of each class, the one with the smallest id; all columns of docs."""
    with scratch(docs.sparkSession):
        _, classes = text_classes(docs, similarity, sigmas, join_ids=False)
        first = kept(classes.filter("first = class").select("first.row_id", "first.raw"), "near-firsts")
    row_id, raw = row_keys(F.col("doc_id"), F.col("text"))
    # the given row travels as one column, so no name inside it can clash
    rows = docs.select(F.struct("*").alias("row"), row_id.alias("row_id"), raw.alias("raw")).join(first, ["row_id", "raw"], "left_semi")
    return rows.dropDuplicates(["row_id", "raw"]).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op1_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id")
