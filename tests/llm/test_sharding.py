"""The two-pass shuffle against one list per bucket."""

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexiforge.llm.sharding import SEED, fisher_yates, op13_external_shuffle, shard_records
from tests.conftest import SMALL

from .data import edge_docs, empty_docs, saved


def digest(*parts):
    return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()


def plain_places(bucket, rows, seed=SEED):
    a = list(range(rows))
    for i in range(rows - 1, 0, -1):
        j = int(digest(seed, bucket, i)[:12], 16) % (i + 1)
        a[i], a[j] = a[j], a[i]
    return a


def plain_shards(rows, shards, bucket_rows):
    """(doc_id, text) -> (shard, slot) of each row."""
    n, held = len(rows), {}
    buckets = max(1, -(-n // bucket_rows))
    for doc_id, text in rows:
        key = digest(SEED, "" if doc_id is None else doc_id, text or "")
        held.setdefault(int(key[:12], 16) % buckets, []).append((key, doc_id, text))
    order, before = {}, 0
    for bucket in sorted(held):
        for rank, place in enumerate(plain_places(bucket, len(held[bucket]))):
            order[before + place] = sorted(held[bucket], key=lambda x: x[0])[rank][1:]
        before += len(held[bucket])
    out, filled = [], Counter()
    for place in range(n):
        shard = place * shards // n
        out.append((*order[place], shard, filled[shard]))
        filled[shard] += 1
    return out


def test_fisher_yates(spark):
    rows = [(b, n) for b in range(3) for n in (0, 1, 2, 3, 17, 300)]
    df = spark.createDataFrame(rows, "bucket long, rows long")
    for r in df.select("bucket", "rows", fisher_yates(SEED, F.col("bucket"), F.col("rows")).alias("places")).collect():
        assert r.places == plain_places(r.bucket, r.rows)


@pytest.mark.parametrize("shards, bucket_rows", [(8, 512), (8, 7), (3, 20), (1, 50), (300, 64)])
def test_equals_plain(spark, shards, bucket_rows):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = shard_records(docs, shards=shards, bucket_rows=bucket_rows)
    assert got.columns == [*docs.columns, "shard", "slot"] and got.filter("n_chars IS NULL").count() == docs.filter("n_chars IS NULL").count()
    expected = plain_shards([(r.doc_id, r.text) for r in docs.collect()], shards, bucket_rows)
    assert sorted(map(tuple, got.select("doc_id", "text", "shard", "slot").collect()), key=repr) == sorted(expected, key=repr)


def test_order_is_random_and_stable(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    a = [r.doc_id for r in shard_records(docs, bucket_rows=40).orderBy("shard", "slot").collect()]
    b = [r.doc_id for r in shard_records(docs.repartition(7, "source").orderBy(F.desc("text")), bucket_rows=40).orderBy("shard", "slot").collect()]
    c = [r.doc_id for r in shard_records(docs, seed=14, bucket_rows=40).orderBy("shard", "slot").collect()]
    assert a == b != c
    n = len(a)
    moved = sum(abs(i - a.index(x)) for i, x in enumerate(sorted(a))) / n
    assert 0.2 * n < moved < 0.5 * n  # a third of n for a uniform order


def test_repeated_records_are_spread(spark):
    """A record that is a third of all rows fills no bucket."""
    rows = spark.range(600).selectExpr("id AS doc_id", "concat('text ', id) AS text").union(spark.range(300).selectExpr("-1L", "'same'"))
    got = shard_records(rows, bucket_rows=50, most_copies=5)
    assert Counter(r["shard"] for r in got.collect()).values() and sorted(Counter(r["shard"] for r in got.collect()).values()) == [112] * 4 + [113] * 4
    same = Counter(r["shard"] for r in got.filter("doc_id = -1").collect())
    assert len(same) == 8 and max(same.values()) < 80
    assert got.groupBy("doc_id").count().filter("doc_id >= 0 AND count > 1").count() == 0 and got.count() == 900


def test_edges(spark, tmp_path):
    docs = edge_docs(spark)
    clash = docs.withColumn("slot", F.lit("clash")).withColumn("row", F.lit(1)).withColumn("key", F.lit("clash")).withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    got = shard_records(clash, shards=4, bucket_rows=3)
    assert got.count() == docs.count() and dict(got.dtypes)["slot"] == "bigint" and {r["key"] for r in got.collect()} == {"clash"}
    read = op13_external_shuffle(spark, saved(docs, tmp_path)).collect()
    given = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in read) == given
    slots = {}
    for r in read:
        slots.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(slots.get(s, [])) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert op13_external_shuffle(spark, saved(empty_docs(spark), tmp_path / "none")).count() == 0
