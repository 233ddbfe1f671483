import hashlib
import heapq
import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from lexiforge.llm.mixing import BLOCK_DOCS, in_mix_order, integer_weights, mix_sources, op6_pfair_mixing, schedule
from tests.conftest import SMALL

from .data import edge_docs, empty_docs


def plain_schedule(weights, block_docs):
    """Earliest deadline first over all slots with one queue, windows from the flow's clock."""
    blocks = [-(-n // block_docs) for _, n, _ in weights]
    clock = lambda x: sum(min(w * x, b) for b, (_, _, w) in zip(blocks, weights, strict=True))
    released: dict = {}
    for i, (b, (_, _, w)) in enumerate(zip(blocks, weights, strict=True)):
        times = [clock(Fraction(j, w)) for j in range(b + 1)]
        for j in range(b):
            released.setdefault(math.floor(times[j]), []).append((math.ceil(times[j + 1]), i, j))
    queue, out = [], {}
    for t in range(sum(blocks)):
        for job in released.get(t, []):
            heapq.heappush(queue, job)
        due, i, j = heapq.heappop(queue)
        assert due > t
        out[(weights[i][0], j)] = (t, due)
    return out


def deviation(rows, weights, blocks):
    """The largest distance of any source from the flow at any time."""
    whole, worst, seen = [], Fraction(0), [0] * len(weights)
    ends = sorted(Fraction(b, w) for b, w in zip(blocks, weights, strict=True))
    clock = lambda x: sum(min(w * x, b) for b, w in zip(blocks, weights, strict=True))
    marks = [(clock(x), x) for x in [Fraction(0), *ends]]
    for at, i in enumerate(rows, 1):
        seen[i] += 1
        whole.append(at)
        k = max(n for n, (t, _) in enumerate(marks) if t <= at)
        active = sum(w for b, w in zip(blocks, weights, strict=True) if Fraction(b, w) > marks[k][1])
        x = marks[k][1] + (Fraction(at - marks[k][0], active) if active else 0)
        worst = max(worst, *(abs(s - min(w * x, b)) for s, w, b in zip(seen, weights, blocks, strict=True)))
    return worst


CASES = {
    "few": [("a", 4000, 100), ("b", 300, 31), ("c", 1000, 7), ("d", 5, 1), ("e", 2000, 50)],
    "heavy and light": [("a", 2400, 9999), ("b", 40, 1)],
    "many light": [("big", 1600, 500)] + [(f"s{i:02d}", 40 + i, 3 + i % 11) for i in range(60)],
    "roots": [(f"s{i}", n, int(n**0.5 * 10**6)) for i, n in enumerate((3000, 1100, 900, 800, 77, 13, 1))],
}


@pytest.mark.parametrize("case", CASES)
def test_schedule_is_edf_and_stays_within_a_block_of_exact_targets(spark, case):
    weights = CASES[case]
    rows = schedule(spark, weights, 4, frame_slots=32).collect()  # many frames
    got = {(r.mix_source, r.mix_block): (r.mix_position, r.mix_deadline) for r in rows}
    assert len(rows) == len(got) and got == plain_schedule(weights, 4)
    assert all(r.mix_release <= r.mix_position < r.mix_deadline for r in rows)
    names = [s for s, _, _ in weights]
    order = [names.index(r.mix_source) for r in sorted(rows, key=lambda r: r.mix_position)]
    assert deviation(order, [w for _, _, w in weights], [-(-n // 4) for _, n, _ in weights]) < 1


def test_one_frame_equals_many(spark):
    weights = CASES["many light"]
    assert sorted(schedule(spark, weights, 4, frame_slots=4096).collect()) == sorted(schedule(spark, weights, 4, frame_slots=1).collect())


def test_targets_are_not_rounded(spark):
    assert integer_weights([0.9999, 0.0001]) == [9999, 1]
    assert integer_weights([0.25, 1, 3]) == [1, 4, 12]
    docs = spark.range(24000).selectExpr("id doc_id", "CASE WHEN id < 23900 THEN 'big' ELSE 'small' END source")
    rows = mix_sources(docs, {"big": 0.9999, "small": 0.0001}, block_docs=2).filter("mix_source = 'small'").collect()
    early = [r for r in rows if r.mix_position < 11950]
    assert len({r.mix_block for r in early}) <= 2  # 11,950 blocks at one in 10,000


def test_every_document_once_in_order(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = op6_pfair_mixing(spark, SMALL).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert len({r.mix_order for r in rows}) == len(rows)
    by: dict = {}
    for r in rows:
        by.setdefault(r.mix_source, []).append(r)
    for group in by.values():
        ranked = sorted(group, key=lambda r: hashlib.md5(str(r.doc_id).encode()).hexdigest())
        assert [r.mix_block for r in ranked] == [i // BLOCK_DOCS for i in range(len(ranked))]
    written = [r.doc_id for r in in_mix_order(mix_sources(docs)).collect()]
    assert written == [r.doc_id for r in sorted(rows, key=lambda r: r.mix_order)]


def test_targets_and_small_ranges(spark):
    docs = spark.range(3000).selectExpr("id doc_id", "CASE WHEN id < 2000 THEN 'big' ELSE 'small' END source")
    rows = mix_sources(docs, {"big": 1.0, "small": 3.0}, block_docs=8, range_rows=32).orderBy("mix_order").collect()
    head = [r.mix_source for r in rows[:1200]]
    assert abs(head.count("small") - 900) <= 8 and math.isclose(len(rows), 3000)
    assert len({(r.mix_source, r.mix_block) for r in rows}) == 375


def test_edges(spark):
    docs = edge_docs(spark)
    made = mix_sources(docs)
    assert made.count() == docs.count() and made.columns[: len(docs.columns)] == docs.columns
    assert in_mix_order(made).columns == docs.columns
    assert mix_sources(empty_docs(spark)).count() == 0
    with pytest.raises(ValueError):
        mix_sources(docs, max_sources=1)
    with pytest.raises(ValueError):
        mix_sources(docs, {"a": 0.0})


def test_columns_with_clashing_names_survive(spark):
    names = ["before", "first", "held", "__hash", "hash", "range", "row", "rank", "id", "mine", "rows", "at", "f", "i", "j", "over"]
    docs = edge_docs(spark).select("*", *[F.lit(c).alias(c) for c in names])
    made = mix_sources(docs)
    assert made.columns[: len(docs.columns)] == docs.columns
    assert all(r[c] == c for r in made.collect() for c in names)
    assert sorted(map(repr, in_mix_order(made).collect())) == sorted(map(repr, docs.collect()))
