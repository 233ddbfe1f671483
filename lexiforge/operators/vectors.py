"""Exact nearest vectors by cells: only cells whose bound allows a better row are compared with a query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored

#: Cells at most; rows and queries that one product takes; row blocks of a cell that one task takes.
MOST_CELLS, ROW_BLOCK, QUERY_BLOCK, BLOCKS_AT_ONCE = 1024, 1024, 256, 16
#: Rows that a query's first cells hold between them, for each result asked for. Scores are rounded to six places.
PROBE, MARGIN = 20, 2e-6
#: Rows from which centres are taken, for each of them.
DRAWN = 4


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))


def scores(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Of each query of a with each row of b: the inner product with the unit query, or 1 / (1 + half the distance)."""
    if metric == "inner":
        return a @ b.T / np.linalg.norm(a, axis=1)[:, None]
    return 1 / (1 + distances(a, b) / 2)


def bounds(a: np.ndarray, centres: np.ndarray, radius: np.ndarray, metric: str) -> np.ndarray:
    """The most that any row of a cell can score: by the triangle inequality."""
    if metric == "inner":
        return scores(a, centres, metric) + radius[None]
    return 1 / (1 + np.maximum(distances(a, centres) - radius[None], 0) / 2)


def centre_rows(rows: DataFrame, n: int, cells: int) -> DataFrame:
    """The rows of the lowest hashes. Every task would send the driver `cells` of them, so first all rows but some DRAWN times
    as many as are wanted are left out by their hash alone."""
    hashed = rows.select("v", F.xxhash64("vec_id", F.lit("centre")).alias("h"))
    low = hashed.filter(F.col("h") < -(1 << 63) + ((1 << 64) * DRAWN * cells) // n) if n > DRAWN * cells else hashed
    return (hashed if low is not hashed and low.isEmpty() else low).orderBy("h").limit(cells)


def cell_search(rows: DataFrame, asked: DataFrame, k: int, metric: str, compared: dict[str, int] | None = None) -> DataFrame:
    """rows(vec_id, v) and asked(vec_id, v) -> query_id, doc_id, score, rank: the exact k best rows of each query.

    Centres are rows drawn by a hash, about the square root of the rows and MOST_CELLS at most; every row goes to its nearest
    one. A query first meets the cells of the highest bounds until they hold PROBE rows for each result; its k-th score then
    rules out every other cell whose bound is lower, and the rest are met in a second round. A cell with very many rows is
    cut into blocks that are dealt out. `compared`, if given, receives how many pairs all and these cells make."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v")).filter("v IS NOT NULL")
    n = rows.count()
    if not n:
        return rows.select(F.col("vec_id").alias("query_id"), F.col("vec_id").alias("doc_id"), F.lit(0.0).alias("score"), F.lit(1).alias("rank"))
    cells = min(MOST_CELLS, max(1, round(n**0.5)))
    drawn = centre_rows(rows, n, cells).collect()
    centres = np.array([r["v"] for r in drawn], dtype=np.float64)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = distances(matrix(batch.column("v")), centres)
            near = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(near.astype(np.int32)), pa.array(far[np.arange(len(near)), near])], names=["vec_id", "v", "cell", "far"])

    held = stored(rows.mapInArrow(assign, "vec_id long, v array<double>, cell int, far double"), "cells")
    facts = {r["cell"]: (r["far"], r["n"]) for r in held.groupBy("cell").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect()}
    radius = np.array([facts.get(c, (0.0, 0))[0] for c in range(len(centres))]) + 1e-9
    sizes = np.array([facts.get(c, (0.0, 0))[1] for c in range(len(centres))])
    deals = np.maximum(1, -(-sizes // (ROW_BLOCK * BLOCKS_AT_ONCE)))

    def visits(batches: Iterator[pa.RecordBatch], second: bool) -> Iterator[pa.RecordBatch]:
        """query_id, v, cell, part: the first cells of each query, or those after them that its k-th score leaves."""
        for batch in batches:
            most = bounds(matrix(batch.column("v")), centres, radius, metric)
            order = np.argsort(-most, axis=1, kind="stable")
            before = np.cumsum(sizes[order], axis=1) - sizes[order]
            chosen = before < k * PROBE
            if second:
                least = batch.column("least").to_numpy(zero_copy_only=False)
                chosen = ~chosen & (np.take_along_axis(most, order, axis=1) >= least[:, None] - MARGIN)
            query, at = np.nonzero(chosen & (sizes[order] > 0))
            cell = order[query, at]
            parts = deals[cell]
            take = np.repeat(np.arange(len(query)), parts)
            part = np.arange(len(take)) - np.repeat(np.cumsum(parts) - parts, parts)
            yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(query[take])), batch.column("v").take(pa.array(query[take])), pa.array(cell[take].astype(np.int32)), pa.array(part.astype(np.int32))], names=["query_id", "v", "cell", "part"])

    spread = F.create_map(*[F.lit(x) for c, m in enumerate(deals) if m > 1 for x in (c, int(m) * BLOCKS_AT_ONCE)]) if (deals > 1).any() else None
    block = F.pmod(F.xxhash64("vec_id"), F.coalesce(spread[F.col("cell")], F.lit(BLOCKS_AT_ONCE)) if spread is not None else F.lit(BLOCKS_AT_ONCE)).cast("int")
    blocks = held.withColumn("block", block).groupBy("cell", "block").agg(F.collect_list("vec_id").alias("ids"), F.collect_list("v").alias("vs"))
    blocks = stored(blocks.select("cell", F.expr(f"block div {BLOCKS_AT_ONCE}").cast("int").alias("part"), "ids", "vs"), "blocks")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                ids, vs, qids, qs = (batch.column(c)[at].values for c in ("ids", "vs", "qids", "qs"))
                ids, qids = ids.to_numpy(zero_copy_only=False), qids.to_numpy(zero_copy_only=False)
                score = np.round(scores(matrix(qs), matrix(vs), metric), 6)
                order = np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, order.shape[1])), pa.array(ids[order].reshape(-1)), pa.array(np.take_along_axis(score, order, axis=1).reshape(-1))], names=["query_id", "doc_id", "score"])

    def met(queries: DataFrame) -> DataFrame:
        """query_id, doc_id, score: of each query's cells the k best rows of each block."""
        packed = queries.groupBy("cell", "part", F.pmod(F.xxhash64("query_id"), F.lit(1 + asked_count // QUERY_BLOCK)).alias("q")).agg(F.collect_list("query_id").alias("qids"), F.collect_list("v").alias("qs"))
        pairs = blocks.join(packed, ["cell", "part"]).select("ids", "vs", "qids", "qs")
        return stored(pairs.mapInArrow(best, "query_id long, doc_id long, score double"), "met")

    at = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    asked = stored(asked.select(F.col("vec_id").cast("long").alias("query_id"), F.col("v").cast("array<double>").alias("v")).filter("v IS NOT NULL"), "asked")
    asked_count = asked.count()
    visit = "query_id long, v array<double>, cell int, part int"
    first_cells = stored(asked.mapInArrow(lambda b: visits(b, False), visit), "visits")
    first = met(first_cells)
    kth = first.withColumn("at", F.row_number().over(at)).filter(F.col("at") == k).select("query_id", F.col("score").alias("least"))
    again = asked.join(kth, "query_id", "left").select("query_id", "v", F.coalesce("least", F.lit(-float("inf"))).alias("least"))
    more_cells = stored(again.mapInArrow(lambda b: visits(b, True), visit), "visits")
    if compared is not None:
        seen = first_cells.unionByName(more_cells).filter("part = 0").groupBy("cell").count().collect()
        compared |= {"all": n * asked_count, "cells": sum(r["count"] * int(sizes[r["cell"]]) for r in seen)}
    return first.unionByName(met(more_cells)).withColumn("rank", F.row_number().over(at)).filter(F.col("rank") <= k)
