"""Exact top k of weighted postings that leaves common tokens of hopeless documents untouched."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import kept, scratch, stored
from .joins import join_hot

#: Postings that a query's first slots hold between them, for each result asked for, before its threshold is taken.
SEED_POSTINGS = 40
#: Scores that differ by less than this share of a query's best may tie once rounded.
MARGIN = 2e-6


def pruned_top_k(asked: DataFrame, posted: DataFrame, k: int, moved: dict[str, int] | None = None) -> DataFrame:
    """query_id, doc_id, score, n_slots: every document that is among a query's k best or may tie with the last of them.

    asked(query_id, slot, token, w) names the tokens that can fill a slot of a query; posted(doc_id, token, part) holds each
    pair once, parts and weights not negative. A document's score is the sum over slots of the best w * part in it.

    Slots are ordered by the most they can add. The first ones, until they hold enough postings, give k documents whose
    whole scores bound the k-th best from below. Slots from which on all together stay under that bound can bring no new
    document: only documents of the slots before them are gathered, those that can't reach the bound even so are dropped,
    and the rest's other slots are looked up by document and token. Tokens that very many documents hold are dealt out over
    tasks. `moved`, if given, receives how many posting rows the plain join and this one touch.
    """
    with scratch(asked.sparkSession):
        stats = stored(posted.groupBy("token").agg(F.max("part").alias("top"), F.count(F.lit(1)).alias("n")), "topk-tokens")
        met = stored(asked.join(stats, "token").withColumn("most", F.col("w") * F.col("top")), "topk-asked")
        slots = met.groupBy("query_id", "slot").agg(F.max("most").alias("most"), F.sum("n").alias("n"))
        order = Window.partitionBy("query_id").orderBy(F.desc("most"), "slot")
        before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        after = F.sum("most").over(order.rowsBetween(0, Window.unboundedFollowing))
        slots = stored(slots.withColumn("before", before).withColumn("left", after), "topk-slots")

        def gathered(chosen: DataFrame) -> DataFrame:
            """query_id, doc_id, score, n_slots over the chosen slots(query_id, slot)."""
            mine = met.join(chosen, ["query_id", "slot"], "left_semi")
            lists = mine.groupBy("token").agg(F.collect_list(F.struct("query_id", "slot", "w")).alias("askers"))
            rows = join_hot(posted.join(lists.select("token"), "token", "left_semi"), lists, "token", stats.select("token", "n"))
            each = rows.select("doc_id", "part", F.explode("askers").alias("a")).select("a.query_id", "a.slot", "doc_id", (F.col("a.w") * F.col("part")).alias("value"))
            best = each.groupBy("query_id", "doc_id", "slot").agg(F.max("value").alias("value"))
            return best.groupBy("query_id", "doc_id").agg(F.sum("value").alias("score"), F.count(F.lit(1)).alias("n_slots"))

        def looked_up(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
            """query_id, doc_id, added, slots: what these tokens(query_id, slot, token, w) add to each pair."""
            each = pairs.select("query_id", "doc_id").join(tokens, "query_id").join(posted, ["doc_id", "token"])
            best = each.groupBy("query_id", "doc_id", "slot").agg(F.max(F.col("w") * F.col("part")).alias("value"))
            return best.groupBy("query_id", "doc_id").agg(F.sum("value").alias("added"), F.count(F.lit(1)).alias("slots"))

        at = Window.partitionBy("query_id").orderBy(F.desc("score"))
        seeds = gathered(slots.filter(F.col("before") < k * SEED_POSTINGS).select("query_id", "slot"))
        seeds = stored(seeds.withColumn("at", F.row_number().over(at)).filter(F.col("at") <= k), "topk-seeds")
        kth = looked_up(seeds, met.select("query_id", "slot", "token", "w")).groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("added")).otherwise(0.0).alias("least"))
        bound = stored(kth.select("query_id", (F.col("least") * (1 - MARGIN) - 1e-12).alias("least")), "topk-bound")

        cut = stored(slots.join(bound, "query_id").withColumn("needed", F.col("left") >= F.col("least")).select("query_id", "slot", "most", "left", "least", "needed"), "topk-cut")
        rest = cut.groupBy("query_id").agg(F.coalesce(F.max(F.when(~F.col("needed"), F.col("left"))), F.lit(0.0)).alias("rest"), F.first("least").alias("least"))
        found = gathered(cut.filter("needed").select("query_id", "slot")).join(rest, "query_id").filter(F.col("score") + F.col("rest") >= F.col("least"))
        found = stored(found.select("query_id", "doc_id", "score", "n_slots"), "topk-found")
        others = met.join(cut.filter("NOT needed").select("query_id", "slot"), ["query_id", "slot"], "left_semi").select("query_id", "slot", "token", "w")
        more = looked_up(found, others)
        whole = found.join(more, ["query_id", "doc_id"], "left").select("query_id", "doc_id", (F.col("score") + F.coalesce("added", F.lit(0.0))).alias("score"), (F.col("n_slots") + F.coalesce("slots", F.lit(0))).alias("n_slots"))
        ranked = whole.withColumn("at", F.row_number().over(at))
        query = Window.partitionBy("query_id")
        last = F.coalesce(F.max(F.when(F.col("at") == k, F.col("score"))).over(query), F.lit(0.0)) - MARGIN * F.max("score").over(query)
        if moved is not None:
            needed = met.join(cut.filter("needed"), ["query_id", "slot"], "left_semi").agg(F.sum("n")).first()[0] or 0
            moved |= {"plain": met.agg(F.sum("n")).first()[0] or 0, "pruned": needed + found.select("query_id").join(others, "query_id").count()}
        return kept(ranked.withColumn("last", last).filter(F.col("score") >= F.col("last")).select("query_id", "doc_id", "score", "n_slots"), "topk")


#: Cells of documents by tokens that are filled at once.
CELLS = 1 << 19


class Alternatives:
    """Queries whose slots may be filled by any of many words, as arrays: of each word its tokens and weights, of each query
    its tokens."""

    def __init__(self, near: pa.Table, asked: pa.Table):
        """near(token, word, w), asked(query_id, token)."""
        token, word = (pc.dictionary_encode(near[c].combine_chunks()) for c in ("token", "word"))
        order = np.argsort(word.indices.to_numpy(), kind="stable")
        self.words = word.dictionary
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(word.indices.to_numpy(), minlength=len(self.words)))])
        self.tokens, self.weights = token.indices.to_numpy()[order].astype(np.int64), near["w"].to_numpy()[order]
        self.n_tokens = len(token.dictionary)
        slots = pc.index_in(asked["token"].combine_chunks(), value_set=token.dictionary)
        asked = asked.filter(slots.is_valid())
        query, slots = asked["query_id"].to_numpy(), slots.drop_null().to_numpy().astype(np.int64)
        order = np.argsort(query, kind="stable")
        self.slots = slots[order]
        self.queries, self.begins = np.unique(query[order], return_index=True)
        top = np.zeros(self.n_tokens)
        np.maximum.at(top, self.tokens, self.weights)
        self.most = float(np.add.reduceat(top[self.slots], self.begins).max()) if len(self.queries) else 0.0

    def scores(self, lists: pa.ListArray, part: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
        """Of runs of the documents' token lists the first document and all scores, a row a document and a column a query;
        part(tf, length) is what a word counts for."""
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        found = pc.fill_null(pc.index_in(lists.flatten(), value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        step = max(1, CELLS // max(self.n_tokens, len(self.slots)))
        for low in range(0, len(lists), step):
            high = min(low + step, len(lists))
            n, mine = lengths[low:high], found[ends[low] : ends[high]]
            held, tf = np.unique((np.repeat(np.arange(high - low), n) * len(self.words) + mine)[mine >= 0], return_counts=True)
            row, word = np.divmod(held, len(self.words))
            value, many = part(tf, n[row]), self.starts[word + 1] - self.starts[word]
            at = np.repeat(self.starts[word] - np.cumsum(many) + many, many) + np.arange(many.sum())
            best = np.zeros((high - low) * self.n_tokens)
            np.maximum.at(best, np.repeat(row * self.n_tokens, many) + self.tokens[at], np.repeat(value, many) * self.weights[at])
            yield low, np.add.reduceat(best.reshape(high - low, -1)[:, self.slots], self.begins, axis=1)


def alternatives_top_k(asked: DataFrame, near: DataFrame, held: DataFrame, k: int, part: Callable[[np.ndarray, np.ndarray, float], np.ndarray], most: float) -> DataFrame:
    """query_id, doc_id, score: every document that is, by any one field, among a query's k best or may tie with the last of
    them, and some more. A document's score is the sum over a query's tokens of the best w * part of their words in it.

    asked(query_id long, field, token), near(field, token, word, w), held(doc_id, field, tokens, mean); part(tf, length,
    mean), `most` at most, is what a word counts for. Where tokens have many words each, those rows far outnumber the
    documents' words, so they are never written out: queries and their near words go to every task, documents are scored
    where they are, and a task gives out what can be among its own k best."""
    spark = asked.sparkSession
    asked, near = asked.select("query_id", "field", "token").toArrow(), near.select("field", "token", "word", "w").toArrow()
    of = lambda t, f: t.filter(pc.equal(t["field"], f))
    made = {f: Alternatives(of(near, f), of(asked, f)) for f in pc.unique(near["field"]).to_pylist()}
    slack = MARGIN * most * max((a.most for a in made.values()), default=0.0)
    shared = spark.sparkContext.broadcast(made)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        best = {f: np.zeros((len(a.queries), k)) for f, a in tables.items()}
        for batch in batches:
            for f, a in tables.items():
                rows = batch.filter(pc.equal(batch["field"], f))
                if not rows.num_rows or not len(a.queries):
                    continue
                docs, mean = rows["doc_id"].to_numpy(), rows["mean"][0].as_py()
                for low, scores in a.scores(rows["tokens"], lambda tf, n, mean=mean: part(tf, n, mean)):
                    best[f] = np.partition(np.concatenate([best[f], scores.T], axis=1), -k, axis=1)[:, -k:]
                    doc, query = np.nonzero((scores > 0) & (scores >= best[f].min(axis=1) - slack))
                    yield pa.RecordBatch.from_arrays([pa.array(a.queries[query]), pa.array(docs[low + doc]), pa.array(scores[doc, query])], ["query_id", "doc_id", "score"])

    found = held.select("doc_id", "field", "tokens", "mean").mapInArrow(scored, "query_id long, doc_id long, score double")
    return found.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
