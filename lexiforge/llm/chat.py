"""Chat formatting over reply trees.

Messages form trees (node, parent). Iterative self-joins enumerate every root-to-leaf path: in each round a node's jump
pointer doubles its reach, so a path of n messages needs about log2(n) joins, and what a round holds is the paths
themselves. Branches are ranked by score within their tree, chosen paths become one formatted conversation each, with a
loss mask of (start, end) code point spans over assistant texts.

Template: each turn is `<s>`, role, newline, text, `</s>`. Control strings inside texts are escaped by one backslash
after their first character (any backslashes already there stay and one is added), which is undone by taking one away.

Defined results: null text or role counts as empty. Repeated rows and rows with equal turn are messages of their own,
ordered by turn, role, text. In other trees rows of one node id are one node, and each of its texts appears in every path
through it. A null tree id is a tree of its own. A parent that is not in its tree makes its child a root. Parents that
form a cycle (or a node that is its own parent) are cut at the cycle's lowest node id, which becomes a root; what hangs
below stays. Branches with equal scores go by leaf. Texts are taken whole: what one task renders is a batch of conversations.
`linear_tree` orders a conversation's rows in one task, which then also writes them as its one output row. An empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import kept, read_table, scratch, stored

#: Control strings of the template and of the instruction template it can be turned into.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
INSIDE = "|".join(re.escape(x[1:]) for x in CONTROL)
ESCAPE, UNESCAPE = re.compile(rf"([<\[])(\\*)({INSIDE})"), re.compile(rf"([<\[])\\(\\*)({INSIDE})")
TURN = re.compile(r"<s>([^\n]*)\n(.*?)</s>", re.S)

FORMATTED = "tree_id long, leaf long, n_turns long, score double, formatted string, loss_mask array<struct<start:int,end:int>>"
READ_BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    return ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1\2\3", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def linear_tree(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text -> messages whose parent is the previous row by turn."""
    order = Window.partitionBy("tree_id").orderBy("turn", "role", "text")
    return (
        rows.select(F.col("conv_id").cast("long").alias("tree_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("node_id", F.row_number().over(order).cast("long"))
        .withColumn("parent_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1))
        .select("tree_id", "node_id", "parent_id", "role", "text")
    )


def same(a: str, b: str, *pairs: tuple[str, str]) -> Column:
    found = F.col(f"{a}.tree_id").eqNullSafe(F.col(f"{b}.tree_id"))
    for x, y in pairs:
        found = found & (F.col(f"{a}.{x}") == F.col(f"{b}.{y}"))
    return found


def climbs(nodes: DataFrame) -> DataFrame:
    """tree_id, node_id, to, lowest: one step from each node to its parent; lowest of the nodes a step leaves behind."""
    there = nodes.select("tree_id", F.col("node_id").alias("to"))
    return stored(nodes.alias("n").join(there.alias("p"), same("n", "p", ("parent_id", "to"))).select("n.tree_id", "n.node_id", "p.to", F.col("n.node_id").alias("lowest")).distinct(), "jumps")


def doubled(jumps: DataFrame) -> DataFrame:
    """Jumps twice as far; those that would leave the tree end."""
    further = jumps.alias("a").join(jumps.alias("b"), same("a", "b", ("to", "node_id")))
    return stored(further.select("a.tree_id", "a.node_id", "b.to", F.least("a.lowest", "b.lowest").alias("lowest")), "jumps")


def root_paths(messages: DataFrame) -> DataFrame:
    """tree_id, leaf, node_id, up: every node of every root-to-leaf path, `up` steps above its leaf."""
    with scratch(messages.sparkSession):
        nodes = stored(messages.select("tree_id", "node_id", "parent_id").distinct(), "nodes")
        many, jumps = nodes.count(), climbs(nodes)
        levels = [jumps]
        # a path without a cycle has at most as many steps as there are nodes
        while not jumps.isEmpty() and 1 << len(levels) <= 2 * many:
            jumps = doubled(jumps)
            levels.append(jumps)
        if not jumps.isEmpty():
            # what still climbs has come into a cycle and been all around it: the lowest node there becomes a root
            cut = jumps.select("tree_id", F.col("to").alias("node_id")).distinct().alias("c").join(jumps.alias("j"), same("c", "j", ("node_id", "node_id"))).filter("j.node_id = j.lowest").select("c.tree_id", "c.node_id").distinct()
            open_nodes = nodes.alias("n").join(cut.alias("c"), same("n", "c", ("node_id", "node_id")), "left")
            nodes = stored(open_nodes.select("n.tree_id", "n.node_id", F.when(F.col("c.node_id").isNull(), F.col("n.parent_id")).alias("parent_id")), "nodes")
            levels = [climbs(nodes)]
            while not levels[-1].isEmpty():
                levels.append(doubled(levels[-1]))
        inner = levels[0].select("tree_id", F.col("to").alias("node_id")).distinct()
        leaves = nodes.alias("n").join(inner.alias("i"), same("n", "i", ("node_id", "node_id")), "left_anti")
        paths = leaves.select("tree_id", F.col("node_id").alias("leaf"), "node_id", F.lit(0).cast("long").alias("up"))
        for k, jumps in enumerate(levels[:-1]):
            above = paths.alias("p").join(jumps.alias("j"), same("p", "j", ("node_id", "node_id"))).select("p.tree_id", "p.leaf", F.col("j.to").alias("node_id"), (F.col("p.up") + (1 << k)).alias("up"))
            paths = stored(paths.unionByName(above), "paths")
        return kept(paths, "root-paths")


def default_score() -> Column:
    """Answered turns count most, then assistant characters."""
    assistant = F.col("role") == "assistant"
    return F.sum(F.when(assistant & (F.length("text") > 0), 1.0).otherwise(0.0)) + F.sum(F.when(assistant, F.length("text")).otherwise(0)) / 1e9


def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, masks = [], []
        for turns in batch.column("turns").to_pylist():
            parts, mask, at = [], [], 0
            for turn in sorted(turns, key=lambda x: -x["up"]):
                head, body = f"<s>{escape_role(turn['role'])}\n", escape(turn["text"])
                if turn["role"] == "assistant":
                    mask.append({"start": at + len(head), "end": at + len(head) + len(body)})
                parts += [head, body, "</s>"]
                at += len(head) + len(body) + 4
            texts.append("".join(parts))
            masks.append(mask)
        kept = {n: batch.column(n) for n in ("tree_id", "leaf", "n_turns", "score")}
        yield pa.RecordBatch.from_arrays([*kept.values(), pa.array(texts, pa.string()), pa.array(masks, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=[*kept, "formatted", "loss_mask"])


def format_chats(messages: DataFrame, score: Column | None = None, branches: int | None = None) -> DataFrame:
    """tree_id, node_id, parent_id, role, text -> one formatted conversation for each chosen path. `score` is an
    aggregate over a path's messages; the best `branches` paths of each tree are chosen, all when None."""
    paths = root_paths(messages)
    turns = paths.alias("p").join(messages.alias("m"), same("p", "m", ("node_id", "node_id"))).select("p.tree_id", "p.leaf", "p.up", "m.role", "m.text")
    whole = turns.groupBy("tree_id", "leaf").agg(F.count(F.lit(1)).alias("n_turns"), (default_score() if score is None else score).cast("double").alias("score"), F.collect_list(F.struct("up", "role", "text")).alias("turns"))
    if branches is not None:
        rank = F.row_number().over(Window.partitionBy("tree_id").orderBy(F.desc("score"), "leaf"))
        whole = whole.withColumn("branch", rank).filter(F.col("branch") <= branches).drop("branch")
    return whole.select("tree_id", "leaf", "n_turns", "score", "turns").mapInArrow(render, FORMATTED)


def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for tree, text, mask in zip(batch.column("tree_id").to_pylist(), batch.column("formatted").to_pylist(), batch.column("loss_mask").to_pylist(), strict=True):
            turns = [(unescape_role(m[1]), unescape(m[2])) for m in TURN.finditer(text)]
            loss = "".join(unescape(text[x["start"] : x["end"]]) for x in mask)
            said = "".join(f"{role}\n{body}\n" for role, body in turns)
            rows.append((tree, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
        names = [c.split()[0] for c in READ_BACK.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names=names)


def op10_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    own = spark.sql("SELECT -1L conv_id, 0L turn, 'user' role, '</s>[INST] ok [/INST]' text UNION ALL SELECT -1L, 1L, 'assistant', '</s>[INST] ok [/INST]'")
    with scratch(spark):
        chats = stored(format_chats(stored(linear_tree(given.unionByName(own)), "messages"), branches=1), "chats")
        return kept(chats.select("tree_id", "formatted", "loss_mask").mapInArrow(read_back, READ_BACK), "read-back")


#: conversations of one row per turn, texts free of control strings but for conversation -1: every column but the
#: formatted length's escapes is plain SQL; the escape adds one character for each control string.
OP10_SQL = """
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), escaped AS (
  SELECT *, regexp_replace(text, '([<\\[])(\\\\*)(s>|/s>|INST\\]|/INST\\]|<SYS>>|</SYS>>)', '\\1\\\\\\2\\3', 'g') AS body FROM given
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(role) + length(body) + 8) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""
