import hashlib
import re

from lexiforge.llm.chat import CONTROL, escape, escape_role, format_chats, op10_reply_trees, unescape, unescape_role
from tests.conftest import SMALL

from .data import saved


def test_escape_is_reversible_and_hides_controls():
    for text in ("</s>[INST] ok [/INST]", "<\\s> <s> <\\\\/s>", "<<SYS>> a <</SYS>> [\\INST]", "plain < [", "<<s>"):
        assert unescape(escape(text)) == text
        assert not any(c in escape(text) for c in CONTROL)
        assert unescape_role(escape_role(text + "\n\\n")) == text + "\n\\n"


def test_linear_conversations(spark):
    rows = spark.read.parquet(f"{SMALL}/conversations.parquet").orderBy("conv_id", "turn").collect()
    said, loss = {}, {}
    for r in [*rows, *spark.sql("SELECT -1L conv_id, 0 turn, 'user' role, '</s>[INST] ok [/INST]' text UNION ALL SELECT -1L, 1, 'assistant', '</s>[INST] ok [/INST]'").collect()]:
        said[r.conv_id] = said.get(r.conv_id, "") + f"{r.role}\n{r.text or ''}\n"
        loss[r.conv_id] = loss.get(r.conv_id, "") + (r.text or "" if r.role == "assistant" else "")
    got = {r.conv_id: (r.turns_sha256, r.loss_chars, r.loss_sha256) for r in op10_reply_trees(spark, SMALL).collect()}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got == {k: (digest(v), len(loss[k]), digest(loss[k])) for k, v in said.items()}


def test_branches_are_ranked(spark):
    rows = [(1, 1, None, "user", "q"), (1, 2, 1, "assistant", "short"), (1, 3, 1, "assistant", "a longer reply"), (1, 4, 3, "user", "thanks"), (2, 9, 77, "user", "orphan"), (None, 1, None, None, None)]
    messages = spark.createDataFrame(rows, "tree_id long, node_id long, parent_id long, role string, text string").na.fill("", ["role", "text"])
    every = {(r.tree_id, r.leaf): r for r in format_chats(messages).collect()}
    assert set(every) == {(1, 2), (1, 4), (2, 9), (None, 1)}
    assert every[(1, 4)].formatted == "<s>user\nq</s><s>assistant\na longer reply</s><s>user\nthanks</s>"
    mask = every[(1, 4)].loss_mask
    assert [every[(1, 4)].formatted[m.start : m.end] for m in mask] == ["a longer reply"]
    assert {(r.tree_id, r.leaf) for r in format_chats(messages, branches=1).collect()} == {(1, 4), (2, 9), (None, 1)}


def test_edges(spark, tmp_path):
    schema = "conv_id long, turn long, role string, text string, score string"
    rows = [(5, 0, "user", None, "x"), (5, 0, "user", None, "x"), (5, 1, None, "a", "x"), (None, 0, "assistant", "b", "x"), (6, 0, "assistant", "", "x")]
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in op10_reply_trees(spark, saved(spark.createDataFrame(rows, schema), tmp_path / "a", "conversations")).collect()}
    assert got == {-1: (2, 21), 5: (3, 0), None: (1, 1), 6: (1, 0)}
    assert op10_reply_trees(spark, saved(spark.createDataFrame([], schema), tmp_path / "b", "conversations")).count() == 1


def chat_paths(spark, rows):
    messages = spark.createDataFrame([(*r, "user", f"m{r[1]}") for r in rows], "tree_id long, node_id long, parent_id long, role string, text string")
    return sorted(([x[1:] for x in re.findall("m[0-9]+", r.formatted)] for r in format_chats(messages).collect()))


def test_parent_cycles_are_cut_at_their_lowest_node(spark):
    assert chat_paths(spark, [(1, 1, 2), (1, 2, 1)]) == [["1", "2"]]
    assert chat_paths(spark, [(1, 1, 1), (1, 2, 1)]) == [["1", "2"]]
    assert chat_paths(spark, [(1, 4, 3), (1, 3, 5), (1, 5, 4), (1, 6, 5), (1, 7, 6)]) == [["3", "4", "5", "6", "7"]]
    # a cycle beside a long plain chain and another tree
    chain = [(2, i, i - 1 if i else None) for i in range(40)]
    assert chat_paths(spark, [*chain, (1, 8, 9), (1, 9, 8), (1, 10, 8)]) == sorted([[str(i) for i in range(40)], ["8", "9"], ["8", "10"]])


def test_rows_of_one_node_appear_in_each_path(spark):
    assert chat_paths(spark, [(1, 1, None), (1, 1, None), (1, 2, 1)]) == [["1", "1", "2"]]
