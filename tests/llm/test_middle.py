"""Fill-in-middle over frames against plain strings."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexiforge.llm.middle import Frame, FrameReader, FrameWriter, digests, fill_in_middle, numbers, op12_fill_in_middle, restored, text_frames, to_frames, transformed
from tests.conftest import SMALL

from .data import edge_docs, empty_docs, saved


def plain(doc_id, text, rate=100, spm_rate=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h1, h2, h3, h4 = numbers(doc_id)
    n, sha = len(units), lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < spm_rate else "psm"
    out = f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, form, len(p), len(m), sha(out), sha(text)


def test_hash_of_the_id():
    assert numbers(5) == [int(hashlib.sha256(b"7:5").hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab\né€𝄞<P>SM"), max_size=120), st.integers(8, 40), st.integers(0, 50))
def test_frames_of_any_size(text, size, doc_id):
    frames = to_frames(text.encode(), size)
    reader = FrameReader(frames)
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    assert b"".join(reader.stream((0, 0))).decode() == text
    assert (frames[-1].units, frames[-1].chars) == (len(units), len(text)) if frames else not text
    for k in range(len(units) + 1):
        place = reader.place(k)
        assert place[2] == len("".join(units[:k])) and b"".join(reader.stream((0, 0), place)).decode() == "".join(units[:k])
        assert b"".join(reader.stream(place)).decode() == "".join(units[k:])
    marked = bool(re.search("<[PSM]>", text))
    form, prefix, middle, out = transformed(reader, doc_id, len(units), marked, 100, 50, size)
    assert b"".join(restored(FrameReader(out), form)).decode() == text
    whole = b"".join(FrameReader(out).stream((0, 0))).decode()
    expected = plain(doc_id, text)
    assert (form, prefix, middle, hashlib.sha256(whole.encode()).hexdigest()) == (expected[2], expected[3], expected[4], expected[5])


def test_only_the_cut_frame_is_opened():
    frames = to_frames(b"line of text\n" * 5000, 4096)
    reader = FrameReader(frames)
    assert len(frames) > 10
    reader.place(2500)
    assert reader.opened == 1
    assert all(isinstance(f, Frame) for f in frames) and sum(len(f.data) for f in frames) < 5000 * 13 / 4


def test_mark_across_frames():
    writer = FrameWriter(8)
    for raw in (b"aaaaaaa", b"<S>", b"bbbbbbbbbbbbbb", b"<M>", b"c"):
        writer.write(raw)
    reader = FrameReader(writer.close())
    at = reader.find(b"<S>")
    assert b"".join(reader.stream((0, 0), at)) == b"aaaaaaa"
    assert b"".join(reader.stream(reader.forward(at, 3), reader.find(b"<M>"))) == b"bbbbbbbbbbbbbb"


@pytest.mark.parametrize("rate, spm_rate", [(100, 50), (40, 50), (0, 50), (100, 0), (100, 100)])
def test_documents_equal_plain(spark, rate, spm_rate):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = [tuple(r) for r in digests(fill_in_middle(text_frames(docs), rate, spm_rate)).collect()]
    assert sorted(got) == sorted(plain(r.doc_id, r.text, rate, spm_rate) for r in docs.collect())


def test_edges(spark, tmp_path):
    docs = edge_docs(spark)
    more = spark.createDataFrame([(20, "has <P> inside\nand more"), (21, "\n"), (22, "\n\n"), (23, "one"), (24, "x\x00\ny\r\nz")], "doc_id long, text string")
    both = docs.unionByName(more, allowMissingColumns=True)
    got = [tuple(r) for r in op12_fill_in_middle(spark, saved(both, tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted((plain(r.doc_id, r.text) for r in both.collect()), key=repr)
    assert op12_fill_in_middle(spark, saved(empty_docs(spark), tmp_path / "none")).count() == 0
