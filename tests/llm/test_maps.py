"""Operators that map documents, against plain brute-force versions."""

import hashlib
import io
import re
import struct
import wave
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexiforge.llm.arrow import mix64
from lexiforge.llm.language import MIN_RATIO, MIN_SHARE, SIZES, SLOTS, WEIGHTS, fit, held_out, op3_language_filters, predictor
from lexiforge.llm.media import BANDS, fingerprint, fingerprints, from_wav, op7_wav_fingerprints, to_media
from lexiforge.llm.pieces import Pieces, op9_streaming_viterbi, piece_encoder
from lexiforge.llm.quality import MAX_DUPLICATE_SHARE, op4_repetition_coverage, quality
from lexiforge.llm.tokens import op2_token_files, token_files
from tests.conftest import SMALL

from .data import edge_docs, empty_docs, saved


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_quality(text):
    text = text or ""
    ws = words(text)
    lines, seen, twice, twice_chars = [x for x in text.split("\n") if words(x)], set(), 0, 0
    for line in lines:
        if line in seen:
            twice += 1
            twice_chars += sum(map(len, words(line)))
        seen.add(line)

    def marked(n, later):
        count, at, hit = {}, {}, set()
        for i in range(len(ws) - n + 1):
            g = tuple(ws[i : i + n])
            count[g] = count.get(g, 0) + 1
            at.setdefault(g, []).append(i)
        for g, c in count.items():
            if c > 1:
                for i in at[g][1 if later else 0 :]:
                    hit.update(range(i, i + n))
        return hit

    chars = sum(map(len, ws))
    repeat = len(marked(3, False))
    shares = [sum(len(ws[i]) for i in marked(n, True)) for n in MAX_DUPLICATE_SHARE]
    failed = len(ws) < 50 or 100 * repeat > 50 * len(ws)
    over = any(s > m * chars for s, m in zip(shares, MAX_DUPLICATE_SHARE.values(), strict=True)) or twice > 0.3 * len(lines) or twice_chars > 0.2 * chars
    return (len(ws), chars, sum(text.count(c) for c in "#*$%&|<>"), twice, repeat, shares, failed, not failed and not over)


def as_quality(r):
    return (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.dup_ngram_chars, r.base_failed, r.kept)


def test_quality_equals_brute_force(spark, docs):
    got = {r.doc_id: as_quality(r) for r in op4_repetition_coverage(spark, SMALL).collect()}
    assert got == {i: plain_quality(t) for i, t in docs}
    assert any(x[-1] for x in got.values()) and not all(x[-1] for x in got.values())


def test_quality_edges(spark):
    edge = edge_docs(spark)
    expected = sorted(map(repr, (plain_quality(r.text) for r in edge.collect())))
    assert sorted(repr(as_quality(r)) for r in quality(edge).collect()) == expected
    assert quality(empty_docs(spark)).count() == 0


def plain_tokens(rows):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out, start = [], 0
    for i, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def test_token_files_equal_the_library(spark, docs):
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in op2_token_files(spark, SMALL).collect())
    assert got == plain_tokens(docs)


def test_token_files_edges(spark, tmp_path):
    edge = edge_docs(spark)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in op2_token_files(spark, saved(edge, tmp_path / "a")).collect()]
    assert sorted(got, key=lambda r: r[1]) == plain_tokens([(r.doc_id, r.text) for r in edge.collect()])
    assert op2_token_files(spark, saved(empty_docs(spark), tmp_path / "b")).count() == 0


def test_token_files_prune_columns_and_rows(spark):
    files = token_files(edge_docs(spark), public_tokenizers.path("word_bpe_49k.json"))
    plan = files.filter("doc_id = 5").select("n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,n_tokens:bigint>" in plan and "EqualTo(doc_id,5)" in plan


def test_media_round_trip(spark, docs):
    got = {r.doc_id: r for r in op7_wav_fingerprints(spark, SMALL).collect()}
    for i, text in docs:
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    media = to_media(edge_docs(spark)).collect()
    for m in media:
        with wave.open(io.BytesIO(bytes(m.media))) as w:
            assert w.getsampwidth() == 1 and w.getnframes() % 64 == 0 and w.getnframes() >= 64
    found = fingerprints(spark.createDataFrame(media)).collect()
    same = [r for r in found if r.doc_id == 6]
    assert same[0].fingerprint == same[1].fingerprint and len(same[0].fingerprint) > 0
    assert all(list(r.fingerprint) == sorted(r.fingerprint) for r in found)
    assert next(r for r in found if r.doc_id == 3).fingerprint == []
    assert fingerprints(to_media(empty_docs(spark))).count() == 0


def plain_peaks(samples):
    """(frame, bin): a plain discrete Fourier transform of every frame."""
    size, hop = 256, 128
    x = [float(v) - 128 for v in samples]
    while len(x) < size or (len(x) - size) % hop:
        x.append(0.0)
    turn = np.exp(-2j * np.pi * np.outer(np.arange(size), np.arange(size // 2 + 1)) / size)
    level = []
    for at in range(0, len(x) - size + 1, hop):
        frame = np.array(x[at : at + size]) * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / (size - 1)))
        level.append(np.abs(frame @ turn))
    best = [[(max(range(a, b), key=lambda k: (row[k], -k))) for a, b in BANDS] for row in level]
    loud = [[round(float(row[k]), 3) for k in ks] for row, ks in zip(level, best, strict=True)]
    quiet = [0.0] * len(BANDS)
    found = []
    for i, row in enumerate(loud):
        before, after = loud[i - 1] if i else quiet, loud[i + 1] if i + 1 < len(loud) else quiet
        found += [(i, best[i][b]) for b in range(len(BANDS)) if row[b] > 1 and row[b] >= before[b] and row[b] >= after[b]]
    return found


def plain_fingerprint(samples):
    at, out = plain_peaks(samples), []
    for i, (frame, first) in enumerate(at):
        for other, second in at[i + 1 : i + 4]:
            if 1 <= other - frame <= 15:
                out.append((frame << 32) | (first << 16) | (second << 4) | (other - frame))
    return sorted(out)


def test_fingerprints_equal_a_plain_transform(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").filter("length(text) < 4000").unionByName(edge_docs(spark).select("doc_id", "text", "lang", "source", "n_chars"))
    media = to_media(docs)
    rows = {bytes(r.media) for r in media.limit(60).collect()}
    assert len(rows) > 40
    for m in rows:
        samples = np.frombuffer(from_wav(m), dtype=np.uint8)
        assert fingerprint(samples).tolist() == plain_fingerprint(samples)


def test_media_query_digests_the_stored_arrays(spark):
    got = {r.doc_id: r.feature for r in op7_wav_fingerprints(spark, SMALL).collect()}
    for r in fingerprints(to_media(spark.read.parquet(f"{SMALL}/documents.parquet"))).limit(30).collect():
        assert got[r.doc_id] == f"{len(r.fingerprint)}:{hashlib.sha256(','.join(map(str, r.fingerprint)).encode()).hexdigest()}"


def plain_grams(text):
    """Distinct 3- and 4-grams of letters in small form, with one space for anything else."""
    t = "".join(c if c.isalpha() else " " for c in f" {(text or '').lower()} ")
    t = re.sub(" +", " ", t)
    return [(n, t[i : i + n]) for n in SIZES for i in range(len(t) - n + 1)]


def plain_hash(n, gram):
    total = sum(ord(c) * int(w) for c, w in zip(gram, WEIGHTS, strict=False)) % 2**64
    return int(mix64(np.array([(total + n) % 2**64], dtype=np.uint64))[0])


def plain_filter(rows):
    """Slot -> mask, and languages, by sets in one loop."""
    languages, held, size = sorted({r.lang for r in rows}), {}, {}
    for r in rows:
        size[r.lang] = size.get(r.lang, 0) + 1
        for g in set(plain_grams(r.text)):
            held.setdefault(g, {}).setdefault(r.lang, 0)
            held[g][r.lang] += 1
    mask = {}
    for (n, g), count in held.items():
        share = {k: c / size[k] for k, c in count.items() if c >= 2 and c / size[k] >= MIN_SHARE}
        for k, p in share.items():
            if p >= MIN_RATIO * max(share.values()):
                for i in range(3):
                    slot = plain_hash(n, g) >> (21 * i) & (SLOTS - 1)
                    mask[slot] = mask.get(slot, 0) | 1 << languages.index(k)
    return languages, mask


def plain_prediction(languages, mask, text):
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    grams, shares = plain_grams(text), []
    for b in range(len(languages)):
        rate = (sum(m >> b & 1 for m in mask.values()) / SLOTS) ** 3
        hits = sum(all(mask.get(plain_hash(n, g) >> (21 * i) & (SLOTS - 1), 0) >> b & 1 for i in range(3)) for n, g in grams) / len(grams)
        shares.append(min(1.0, max(0.0, (hits - rate) / (1 - rate))))
    best = max(range(len(languages)), key=lambda b: (shares[b], -b))
    return (languages[best], shares[best] / sum(shares)) if shares[best] > 0 else (None, 0.0)


def test_language_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").filter("length(text) < 3000")
    learned = docs.filter(~held_out()).filter("lang IS NOT NULL AND lang <> '' AND text IS NOT NULL")
    languages, mask = plain_filter(learned.collect())
    filters = fit(learned)
    assert filters.languages == languages
    assert {int(i): int(filters.table[i]) for i in np.flatnonzero(filters.table)} == mask
    for r in docs.withColumn("found", predictor(spark, filters)("text")).limit(40).collect():
        said, score = plain_prediction(languages, mask, r.text)
        assert said in (None, r.found.lang_pred) and abs(score - r.found.score) < 1e-9


def test_language_accuracy_held_out(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = [r for r in op3_language_filters(spark, folder).collect() if r.held_out]
    right = [truth[r.doc_id] == r.lang_pred for r in got if r.lang_pred != "und"]
    assert len(got) > 100 and np.mean(right) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark):
    docs = edge_docs(spark)
    made = docs.withColumn("found", predictor(spark, fit(docs.filter(~held_out())))("text"))
    found = {(r.doc_id, r.text): r.found for r in made.collect()}
    assert made.columns[: len(docs.columns)] == docs.columns
    assert all((f.lang_pred == "und") == (not any(c.isalpha() for c in t or "")) for (_, t), f in found.items())
    empty = empty_docs(spark)
    assert empty.withColumn("found", predictor(spark, fit(empty))("text")).count() == 0
    assert docs.withColumn("found", predictor(spark, fit(empty))("text")).filter("found.lang_pred <> 'und'").count() == 0


def plain_viterbi(model, text):
    """The whole lattice at once."""
    if not text:
        return []
    units = ["\0mark" if c == "▁" else "▁" if c == " " else c for c in " " + text]
    best, back = [0.0] + [None] * len(units), [None] * (len(units) + 1)
    for end in range(1, len(units) + 1):
        for start in range(max(0, end - model.longest), end):
            piece = model.scores.get("".join(units[start:end]))
            if piece and (best[end] is None or best[start] + piece[0] > best[end]):
                best[end], back[end] = best[start] + piece[0], (start, [piece[1]])
        if best[end] is None:
            ids = model.byte_ids("▁" if units[end - 1] == "\0mark" else units[end - 1])
            best[end], back[end] = best[end - 1] + model.byte_score * len(ids), (end - 1, ids)
    path, at = [], len(units)
    while at:
        path.append(back[at][1])
        at = back[at][0]
    return [i for ids in reversed(path) for i in ids]


def test_streaming_viterbi_equals_whole_lattice(spark, docs):
    model = Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    texts = [t for _, t in docs[:40]] + [r.text for r in edge_docs(spark).collect()] + ["ab" * 700 + "é漢字😀" * 30]
    texts.append("".join(map(chr, range(0xFDD0, 0xFDF0))) + "▁▁ ▁a▁ b" + "▁" * 200)
    for text in texts:
        text = text or ""
        expected = plain_viterbi(model, text)
        assert model.encode(text).tolist() == expected
        assert list(model.viterbi(" " + text if text else "")) == expected
        assert model.decode(expected) == text


def test_pieces_round_trip(spark, tmp_path):
    assert op9_streaming_viterbi(spark, SMALL).filter("NOT round_trip").count() == 0
    edge = op9_streaming_viterbi(spark, saved(edge_docs(spark), tmp_path))
    assert edge.filter("NOT round_trip").count() == 0 and edge.filter("n_pieces = 0").count() == 2
    assert op9_streaming_viterbi(spark, saved(empty_docs(spark), tmp_path / "none")).count() == 0


def test_pieces_keep_clashing_columns(spark):
    docs = edge_docs(spark).withColumn("ids", F.lit("mine")).withColumn("decoded", F.lit("too"))
    made = docs.withColumn("found", piece_encoder(public_tokenizers.path("piece_bpe_32k.model"))("text"))
    assert made.columns == [*docs.columns, "found"] and made.filter("ids <> 'mine' OR decoded <> 'too'").count() == 0
