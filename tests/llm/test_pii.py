import collections
import hashlib
import re

import regex
from pyspark.sql import functions as F

from lexiforge.llm import pii
from lexiforge.llm.pii import op8_contextual_pii, redact, with_spans
from tests.conftest import SMALL

from .data import edge_docs, empty_docs

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def good(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and luhn(d)
    return kind == "email" or 9 <= len(d) <= 15


def plain(text):
    spans = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if good(kind, m[0])]
    return [(kind, a, b) for a, _, b, kind in sorted(spans)]


def slots(text):
    """(start, end, instance, the two patterns around, whether a candidate) of each word."""
    words = list(re.finditer(r"[^\x20\x09-\x0D]+", text or ""))
    bare = [regex.sub(r"^[^\p{L}\p{N}=:#]+|[^\p{L}\p{N}=:#]+$", "", w[0]).lower() for w in words]
    near = lambda i: bare[i] if 0 <= i < len(bare) else ""
    out = []
    for i, w in enumerate(words):
        instance = regex.sub(r"^[^\p{L}\p{N}+]+|[^\p{L}\p{N}]+$", "", w[0]).lower()
        out.append((w.start(), w.end(), instance, (("two", near(i - 2), near(i - 1)), ("around", near(i - 1), near(i + 1))), bool(re.search("[0-9@]", w[0]))))
    return out


def key_shaped(instance):
    return len(instance) >= 20 and re.fullmatch("[a-z0-9_+/=-]+", instance) and re.search("[0-9]", instance) and re.search("[a-z]", instance)


def kept_from_seeds(spark, texts, share=pii.HELD_OUT):
    """The key-shaped words of the texts that are no seeds."""
    words = {(w,) for t in texts for _, _, w, _, candidate in slots(t) if candidate and key_shaped(w)}
    return {r.w for r in spark.createDataFrame(list(words), "w string").filter(pii.held_out(F.col("w"), share)).collect()} if words else set()


def plain_context(texts, held=frozenset()):
    """Spans (start, end, no seed) of each text that bootstrapping finds, by dictionaries in loops."""
    total, words = collections.Counter(), []
    for t, text in enumerate(texts):
        base = plain(text)
        for start, end, instance, keys, candidate in slots(text):
            total.update(keys)
            if candidate:
                state = 2 if any(start <= a < end for _, a, _ in base) else 1 if any(a < end and b > start for _, a, b in base) else 0
                if state == 2 or state == 0 and len(instance) >= 5:
                    words.append((t, start, end, instance, keys, state))
    edges, seeds = {}, {}
    for _, _, _, instance, keys, state in words:
        for k in keys:
            n, most = edges.setdefault(k, {}).get(instance, (0, 0))
            edges[k][instance] = (n + 1, max(most, state))
        sure = 1.0 if state == 2 else 0.9 if key_shaped(instance) and instance not in held else None
        if sure:
            seeds[instance] = max(sure, seeds.get(instance, 0))
    known = dict(seeds)
    for _ in range(3):
        miss, pairs = {}, set()
        for k, there in edges.items():
            met = {i: n * known[i] for i, (n, _) in there.items() if i in known}
            for i, (n, state) in there.items():
                others, words_there = len(met) - (i in met), total[k] - (n if i in met else 0)
                if state == 0 and len(met) >= 5 and sum(met.values()) / total[k] >= 0.5 and others >= 5:
                    p = (sum(met.values()) - met.get(i, 0)) / words_there
                    if p >= 0.5:
                        pairs.add((k, i))
                        miss[i] = miss.get(i, 1.0) * max(1 - p, 1e-6)
        good = {i: 1 - m for i, m in miss.items() if 1 - m >= 0.7}
        known = dict(seeds)
        for i, c in good.items():
            known[i] = max(c, known.get(i, 0))
    found = collections.defaultdict(set)
    for t, start, end, instance, keys, state in words:
        if state == 0 and instance in good and any((k, instance) in pairs for k in keys):
            found[t].add((start, end, instance not in seeds))
    return [sorted(found[t]) for t in range(len(texts))]


ODD = [
    "a@b.c_d@e.f x@y.z@q.w a.@b.c. @x.y",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.255 91.2.3.4x5 1.1.1",
    "4111-1111-1111-1111 4111 1111  1111 1111 4111111111111111-4 79927398713 " + "4" * 3000,
    "+1 (743) 555-3824. +12345678 ++44 20 7946 0958 +1) 2 +1234567890123456",
    "é😀 a@b.co 10.0.0.1, ñ 4111 1111 1111 1111",
    "x" * 4000 + "@" + "y" * 50,
    "1 2 3 4 5 6 7 8 9 0 " * 50,
]


def rows_equal(made, texts):
    for r in made.collect():
        assert [(s.kind, s.start, s.end) for s in r.base] == plain(texts[r.row.doc_id])


def test_base_spans_equal_plain_patterns(spark):
    texts = dict(enumerate(ODD))
    rows_equal(with_spans(spark.createDataFrame(list(texts.items()), "doc_id long, text string")), texts)


def test_query_on_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in op8_contextual_pii(spark, SMALL).collect():
        base = plain(texts[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for x, *_ in base) for k in BASE]
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))


def spans_of(spark, rows):
    return {r.row.doc_id: r.spans for r in with_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def contexts(found, rows):
    return {i: [t[s.start : s.end] for s in found[i] if s.kind == "context"] for i, t in rows}


def test_context_spans_equal_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    rows += [(10_000 + i, f"please write to u{i}@mail.example.com for details") for i in range(30)]
    rows += [(11_000 + i, f"please write to desk{i}77 for details or card 4111 1111 1111 1111") for i in range(6)]
    rows += [(12_000 + i, f"your member number desk{i}77 was renewed") for i in range(8)]
    rows += [(13_000 + i, f'TOKEN = "{hashlib.sha1(str(i).encode()).hexdigest().upper()}"') for i in range(9)] + [(13_100, "token = abc123x now")]
    rows += [(14_000 + i, f"build {hashlib.sha1(str(90 + i).encode()).hexdigest()} passed") for i in range(5)]  # five vouch for no one of themselves
    texts = [t for _, t in rows]
    made = {r.row.doc_id: r for r in with_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    expected = dict(zip([i for i, _ in rows], plain_context(texts, kept_from_seeds(spark, texts)), strict=True))
    assert {i: [(s.start, s.end) for s in r.spans if s.kind == "context"] for i, r in made.items()} == {i: [x[:2] for x in spans] for i, spans in expected.items()}
    assert {i: r.unseen for i, r in made.items()} == {i: sum(x[2] for x in spans) for i, spans in expected.items()}
    assert sum(map(len, expected.values())) > 20 and not any(expected[14_000 + i] for i in range(5))


def test_contexts_find_the_keys_kept_from_the_seeds(spark):
    """Recall of discovery on the given tables: every occurrence of a key that is no seed is found by its context alone, and
    nothing but keys is."""
    folder = "/root/testdata/sf0.1"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").filter("text RLIKE '[0-9A-Za-z_+/=-]{20}'").collect()}
    held = kept_from_seeds(spark, texts.values())
    made = op8_contextual_pii(spark, folder).filter("n_context > 0").collect()
    found = [(r.doc_id, int(a), int(b)) for r in made for k, a, b in (x.split(":") for x in r.spans.split(",")) if k == "context"]
    assert len(found) > 20 and all(re.search("[0-9A-Fa-f]{40}", texts[i][a:b]) for i, a, b in found)
    hidden = {(i, a, b) for i, t in texts.items() for a, b, w, _, candidate in slots(t) if candidate and w in held}
    assert len(hidden) >= 10 and sum(r.n_unseen for r in made) >= len(hidden)
    assert len(hidden & set(found)) / len(hidden) == 1.0


def test_patterns_discover_unseen_identifiers(spark):
    rows = [(i, f"some text here, please write to u{i}@mail.example.com for details, thanks") for i in range(12)]
    rows += [(100 + i, f"some other words, please write to desk{i}77 for details, thanks") for i in range(3)]
    rows += [(200, "we saw room12345 and nothing else"), (201, "in 20240 words we wrote about it")]
    found = contexts(spans_of(spark, rows), rows)
    assert [found[i] for i in (100, 101, 102)] == [["desk077"], ["desk177"], ["desk277"]] and found[200] == found[201] == []


def test_keys_need_a_confident_pattern(spark):
    key = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    rows = [(i, f'w{i} said token = "{key(i)}" and more') for i in range(12)] + [(50, 'then TOKEN = "short123" stood there')]
    rows += [(100, f"the build {key(100)} went out")]
    found = contexts(spans_of(spark, rows), rows)
    assert all(found[i] == [f'"{key(i)}"'] for i in range(12)) and found[50] == ['"short123"'] and found[100] == []


def test_five_instances_count_among_many_seeds(spark):
    rows = [(i, f"w{'abcdefghij'[i % 10]} {'x' * (i % 97)} u{i}@mail.example.com") for i in range(6000)]
    rows += [(10_000 + i, f"please write to v{i}@mail.example.com for details") for i in range(5)] + [(20_000, "please write to desk077 for details")]
    assert [(s.kind, s.start, s.end) for s in spans_of(spark, rows)[20_000]] == [("context", 16, 23)]


def test_discovered_instances_make_patterns_of_their_own(spark):
    rows = [(i, f"please write to u{i}@mail.example.com for details") for i in range(30)]
    rows += [(100 + i, f"please write to desk{i}77 for details") for i in range(6)]
    rows += [(200 + i, f"your member number desk{i}77 was renewed") for i in range(6)] + [(300, "your member number desk9977 was renewed")]
    rows += [(400, "the room desk9988 stood empty")]
    found = contexts(spans_of(spark, rows), rows)
    assert found[105] == found[205] == ["desk577"] and found[300] == ["desk9977"] and found[400] == []


def test_large_pattern_tables_are_joined_by_shuffle(spark, monkeypatch):
    rows = [(i, f"please write to u{i}@mail.example.com for details") for i in range(9)] + [(100, "please write to desk077 for details")]
    expected = spans_of(spark, rows)
    monkeypatch.setattr(pii, "BROADCAST_ROWS", 0)
    assert spans_of(spark, rows) == expected and [s.kind for s in expected[100]] == ["context"]


def test_many_matches_in_one_text(spark):
    text = " ".join(f"a{i}@b{i}.com 10.0.{i % 256}.1 x{i}" for i in range(1500))
    rows_equal(with_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")), {1: text})


def test_columns_with_clashing_names_survive(spark):
    names = ["row", "base", "words", "id", "spans", "whole", "__pii_row", "clean", "touched"]
    made = redact(edge_docs(spark).select("*", *[F.lit(c).alias(c) for c in names]))
    assert made.columns[-len(names) :] == names and all(r[c] == c for r in made.collect() for c in names)


def test_redaction(spark):
    docs = edge_docs(spark)
    made = redact(docs)
    assert made.columns == docs.columns and made.count() == docs.count()
    rows = {r.doc_id: r for r in made.collect()}
    assert rows[9].text.endswith("mail <EMAIL> now <IP> or <CARD> <PHONE>") and rows[9].n_chars == len(rows[9].text)
    assert rows[2].text is None and rows[5].text == next(r.text for r in docs.collect() if r.doc_id == 5)
    assert redact(empty_docs(spark)).count() == 0
