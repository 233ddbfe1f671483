import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline as P
from lexiforge.llm.language import fit, predictor
from lexiforge.llm.mixing import mix_sources
from lexiforge.llm.pieces import Pieces
from lexiforge.sources.tables import read_table
from tests.conftest import SMALL

from .data import edge_docs, empty_docs, saved
from .test_near import plain_classes
from .test_pii import plain, plain_context


def test_run_equals_brute_force(spark):
    docs = read_table(spark, SMALL, "documents")
    said = docs.withColumn("f", predictor(spark, fit(docs))("text")).collect()
    kept = {r.doc_id: r.text for r in said if r.f.lang_pred != "und" and r.f.coverage >= P.MIN_COVERAGE}
    classes = plain_classes(list(kept.items()))
    kept = {i: t for i, t in kept.items() if classes[i] == i}
    got = {r.doc_id: r for r in P.run(spark, SMALL).collect()}
    assert set(got) == set(kept)
    context = dict(zip(kept, plain_context(list(kept.values())), strict=True))
    model = Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    for i, text in kept.items():
        back, at, out = model.decode(got[i].ids), 0, []
        spans = [(a, kind, b) for kind, a, b in plain(text)] + [(a, "~context", b) for a, b in context[i]]
        for a, kind, b in sorted(spans, key=lambda x: x[0]):
            kind = kind.strip("~")
            if a >= at:
                out += [text[at:a], f"<{kind.upper()}>"]
            at = max(at, b)
        assert back == "".join([*out, text[at:]])
    order = [r.doc_id for r in sorted(got.values(), key=lambda r: (r.mix_file, r.mix_row))]
    assert order == [r.doc_id for r in mix_sources(docs.filter(F.col("doc_id").isin(*kept))).orderBy("mix_order").collect()]


def test_stages_keep_columns(spark, tmp_path):
    docs = edge_docs(spark)
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == edge_docs(spark).columns
    assert P.STAGES[-1][1](spark, docs, "").count() == docs.count() > 0
    assert P.run(spark, saved(empty_docs(spark), tmp_path)).count() == 0
