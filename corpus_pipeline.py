"""A training corpus from documents: language, near copies, personal data, source mix, piece ids.

Each stage works on all that the one before it kept; `run` writes every stage but the last as Parquet to the shared
folder, rereads it, and deletes what no later stage reads. Language rejects documents without a letter and those in which hardly any n-gram belongs to the
language found; near-duplicate removal keeps the document with the smallest id of each class; personal data is replaced
by its kind; mixing drops nothing and writes the documents in the order of the mix, file by file; encoding gives each
document's piece ids and its place in the mix.

Defined results: null and empty texts have no letter and go in the first stage. Repeated rows are copies of each other.
Ties go as each operator says. Texts are taken whole. Stages keep the columns of documents and extra ones, whatever their
names; the last returns its own. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm.language import UNKNOWN, fit, predictor
from lexiforge.llm.mixing import in_mix_order, mix_sources
from lexiforge.llm.near import deduplicate
from lexiforge.llm.pieces import piece_encoder
from lexiforge.llm.pii import redact
from lexiforge.sources.tables import kept, read_table, scratch

MIN_COVERAGE = 0.05


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = docs.select(F.struct("*").alias("row"), predictor(spark, fit(docs))("text").alias("found"))
    sure = found.filter((F.col("found.lang_pred") != UNKNOWN) & (F.col("found.coverage") >= MIN_COVERAGE))
    return sure.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return in_mix_order(mix_sources(docs))


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    try:
        placed = docs.select("doc_id", "source", "text", F.col("_metadata.file_name").alias("mix_file"), F.col("_metadata.row_index").alias("mix_row"))
    except AnalysisException:  # docs that were not read from files have no place
        placed = docs.select("doc_id", "source", "text", F.lit(None).cast("string").alias("mix_file"), F.lit(None).cast("long").alias("mix_row"))
    ids = placed.withColumn("ids", piece_encoder(public_tokenizers.path("piece_bpe_32k.model"))("text"))
    return ids.select("doc_id", "source", "mix_file", "mix_row", F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mixing),
    ("piece_ids", piece_ids),
]

#: Language filters, signatures and best paths can't be expressed in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    *early, (name, mixed), (_, last) = STAGES
    with scratch(spark):
        for early_name, stage in early:
            with scratch(spark):
                docs = kept(stage(spark, docs, sf_dir), f"pipeline-{early_name}")
        docs = kept(mixed(spark, docs, sf_dir), f"pipeline-{name}")
    return last(spark, docs, sf_dir)
