"""Small tables with the cases every operator must define."""

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, n string"

LONG = " ".join(f"word{i % 997} und die" for i in range(8000))
TEXTS = [
    (1, "The cat sat on the mat. The cat sat on the mat.\nThe cat sat on the mat.\n", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "a"),
    (4, LONG, "de", "b"),
    (5, "Ünïcode, ▁marks▁ and\ttabs  two spaces  em\x85nel İstanbul don't", "en", "b"),
    (6, "a b c " * 400, "en", "a"),
    (6, "a b c " * 400, "en", "a"),
    (7, "12345 !!! ###", "en", "a"),
    (None, "no id here", "en", None),
    (8, "x" * 5000, "en", "a"),
    (9, "\n\n a\n a\n<|endoftext|> mail bob.x@mail.example.com now 10.0.0.1 or 4111 1111 1111 1111 +1 (743) 555-3824", "en", "a"),
]


def edge_docs(spark: SparkSession) -> DataFrame:
    rows = [(i, t, lang, src, None if t is None else len(t), "clash", "clash") for i, t, lang, src in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


def empty_docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def saved(df: DataFrame, path, name: str = "documents") -> str:
    df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return str(path)
