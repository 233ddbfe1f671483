"""Token id output as Parquet list columns.

Documents are range-partitioned and sorted by doc_id, encoded in Arrow batches, and written by Spark's Parquet writer:
ids dictionary-encoded where the dictionary fits and delta-encoded beyond it (format version 2), row groups and pages of
controlled size, page indexes for doc_id. Readers can thus fetch metadata columns without ids, or the ids of a doc_id
range alone. Each row also holds its shard (write task) and its start within the shard, so the global start of a
document needs only one sum per shard.

Encoding works on white-space words: the tokenizer's normaliser and splitter never join characters across ASCII white
space, and always part a letter from a full stop, comma, exclamation or question mark after it, so the ids of a text are
those of its words in order. ASCII letters are made small beforehand, as the normaliser does. Words of small Latin
letters go to the tokenizer's model alone, as normaliser and splitter leave them unchanged; others go through all of it.

Defined results: a null or empty text is the end id alone. Rows with null doc_id come first; rows with equal doc_id are
ordered by text; repeated rows are written each. Texts are taken whole: a task holds a batch of about two megabytes, or
one longer text. An empty table writes empty files. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import read_table, stored
from .arrow import chunks

END_ID = 1
CACHE_WORDS = 400_000
BATCH_BYTES = 2 << 20
WRITE_OPTIONS = {
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "true",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
}
FILE_SCHEMA = "doc_id long, shard int, start_in_shard long, n_tokens long, ids array<int>"
PLAIN = re.compile(r"[a-zß-öø-ÿ]+\Z")
#: No text holds this byte.
END_MARK = b"\xff"
PUNCTUATION = np.isin(np.arange(256), list(b".,!?"))


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: itself where it prints, else one from 256 on."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printed]
    return {b: chr(b) for b in printed} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordTable(dict):
    """Words to places in one growing table of 16-bit ids. A word not met before gets the next place at once and is encoded
    with the other new ones of its batch; past CACHE_WORDS words the table starts anew, so memory is bounded. Place 0 is
    the end mark of a text."""

    def __init__(self, vocabulary: str, end_id: int):
        from tokenizers import Tokenizer

        super().__init__()
        self.full = Tokenizer.from_file(vocabulary)
        if self.full.get_vocab_size() > 1 << 16:
            raise ValueError("ids need more than 16 bits")
        self.full.model._resize_cache(0)  # every word comes once
        self.pieces, self.letters, self.end_id = self.full.model.tokenize, byte_letters(), end_id
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new: list[bytes] = []
        self.start, self.size = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)
        self.ids, self.used = np.full(1 << 20, self.end_id, dtype=np.uint16), 1
        self[END_MARK], self.size[0] = 0, 1

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self)
        self.new.append(word)
        return place

    def places(self, words: list[bytes]) -> np.ndarray:
        """The place of each word, all of them encoded."""
        if len(self) > CACHE_WORDS:
            self.forget()
        found = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        new, self.new = self.new, []
        first = len(self) - len(new)
        ids, sizes = [], []
        for w in new:
            text = w.decode("utf-8", "replace")
            if PLAIN.match(text):  # normaliser and splitter would leave it as it is
                made = [x.id for x in self.pieces(text if len(text) == len(w) else w.decode("latin-1").translate(self.letters))]
            else:
                made = self.full.encode(text, add_special_tokens=False).ids
            ids += made
            sizes.append(len(made))
        while len(self) > len(self.start):
            self.start, self.size = np.concatenate([self.start, self.start]), np.concatenate([self.size, self.size])
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, self.ids])
        sizes = np.array(sizes, dtype=np.int64)
        self.size[first : len(self)] = sizes
        self.start[first : len(self)] = self.used + np.cumsum(sizes) - sizes
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return found


TABLES: dict[tuple[str, int], WordTable] = {}


def word_table(vocabulary: str, end_id: int) -> WordTable:
    if (vocabulary, end_id) not in TABLES:
        TABLES[vocabulary, end_id] = WordTable(vocabulary, end_id)
    return TABLES[vocabulary, end_id]


def parted(raw: bytes) -> bytes:
    """raw with a space between a letter and a plain punctuation mark after it: the splitter always parts the two."""
    data = np.frombuffer(raw, dtype=np.uint8)
    if len(data) < 3:
        return raw
    small = ((data | 32) >= 97) & ((data | 32) <= 122)
    latin = np.zeros(len(data), dtype=bool)
    latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    cut = np.zeros(len(data), dtype=bool)
    cut[1:] = PUNCTUATION[data[1:]] & (small | latin)[:-1]
    out = np.full(len(data) + int(cut.sum()), 32, dtype=np.uint8)
    out[np.arange(len(data)) + np.cumsum(cut)] = data
    return out.tobytes()


def encode_batch(column: pa.Array, vocabulary: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, ids) of a batch of texts, the end id after each."""
    raw = (b" " + END_MARK + b" ").join([x or b"" for x in column.cast(pa.large_binary()).to_pylist()] + [b""])
    if b"<|" not in raw:  # a special token is found before letters are made small
        raw = raw.lower()
    table = word_table(vocabulary, end_id)
    place = table.places(parted(raw).split())
    size = table.size[place]
    stops = np.cumsum(size)
    ids = table.ids[np.arange(int(stops[-1]) if len(stops) else 0) + np.repeat(table.start[place] - (stops - size), size)]
    return np.concatenate([[0], stops[place == 0]]), ids.astype(np.int32)


def write_ids(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int) -> Iterator[pa.RecordBatch]:
    shard, start = TaskContext.get().partitionId(), 0
    for batch in chunks(batches, limit=BATCH_BYTES):
        offsets, ids = encode_batch(batch.column("text"), vocabulary, end_id)
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.full(n, shard, dtype=np.int32)), pa.array(offsets[:-1] + start), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))],
            names=["doc_id", "shard", "start_in_shard", "n_tokens", "ids"],
        )
        start += int(offsets[-1])


def token_files(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """doc_id and text -> the written and reread token table, files in ascending doc_id order."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stored(ordered.mapInArrow(lambda batches: write_ids(batches, vocabulary, end_id), FILE_SCHEMA), "tokens", **WRITE_OPTIONS)


def shard_starts(files: DataFrame) -> DataFrame:
    """shard, before: the ids of all shards before it. One row for each written file, a running sum over those."""
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("in_shard"))
    return totals.select("shard", (F.sum("in_shard").over(Window.orderBy("shard")) - F.col("in_shard")).alias("before"))


def checksum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("ids")
        offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype("<u4")
        crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        kept = {n: batch.column(n) for n in ("doc_id", "shard", "start_in_shard")}
        yield pa.RecordBatch.from_arrays([*kept.values(), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], names=[*kept, "n_tokens", "ids_crc32"])


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = token_files(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    read = files.select("doc_id", "shard", "start_in_shard", "ids").mapInArrow(checksum, "doc_id long, shard int, start_in_shard long, n_tokens long, ids_crc32 long")
    return read.join(shard_starts(files), "shard").select("doc_id", (F.col("before") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids_crc32")
