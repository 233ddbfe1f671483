"""SentencePiece encoding and decoding by streaming Viterbi.

The best segmentation of a text under the vocabulary's stored piece scores is found from left to right. Scores are kept
for a window no longer than the longest piece; when the backpointers of all surviving boundaries lead through one
boundary, the ids up to it are committed and forgotten, so the search needs only the window and what is still undecided.
Where no piece can cross a boundary (before a word mark, around a newline, between a letter and the punctuation after it)
all paths meet for certain; a text is cut there first, so `encode` holds the text, its segments and its ids at once. A
bounded number of segments is remembered.

The given vocabulary is a merge vocabulary, whose own encoder applies merges in rank order; this operator returns the
highest-scoring path instead, as the method is named. Decoding is exact: it gives back the text.

Unknown characters become byte pieces, as does the word mark itself where a text contains it, so decoding stays
lossless. Ties between paths prefer the longer last piece.

Defined results: a null or empty text has no ids and decodes to an empty text. Repeated rows get equal ids. Texts are
taken whole, whatever their length. An empty table gives an empty result. Other columns, whatever their names, are kept
and not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import read_table, stored

MARK = "▁"
CHECK_EVERY = 64
CACHE_SEGMENTS = 450_000
SEGMENT = re.compile(r" *[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[.,!? \n]|\Z)| *[^ \n]+| +|\n")
CROSSING = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ][.,!?]")


class Pieces:
    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.text, self.scores, self.bytes = [], {}, {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.text.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.text.append(b"")
            else:
                self.scores[piece] = (sp.get_score(i), i)
                self.text.append(piece.replace(MARK, " ").encode())
        self.longest = max(map(len, self.scores))
        #: a tree of pieces: character -> (children, score, id), id -1 where no piece ends
        self.tree: dict = {}
        for piece, (score, i) in self.scores.items():
            node = self.tree
            for c in piece[:-1]:
                node = node.setdefault(c, ({}, 0.0, -1))[0]
            node[piece[-1]] = (node[piece[-1]][0] if piece[-1] in node else {}, score, i)
        self.byte_score = min(s for s, _ in self.scores.values()) - 10
        #: whether boundaries before a word mark that follows another character, around a newline, and between a letter
        #: and the punctuation after it are certain
        self.certain = not any(MARK in p.lstrip(MARK) or "\n" in p or CROSSING.search(p) for p in self.scores)
        self.width = np.uint16 if len(self.text) <= 1 << 16 else np.int32
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def byte_ids(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode("utf-8", "replace")]

    def viterbi(self, text: str) -> Iterator[int]:
        """Ids of a text in which spaces are word marks; a mark in it is text."""
        # a mark of the text itself is None, which no piece begins or goes on with
        units = [None if c == MARK else MARK if c == " " else c for c in text] if MARK in text else text.replace(" ", MARK)
        tree, longest, size, done = self.tree, self.longest, len(units), 0
        best: dict[int, float] = {0: 0.0}  # boundaries not yet left, one piece ahead at most
        back: dict[int, tuple[int, int]] = {}  # previous boundary and piece, -1 for bytes; since the last commit
        for start in range(size):
            here = best.pop(start)
            node, end = tree, start
            for c in units[start : start + longest]:
                step = node.get(c)
                if step is None:
                    break
                node, score, piece = step
                end += 1
                if piece >= 0 and (end not in best or here + score > best[end]):
                    best[end], back[end] = here + score, (start, piece)
            if start + 1 not in best:
                best[start + 1], back[start + 1] = here + self.byte_score * len(self.byte_ids(units[start] or MARK)), (start, -1)
            last = start + 1 == size
            if last or (start + 1) % CHECK_EVERY == 0:
                alive = set(best)
                while len(alive) > 1 and max(alive) > done:
                    top = max(alive)
                    alive.discard(top)
                    alive.add(back[top][0])
                meet = max(alive)
                path, at = [], meet
                while at > done:
                    path.append((at, *back.pop(at)))
                    at = path[-1][1]
                for end, begin, piece in reversed(path):
                    if piece >= 0:
                        yield piece
                    else:
                        yield from self.byte_ids(units[begin] or MARK)
                for at in [x for x in back if x <= meet]:
                    del back[at]
                done = meet

    def segment(self, text: str) -> bytes:
        """Ids as 16- or 32-bit integers; remembered in two generations of bounded size."""
        found = self.old.get(text)
        if found is None:
            found = np.fromiter(self.viterbi(text), dtype=self.width).tobytes()
        if len(text) <= CHECK_EVERY:
            if len(self.young) >= CACHE_SEGMENTS // 2:
                self.old, self.young = self.young, {}
            self.young[text] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=np.int32)
        parts = SEGMENT.findall(" " + text) if self.certain else [" " + text]
        segment = self.segment
        return np.frombuffer(b"".join([self.young.get(p) or segment(p) for p in parts]), dtype=self.width).astype(np.int32)

    def decode(self, ids: list[int]) -> str:
        pieces = self.text
        return b"".join([pieces[i] for i in ids]).decode("utf-8", "replace")[1:]


MODELS: dict[str, Pieces] = {}


def pieces(model: str) -> Pieces:
    if model not in MODELS:
        MODELS[model] = Pieces(model)
    return MODELS[model]


def piece_encoder(model: str):
    """A column function: text -> array of ids."""

    @F.arrow_udf("array<int>")
    def encode(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            made = [pieces(model).encode(t.as_py() or "") for t in column]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in made])]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(made) if made else np.zeros(0, np.int32)))

    return lambda text: encode(F.col(text).cast("string"))


def piece_decoder(model: str):
    """A column function: array of ids -> text."""

    @F.arrow_udf("string")
    def decode(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
            yield pa.array([pieces(model).decode(values[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.string())

    return lambda ids: decode(F.col(ids))


def op9_streaming_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = read_table(spark, sf_dir, "documents")
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    made = stored(given.withColumn("ids", piece_encoder(model)("text")).drop("text"), "pieces")
    back = made.withColumn("decoded", F.sha2(piece_decoder(model)("ids"), 256))
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.col("decoded").alias("decoded_sha256"),
        (F.col("decoded") == F.col("text_sha256")).alias("round_trip"),
    )
