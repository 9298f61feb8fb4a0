"""Encoding of a corpus with a public tokenizer (problem 8): content-defined chunk reuse.

A rolling hash over the characters cuts texts at places that depend on the neighbouring characters only, so
texts that share a passage share its chunks.  A chunk is encoded once and its ids are reused wherever it comes
again.  Joins are repaired: at each cut the piece between the nearest certain token borders on either side is
encoded anew.  A border is certain where a space follows a letter, since no token of a byte-level vocabulary
with the usual splitting pattern holds a letter before a space and nothing before it changes what follows; so
the joined ids equal those of the whole text.  Where a text has no such border, the repair grows to the whole
text.  Reuse reaches as far as one Python worker's memory of chunks, which spans its tasks.  ``encode_shared`` has
each chunk encoded once in the whole cluster instead; the query does without it, as moving chunks and ids costs more
than encoding them.

Null and empty texts give an empty list.  Texts are encoded exactly as stored, special tokens' strings as
ordinary text.  Every input row gives one row.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.runtime import cut, ship, table

#: Splitting pattern of the vocabulary, a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of the rolling window, mean characters of a chunk, characters of remembered chunks, texts hashed at once.
WINDOW, CHUNK, MEMORY, TEXTS = 12, 256, 16_000_000, 256

_encoders: dict[str, Encoder] = {}


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Of a file in the folder of SKEIN_TOKENIZERS, else of the installed public tokenizers."""
    folder = os.environ.get("SKEIN_TOKENIZERS")
    if not folder:
        import public_tokenizers

        return public_tokenizers.path(name)
    return os.path.join(folder, name)


_LETTERS = np.zeros(0x530, bool)
_LETTERS[[c for c in range(0x530) if chr(c).isalpha()]] = True


def pieces(texts: list[str], chunk: int = CHUNK) -> tuple[list[str], np.ndarray]:
    """The chunks and repaired joins of texts, and the number of the text each belongs to.

    A text's pieces joined are the text, and encoded apart they give its ids.  All texts are hashed at once; a
    window that reaches over the end of a text cuts nothing.
    """
    whole, starts = "".join(texts), np.cumsum([0, *map(len, texts)])
    if not whole:
        return [], np.empty(0, np.int64)
    codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    sure = np.flatnonzero((codes[1:] == 32) & _LETTERS[np.minimum(codes[:-1], 0x52F)] & (codes[:-1] < 0x530)) + 1
    ends = [starts]
    if len(codes) >= WINDOW and len(sure):
        mixed, last = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), len(codes) - WINDOW + 1
        sums = np.zeros(last, np.uint64)
        for i in range(WINDOW):
            sums = sums * np.uint64(0x100000001B3) + mixed[i : last + i]
        hits = np.flatnonzero((sums >> np.uint64(40)) % np.uint64(chunk) == 0)
        of = lambda at: np.searchsorted(starts, at, side="right")
        hits = hits[of(hits) == of(hits + WINDOW - 1)]
        cuts = hits + WINDOW // 2
        for near in (np.searchsorted(sure, cuts), np.searchsorted(sure, cuts) - 1):
            there = (near >= 0) & (near < len(sure))
            border, cut = sure[near[there]], cuts[there]
            ends.append(border[of(border) == of(cut)])
    bounds = np.unique(np.concatenate(ends))
    parts = bounds.tolist()
    return [whole[x:y] for x, y in zip(parts, parts[1:])], np.searchsorted(starts, bounds[:-1], side="right") - 1


class Encoder:
    """A tokenizer that remembers the ids of the chunks it has encoded."""

    def __init__(self, path: str) -> None:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}  # noqa: SIM115
        self.encode = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, np.ndarray] = {}
        self.chars = 0

    def ids(self, piece: str) -> np.ndarray:
        ids = self.known.get(piece)
        if ids is None:
            ids = np.array(self.encode(piece), np.int32)
            if self.chars > MEMORY:
                self.known.clear()
                self.chars = 0
            self.known[piece] = ids
            self.chars += len(piece)
        return ids


def _encoded(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        encoder = _encoders[path]
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS):
                part = batch.slice(start, TEXTS)
                parts, of = pieces([t or "" for t in part.column(1).to_pylist()])
                lists = [encoder.ids(p) for p in parts]
                sizes = np.bincount(of, np.fromiter(map(len, lists), np.int64, len(lists)), part.num_rows)
                flat = np.concatenate(lists) if lists else np.empty(0, np.int32)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "ids"])

    return encode


def encode_texts(docs: DataFrame, id_col: str, text_col: str, path: str | None = None) -> DataFrame:
    """(doc_id, ids): one row a document, no shuffle."""
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_encoded(path or vocabulary_path()), f"doc_id {kind}, ids array<int>")


def _cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, TEXTS):
            part = batch.slice(start, TEXTS)
            parts, of = pieces([t or "" for t in part.column(1).to_pylist()])
            place = np.arange(len(of)) - np.searchsorted(of, of)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of)), pa.array(place.astype(np.int32)), pa.array([hashlib.md5(p.encode()).digest() for p in parts], pa.binary()), pa.array(parts, pa.string())], ["row", "place", "key", "piece"])


def encode_shared(docs: DataFrame, id_col: str, text_col: str, path: str | None = None) -> DataFrame:
    """(doc_id, ids) as ``encode_texts`` gives, but with every different piece encoded once in the whole cluster.

    Pieces are brought together by their MD5, encoded, joined back and put together by row.  This moves all texts
    and all ids, so it pays only where encoding costs much more than moving (see the README for figures).
    """
    ship(docs.sparkSession)
    rows = cut(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    parts = cut(rows.select("row", "text").mapInArrow(_cut_up, "row bigint, place int, key binary, piece string"))
    once = parts.groupBy("key").agg(F.any_value("piece").alias("piece"))
    known = once.mapInArrow(_encoded(path or vocabulary_path()), "doc_id binary, ids array<int>").withColumnRenamed("doc_id", "key")
    whole = parts.select("row", "place", "key").join(known, "key").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "ids"))).alias("p"))
    return rows.select("row", "doc_id").join(whole, "row", "left").select("doc_id", F.coalesce(F.flatten(F.transform("p", lambda x: x["ids"])), F.array().cast("array<int>")).alias("ids"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_texts(table(spark, d, "documents"), "doc_id", "text")


QUERIES = {"p8_ids": p8_ids}
SQL: dict[str, str] = {}
