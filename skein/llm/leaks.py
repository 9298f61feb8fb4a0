"""Evaluation texts leaking into training text (problem 9): prefix-filtered set join.

The passages sought are the windows of ``SPAN`` words of every item, or the whole item if it is shorter.  All
words of a window must be in the document, so one word is a sufficient prefix: its rarest in the corpus.  The
documents are tokenised once.  That pass counts the document frequency of every item word over all documents and
keeps the runs of item words that are long enough for a window, since a window lies whole in such a run (the
length bound).  The words of the runs are then joined with the windows on the prefix word; the positional bound is
that the window starts where the prefix word's place says and fits into the run, and the words there are compared
exactly.

The item words are given to all tasks if they have at most ``VOCABULARY`` bytes; beyond that every word counts as
one, so the runs are the whole documents and the join does the work alone.

Texts are compared in NFC without U+00AD and U+200B, lower-cased, with ё as е; words are the longest runs of
letters and digits.  Null, empty and wordless texts and items have no passages, rows without id no result.  Empty
tables give no rows.  Repeated rows give one result row.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.runtime import cut, ship, table

#: Words of a passage; bytes of the item words that may be given to all tasks; words counted before they are handed over.
SPAN, VOCABULARY, WORDS = 12, 16_000_000, 500_000

_WORD = re.compile(r"[^\W_]+")
_FOLD = {0xAD: None, 0x200B: None}


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    text = text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
    if "\xad" in text or "​" in text:
        text = text.translate(_FOLD)
    return _WORD.findall(text.lower().replace("ё", "е"))


def _tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(words_of, batch.column(1).to_pylist()), pa.list_(pa.string()))], ["item_id", "words"])


def _runs(shared):
    """(doc_id, words, n) of documents: the runs of words of a vocabulary that are at least so long, and after
    them, without doc_id, single words with the number of documents that have them."""

    def out(docs: list[int | None], words: list[list[str]], n: list[int | None]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(words, pa.list_(pa.string())), pa.array(n, pa.int64())], ["doc_id", "words", "n"])

    def given(df: Counter[str]) -> pa.RecordBatch:
        return out([None] * len(df), [[w] for w in df], list(df.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabularies: list[tuple[frozenset[str] | None, int]] = shared.value
        counted = None if any(v is None for v, _ in vocabularies) else frozenset().union(*(v for v, _ in vocabularies))
        df: Counter[str] = Counter()
        for batch in batches:
            docs, found = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                df.update(set(words) if counted is None else counted.intersection(words))
                for vocabulary, least in vocabularies:
                    start = 0
                    for at in [*(() if vocabulary is None else (i for i, w in enumerate(words) if w not in vocabulary)), len(words)]:
                        if at - start >= least:
                            docs.append(doc)
                            found.append(words[start:at])
                        start = at + 1
            yield out(docs, found, [None] * len(docs))
            if len(df) > WORDS:
                yield given(df)
                df.clear()
        yield given(df)

    return run


def _vocabulary(items: DataFrame, most: int) -> frozenset[str] | None:
    """The different words of the items, if they have at most ``most`` bytes."""
    words = items.select(F.explode("words").alias("w")).distinct()
    if (words.agg(F.sum(F.octet_length("w") + 64)).first()[0] or 0) > most:
        return None
    return frozenset(r.w for r in words.toLocalIterator())


def leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, span: int = SPAN, vocabulary: int = VOCABULARY) -> DataFrame:
    """(doc_id, item_id): every document that holds ``span`` consecutive words, or all words, of an item."""
    ship(docs.sparkSession)
    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    asked = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(item_text).alias("text")).where("item_id is not null and text is not null").distinct()
    asked = cut(asked.mapInArrow(_tokenised, "item_id bigint, words array<string>").where(F.size("words") > 0))
    short = F.size("words") < span
    least = asked.where(short).agg(F.min(F.size("words"))).first()[0]
    groups = [(asked.where(~short), span)] + ([(asked.where(short), least)] if least else [])
    known = [(_vocabulary(g, vocabulary), n) for g, n in groups]
    rows = cut(texts.mapInArrow(_runs(docs.sparkSession.sparkContext.broadcast(known)), "doc_id bigint, words array<string>, n bigint"))
    frequency = rows.where("n is not null").groupBy(F.col("words")[0].alias("word")).agg(F.sum("n").alias("df"))

    size = F.least(F.lit(span), F.size("words"))
    windows = asked.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - size + 1), lambda i: F.slice("words", i, size))).alias("window")).distinct()
    placed = windows.select("item_id", "window", F.posexplode("window").alias("place", "word")).join(frequency, "word")
    prefix = placed.groupBy("item_id", "window").agg(F.min(F.struct("df", "word", "place")).alias("p"), F.count("*").alias("known")).where(F.col("known") == F.size("window"))
    prefix = cut(prefix.select("item_id", "window", "p.word", "p.place", F.size("window").alias("size")))

    # a word of a run with the words round it, as far as a window that holds it can reach
    around = lambda w, i: F.struct(w.alias("word"), F.slice("words", F.greatest(i - span + 1, F.lit(0)) + 1, F.lit(2 * span - 1)).alias("near"), F.least(i, F.lit(span - 1)).alias("at"))
    tokens = rows.where("n is null").select("doc_id", F.inline(F.transform("words", around)))
    if all(v is not None for v, _ in known):  # so the prefix words are as few
        tokens = tokens.join(F.broadcast(prefix.select("word").distinct()), "word", "left_semi")
    start = F.col("at") - F.col("place")
    met = tokens.join(prefix, "word").where((start >= 0) & (start + F.col("size") <= F.size("near"))).where(F.slice("near", start + 1, F.col("size")) == F.col("window"))
    return met.select("doc_id", "item_id").distinct()


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "test_items"), "item_id", "text")


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """The items that leaked, with the number of documents that hold a passage of them."""
    return p9_found(spark, d).groupBy("item_id").agg(F.count("*").alias("n_docs"))


QUERIES = {"p9_found": p9_found, "p9_items": p9_items}
_WITH = r"""with norm as (select 'd' kind, doc_id id, text from documents where text is not null union all select 'i', item_id, text from test_items where text is not null),
  w as (select kind, id, regexp_extract_all(replace(lower(replace(replace(nfc_normalize(text), chr(173), ''), chr(8203), '')), 'ё', 'е'), '[\p{L}\p{N}]+') ws from norm),
  iw as (select distinct id item_id, ws[s:s + least(len(ws), 12) - 1] p from (select id, ws, unnest(range(1, len(ws) - least(len(ws), 12) + 2)) s from w where kind = 'i' and len(ws) > 0)),
  sizes as (select distinct len(p) n from iw),
  dw as (select distinct id doc_id, ws[s:s + n - 1] p from (select id, ws, n, unnest(range(1, len(ws) - n + 2)) s from w, sizes where kind = 'd' and len(ws) >= n)),
  f as (select distinct doc_id, item_id from dw join iw using (p))"""
SQL = {"p9_found": f"{_WITH} select doc_id, item_id from f", "p9_items": f"{_WITH} select item_id, count(*) n_docs from f group by 1"}
