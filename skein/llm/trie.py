"""Frequency of every distinct value or term (problem 4): burst-trie counting.

Repeated rows of a record and term are first merged into one with a count, partly before the shuffle; it is
keyed by both, so neither a hot record nor a hot term makes a large partition.  Each task then streams its rows
into a burst trie: terms are routed by their leading bytes, and a leaf that grows beyond its capacity bursts into
one leaf a next byte, so that prefixes are as long as the data need.  Leaves hold an occurrence and a record
counter a term.  A trie that reaches its limit of terms is handed over and begun anew, so memory is bounded.
Matching subtrees of all tasks are merged by a final sum, where a term has at most one row a task and trie; no
task holds a whole subtree.

Nulls: null terms are not counted, but their records count for the total; rows without record count as
occurrences only.  Empty input gives no terms.  Terms may be strings (by UTF-8 bytes, whole) or integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.runtime import cut, ship, table

#: Terms of a leaf before it bursts, and of a trie before it is handed over.
LEAF, TRIE = 512, 500_000


class BurstTrie:
    """Counters of byte strings; ``add`` routes by bytes, leaves burst at ``capacity`` terms."""

    def __init__(self, capacity: int = LEAF) -> None:
        self.capacity, self.size, self.root = capacity, 0, {}
        self.inner: set[int] = set()  # id of the tables that have burst: next byte -> table

    def add(self, key: bytes, occurrences: int, records: int) -> None:
        node, depth = self.root, 0
        while id(node) in self.inner:
            byte, depth = key[depth : depth + 1], depth + 1
            node = node.setdefault(byte, {})
        suffix = key[depth:]
        cell = node.get(suffix)
        if cell is not None:
            cell[0] += occurrences
            cell[1] += records
            return
        node[suffix] = [occurrences, records]
        self.size += 1
        if len(node) > self.capacity and depth < 64:
            self._burst(node)

    def _burst(self, node: dict) -> None:
        cells = list(node.items())
        node.clear()
        self.inner.add(id(node))
        for suffix, cell in cells:
            node.setdefault(suffix[:1], {})[suffix[1:]] = cell

    def items(self) -> Iterator[tuple[bytes, list[int]]]:
        """All terms in byte order, subtree by subtree."""
        stack = [(b"", self.root)]
        while stack:
            prefix, node = stack.pop()
            if id(node) in self.inner:
                stack += [(prefix + k, node[k]) for k in sorted(node, reverse=True)]
            else:
                yield from ((prefix + k, node[k]) for k in sorted(node))


def _counter(capacity: int, limit: int, integers: bool):
    def given(trie: BurstTrie) -> pa.RecordBatch:
        cells = list(trie.items())
        keys = [int.from_bytes(k, "big") - (1 << 63) for k, _ in cells] if integers else [k.decode() for k, _ in cells]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64() if integers else pa.string()), pa.array([c[0] for _, c in cells], pa.int64()), pa.array([c[1] for _, c in cells], pa.int64())], ["term", "occurrences", "records"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = BurstTrie(capacity)
        for batch in batches:
            terms = batch.column(0).dictionary_encode()
            code, n, known = terms.indices.to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            words = terms.dictionary.to_pylist()
            occ = np.bincount(code, n, len(words)).astype(np.int64)
            rec = np.bincount(code, known, len(words)).astype(np.int64)
            for term, o, r in zip(words, occ.tolist(), rec.tolist()):
                trie.add((term + (1 << 63)).to_bytes(8, "big") if integers else term.encode(), o, r)
            if trie.size >= limit:
                yield given(trie)
                trie = BurstTrie(capacity)
        if trie.size:
            yield given(trie)

    return count


def term_counts(rows: DataFrame, record: str, term: str, capacity: int = LEAF, limit: int = TRIE) -> DataFrame:
    """(term, occurrences, records): rows and different records of every term; a row of the null term has the
    different records of all rows.  ``term`` is a string or an integer column."""
    ship(rows.sparkSession)
    integers = dict(rows.dtypes)[term] != "string"
    kind = "bigint" if integers else "string"
    there = rows.select(F.col(record).alias("record"), F.col(term).cast(kind).alias("term"))
    pairs = there.where("term is not null").groupBy("record", "term").agg(F.count("*").alias("n")).select("term", "n", F.col("record").isNotNull().alias("known"))
    tries = pairs.mapInArrow(_counter(capacity, limit, integers), f"term {kind}, occurrences bigint, records bigint")
    total = there.agg(F.count_distinct("record").alias("records")).select(F.lit(None).cast(kind).alias("term"), F.lit(0).cast("bigint").alias("occurrences"), "records")
    return tries.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")).unionByName(total)


def p4_found(spark: SparkSession, d: str, rare: int = 2, common: int = 20) -> DataFrame:
    """Words in at most ``rare`` tweets, in more than one of ``common``, and those whose post_cnt is another."""
    counts = cut(term_counts(table(spark, d, "tweets_nouns"), "id", "noun_md5"))  # a row a word, read three times
    total = counts.where("term is null").agg(F.max("records").alias("n")).scalar()
    words = counts.where("term is not null").select(F.col("term").alias("noun_md5"), F.col("records").alias("f"))
    marks = F.array_compact(F.array(F.when(F.col("f").between(1, rare), "rare"), F.when(F.col("f") * common > total, "common")))
    stated = table(spark, d, "post_cnt").where("post_md5 is not null and post_cnt is not null").select(F.col("post_md5").alias("noun_md5"), "post_cnt").distinct()
    stale = stated.join(words, "noun_md5", "left").where(F.col("post_cnt") != F.coalesce("f", F.lit(0))).select("noun_md5").distinct()
    return words.select("noun_md5", F.explode(marks).alias("mark")).unionByName(stale.select("noun_md5", F.lit("stale").alias("mark")))


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows (as they stand, repeated ones too) and different tweets of every word."""
    return term_counts(table(spark, d, "tweets_nouns"), "id", "noun_md5").where("term is not null").select(F.col("term").alias("noun_md5"), "occurrences", F.col("records").alias("tweets"))


QUERIES = {"p4_found": p4_found, "p4_counts": p4_counts}
SQL = {
    "p4_found": """with c as (select noun_md5, count(distinct id) f from tweets_nouns where noun_md5 is not null group by 1), t as (select count(distinct id) n from tweets_nouns)
select noun_md5, 'rare' mark from c where f between 1 and 2 union all select noun_md5, 'common' from c, t where f * 20 > n
union all select distinct p.post_md5, 'stale' from post_cnt p left join c on c.noun_md5 = p.post_md5 where p.post_md5 is not null and p.post_cnt <> coalesce(f, 0)""",
    "p4_counts": "select noun_md5, count(*) occurrences, count(distinct id) tweets from tweets_nouns where noun_md5 is not null group by 1",
}
