"""Items that appear together (problem 1): blocked Gram matrix.

A record is a sparse binary row: the sorted array of its items, with a weight.  Rows are cut into item blocks of at
most ``BLOCK`` items, and each two blocks of a row are a row of a block product.  Equal rows of block products
are brought together and their weights summed, partly before the shuffle; so a record or basket that many repeat
is multiplied once, and the block products of a very long record are spread over the tasks by their contents.  Each
task takes its rows a batch at a time as a block of records, forms the sparse transpose-product of the two sides and
hands over its entries, summed; Spark sums them over the blocks of records.  Counts are normalised by the
marginals that independence would let one expect.

Nulls: null items and records with a null or non-positive weight are left out.  An item counts once per
record, however often the array repeats it.  Empty input gives an empty result.  Only the named columns are
read, so extra columns cannot clash.  Items are integers or strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.runtime import cut, ship, table

#: Items of one record in one block; products of a batch that are formed at a time.
BLOCK, PRODUCTS = 256, 4_000_000


def _blocks(items: Column, width: int) -> Column:
    cut_up = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / width).cast("int")), lambda i: F.slice(items, i * width + 1, F.lit(width)))
    return F.when(F.size(items) > width, cut_up).otherwise(F.array(items))


def _clean(c: str) -> Column:
    return F.sort_array(F.array_distinct(F.array_compact(c)))


def gram(records: DataFrame, left: str, right: str | None = None, weight: str | None = None, block: int = BLOCK) -> DataFrame:
    """Entries (item1, item2, n) of the Gram matrix of ``records``.

    With one array column the matrix is symmetric and its upper half (item1 < item2) is given.  With two, it
    is the rectangular product left' x right, ordered, diagonal entries included.
    """
    return _entries_of(records, left, right, weight, block).groupBy("item1", "item2").agg(F.sum("n").alias("n"))


def gram_by(records: DataFrame, key: str, items: str, block: int = BLOCK) -> DataFrame:
    """Entries (key, item1, item2, n) of one symmetric Gram matrix for each value of ``key`` (a string)."""
    return _entries_of(records, items, None, None, block, key).groupBy("key", "item1", "item2").agg(F.sum("n").alias("n"))


def block_rows(records: DataFrame, left: str, right: str | None, weight: str | None, block: int, key: str | None = None) -> DataFrame:
    """(key, a, b, w): each two item blocks of the rows, equal ones once with the sum of their weights."""
    w = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    k = F.col(key).cast("string") if key else F.lit("")
    rows = records.select(k.alias("key"), _clean(left).alias("a"), *([_clean(right).alias("b")] if right else []), w.alias("w"))
    rows = (rows if right else rows.withColumn("b", F.col("a"))).where((F.size("a") > 0) & (F.size("b") > 0) & (F.col("w") > 0))
    pairs = rows.select("key", F.explode(_blocks(F.col("a"), block)).alias("a"), "b", "w").select("key", "a", F.explode(_blocks(F.col("b"), block)).alias("b"), "w")
    if right is None:
        pairs = pairs.where(F.element_at("a", 1) < F.element_at("b", -1))
    # the number of tasks is set: by the size of these rows, many products would be coalesced into one task
    return pairs.groupBy("key", "a", "b").agg(F.sum("w").alias("w")).repartition(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "a", "b")


def _multiplied():
    """The entries of the products of a batch's rows, summed."""

    def product(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        (key, one, two), w = (rows.column(i) for i in range(3)), rows.column(3).to_numpy()
        n1, n2 = one.value_lengths().to_numpy(), two.value_lengths().to_numpy()
        keys, x, y = key.dictionary_encode(), one.flatten().dictionary_encode(), two.flatten().dictionary_encode()
        first, second, of = x.indices.to_numpy().astype(np.int64), y.indices.to_numpy().astype(np.int64), keys.indices.to_numpy().astype(np.int64)
        start2 = np.cumsum(n2) - n2
        row = np.repeat(np.arange(len(n1)), n1)  # of each item of the left side; it meets all items of its row's right side
        edges = np.concatenate([[0], np.cumsum(n2[row])])
        at = 0
        while at < len(row):
            to = max(at + 1, int(np.searchsorted(edges, edges[at] + PRODUCTS, side="right")) - 1)
            r, size = row[at:to], n2[row[at:to]]
            slot = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            cell = (np.repeat(of[r], size) * len(x.dictionary) + np.repeat(first[at:to], size)) * len(y.dictionary) + second[np.repeat(start2[r], size) + slot]
            cells, where = np.unique(cell, return_inverse=True)
            n = np.zeros(len(cells), np.int64)
            np.add.at(n, where, np.repeat(w[r], size))
            ij, j = np.divmod(cells, len(y.dictionary))
            k, i = np.divmod(ij, len(x.dictionary))
            yield pa.RecordBatch.from_arrays([keys.dictionary.take(pa.array(k)), x.dictionary.take(pa.array(i)), y.dictionary.take(pa.array(j)), pa.array(n)], ["key", "item1", "item2", "n"])
            at = to

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from product(batch)

    return multiply


def _entries_of(records: DataFrame, left: str, right: str | None, weight: str | None, block: int, key: str | None = None) -> DataFrame:
    ship(records.sparkSession)
    rows = block_rows(records, left, right, weight, block, key)
    kind = {c: t.removeprefix("array<").removesuffix(">") for c, t in rows.dtypes if c in "ab"}
    entries = rows.select("key", "a", "b", "w").mapInArrow(_multiplied(), f"key string, item1 {kind['a']}, item2 {kind['b']}, n bigint")
    return entries.where("item1 < item2") if right is None else entries


def with_expected(pairs: DataFrame, kept: Column | None = None, symmetric: bool = True) -> DataFrame:
    """Adds the marginals m1, m2 and the total to the Gram entries; ``kept`` selects entries before the joins.

    m1 and m2 are sums of n over all entries of item1 and of item2, on any side if ``symmetric``, else on
    their own side; total is the sum of n over all entries.  The entries are read several times, so they should be
    a written table.
    """
    total = pairs.agg(F.sum("n").alias("n")).scalar()
    wanted = pairs.where(kept) if kept is not None else pairs
    if symmetric:
        both = pairs.select(F.explode(F.array("item1", "item2")).alias("item"), "n").groupBy("item").agg(F.sum("n").alias("m"))
        one, two = both, both
    else:
        one = pairs.groupBy(F.col("item1").alias("item")).agg(F.sum("n").alias("m"))
        two = pairs.groupBy(F.col("item2").alias("item")).agg(F.sum("n").alias("m"))
    return (
        wanted.join(one.select(F.col("item").alias("item1"), F.col("m").alias("m1")), "item1")
        .join(two.select(F.col("item").alias("item2"), F.col("m").alias("m2")), "item2")
        .withColumn("total", total)
    )


def _entries(spark: SparkSession, d: str, name: str) -> DataFrame:
    if name == "word_mates":
        rows = table(spark, d, name).select("word1", "word2", "tenminute", "cnt").where("word1 <> word2 and tenminute is not null and cnt >= 1").distinct()
        return cut(gram(rows.select(F.array("word1", "word2").alias("items"), "cnt"), "items", weight="cnt"))
    rows = table(spark, d, name).select("post_md5", "reply_md5", "reply_cnt").where("post_md5 <> reply_md5 and reply_cnt >= 1").distinct()
    return cut(gram(rows.select(F.array("post_md5").alias("posts"), F.array("reply_md5").alias("replies"), "reply_cnt"), "posts", "replies", "reply_cnt"))


def _dec(c: str) -> Column:
    return F.col(c).cast("decimal(19,0)")


def p1_found(spark: SparkSession, d: str, least: int = 8, ratio: int = 5) -> DataFrame:
    """Pairs seen at least ``least`` times and ``ratio`` times as often as their marginals let one expect."""
    kept = F.col("n") >= least
    mates = with_expected(_entries(spark, d, "word_mates"), kept).where(_dec("n") * F.lit(2).cast("decimal(1,0)") * _dec("total") >= _dec("m1") * _dec("m2") * F.lit(ratio).cast("decimal(4,0)"))
    replies = with_expected(_entries(spark, d, "post_reply_cnt"), kept, symmetric=False).where(_dec("n") * _dec("total") >= _dec("m1") * _dec("m2") * F.lit(ratio).cast("decimal(4,0)"))
    return mates.select(F.lit("word_mates").alias("pair_table"), F.col("item1").alias("word1"), F.col("item2").alias("word2")).unionByName(
        replies.select(F.lit("post_reply_cnt").alias("pair_table"), F.least("item1", "item2").alias("word1"), F.greatest("item1", "item2").alias("word2")).distinct()
    )


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every pair with its count and lift: how many times more often than expected (post_reply_cnt keeps its order)."""
    mates = with_expected(_entries(spark, d, "word_mates")).withColumn("lift", F.expr("2D * n * total / (double(m1) * m2)"))
    replies = with_expected(_entries(spark, d, "post_reply_cnt"), symmetric=False).withColumn("lift", F.expr("1D * n * total / (double(m1) * m2)"))
    out = lambda df, name: df.select(F.lit(name).alias("pair_table"), F.col("item1").alias("word1"), F.col("item2").alias("word2"), "n", F.round("lift", 6).alias("lift"))
    return out(mates, "word_mates").unionByName(out(replies, "post_reply_cnt"))


QUERIES = {"p1_found": p1_found, "p1_pairs": p1_pairs}

_WITH = """with wm as (select least(word1, word2) a, greatest(word1, word2) b, sum(cnt)::bigint n from
    (select distinct word1, word2, tenminute, cnt from word_mates where word1 <> word2 and tenminute is not null and cnt >= 1) group by 1, 2),
  wmt as (select sum(n)::hugeint t from wm), wmm as (select w, sum(n)::hugeint m from (select a w, n from wm union all select b, n from wm) group by w),
  pr as (select post_md5 a, reply_md5 b, sum(reply_cnt)::bigint n from (select distinct * from post_reply_cnt where post_md5 <> reply_md5 and reply_cnt >= 1) group by 1, 2),
  prt as (select sum(n)::hugeint t from pr), prp as (select a w, sum(n)::hugeint m from pr group by a), prr as (select b w, sum(n)::hugeint m from pr group by b)"""
SQL = {
    "p1_found": f"""{_WITH}
select 'word_mates' pair_table, a word1, b word2 from wm, wmt, wmm x, wmm y where x.w = a and y.w = b and n >= 8 and n * 2 * t >= 5 * x.m * y.m
union all select distinct 'post_reply_cnt', least(a, b), greatest(a, b) from pr, prt, prp x, prr y where x.w = a and y.w = b and n >= 8 and n * t >= 5 * x.m * y.m""",
    "p1_pairs": f"""{_WITH}
select 'word_mates' pair_table, a word1, b word2, n, round(2.0::double * n * t / (x.m::double * y.m), 6) lift from wm, wmt, wmm x, wmm y where x.w = a and y.w = b
union all select 'post_reply_cnt', a, b, n, round(1.0::double * n * t / (x.m::double * y.m), 6) from pr, prt, prp x, prr y where x.w = a and y.w = b""",
}
