"""How distinctive a term is for a record (problem 5): two-Poisson mixture per term.

For every term the histogram of its counts over the records (zeros included) is fitted by
expectation-maximisation, until no parameter moves, as a mixture of two Poisson distributions: records about the
term (elite) and the rest.  The posterior probability of the elite component, given the count, scores an occurrence.  Histograms
are built and fitted a term a row; a histogram has as many entries as there are different counts.

Nulls: rows with a null in any column or a count below 1 are left out.  Repeated rows count once; a pair with
several counts keeps each.  Empty input gives no rows.  Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.runtime import ship, table

#: A term is fitted when a round moves none of its parameters by more than this part of it.
STILL = 1e-9


def occurrences(rows: DataFrame, record: str, term: str, count: str) -> DataFrame:
    """The distinct usable rows as (record, term, cnt)."""
    return rows.select(F.col(record).alias("record"), F.col(term).alias("term"), F.col(count).cast("bigint").alias("cnt")).where("record is not null and term is not null and cnt >= 1").distinct()


def histograms(rows: DataFrame) -> DataFrame:
    """(term, d, hist, total): different records of the term, [(cnt, records)], different records of all."""
    total = rows.agg(F.count_distinct("record").alias("n")).scalar()
    cells = rows.groupBy("term", "cnt").agg(F.count("*").alias("n"))
    hist = cells.groupBy("term").agg(F.array_sort(F.collect_list(F.struct("cnt", "n"))).alias("hist"))
    d = rows.groupBy("term").agg(F.count_distinct("record").alias("d"))
    return hist.join(d, "term").withColumn("total", total)


def fit_mixture(values: np.ndarray, counts: np.ndarray, sizes: np.ndarray, rounds: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(share of elite, mean of the rest, mean of elite) for each of the histograms, which lie one after another.

    ``sizes`` are their numbers of entries, none 0.  Histograms leave when their parameters stand still; ``rounds``
    ends all of them earlier.  A share below one record is held against one record.
    """
    total = lambda x, size: np.add.reduceat(x, np.cumsum(size) - size) if len(size) else np.empty(0)
    n = total(counts, sizes)
    mean = total(values * counts, sizes) / n
    top = np.maximum.reduceat(np.where(counts > 0, values, 0), np.cumsum(sizes) - sizes) if len(sizes) else n
    low, high, share = np.maximum(mean * 0.5, 1e-9), np.maximum((mean + top) / 2, mean * 1.5 + 1e-9), np.full(len(n), 0.1)
    at, v, c, m, size, done = np.arange(len(n)), values, counts, n, sizes, 0
    while len(at) and done != rounds:
        s, lo, hi = share[at], low[at], high[at]
        log_odds = np.repeat(np.log(s / (1 - s)) - (hi - lo), size) + v * np.repeat(np.log(hi / lo), size)
        elite = c / (1 + np.exp(-np.clip(log_odds, -700, 700)))
        rest = c - elite
        e, r = total(elite, size), total(rest, size)
        high[at] = np.maximum(total(elite * v, size) / np.maximum(e, 1e-12), 1e-9)
        low[at] = np.maximum(total(rest * v, size) / np.maximum(r, 1e-12), 1e-9)
        share[at] = np.clip(e / m, 1e-9, 1 - 1e-9)
        moved = np.maximum(abs(high[at] - hi) / hi, abs(low[at] - lo) / lo)
        moved = np.maximum(moved, abs(share[at] - s) / np.maximum(np.minimum(s, 1 - s), 1 / m)) > STILL
        if not moved.all():
            entry = np.repeat(moved, size)
            at, v, c, m, size = at[moved], v[entry], c[entry], m[moved], size[moved]
        done += 1
    turn = high < low
    return np.where(turn, 1 - share, share), np.where(turn, high, low), np.where(turn, low, high)


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        hist = batch.column(1)
        sizes = np.diff(hist.offsets.to_numpy())
        flat = hist.flatten()
        pairs = np.stack([flat.field("cnt").to_numpy(zero_copy_only=False), flat.field("n").to_numpy(zero_copy_only=False)], 1).astype(float)
        ends, total = np.cumsum(sizes), batch.column(2).to_numpy()
        once: dict[bytes, int] = {}  # many terms have equal histograms
        fitted, of = [], np.empty(len(sizes), np.int64)
        for i, (a, b) in enumerate(zip((ends - sizes).tolist(), ends.tolist())):
            whole = np.vstack([[0.0, max(total[i] - pairs[a:b, 1].sum(), 0.0)], pairs[a:b]])
            of[i] = once.setdefault(whole.tobytes(), len(once))
            if of[i] == len(fitted):
                fitted.append(whole)
        values, counts = np.vstack(fitted).T
        share, low, high = (x[of] for x in fit_mixture(values, counts, np.array([len(x) for x in fitted])))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(share), pa.array(low), pa.array(high)], ["term", "share", "low", "high"])


def two_poisson(rows: DataFrame, hist: DataFrame) -> DataFrame:
    """(record, term, cnt, d, total, elite): every occurrence with the posterior of its elite component."""
    ship(rows.sparkSession)
    kind = dict(hist.dtypes)["term"]
    fitted = hist.select("term", "hist", F.col("total")).mapInArrow(_fit, f"term {kind}, share double, low double, high double")
    known = hist.select("term", "d", "total").join(fitted, "term")
    odds = F.log((1 - F.col("share")) / F.col("share")) + (F.col("high") - F.col("low")) + F.col("cnt") * F.log(F.col("low") / F.col("high"))
    return rows.join(known, "term").select("record", "term", "cnt", "d", "total", (1 / (1 + F.exp(F.least(odds, F.lit(700.0))))).alias("elite"))


def p5_found(spark: SparkSession, d: str, top: int = 3, least: int = 5) -> DataFrame:
    """The ``top`` replies of greatest weight of each post whose post_cnt is above ``least``.

    The weight is the given (1 + ln reply_cnt) * ln(P / d), with d and P from the operator's histograms; the
    mixture's posterior is another figure and cannot give these ranks (see p5_scores).
    """
    rows = occurrences(table(spark, d, "post_reply_cnt"), "post_md5", "reply_md5", "reply_cnt")
    frequent = table(spark, d, "post_cnt").where(F.col("post_cnt") > least).select(F.col("post_md5").alias("record")).distinct()
    hist = histograms(rows).select("term", "d", "total")
    weighted = rows.join(frequent, "record", "left_semi").join(hist, "term").withColumn("weight", F.round((1 + F.log("cnt")) * F.log(F.col("total") / F.col("d")), 9))
    ranks = Window.partitionBy("record").orderBy(F.desc("weight"), "term")
    best = weighted.groupBy("record", "term").agg(F.max("weight").alias("weight"))
    return best.withColumn("k", F.row_number().over(ranks)).where(F.col("k") <= top).select(F.col("record").alias("post_md5"), F.col("term").alias("reply_md5"))


def p5_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every reply of every post with the posterior probability that the post is about it."""
    rows = occurrences(table(spark, d, "post_reply_cnt"), "post_md5", "reply_md5", "reply_cnt")
    return two_poisson(rows, histograms(rows)).select(F.col("record").alias("post_md5"), F.col("term").alias("reply_md5"), F.col("cnt").alias("reply_cnt"), "d", F.round("elite", 6).alias("elite"))


QUERIES = {"p5_found": p5_found, "p5_scores": p5_scores}
SQL = {
    "p5_found": """with r as (select distinct post_md5, reply_md5, reply_cnt from post_reply_cnt where post_md5 is not null and reply_md5 is not null and reply_cnt >= 1),
  p as (select count(distinct post_md5) n from r), d as (select reply_md5, count(distinct post_md5) d from r group by 1),
  w as (select post_md5, reply_md5, max(round((1 + ln(reply_cnt)) * ln(n::double / d), 9)) weight from r join d using (reply_md5), p group by all)
select post_md5, reply_md5 from (select *, row_number() over (partition by post_md5 order by weight desc, reply_md5) k from w) where k <= 3
  and post_md5 in (select post_md5 from post_cnt where post_cnt > 5)""",
}
