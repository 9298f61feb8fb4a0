"""Ranks, gap filling, normalisation and least-squares trends of hourly series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.config import SETTINGS
from skein.functions.scalars import word_score
from skein.operators.counters import hourly, recent_sum
from skein.plans import frames as fr
from skein.runtime import cut


def ordinal(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """Ranks 0, 1, ... by a total order, without bringing all rows into one task.

    Rows are range partitioned and sorted, numbered within their partition, and shifted by the counts of the
    partitions before, of which there are no more than shuffle partitions.
    """
    rows = cut(df.orderBy(*order).withColumn("__m", F.monotonically_increasing_id()))
    part = F.shiftright("__m", 33)
    shift, shifts = 0, []
    for r in rows.groupBy(part.alias("p")).count().orderBy("p").collect():
        shifts.append((r.p, shift))
        shift += r["count"]
    before = df.sparkSession.createDataFrame(shifts, "__p bigint, __s bigint")
    return rows.withColumn("__p", part).join(F.broadcast(before), "__p").withColumn(name, F.col("__s") + F.col("__m").bitwiseAND((1 << 33) - 1)).drop("__m", "__p", "__s")


def fill_gaps(series: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """The series with 0 where a key lacks one of the times that any key has.

    Times are the observed ones (a bounded look-back holds few); they are given to every key as an array.
    """
    times = series.agg(F.array_sort(F.collect_set(at)).alias("t")).scalar()
    grid = series.select(key).distinct().select(key, F.explode(times).alias(at))
    return grid.join(series, [key, at], "left").select(key, at, F.coalesce(value, F.lit(0)).cast("bigint").alias(value))


def scale_to_max(series: DataFrame, key: str, value: str) -> DataFrame:
    """Adds ``scaled``: the value in percent of the key's largest; null where that is 0."""
    top = F.max(value).over(Window.partitionBy(key))
    return series.withColumn("scaled", F.try_divide(F.col(value) * 100.0, top))


def slopes(series: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """(key, trend, intercept, delta): least-squares line of the percent-scaled, zero-filled series on x = 1..n.

    Zeros add nothing to the sums of y and xy, and the sums of x and x*x depend on n alone, so the gaps are
    never filled: the observed times are numbered, and one aggregation per key gives the line.  The trend is
    null for fewer than two times.
    """
    times = series.select(at).distinct()
    numbered = times.select(at, F.row_number().over(Window.orderBy(at)).cast("double").alias("x"))  # as many rows as hours looked back at
    n = times.agg(F.count("*").cast("double").alias("n")).scalar()
    sums = series.join(F.broadcast(numbered), at).groupBy(key).agg(F.sum(F.col("x") * F.col(value)).alias("xy"), F.sum(value).cast("double").alias("y"), F.max(value).cast("double").alias("top"))
    n_ = F.col("n")
    slope = F.try_divide(n_ * F.col("xy") - (n_ * (n_ + 1) / 2) * F.col("y"), n_ * n_ * (n_ * n_ - 1) / 12) * F.try_divide(F.lit(100.0), F.col("top"))
    return (
        sums.withColumn("n", n)
        .withColumn("trend", slope)
        .select(key, "trend", (F.try_divide(F.col("y") * 100, F.col("top") * F.col("n")) - F.col("trend") * (F.col("n") + 1) / 2).alias("intercept"), (F.col("trend") * (F.col("n") - 1)).alias("delta"))
    )


def combined_rank(counts: DataFrame, trend: DataFrame, top: int = SETTINGS.trending_kept) -> DataFrame:
    """(word_md5, rank): words by the sum of their ranks by score and by trend, the least ``top``.

    A word without a trend ranks with 0, ahead of those that fall.  Ties go to the smaller key.
    """
    scored = ordinal(counts.select("word_md5", word_score("cnt").alias("score")), "by_score", F.desc("score"), F.asc("word_md5"))
    both = scored.join(trend.select("word_md5", "trend"), "word_md5", "left").select("word_md5", "by_score", F.coalesce("trend", F.lit(0.0)).alias("trend"))
    ranked = ordinal(both, "by_trend", F.desc("trend"), F.asc("word_md5"))
    return ranked.select("word_md5", (F.col("by_score") + F.col("by_trend")).alias("rank")).orderBy("rank", "word_md5").limit(top)


# ---- queries


def _hours(spark: SparkSession, d: str) -> DataFrame:
    return hourly(fr.word_time(spark, d), fr.bucket(SETTINGS.trend_days))


def word_trends(spark: SparkSession, d: str) -> DataFrame:
    """(word_md5, trend, intercept, delta) of every word of the look-back."""
    return slopes(_hours(spark, d), "word_md5", "hour", "cnt")


def trending_words(spark: SparkSession, d: str, top: int = SETTINGS.trending_kept) -> DataFrame:
    """The ``top`` words of greatest trend."""
    t = word_trends(spark, d).select("word_md5", F.round("trend", 6).alias("trend"), F.round("delta", 6).alias("delta"))
    return t.orderBy(F.desc("trend"), "word_md5").limit(top)


def _day_counts(spark: SparkSession, d: str) -> DataFrame:
    return recent_sum(fr.word_time(spark, d), ["word_md5"], fr.bucket(1))


def word_series(spark: SparkSession, d: str) -> DataFrame:
    """Zero-filled hourly series of every word of the look-back, in percent of its peak."""
    return scale_to_max(fill_gaps(_hours(spark, d), "word_md5", "hour", "cnt"), "word_md5", "cnt").select("word_md5", "hour", "cnt", F.round("scaled", 6).alias("scaled"))


def series_totals(spark: SparkSession, d: str) -> DataFrame:
    """(word_md5, total, peak, mean, place): words by their series' total, the greatest first; ties to the smaller key."""
    sums = word_series(spark, d).groupBy("word_md5").agg(F.sum("cnt").cast("bigint").alias("total"), F.max("cnt").alias("peak"), F.round(F.avg("cnt"), 6).alias("mean"))
    return ordinal(sums, "place", F.desc("total"), F.asc("word_md5"))


def day_series(spark: SparkSession, d: str, top: int = SETTINGS.trending_kept, day: int = 20140309) -> DataFrame:
    """Ten-minute series of one day for the trending words, as text, with trend and word."""
    trend = cut(trending_words(spark, d, top)).select("word_md5", "trend")
    rows = fr.word_time(spark, d).where(F.col("tenminute").between(day * 1000, day * 1000 + 999)).join(trend, "word_md5", "left_semi")
    lists = fill_gaps(rows, "word_md5", "tenminute", "cnt").groupBy("word_md5").agg(F.array_sort(F.collect_list(F.struct("tenminute", "cnt"))).alias("s"))
    words = fr.dictionary(spark, d).select(F.col("noun_md5").alias("word_md5"), F.col("noun").alias("text"))
    return lists.join(trend, "word_md5").join(words, "word_md5", "left").select("word_md5", "text", F.coalesce("trend", F.lit(0.0)).alias("trend"), F.array_join(F.transform("s", lambda x: x["cnt"].cast("string")), ",").alias("series"))


def frequent_words(spark: SparkSession, d: str, top: int) -> DataFrame:
    return fr.counts(spark, d).orderBy(F.desc("post_cnt"), "post_md5").limit(top)


def _moving(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("word_md5").orderBy("hour").rowsBetween(-1, 1)
    return word_series(spark, d).select("word_md5", "hour", F.round(F.avg("cnt").over(w), 6).alias("mean"))


QUERIES = {
    "trending_words": trending_words,
    "w4_gap_filled_series": word_series,
    "w6_word_trends": lambda s, d: word_trends(s, d).select("word_md5", *[F.round(c, 6).alias(c) for c in ("trend", "intercept", "delta")]),
    "w1_ranks": lambda s, d: ordinal(_day_counts(s, d), "rank", F.desc("cnt"), F.asc("word_md5")).select("word_md5", "cnt", "rank"),
    "w2_combined_rank": lambda s, d: combined_rank(_day_counts(s, d), word_trends(s, d).select("word_md5", F.round("trend", 6).alias("trend"))),
    "w9_moving_average": _moving,
    "w2_first_hundred": lambda s, d: combined_rank(_day_counts(s, d), word_trends(s, d).select("word_md5", F.round("trend", 6).alias("trend")), 100),
    "t3_frequent_words": lambda s, d: frequent_words(s, d, SETTINGS.trending_kept),
    "t3_first_hundred": lambda s, d: frequent_words(s, d, 100),
    "trending_first_hundred": lambda s, d: trending_words(s, d, 100),
    "g15_day_series": day_series,
    "g15_first_fifty": lambda s, d: day_series(s, d, 50),
    "a33_series_totals": series_totals,
}

_H = f"{fr.WT}, h as (select word_md5, tenminute // 10 as hour, sum(cnt)::bigint cnt from wt where tenminute > {fr.bucket(3)} group by all)"
_GRID = "hr as (select hour, row_number() over (order by hour)::double x from (select distinct hour from h)), grid as (select w.word_md5, hr.hour, x, coalesce(cnt, 0) cnt from (select distinct word_md5 from h) w cross join hr left join h on h.word_md5 = w.word_md5 and h.hour = hr.hour)"
_TR = f"{_H}, {_GRID}, norm as (select *, cnt * 100.0::double / max(cnt) over (partition by word_md5) y from grid), tr as (select word_md5, regr_slope(y, x) trend, regr_intercept(y, x) intercept, regr_slope(y, x) * (count(*) - 1) delta from norm group by 1)"
_DC = f"dc as (select word_md5, sum(cnt)::bigint cnt from wt where tenminute > {fr.bucket(1)} group by 1)"
_WS = f"{_H}, hr as (select distinct hour from h), ws as (select w.word_md5, hr.hour, coalesce(cnt, 0)::bigint cnt from (select distinct word_md5 from h) w cross join hr left join h on h.word_md5 = w.word_md5 and h.hour = hr.hour)"


def _trending_sql(n: int) -> str:
    return f"with {_TR} select word_md5, round(trend, 6) trend, round(delta, 6) delta from tr order by round(trend, 6) desc, word_md5 limit {n}"


def _combined_sql(n: int) -> str:
    return f"""with {_TR}, {_DC}, s as (select word_md5, row_number() over (order by (1 + ln(cnt)) * ln(4e6 / cnt) desc, word_md5) - 1 r1 from dc),
  b as (select s.word_md5, r1, coalesce(round(trend, 6), 0) trend from s left join tr using (word_md5))
select word_md5, r1 + row_number() over (order by trend desc, word_md5) - 1 as \"rank\" from b order by 2, 1 limit {n}"""


def _day_sql(n: int) -> str:
    return f"""with {_TR}, top as (select word_md5, round(trend, 6) trend from tr order by round(trend, 6) desc, word_md5 limit {n}), {fr.DICT}, t as (select * from wt where tenminute between 20140309000 and 20140309999 and word_md5 in (select word_md5 from top)), tm as (select distinct tenminute from t),
  g as (select w.word_md5, tm.tenminute, coalesce(cnt, 0) cnt from (select distinct word_md5 from t) w cross join tm left join t on t.word_md5 = w.word_md5 and t.tenminute = tm.tenminute),
  l as (select word_md5, string_agg(cnt::varchar, ',' order by tenminute) series from g group by 1)
select word_md5, noun as text, coalesce(trend, 0) trend, series from l join top using (word_md5) left join dict on noun_md5 = word_md5"""


SQL = {
    "trending_words": _trending_sql(2000),
    "trending_first_hundred": _trending_sql(100),
    "w2_first_hundred": _combined_sql(100),
    "t3_first_hundred": f"with {fr.PC} select post_md5, post_cnt from pc order by post_cnt desc, post_md5 limit 100",
    "g15_first_fifty": _day_sql(50),
    "w4_gap_filled_series": f"with {_WS} select word_md5, hour, cnt, round(cnt * 100.0::double / max(cnt) over (partition by word_md5), 6) scaled from ws",
    "w6_word_trends": f"with {_TR} select word_md5, round(trend, 6) trend, round(intercept, 6) intercept, round(delta, 6) delta from tr",
    "w1_ranks": f"with {fr.WT}, {_DC} select word_md5, cnt, row_number() over (order by cnt desc, word_md5) - 1 as \"rank\" from dc",
    "w2_combined_rank": _combined_sql(2000),
    "w9_moving_average": f"with {_WS} select word_md5, hour, round(avg(cnt) over (partition by word_md5 order by hour rows between 1 preceding and 1 following), 6) mean from ws",
    "t3_frequent_words": f"with {fr.PC} select post_md5, post_cnt from pc order by post_cnt desc, post_md5 limit 2000",
    "g15_day_series": _day_sql(2000),
    "a33_series_totals": f"with {_WS}, s as (select word_md5, sum(cnt)::bigint total, max(cnt) peak, round(avg(cnt), 6) mean from ws group by 1) select *, row_number() over (order by total desc, word_md5) - 1 place from s",
}
