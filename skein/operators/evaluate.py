"""Evaluation: correlations, gold pairs, marks of annotators, cluster robustness, vocabulary grades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.config import SETTINGS
from skein.functions.scalars import col, digest, similarity10
from skein.operators.trend import ordinal
from skein.plans import frames as fr
from skein.runtime import table

#: Largest mark of each metric: fixed values of the questionnaire.
MARK_MAX = {"topic_density": 5, "title_correctness": 5, "tweets_relatedness": 5, "topic_relevance": 5}


def correlations(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """(n, pearson, spearman) of two columns.

    Spearman is over ordinal ranks: ties are broken by the pair's key columns a, b instead of averaged.  Both
    are null for fewer than two rows.
    """
    rows = pairs.select("a", "b", col(x).cast("double").alias("x"), col(y).cast("double").alias("y"))
    ranked = ordinal(ordinal(rows, "rx", F.asc("x"), F.asc("a"), F.asc("b")), "ry", F.asc("y"), F.asc("a"), F.asc("b"))
    d = (F.col("rx") - F.col("ry")).cast("double")
    n = F.count("*").cast("double")
    return ranked.agg(F.count("*").alias("n"), F.corr("x", "y").alias("pearson"), (1 - F.try_divide(6 * F.sum(d * d), n * (n * n - 1))).alias("spearman"))


def gold_pairs(gold: DataFrame, translations: DataFrame) -> DataFrame:
    """(a, b, human): gold pairs whose words both have a translation and different keys, smaller key first."""
    t = translations.groupBy("word").agg(digest(F.min("translation")).alias("key"))
    rows = gold.join(t.select(F.col("word").alias("word1"), F.col("key").alias("k1")), "word1").join(t.select(F.col("word").alias("word2"), F.col("key").alias("k2")), "word2").where("k1 <> k2")
    return rows.groupBy(F.least("k1", "k2").alias("a"), F.greatest("k1", "k2").alias("b")).agg(F.avg("human_mean").alias("human"))


def against_gold(gold: DataFrame, distances: DataFrame) -> DataFrame:
    """(a, b, human, measured, deviation): gold pairs that were measured, on the scale 0 to 10."""
    m = distances.select("a", "b", similarity10("sim").alias("measured"))
    return gold.join(m, ["a", "b"]).withColumn("deviation", F.col("measured") - F.col("human"))


def scale_range(distances: DataFrame) -> DataFrame:
    s = similarity10("sim")
    return distances.agg(F.min(s).alias("least"), F.max(s).alias("most"))


def grades(counts: DataFrame, above: tuple[int, ...] = (1, 10, 100, 1000)) -> DataFrame:
    """Share of words counted more often than each bound."""
    return counts.agg(F.count("*").alias("words"), *[F.try_divide(F.count_if(F.col("cnt") > n), F.count("*")).alias(f"above_{n}") for n in above])


def co_occurrence_pivot(index: DataFrame, topics: DataFrame, most: int) -> DataFrame:
    """(topic, total, n1 .. n<most>): tweets that have exactly 1, 2, ... of the topic's words."""
    hits = index.select("id", F.col("noun_md5").alias("word")).distinct().join(topics.select("topic", "word").distinct(), "word").groupBy("topic", "id").agg(F.count("*").alias("k"))
    return hits.groupBy("topic").agg(F.count("*").alias("total"), *[F.count_if(F.col("k") == i).alias(f"n{i}") for i in range(1, most + 1)])


def robustness(counts: Column) -> Column:
    """Slope of -log2((n_i + 1) / (n_1 + 1)) over i = 1, 2, ..., up to and with the first 0; null for one value."""
    first_zero = F.array_position(counts, F.lit(0).cast("bigint"))
    used = F.slice(counts, 1, F.when(first_zero > 0, first_zero.cast("int")).otherwise(F.size(counts)))
    y = F.transform(used, lambda n: -F.log2((n + 1) / (F.element_at(counts, 1) + 1)))
    n = F.size(y).cast("double")
    add = lambda a, v: a + v
    xy = F.aggregate(F.transform(y, lambda v, i: v * (i + 1)), F.lit(0.0), add)
    return F.try_divide(n * xy - n * (n + 1) / 2 * F.aggregate(y, F.lit(0.0), add), n * n * (n * n - 1) / 12)


def fact_counts(facts: DataFrame) -> DataFrame:
    """Numbers and shares of facts by kind, and the most and the mean facts a document; shares null without facts."""
    f = facts.select("di", "fact.*")
    per = f.groupBy("di").agg(F.count("*").alias("n"), *[F.count_if(c).alias(c) for c in ("is_hash_tag", "is_person_name", "is_number")])
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.max("n").alias("most"),
        F.avg("n").alias("mean"),
        *[F.try_divide(F.sum(c), F.sum("n")).alias(c) for c in ("is_hash_tag", "is_person_name", "is_number")],
    )


def marks_long(sets: DataFrame, marks: str = "marks", without_spam: bool = False) -> DataFrame:
    """(update_time, username, exp_name, mark, metric, value) of mark sets, the last set of each time and user.

    ``marks`` is the JSON array of a set.  A mark with topic_density and spam also gets the four flags of the
    confusion matrix (dense: density above 3; positive: dense).  Values that are no numbers are left out, as
    are, on demand, marks of spam.
    """
    last = Window.partitionBy("update_time", "username").orderBy(F.desc("exp_name"), F.desc(marks))
    once = sets.withColumn("__n", F.row_number().over(last)).where("__n = 1")
    m = once.select("update_time", "username", "exp_name", F.posexplode(F.from_json(marks, "array<map<string,string>>")).alias("mark", "m"))
    if without_spam:
        m = m.where("coalesce(m['spam'], '') <> '1'")
    dense, spam = F.col("m")["topic_density"].try_cast("int") > 3, F.col("m")["spam"] == "1"
    flag = lambda c: c.cast("int").cast("string")
    flags = F.create_map(F.lit("true_positive"), flag(dense & ~spam), F.lit("false_positive"), flag(dense & spam), F.lit("true_negative"), flag(~dense & spam), F.lit("false_negative"), flag(~dense & ~spam))
    both = F.when(dense.isNotNull() & spam.isNotNull(), F.map_concat(F.map_filter("m", lambda k, v: ~k.isin("true_positive", "false_positive", "true_negative", "false_negative")), flags)).otherwise(F.col("m"))
    return m.select("update_time", "username", "exp_name", "mark", F.explode(both).alias("metric", "v")).select("update_time", "username", "exp_name", "mark", "metric", F.col("v").try_cast("double").alias("value")).where("value is not null")


def mark_averages(long: DataFrame) -> DataFrame:
    """(update_time, username, metric, average): sums over the number of all marks of the set."""
    n = long.groupBy("update_time", "username").agg(F.count_distinct("mark").alias("n"))
    return long.groupBy("update_time", "username", "metric").agg(F.sum("value").alias("s")).join(n, ["update_time", "username"]).select("update_time", "username", "metric", (F.col("s") / F.col("n")).alias("average"))


def mark_totals(averages: DataFrame, most: dict[str, int] | None = None) -> DataFrame:
    """(update_time, username, total): mean of rounded average over largest mark, in percent; null without any."""
    top = F.create_map(*[F.lit(x) for kv in (most or MARK_MAX).items() for x in kv])
    share = F.round("average", 2) / top[F.col("metric")]
    return averages.groupBy("update_time", "username").agg(F.round(F.avg(share) * 100, 2).alias("total"))


def mark_table(averages: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """One row a set, one column a metric (those present, if none are given)."""
    g = averages.groupBy("update_time", "username")
    return (g.pivot("metric", metrics) if metrics else g.pivot("metric")).agg(F.first("average"))


def frequent(rows: DataFrame, column: str, n: int = 10) -> DataFrame:
    return rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


# ---- queries


def _two_measures(s: SparkSession, d: str) -> DataFrame:
    """Pairs measured more than once: least and greatest distance as two measures of the same."""
    t = table(s, d, "noun_similarity").where("sim is not null and not isnan(sim) and post1_md5 <> post2_md5")
    p = t.groupBy(F.least("post1_md5", "post2_md5").alias("a"), F.greatest("post1_md5", "post2_md5").alias("b")).agg(F.min("sim").alias("x"), F.max("sim").alias("y"), F.count("*").alias("c"))
    return p.where("c > 1 and x < y")


def _correlated(s: SparkSession, d: str) -> DataFrame:
    return correlations(_two_measures(s, d), "x", "y").select("n", F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"))


def _gold(s: SparkSession, d: str) -> DataFrame:
    """Pairs of words by their mates: a stand-in for gold, the more mates the more alike."""
    g = table(s, d, "word_mates").where("word1 <> word2 and cnt >= 1").groupBy(F.least("word1", "word2").alias("a"), F.greatest("word1", "word2").alias("b")).agg(F.least(F.sum("cnt"), F.lit(10)).cast("double").alias("human"))
    return against_gold(g, fr.distances(s, d)).select("a", "b", "human", F.round("measured", 6).alias("measured"), F.round("deviation", 6).alias("deviation"))


def _topics(s: SparkSession, d: str) -> DataFrame:
    p = fr.distances(s, d).where("sim < 0.45")
    return p.select(F.col("a").alias("topic"), F.col("b").alias("word")).unionByName(p.select(F.col("a").alias("topic"), F.col("a").alias("word"))).distinct()


def _pivot(s: SparkSession, d: str) -> DataFrame:
    return co_occurrence_pivot(table(s, d, "tweets_nouns").where("noun_md5 is not null"), _topics(s, d), 4)


def _robust(s: SparkSession, d: str) -> DataFrame:
    r = _pivot(s, d).withColumn("robustness", robustness(F.array("n1", "n2", "n3", "n4")))
    return r.select("topic", "total", F.round("robustness", 6).alias("robustness")).orderBy("robustness", "topic")


def _grades(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "tweets_nouns").where("noun_md5 is not null").groupBy("noun_md5").agg(F.count("*").alias("cnt"))
    return grades(c)


def _mark_sets(s: SparkSession, d: str) -> DataFrame:
    """Marks in JSON made from the counts of the frequent posts, an annotator for each last digit."""
    p = fr.counts(s, d).where(f"post_cnt > {SETTINGS.post_min_freq}")
    mark = F.create_map(F.lit("topic_density"), (F.col("post_cnt") % 6).cast("string"), F.lit("spam"), (F.col("post_md5") % 2).cast("string"), F.lit("topic_relevance"), (F.col("post_cnt") % 5).cast("string"))
    return p.groupBy((F.col("post_md5") % 10).alias("update_time")).agg(F.to_json(F.collect_list(mark)).alias("marks")).select("update_time", F.lit("u").alias("username"), F.lit("e").alias("exp_name"), "marks")


def _averages(s: SparkSession, d: str) -> DataFrame:
    return mark_averages(marks_long(_mark_sets(s, d)))


def _intersection(s: SparkSession, d: str) -> DataFrame:
    """Words counted on both of two days, with both counts."""
    c = fr.word_time(s, d).groupBy("word_md5", F.floor(F.col("tenminute") / 1000).cast("bigint").alias("day")).agg(F.sum("cnt").cast("bigint").alias("cnt"))
    one = lambda x, n: c.where(F.col("day") == x).select("word_md5", F.col("cnt").alias(n))
    return one(20140308, "c1").join(one(20140309, "c2"), "word_md5")


QUERIES = {
    "a25_correlations": _correlated,
    "u8_gold_deviation": _gold,
    "g17_scale_range": lambda s, d: scale_range(fr.distances(s, d)).select(F.round("least", 6).alias("least"), F.round("most", 6).alias("most")),
    "a20_words_met": _pivot,
    "x24_robustness": _robust,
    "a21_grades": lambda s, d: _grades(s, d).select("words", *[F.round(f"above_{n}", 6).alias(f"above_{n}") for n in (1, 10, 100, 1000)]),
    "a22_mark_averages": lambda s, d: _averages(s, d).select("update_time", "metric", F.round("average", 6).alias("average")),
    "a22_mark_totals": lambda s, d: mark_totals(_averages(s, d)).select("update_time", "total"),
    "g19_mark_table": lambda s, d: mark_table(_averages(s, d), ["topic_density", "topic_relevance", "spam", "true_positive"]).select("update_time", *[F.round(c, 6).alias(c) for c in ("topic_density", "topic_relevance", "spam", "true_positive")]),
    "a24_distance_spread": lambda s, d: fr.distances(s, d).agg(F.round(F.avg("sim"), 6).alias("mean"), F.round(F.stddev_pop("sim"), 6).alias("sd")),
    "a27_frequent_users": lambda s, d: frequent(fr.tweets_once(s, d, "username"), "username"),
    "j13_words_of_both_days": _intersection,
}

_TWO = "two as (select least(post1_md5, post2_md5) a, greatest(post1_md5, post2_md5) b, min(sim) x, max(sim) y from noun_similarity where sim is not null and not isnan(sim) and post1_md5 <> post2_md5 group by 1, 2 having count(*) > 1 and min(sim) < max(sim))"
_PV = f"""{fr.DIST}, tp as (select a topic, b word from dist where sim < 0.45 union select a, a from dist where sim < 0.45), ix as (select distinct id, noun_md5 from tweets_nouns where noun_md5 is not null),
  k as (select topic, id, count(*) k from ix join tp on word = noun_md5 group by 1, 2), pv as (select topic, count(*) total, count(*) filter (k = 1) n1, count(*) filter (k = 2) n2, count(*) filter (k = 3) n3, count(*) filter (k = 4) n4 from k group by 1)"""
_MK = f"{fr.PC}, p as (select post_md5 % 10 update_time, post_cnt % 6 dens, post_md5 % 2 spam, post_cnt % 5 rel from pc where post_cnt > 5)"
SQL = {
    "a25_correlations": f"""with {_TWO}, r as (select *, row_number() over (order by x, a, b) rx, row_number() over (order by y, a, b) ry from two)
select count(*) n, round(corr(x, y), 6) pearson, round(1 - 6 * sum((rx - ry) ** 2) / nullif(count(*) * (count(*)::double ** 2 - 1), 0), 6) spearman from r""",
    "u8_gold_deviation": f"with {fr.DIST}, g as (select least(word1, word2) a, greatest(word1, word2) b, least(sum(cnt), 10)::double human from word_mates where word1 <> word2 and cnt >= 1 group by 1, 2) select a, b, human, round(10 * (1 - sim), 6) measured, round(10 * (1 - sim) - human, 6) deviation from g join dist using (a, b)",
    "g17_scale_range": f"with {fr.DIST} select round(min(10 * (1 - sim)), 6) least, round(max(10 * (1 - sim)), 6) most from dist",
    "a20_words_met": f"with {_PV} select * from pv",
    "x24_robustness": f"""with {_PV}, l as (select topic, total, unnest([n1, n2, n3, n4]) n, unnest([1, 2, 3, 4]) i, n1, case when n1 = 0 then 1 when n2 = 0 then 2 when n3 = 0 then 3 else 4 end last from pv)
select topic, any_value(total) total, round(regr_slope(-log2((n + 1)::double / (n1 + 1)), i), 6) robustness from l where i <= last group by 1""",
    "a21_grades": "with c as (select count(*) cnt from tweets_nouns where noun_md5 is not null group by noun_md5) select count(*) words, "
    + ", ".join(f"round(count(*) filter (cnt > {n}) / nullif(count(*), 0), 6) above_{n}" for n in (1, 10, 100, 1000))
    + " from c",
    "a22_mark_averages": f"""with {_MK}, l as (select update_time, unnest([dens, spam, rel, (dens > 3 and spam = 0)::int, (dens > 3 and spam = 1)::int, (dens <= 3 and spam = 1)::int, (dens <= 3 and spam = 0)::int]) v,
  unnest(['topic_density', 'spam', 'topic_relevance', 'true_positive', 'false_positive', 'true_negative', 'false_negative']) metric from p) select update_time, metric, round(avg(v), 6) average from l group by 1, 2""",
    "a22_mark_totals": f"with {_MK} select update_time, round((round(avg(dens), 2) / 5 + round(avg(rel), 2) / 5) / 2 * 100, 2) total from p group by 1",
    "g19_mark_table": f"with {_MK} select update_time, round(avg(dens), 6) topic_density, round(avg(rel), 6) topic_relevance, round(avg(spam), 6) spam, round(avg((dens > 3 and spam = 0)::int), 6) true_positive from p group by 1",
    "a24_distance_spread": f"with {fr.DIST} select round(avg(sim), 6) mean, round(stddev_pop(sim), 6) sd from dist",
    "a27_frequent_users": f"with {fr.TW} select username, count(*) n from tw where username is not null group by 1 order by 2 desc, 1 limit 10",
    "j13_words_of_both_days": f"with {fr.WT}, c as (select word_md5, tenminute // 1000 as day, sum(cnt)::bigint cnt from wt group by all) select x.word_md5, x.cnt c1, y.cnt c2 from c x join c y on x.word_md5 = y.word_md5 where x.day = 20140308 and y.day = 20140309",
}
