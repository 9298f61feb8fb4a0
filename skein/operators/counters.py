"""Counters by word and time, co-occurrence and neighbour counts, and their roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.config import SETTINGS
from skein.functions.scalars import col, digests, hour, tenminute, windowed_pairs, zipped
from skein.plans import frames as fr
from skein.runtime import table


def count_words(words: DataFrame, word: str, bucket: Column) -> DataFrame:
    """(word, bucket, cnt)."""
    return words.groupBy(F.col(word).alias("word_md5"), bucket.alias("bucket")).agg(F.count("*").alias("cnt"))


def count_mates(lists: DataFrame, words: str = "words", at: str = "created_at", bag: int = SETTINGS.bag_size, full: bool = False) -> DataFrame:
    """(word1, word2, tenminute, cnt): unordered pairs within the windows of a word list, smaller key first."""
    keys = lists.select(digests(words).alias("w"), tenminute(at).alias("tenminute"))
    pairs = keys.select(F.explode(windowed_pairs("w", bag, full)).alias("p"), "tenminute")
    return pairs.groupBy(F.least("p.w1", "p.w2").alias("word1"), F.greatest("p.w1", "p.w2").alias("word2"), "tenminute").agg(F.count("*").alias("cnt"))


def count_bigrams(lists: DataFrame, lemmas: str, sources: str, at: str = "created_at") -> DataFrame:
    """(word1, word2, source1, source2, tenminute, cnt): ordered neighbours with their surface forms."""
    both = lists.select(digests(lemmas).alias("word"), digests(sources).alias("source"), tenminute(at).alias("tenminute"))
    pairs = both.select(zipped("word", "source").alias("w"), "tenminute").select(F.explode(windowed_pairs("w", 2)).alias("p"), "tenminute")
    keys = {"word1": "p.w1.word", "word2": "p.w2.word", "source1": "p.w1.source", "source2": "p.w2.source"}
    return pairs.groupBy(*[F.col(v).alias(k) for k, v in keys.items()], "tenminute").agg(F.count("*").alias("cnt"))


def recent_sum(counters: DataFrame, keys: list[str], after: int, bucket: str = "tenminute") -> DataFrame:
    """Sums of cnt by key over the buckets strictly after ``after``."""
    return counters.where(F.col(bucket) > after).groupBy(*keys).agg(F.sum("cnt").cast("bigint").alias("cnt"))


def hourly(counters: DataFrame, after: int | None = None) -> DataFrame:
    """(word_md5, hour, cnt) from ten-minute counters: a bucket without its last digit."""
    rows = counters if after is None else counters.where(F.col("tenminute") > after)
    return rows.groupBy("word_md5", F.floor(F.col("tenminute") / 10).cast("bigint").alias("hour")).agg(F.sum("cnt").cast("bigint").alias("cnt"))


def recent_mates(mates: DataFrame, words: DataFrame, after: int) -> DataFrame:
    """Two-day sums of the pairs whose first (smaller) key is among ``words``; the second may be any word."""
    canonical = mates.where("word1 is not null and word2 is not null and cnt >= 1").select(F.least("word1", "word2").alias("word1"), F.greatest("word1", "word2").alias("word2"), "tenminute", "cnt")
    return recent_sum(canonical.join(words.select(F.col("word_md5").alias("word1")).distinct(), "word1", "left_semi"), ["word1", "word2"], after)


def symmetric(pairs: DataFrame, a: str, b: str, *values: str) -> DataFrame:
    """Every pair in both orders, a pair of a word with itself once."""
    return pairs.select(a, b, *values).unionByName(pairs.where(col(a) != col(b)).select(F.col(b).alias(a), F.col(a).alias(b), *values))


def drop_noise(bigrams: DataFrame, words: DataFrame, least: float = SETTINGS.bigram_noise) -> DataFrame:
    """Bigrams whose count is at least that share of their first word's count; uncounted words drop theirs."""
    total = words.select(F.col("word_md5").alias("word1"), F.col("cnt").alias("word1_cnt"))
    return bigrams.join(total, "word1").where(F.try_divide("cnt", "word1_cnt") >= least)


def documents_of_words(rows: DataFrame, doc: str, word: str) -> DataFrame:
    return rows.groupBy(F.col(word).alias("word_md5")).agg(F.count_distinct(doc).alias("docs"))


# ---- queries

_LEMMA = r"^[^\p{L}\p{N}#]+|[^\p{L}\p{N}]+$"


def _lists(spark: SparkSession, d: str) -> DataFrame:
    """Word lists with sources (tokens) and lemmas (tokens without outer punctuation)."""
    return fr.word_lists(spark, d).where("created_at is not null").select("created_at", F.col("words").alias("sources"), F.transform("words", lambda w: F.regexp_replace(w, _LEMMA, "")).alias("lemmas"))


def _bigrams(spark: SparkSession, d: str) -> DataFrame:
    return count_bigrams(_lists(spark, d), "lemmas", "sources")


def _day_words(spark: SparkSession, d: str) -> DataFrame:
    return recent_sum(fr.word_time(spark, d), ["word_md5"], fr.bucket(1))


QUERIES = {
    "a1_word_tenminute": lambda s, d: count_words(fr.words_of_tweets(s, d).where("created_at is not null"), "noun_md5", tenminute("created_at")),
    "a2_word_hour": lambda s, d: count_words(fr.words_of_tweets(s, d).where("created_at is not null"), "noun_md5", hour("created_at")),
    "a3_word_mates": lambda s, d: count_mates(fr.word_lists(s, d).where("created_at is not null")),
    "a4_bigrams": _bigrams,
    "a5_day_words": _day_words,
    "a6_day_bigrams": lambda s, d: recent_sum(_bigrams(s, d), ["source1", "word1", "source2", "word2"], fr.bucket(1)),
    "a7_hourly": lambda s, d: hourly(fr.word_time(s, d), fr.bucket(3)),
    "a8_recent_mates": lambda s, d: recent_mates(table(s, d, "word_mates"), _day_words(s, d).where("cnt >= 3"), fr.bucket(2)),
    "a9_symmetric_mates": lambda s, d: symmetric(recent_sum(table(s, d, "word_mates").where("word1 is not null and word2 is not null").select(F.least("word1", "word2").alias("word1"), F.greatest("word1", "word2").alias("word2"), "tenminute", "cnt"), ["word1", "word2"], fr.bucket(2)), "word1", "word2", "cnt"),
    "a10_documents_of_words": lambda s, d: documents_of_words(table(s, d, "tweets_nouns").where("noun_md5 is not null"), "id", "noun_md5"),
    "f4_after_bound": lambda s, d: table(s, d, "word_mates").where(F.col("tenminute") > fr.bucket(1)).select("word1", "word2", "tenminute", "cnt"),
    "f9_bigram_noise": lambda s, d: drop_noise(recent_sum(_bigrams(s, d), ["word1", "word2"], fr.bucket(1)), recent_sum(_bigrams(s, d), ["word1"], fr.bucket(1)).withColumnRenamed("word1", "word_md5"), 0.2),
    "x3_windowed_pairs": lambda s, d: fr.word_lists(s, d).select("id", F.explode(windowed_pairs("words")).alias("p")).groupBy("id").agg(F.count("*").alias("pairs"), F.min(F.concat_ws(" ", "p.w1", "p.w2")).alias("least_pair")),
    "g14_pairs_with_time": lambda s, d: fr.word_lists(s, d).select("created_at", F.explode(windowed_pairs("words", 3)).alias("p")).groupBy("created_at", F.col("p.w1").alias("word1"), F.col("p.w2").alias("word2")).agg(F.count("*").alias("n")),
    "k2_added_counts": lambda s, d: added(s, d),
    "d10_all_days": lambda s, d: fr.word_time(s, d).groupBy(F.floor(F.col("tenminute") / 1000).cast("bigint").alias("day")).agg(F.sum("cnt").cast("bigint").alias("cnt"), F.count_distinct("word_md5").alias("words")),
    "g4_table_counts": lambda s, d: table(s, d, "post_cnt").agg(F.count("*").alias("n")).select(F.lit("post_cnt").alias("name"), "n").unionByName(table(s, d, "post_reply_cnt").agg(F.count("*").alias("n")).select(F.lit("post_reply_cnt").alias("name"), "n")),
    "streamed_word_hours": lambda s, d: streamed(s, d),
}


def added(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counters of the first days with the increments of the rest added."""
    from skein.sources.sinks import add_counts

    hours = hourly(fr.word_time(spark, d))
    return add_counts(hours.where(F.col("hour") < 2014030600), hours.where(F.col("hour") >= 2014030600), ["word_md5"], "cnt")


def streamed(spark: SparkSession, d: str) -> DataFrame:
    from skein.streaming.jobs import word_hours_of_files

    return word_hours_of_files(spark, d)


def _pairs_sql(words: str, bag: int, extra: str) -> str:
    """Rows (extra, w1, w2) of all windows; the last two of each length are left out."""
    return f"select {extra}, words[i + 1] w1, words[i + n] w2 from (select *, unnest(range(0, len(words) - n - 1)) i from (select *, unnest(range(2, {bag + 1})) n from {words}))"


_BG = rf"""{fr.WL}, ls as (select created_at, words srcs, list_transform(words, lambda w: regexp_replace(regexp_replace(w, '^[^\p{{L}}\p{{N}}#]+', ''), '[^\p{{L}}\p{{N}}]+$', '')) lems from wl where created_at is not null),
  bg as (select {fr.sql_digest("lems[i + 1]")} word1, {fr.sql_digest("lems[i + 2]")} word2, {fr.sql_digest("srcs[i + 1]")} source1, {fr.sql_digest("srcs[i + 2]")} source2, created_at // 1000 tenminute, count(*) cnt
    from (select *, unnest(range(0, len(srcs) - 3)) i from ls) group by all)"""
SQL = {
    "a1_word_tenminute": f"with {fr.WT} select word_md5, tenminute bucket, cnt from wt",
    "a2_word_hour": f"with {fr.TN} select noun_md5 word_md5, created_at // 10000 bucket, count(*) cnt from tn where created_at is not null group by all",
    "a3_word_mates": f"with {fr.WL}, p as ({_pairs_sql('wl', 5, 'created_at')}), k as (select created_at // 1000 tenminute, {fr.sql_digest('w1')} a, {fr.sql_digest('w2')} b from p where created_at is not null) select least(a, b) word1, greatest(a, b) word2, tenminute, count(*) cnt from k group by all",
    "a4_bigrams": f"with {_BG} select * from bg",
    "a5_day_words": f"with {fr.WT} select word_md5, sum(cnt)::bigint cnt from wt where tenminute > {fr.bucket(1)} group by 1",
    "a6_day_bigrams": f"with {_BG} select source1, word1, source2, word2, sum(cnt)::bigint cnt from bg where tenminute > {fr.bucket(1)} group by all",
    "a7_hourly": f"with {fr.WT} select word_md5, tenminute // 10 as hour, sum(cnt)::bigint cnt from wt where tenminute > {fr.bucket(3)} group by all",
    "a8_recent_mates": f"""with {fr.WT}, w as (select word_md5 from wt where tenminute > {fr.bucket(1)} group by 1 having sum(cnt) >= 3)
select least(word1, word2) word1, greatest(word1, word2) word2, sum(cnt)::bigint cnt from word_mates where word1 is not null and word2 is not null and cnt >= 1 and tenminute > {fr.bucket(2)} and least(word1, word2) in (select word_md5 from w) group by 1, 2""",
    "a9_symmetric_mates": f"""with m as (select least(word1, word2) a, greatest(word1, word2) b, sum(cnt)::bigint cnt from word_mates where word1 is not null and word2 is not null and tenminute > {fr.bucket(2)} group by 1, 2)
select a word1, b word2, cnt from m union all select b, a, cnt from m where a <> b""",
    "a10_documents_of_words": "select noun_md5 word_md5, count(distinct id) docs from tweets_nouns where noun_md5 is not null group by 1",
    "f4_after_bound": f"select * from word_mates where tenminute > {fr.bucket(1)}",
    "f9_bigram_noise": f"""with {_BG}, d as (select word1, word2, sum(cnt)::bigint cnt from bg where tenminute > {fr.bucket(1)} group by all), w as (select word1, sum(cnt)::bigint word1_cnt from d group by 1)
select word1, word2, cnt, word1_cnt from d join w using (word1) where cnt / word1_cnt >= 0.2""",
    "x3_windowed_pairs": f"with {fr.WL}, p as ({_pairs_sql('wl', 5, 'id')}) select id, count(*) pairs, min(w1 || ' ' || w2) least_pair from p group by 1",
    "g14_pairs_with_time": f"with {fr.WL}, p as ({_pairs_sql('wl', 3, 'created_at')}) select created_at, w1 word1, w2 word2, count(*) n from p group by all",
    "k2_added_counts": f"with {fr.WT} select word_md5, sum(cnt)::bigint cnt from wt group by 1",
    "d10_all_days": f"with {fr.WT} select tenminute // 1000 as day, sum(cnt)::bigint cnt, count(distinct word_md5) words from wt group by 1",
    "g4_table_counts": "select 'post_cnt' as name, count(*) n from post_cnt union all select 'post_reply_cnt', count(*) from post_reply_cnt",
    "streamed_word_hours": f"with {fr.TW} select created_at // 10000 as hour, count(*) tweets from tw where created_at is not null group by 1",
}
