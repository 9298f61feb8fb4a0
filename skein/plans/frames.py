"""Base relations of a data folder that several queries start from, each with its SQL twin."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.scalars import clean_text, tenminute, tokens
from skein.runtime import table
from skein.sources.sinks import keep_first

#: "Now" of the queries: within the data's ten days.
NOW = datetime(2014, 3, 10, 12)


def bucket(days: float, digits: int = 11) -> int:
    """The time ``days`` before now as leading digits of yyyyMMddHHmmss."""
    return int((NOW - timedelta(days=days)).strftime("%Y%m%d%H%M%S")[:digits])


def tweets_once(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """One row a tweet, the first that arrived, with id and the given columns; no other column is moved."""
    order = ("fetched_at", "username", "in_reply_to_username")
    t = table(spark, d, "tweets").select("id", *dict.fromkeys((*order, *columns)))
    return keep_first(t, ["id"], *map(F.col, order)).select("id", *columns)


def words_of_tweets(spark: SparkSession, d: str) -> DataFrame:
    """(id, noun_md5, created_at), each pair of tweet and word once."""
    at = table(spark, d, "tweets").groupBy("id").agg(F.min("created_at").alias("created_at"))
    return table(spark, d, "tweets_nouns").where("noun_md5 is not null").select("id", "noun_md5").distinct().join(at, "id")


def word_time(spark: SparkSession, d: str) -> DataFrame:
    """The ten-minute counters (word_md5, tenminute, cnt)."""
    return words_of_tweets(spark, d).where("created_at is not null").groupBy(F.col("noun_md5").alias("word_md5"), tenminute("created_at").alias("tenminute")).agg(F.count("*").alias("cnt"))


def word_lists(spark: SparkSession, d: str) -> DataFrame:
    """(id, created_at, words): the lower-cased tokens of each cleaned tweet, in order."""
    return tweets_once(spark, d, "tw_text", "created_at").where("tw_text is not null").select("id", "created_at", tokens(F.lower(clean_text("tw_text"))).alias("words"))


def distances(spark: SparkSession, d: str) -> DataFrame:
    """(a, b, sim): each measured pair once, a < b, with its least distance."""
    return (
        table(spark, d, "noun_similarity")
        .where("sim is not null and not isnan(sim) and post1_md5 <> post2_md5")
        .groupBy(F.least("post1_md5", "post2_md5").alias("a"), F.greatest("post1_md5", "post2_md5").alias("b"))
        .agg(F.min("sim").alias("sim"))
    )


def matrix(spark: SparkSession, d: str) -> DataFrame:
    """(post_md5, reply_md5, reply_cnt): the sparse profile matrix, usable counts, one row a cell."""
    return table(spark, d, "post_reply_cnt").where("post_md5 is not null and reply_md5 is not null and reply_cnt >= 1").groupBy("post_md5", "reply_md5").agg(F.max("reply_cnt").alias("reply_cnt"))


def counts(spark: SparkSession, d: str) -> DataFrame:
    """(post_md5, post_cnt): one usable count a word, the largest."""
    return table(spark, d, "post_cnt").where("post_md5 is not null and post_cnt >= 1").groupBy("post_md5").agg(F.max("post_cnt").alias("post_cnt"))


def dictionary(spark: SparkSession, d: str) -> DataFrame:
    """(noun_md5, noun): one text a key, trimmed and lower-cased."""
    return table(spark, d, "nouns").where("noun_md5 is not null and noun is not null").groupBy("noun_md5").agg(F.min(F.lower(F.trim("noun"))).alias("noun"))


def sql_digest(x: str) -> str:
    part = lambda i: f"('0x' || substr(md5({x}), {1 + 8 * i}, 8))::ubigint"
    return f"xor(xor({part(0)}, {part(1)}), xor({part(2)}, {part(3)}))::bigint"


TW = "tw as (select * from tweets qualify row_number() over (partition by id order by fetched_at nulls first, username nulls first, in_reply_to_username nulls first) = 1)"
TN = "tn as (select n.id, noun_md5, created_at from (select distinct id, noun_md5 from tweets_nouns where noun_md5 is not null) n join (select id, min(created_at) created_at from tweets group by id) t using (id))"
WT = f"{TN}, wt as (select noun_md5 word_md5, created_at // 1000 tenminute, count(*)::bigint cnt from tn where created_at is not null group by all)"
CLEAN = r"regexp_replace(replace(replace(tw_text, chr(10), ' '), '''', '\'''), '(^@|\s@)[^\s]+', '', 'g')"
WL = rf"{TW}, wl as (select id, created_at, list_filter(string_split_regex(lower({CLEAN}), '\s+'), lambda x: x <> '') words from tw where tw_text is not null)"
DIST = "dist as (select least(post1_md5, post2_md5) a, greatest(post1_md5, post2_md5) b, min(sim) sim from noun_similarity where sim is not null and not isnan(sim) and post1_md5 <> post2_md5 group by 1, 2)"
MX = "mx as (select post_md5, reply_md5, max(reply_cnt) reply_cnt from post_reply_cnt where post_md5 is not null and reply_md5 is not null and reply_cnt >= 1 group by 1, 2)"
PC = "pc as (select post_md5, max(post_cnt) post_cnt from post_cnt where post_md5 is not null and post_cnt >= 1 group by 1)"
DICT = "dict as (select noun_md5, min(lower(trim(noun))) noun from nouns where noun_md5 is not null and noun is not null group by 1)"
