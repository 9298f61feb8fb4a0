"""Schemas of all tables, and tables that are empty where they are missing."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

_COUNTS = "cnt bigint"
_DDL = {
    "tweets": "id bigint, tw_text string, username string, user_id bigint, in_reply_to_username string, in_reply_to_id bigint, created_at bigint",
    "users": "username string, since_id bigint, reply_cnt bigint, blocked_user int, done_time string",
    "nouns": "noun_md5 bigint, noun string",
    "sources": "noun_md5 bigint, noun string",
    "tweets_nouns": "id bigint, noun_md5 bigint",
    "tweets_words": "id bigint, noun_md5 bigint, source_md5 bigint",
    "tweets_words_simple": "noun_md5 bigint, source_md5 bigint",
    "tweet_chains": "post_id bigint, reply_id bigint",
    "chains_nouns": "p_id bigint, p_md5 bigint, r_id bigint, r_md5 bigint",
    "chains_nouns_all": "p_id bigint, p_md5 bigint, r_id bigint, r_md5 bigint, created_at bigint",
    "word_time_cnt": f"word_md5 bigint, tenminute bigint, {_COUNTS}",
    "word_hour_cnt": f"word_md5 bigint, hour bigint, {_COUNTS}",
    "word_mates": f"word1 bigint, word2 bigint, tenminute bigint, {_COUNTS}",
    "word_mates_sum": f"word1 bigint, word2 bigint, {_COUNTS}",
    "bigram_day": f"tenminute bigint, word1 bigint, word2 bigint, source1 bigint, source2 bigint, {_COUNTS}",
    "lemma_word_pairs": f"noun1 bigint, noun2 bigint, source1 bigint, source2 bigint, {_COUNTS}",
    "post_cnt": "post_md5 bigint, post_cnt bigint",
    "post_reply_cnt": "post_md5 bigint, reply_md5 bigint, reply_cnt bigint",
    "valid_replys": "reply_md5 bigint",
    "noun_similarity": "post1_md5 bigint, post2_md5 bigint, sim double",
    "noun_trend": "noun_md5 bigint, trend double",
    "clusters": "cluster_date string, k bigint, cluster string",
    "relevant": "cluster_date string, relevant string",
    "quality_marks": "update_time bigint, username string, exp_name string, exp_descr string, marks string",
    "tomita_progress": "id bigint, id_done int",
    "statuses_progress": "id bigint, id_done int",
}

#: Type names of nested values.
MEMBER = "struct<id: bigint, text: string, stem_text: string, trend: double, post_cnt: bigint>"
CLUSTER = f"members array<{MEMBER}>, members_len int, members_md5 string, centroid_md5 string, centroid_text string, unaligned string, gen_title string"
FACT = "struct<noun: string, noun_lemma: string, prep: string, prep_lemma: string, noun_id: string, prep_id: string, lead_id: string, is_hash_tag: boolean, is_person_name: boolean, is_number: boolean>"
MARKS = "array<map<string, string>>"


def ddl(name: str, like: str | None = None) -> str:
    """Columns of table ``name``; with ``like``, of a table of another name made by that template."""
    return _DDL[like or name]


def empty(spark: SparkSession, name: str, like: str | None = None) -> DataFrame:
    return spark.createDataFrame([], ddl(name, like))


def read_or_empty(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The parquet table at ``path``, or an empty one of the schema of ``name`` if there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty(spark, name)
