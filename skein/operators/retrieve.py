"""Tweets of a topic: lookup by word, removal of copies, ranking; and the joins of the ingest stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.config import SETTINGS
from skein.functions.scalars import clean_text, day, digest, has_cyrillic, to_time, tokens
from skein.operators.api import topics_of
from skein.plans import frames as fr
from skein.runtime import table


def matching(tweets: DataFrame, index: DataFrame, topics: DataFrame, limit: int | None = None) -> DataFrame:
    """(topic, id, words) with the other columns of ``tweets``: tweets with a word of the topic, and which.

    ``topics`` are (topic, word).  With ``limit``, a topic's matches are the first so many of each day by id.
    """
    hits = index.select("id", F.col("noun_md5").alias("word")).distinct().join(topics.select("topic", "word").distinct(), "word").groupBy("topic", "id").agg(F.array_sort(F.collect_set("word")).alias("words"))
    found = hits.join(tweets, "id")
    if limit is not None:
        w = Window.partitionBy("topic", day("created_at")).orderBy("id")
        found = found.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= limit).drop("__n")
    return found


def newest_wins(today: DataFrame, before: DataFrame, key: str = "id") -> DataFrame:
    """Rows of two days; of a key in both, today's."""
    return today.unionByName(before.join(today.select(key).distinct(), key, "left_anti"))


def with_text_key(tweets: DataFrame, *columns: str) -> DataFrame:
    """(id, text_md5, columns) of the tweets that have a text; the texts themselves need not be moved."""
    return tweets.where("tw_text is not null").select("id", F.md5("tw_text").alias("text_md5"), *columns)


def without_copies(found: DataFrame) -> DataFrame:
    """One tweet of each topic and exact text (``text_md5``): the greatest id."""
    last = found.groupBy("topic", "text_md5").agg(F.max("id").alias("id")).select("topic", "id")
    return found.join(last, ["topic", "id"], "left_semi")


def without_near_copies(found: DataFrame, words: str) -> DataFrame:
    """One tweet of each topic and set of words: the latest, of equal times the smaller id."""
    key = F.array_join(F.transform(F.array_sort(F.array_distinct(F.col(words))), lambda x: x.cast("string")), ",")
    last = F.max_by(F.struct(*found.columns), F.struct(F.coalesce("created_at", F.lit(0)), (-F.col("id")).alias("i")))
    return found.groupBy("topic", key.alias("__k")).agg(last.alias("r")).select("r.*")


def relevant(found: DataFrame, index: DataFrame, top: int = SETTINGS.tweets_per_cluster) -> DataFrame:
    """(topic, rank, id, matched, created_at, density): the best tweets of each topic.

    Exact copies go first, then tweets with the same set of all words; ranked by number of matched words, then
    time, then id.  density is the number of different sets of matched words.
    """
    once = without_copies(found)
    every = index.select("id", "noun_md5").distinct().join(once.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.collect_set("noun_md5").alias("all_words"))
    full = without_near_copies(once.join(every, "id"), "all_words")
    density = once.groupBy("topic").agg(F.count_distinct("words").alias("density"))
    w = Window.partitionBy("topic").orderBy(F.desc("matched"), F.desc("created_at"), "id")
    ranked = full.withColumn("matched", F.size("words")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return ranked.join(density, "topic").select("topic", "rank", "id", "matched", "created_at", "density")


def match_histogram(found: DataFrame) -> DataFrame:
    """(topic, matched, tweets): after exact copies are gone, before near copies are."""
    return without_copies(found).groupBy("topic", F.size("words").alias("matched")).agg(F.count("*").alias("tweets"))


def chains(tweets: DataFrame, same_day: bool = True) -> DataFrame:
    """(post_id, reply_id) of the replies whose post is there, by default on the same day."""
    post = tweets.select(F.col("id").alias("post_id"), day("created_at").alias("d"))
    reply = tweets.where("in_reply_to_id is not null").select(F.col("id").alias("reply_id"), F.col("in_reply_to_id").alias("post_id"), day("created_at").alias("d"))
    return reply.join(post, ["post_id", "d"] if same_day else "post_id").select("post_id", "reply_id").distinct()


def unseen(rows: DataFrame, seen: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(seen.select(key), key, "left_anti")


def next_chunk(progress: DataFrame, tweets: DataFrame, n: int = SETTINGS.chunk_rows) -> DataFrame:
    """The first n tweets, by id, that are queued and not done."""
    return progress.where("id_done is null or id_done = 0").select("id").join(tweets, "id").orderBy("id").limit(n)


def look_up_words(words: DataFrame, tweets_words: DataFrame, sources: DataFrame, nouns: DataFrame) -> DataFrame:
    """(word, word_md5, lemma_md5) of typed words: as a surface form with its lemma, else as a lemma."""
    asked = words.select("word", digest("word").alias("word_md5"))
    as_source = tweets_words.join(sources.select(F.col("noun_md5").alias("source_md5")).distinct(), "source_md5").groupBy("source_md5").agg(F.min("noun_md5").alias("lemma"))
    as_noun = nouns.select("noun_md5").distinct()
    return asked.join(as_source, asked["word_md5"] == as_source["source_md5"], "left").join(as_noun, asked["word_md5"] == as_noun["noun_md5"], "left").select("word", "word_md5", F.coalesce("lemma", "noun_md5").alias("lemma_md5"))


def reply_contexts(chains_: DataFrame, index: DataFrame) -> DataFrame:
    """(p_id, p_md5, r_id, r_md5): words of a post with the words of its replies."""
    i = index.select("id", "noun_md5").distinct()
    return chains_.select(F.col("post_id").alias("p_id"), F.col("reply_id").alias("r_id")).join(i.select(F.col("id").alias("p_id"), F.col("noun_md5").alias("p_md5")), "p_id").join(i.select(F.col("id").alias("r_id"), F.col("noun_md5").alias("r_md5")), "r_id").select("p_id", "p_md5", "r_id", "r_md5")


def post_contexts(index: DataFrame) -> DataFrame:
    """(id, p_md5, r_md5): every two different words of a tweet, both ways."""
    i = index.select("id", "noun_md5").distinct()
    other = i.select(F.col("id"), F.col("noun_md5").alias("r_md5"))
    return i.withColumnRenamed("noun_md5", "p_md5").join(other, "id").where("p_md5 <> r_md5")


def count_contexts(contexts: DataFrame, post_id: str) -> tuple[DataFrame, DataFrame]:
    """(post_md5, post_cnt) by different posts, and (post_md5, reply_md5, reply_cnt)."""
    return (
        contexts.groupBy(F.col("p_md5").alias("post_md5")).agg(F.count_distinct(post_id).alias("post_cnt")),
        contexts.groupBy(F.col("p_md5").alias("post_md5"), F.col("r_md5").alias("reply_md5")).agg(F.count("*").alias("reply_cnt")),
    )


def own_contexts(index: DataFrame) -> DataFrame:
    """(id, p_md5, r_md5): every word of a tweet with every word of it, itself too."""
    i = index.select("id", "noun_md5").distinct()
    return i.withColumnRenamed("noun_md5", "p_md5").join(i.withColumnRenamed("noun_md5", "r_md5"), "id")


def kept_contexts(counts: DataFrame, contexts: DataFrame, n: int, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """Word counts and contexts of the ``n`` most frequent words (of int(1.1 n), for contexts), of those at least
    ``least`` times counted; ties to the smaller key."""
    top = counts.orderBy(F.desc("post_cnt"), "post_md5").limit(n).where(F.col("post_cnt") >= least)
    words = top.orderBy(F.desc("post_cnt"), "post_md5").limit(int(1.1 * n)).select("post_md5")
    return top, contexts.join(words, "post_md5", "left_semi")


def answered(chains_: DataFrame, index: DataFrame, post_words: DataFrame, reply_words: DataFrame) -> DataFrame:
    """Chains whose post has one of ``post_words`` and whose reply has one of ``reply_words`` (both (word))."""
    ids = lambda words, name: index.join(words.select(F.col("word").alias("noun_md5")).distinct(), "noun_md5", "left_semi").select(F.col("id").alias(name)).distinct()
    return chains_.join(ids(post_words, "post_id"), "post_id", "left_semi").join(ids(reply_words, "reply_id"), "reply_id", "left_semi").select("post_id", "reply_id")


# ---- queries


def _topics(s: SparkSession, d: str) -> DataFrame:
    """(topic, word): the members of all published topics; a topic is named by its snapshot and place."""
    t = topics_of(table(s, d, "clusters").distinct())
    return t.select(F.concat_ws(":", "cluster_date", "topic").alias("topic"), F.explode("members.id").alias("word")).where("word is not null").distinct()


def _found(s: SparkSession, d: str, limit: int | None = None) -> DataFrame:
    return matching(with_text_key(fr.tweets_once(s, d, "tw_text", "created_at"), "created_at"), _index(s, d), _topics(s, d), limit)


def _joined(c: str) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)


def _index(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "tweets_nouns").where("noun_md5 is not null")


def _chains(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "tweet_chains").where("post_id is not null and reply_id is not null").distinct()


def _look_up(s: SparkSession, d: str) -> DataFrame:
    nouns = fr.dictionary(s, d)
    words = nouns.select(F.col("noun").alias("word")).unionByName(s.createDataFrame([("__total__",), ("нетслова",)], "word string")).distinct()
    tw = table(s, d, "word_mates").where("word1 is not null and word2 is not null").select(F.lit(1).alias("id"), F.col("word1").alias("noun_md5"), F.col("word2").alias("source_md5"))
    return look_up_words(words, tw, nouns, nouns)


def _context_pairs(s: SparkSession, d: str) -> DataFrame:
    return count_contexts(reply_contexts(_chains(s, d), _index(s, d)), "p_id")[1]


def _kept_contexts(s: SparkSession, d: str) -> DataFrame:
    return kept_contexts(*count_contexts(own_contexts(_index(s, d)), "id"), SETTINGS.contexts_kept)[1]


def _next_chunk(s: SparkSession, d: str, n: int) -> DataFrame:
    """The replies of all chains are queued; what arrived before a time is done."""
    arrived = table(s, d, "tweets").groupBy("id").agg(F.min("fetched_at").alias("at"))
    queue = _chains(s, d).select(F.col("reply_id").alias("id")).distinct().join(arrived, "id").select("id", (F.col("at") < F.lit("2014-03-04").cast("timestamp")).cast("int").alias("id_done"))
    return next_chunk(queue, fr.tweets_once(s, d, "created_at"), n).select("id", "created_at")


QUERIES = {
    "f1_cyrillic": lambda s, d: table(s, d, "tweets").where(has_cyrillic("tw_text")).select("id").distinct(),
    "f2_clean_texts": lambda s, d: fr.tweets_once(s, d, "tw_text").select("id", clean_text("tw_text").alias("text")),
    "f3_date_range": lambda s, d: fr.tweets_once(s, d, "created_at").where(day("created_at").between(20140303, 20140305)).select("id", "created_at"),
    "f5_hour_range": lambda s, d: fr.word_time(s, d).where(F.col("tenminute").between(20140308090, 20140308119)).groupBy("word_md5").agg(F.sum("cnt").cast("bigint").alias("cnt")),
    "f6_words_in_list": lambda s, d: _index(s, d).join(fr.counts(s, d).where("post_cnt > 20").select(F.col("post_md5").alias("noun_md5")), "noun_md5", "left_semi").select("id", "noun_md5").distinct(),
    "f8_frequent_posts": lambda s, d: fr.counts(s, d).where("post_cnt > 5"),
    "f11_unseen_posts": lambda s, d: unseen(table(s, d, "tweets").where("in_reply_to_id is not null").select(F.col("in_reply_to_id").alias("id")).distinct(), table(s, d, "tweets")),
    "f15_recent": lambda s, d: fr.tweets_once(s, d, "created_at", "username").where(to_time("created_at") >= F.lit("2014-03-09").cast("timestamp")).select("id", "username"),
    "j1_chains": lambda s, d: chains(fr.tweets_once(s, d, "in_reply_to_id", "created_at")),
    "j1_chains_any_day": lambda s, d: chains(fr.tweets_once(s, d, "in_reply_to_id", "created_at"), same_day=False),
    "j2_tweets_without_words": lambda s, d: unseen(table(s, d, "tweets").select("id").distinct(), table(s, d, "tweets_nouns")),
    "j3_next_chunk": lambda s, d: _next_chunk(s, d, SETTINGS.chunk_rows),
    "j3_chunk_of_hundred": lambda s, d: _next_chunk(s, d, 100),
    "j5_matching_tweets": lambda s, d: _found(s, d).select("topic", "id", _joined("words")),
    "j6_looked_up_words": _look_up,
    "j7_reply_posts": lambda s, d: table(s, d, "tweets").select("id", "created_at").distinct().join(_chains(s, d).select(F.col("post_id").alias("id")), "id", "left_semi").groupBy(day("created_at").alias("day")).agg(F.count("*").alias("posts")),
    "j8_reply_contexts": _context_pairs,
    "j8_post_contexts": lambda s, d: count_contexts(post_contexts(_index(s, d)), "id")[1],
    "g6_kept_contexts": _kept_contexts,
    "a31_context_counts": lambda s, d: count_contexts(reply_contexts(_chains(s, d), _index(s, d)), "p_id")[0],
    "j14_newest_wins": lambda s, d: newest_wins(*(fr.tweets_once(s, d, "created_at", "username").where(day("created_at") == x).select("id", "username") for x in (20140309, 20140308))),
    "d2_exact_copies": lambda s, d: without_copies(_found(s, d)).select("topic", "id"),
    "d3_near_copies": lambda s, d: without_near_copies(_found(s, d), "words").select("topic", "id", _joined("words")),
    "t5_relevant_tweets": lambda s, d: relevant(_found(s, d), _index(s, d)),
    "a19_match_histogram": lambda s, d: match_histogram(_found(s, d)),
    "t11_first_tweets_of_day": lambda s, d: _found(s, d, SETTINGS.tweets_per_day).select("topic", "id"),
    "t11_first_two_of_day": lambda s, d: _found(s, d, 2).select("topic", "id"),
    "g2_answered_with": lambda s, d: answered(_chains(s, d), _index(s, d), *([_topics(s, d).select("word")] * 2)),
    "g9_words_in_scope": lambda s, d: fr.matrix(s, d).join(fr.dictionary(s, d).select(digest("noun").alias("post_md5")).distinct(), "post_md5", "left_semi"),
    "x1_digests": lambda s, d: fr.dictionary(s, d).select("noun", digest("noun").alias("key")),
    "x15_query_words": lambda s, d: fr.tweets_once(s, d, "tw_text").select("id", F.size(tokens("tw_text")).alias("n")),
    "j9_words_as_text": lambda s, d: fr.matrix(s, d).join(fr.dictionary(s, d), F.col("post_md5") == F.col("noun_md5")).select("noun", "reply_md5", "reply_cnt"),
    "j10_words_with_default": lambda s, d: fr.dictionary(s, d).join(fr.counts(s, d), F.col("noun_md5") == F.col("post_md5"), "left").select("noun_md5", F.coalesce("post_cnt", F.lit(0)).alias("post_cnt")),
    "a30_words_of_tweets": lambda s, d: _index(s, d).groupBy("id").agg(F.array_sort(F.collect_set("noun_md5")).alias("words")).select("id", _joined("words")),
    "d8_other_words": lambda s, d: _index(s, d).groupBy("id").agg(F.array_sort(F.collect_set("noun_md5")).alias("words")).select("id", F.array_except("words", F.slice("words", 1, 1)).alias("words")).select("id", _joined("words")),
}

_IX = "ix as (select distinct id, noun_md5 from tweets_nouns where noun_md5 is not null)"
_CH = "ch as (select distinct post_id, reply_id from tweet_chains where post_id is not null and reply_id is not null)"


_TOPICS = f"""{fr.TW}, {_IX}, jc as (select distinct cluster_date, k, cluster from clusters where cluster_date is not null and json_valid(cluster)),
  tc as (select cluster_date, unnest(json_extract(cluster::json, '$.clusters[*]')) t, generate_subscripts(json_extract(cluster::json, '$.clusters[*]'), 1) - 1 i from jc),
  tp as (select distinct topic, word from (select cluster_date || ':' || i topic, try_cast(unnest(json_extract(t, '$.members[*]'))->>'$.id' as bigint) word from tc) where word is not null)"""
_FOUND = f"""{_TOPICS}, fd as (select topic, ix.id, any_value(tw_text) tw_text, any_value(created_at) created_at, list(noun_md5 order by noun_md5) words from tp join ix on word = noun_md5 join tw on tw.id = ix.id where tw_text is not null group by topic, ix.id)"""
_ONCE = "oc as (select * from fd qualify row_number() over (partition by topic, tw_text order by id desc) = 1)"
_QUEUE = f"with {fr.TW}, {_CH}, ar as (select id from tweets group by id having not coalesce(min(fetched_at) < timestamptz '2014-03-04 00:00:00+00', false)) select id, created_at from tw where id in (select reply_id from ch) and id in (select id from ar) order by id limit "
SQL = {
    "f1_cyrillic": r"select distinct id from tweets where regexp_matches(tw_text, '^[^\n]*[а-яА-Я]')",
    "f2_clean_texts": f"with {fr.TW} select id, {fr.CLEAN} as \"text\" from tw",
    "f3_date_range": f"with {fr.TW} select id, created_at from tw where created_at // 1000000 between 20140303 and 20140305",
    "f5_hour_range": f"with {fr.WT} select word_md5, sum(cnt)::bigint cnt from wt where tenminute between 20140308090 and 20140308119 group by 1",
    "f6_words_in_list": f"with {_IX}, {fr.PC} select * from ix where noun_md5 in (select post_md5 from pc where post_cnt > 20)",
    "f8_frequent_posts": f"with {fr.PC} select * from pc where post_cnt > 5",
    "f11_unseen_posts": "select distinct in_reply_to_id id from tweets where in_reply_to_id is not null and in_reply_to_id not in (select id from tweets)",
    "f15_recent": f"with {fr.TW} select id, username from tw where created_at >= 20140309000000",
    "j1_chains": f"with {fr.TW} select distinct p.id post_id, r.id reply_id from tw r join tw p on r.in_reply_to_id = p.id and r.created_at // 1000000 = p.created_at // 1000000",
    "j1_chains_any_day": f"with {fr.TW} select distinct p.id post_id, r.id reply_id from tw r join tw p on r.in_reply_to_id = p.id",
    "j2_tweets_without_words": "select distinct id from tweets where id not in (select id from tweets_nouns)",
    "j3_next_chunk": _QUEUE + "50000",
    "j3_chunk_of_hundred": _QUEUE + "100",
    "j5_matching_tweets": f"with {_FOUND} select topic, id, array_to_string(words, ',') words from fd",
    "j6_looked_up_words": f"""with {fr.DICT}, w as (select noun word from dict union select '__total__' union select 'нетслова'), a as (select word, {fr.sql_digest('word')} word_md5 from w),
  s as (select word2, min(word1) lemma from word_mates where word1 is not null and word2 in (select noun_md5 from dict) group by 1)
select word, word_md5, coalesce(lemma, noun_md5) lemma_md5 from a left join s on word2 = word_md5 left join dict on noun_md5 = word_md5""",
    "j7_reply_posts": f"with {_CH} select created_at // 1000000 as day, count(*) posts from (select distinct id, created_at from tweets) where id in (select post_id from ch) group by 1",
    "j8_reply_contexts": f"with {_IX}, {_CH} select p.noun_md5 post_md5, r.noun_md5 reply_md5, count(*) reply_cnt from ch join ix p on p.id = post_id join ix r on r.id = reply_id group by 1, 2",
    "j8_post_contexts": f"with {_IX} select p.noun_md5 post_md5, r.noun_md5 reply_md5, count(*) reply_cnt from ix p join ix r on p.id = r.id and p.noun_md5 <> r.noun_md5 group by 1, 2",
    "g6_kept_contexts": f"with {_IX}, c as (select noun_md5, count(*) n from ix group by 1), t as (select noun_md5 from (select * from c order by n desc, noun_md5 limit 2000) where n >= 3) select p.noun_md5 post_md5, r.noun_md5 reply_md5, count(*) reply_cnt from ix p join ix r on p.id = r.id where p.noun_md5 in (select noun_md5 from t) group by 1, 2",
    "a31_context_counts": f"with {_IX}, {_CH} select p.noun_md5 post_md5, count(distinct p.id) post_cnt from ch join ix p on p.id = post_id join ix r on r.id = reply_id group by 1",
    "j14_newest_wins": f"with {fr.TW} select id, username from tw where created_at // 1000000 in (20140308, 20140309)",
    "d2_exact_copies": f"with {_FOUND}, {_ONCE} select topic, id from oc",
    "d3_near_copies": f"with {_FOUND} select topic, id, array_to_string(words, ',') words from fd qualify row_number() over (partition by topic, words order by coalesce(created_at, 0) desc, id) = 1",
    "t5_relevant_tweets": f"""with {_FOUND}, {_ONCE}, aw as (select id, list(noun_md5 order by noun_md5) aw from ix group by 1), fl as (select oc.*, aw from oc join aw using (id) qualify row_number() over (partition by topic, aw order by coalesce(created_at, 0) desc, oc.id) = 1),
  dn as (select topic, count(distinct words) density from oc group by 1), rk as (select *, row_number() over (partition by topic order by len(words) desc, created_at desc nulls last, id)::int r from fl)
select topic, r as \"rank\", id, len(words)::int matched, created_at, density from rk join dn using (topic) where r <= 10""",
    "a19_match_histogram": f"with {_FOUND}, {_ONCE} select topic, len(words)::int matched, count(*) tweets from oc group by all",
    "t11_first_tweets_of_day": f"with {_FOUND} select topic, id from fd qualify row_number() over (partition by topic, created_at // 1000000 order by id) <= 10000",
    "t11_first_two_of_day": f"with {_FOUND} select topic, id from fd qualify row_number() over (partition by topic, created_at // 1000000 order by id) <= 2",
    "g2_answered_with": f"with {_TOPICS}, {_CH}, hit as (select id from ix where noun_md5 in (select word from tp)) select * from ch where post_id in (select id from hit) and reply_id in (select id from hit)",
    "g9_words_in_scope": f"with {fr.MX}, {fr.DICT} select * from mx where post_md5 in (select {fr.sql_digest('noun')} from dict)",
    "x1_digests": f"with {fr.DICT} select noun, {fr.sql_digest('noun')} as \"key\" from dict",
    "x15_query_words": rf"with {fr.TW} select id, len(list_filter(string_split_regex(tw_text, '\s+'), lambda x: x <> ''))::int n from tw",
    "j9_words_as_text": f"with {fr.MX}, {fr.DICT} select noun, reply_md5, reply_cnt from mx join dict on noun_md5 = post_md5",
    "j10_words_with_default": f"with {fr.PC}, {fr.DICT} select noun_md5, coalesce(post_cnt, 0) post_cnt from dict left join pc on noun_md5 = post_md5",
    "a30_words_of_tweets": f"with {_IX} select id, string_agg(noun_md5::varchar, ',' order by noun_md5) words from ix group by 1",
    "d8_other_words": f"with {_IX} select id, array_to_string(list(noun_md5 order by noun_md5)[2:], ',') words from ix group by 1",
}
