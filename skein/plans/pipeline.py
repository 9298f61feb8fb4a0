"""The whole batch run: from tweets and word lists to published topics with titles and relevant tweets.

Stages are DataFrames chained lazily; only what several stages read is written in between (to the shared
checkpoint folder), so that a lost executor repeats one stage at most.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.config import SETTINGS, Settings
from skein.functions.scalars import digests
from skein.operators import align, counters, profiles, retrieve, topics, trend
from skein.runtime import cut


@dataclass
class Result:
    """Tables of a run, and seconds by stage."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    seconds: dict[str, float] = field(default_factory=dict)


def run(lists: DataFrame, tweets: DataFrame, index: DataFrame, now: datetime, prev_trend: DataFrame | None = None, trash: DataFrame | None = None, swear: DataFrame | None = None, settings: Settings = SETTINGS) -> Result:
    """Counters, co-occurrence, profiles, distances, trends, topics, titles and relevant tweets as of ``now``.

    ``lists`` are (id, created_at, lemmas, sources), ``tweets`` the tweets table, ``index`` (id, noun_md5),
    ``prev_trend`` the trends (word_md5, trend) of the run before, which choose the words whose pairs are
    counted; without them this run's own are taken.  ``trash`` and ``swear`` are words (post_md5).
    """
    out = Result()
    after = lambda days: int((now - timedelta(days=days)).strftime("%Y%m%d%H%M%S")[:11])
    empty = index.sparkSession.createDataFrame([], "post_md5 bigint")

    def stage(name: str, make: Callable[[], DataFrame]) -> DataFrame:
        began = time.time()
        out.tables[name] = cut(make())
        out.seconds[name] = time.time() - began
        return out.tables[name]

    hashed = lists.withColumn("words", digests("lemmas"))
    words = stage("word_time_cnt", lambda: counters.count_words(hashed.select("created_at", F.explode("words").alias("w")), "w", F.floor(F.col("created_at") / 1000).cast("bigint")).withColumnRenamed("bucket", "tenminute"))
    mates = stage("word_mates", lambda: counters.count_mates(lists, "lemmas", bag=settings.bag_size))
    bigrams = stage("bigram_day", lambda: counters.count_bigrams(lists, "lemmas", "sources"))
    rates = stage("noun_trend", lambda: trend.slopes(counters.hourly(words, after(settings.trend_days)), "word_md5", "hour", "cnt"))
    post_cnt = stage("post_cnt", lambda: counters.recent_sum(words, ["word_md5"], after(settings.count_days)))
    chosen = trend.combined_rank(post_cnt, prev_trend if prev_trend is not None else rates.select("word_md5", "trend"), settings.trending_kept)
    matrix = stage("post_reply_cnt", lambda: counters.symmetric(counters.recent_mates(mates, chosen, after(settings.mates_days)), "word1", "word2", "cnt").toDF("post_md5", "reply_md5", "reply_cnt"))
    p = profiles.profiles(matrix, post_cnt.toDF("post_md5", "post_cnt"), profiles.top_replies(matrix, settings.reply_dimensions), settings.post_min_freq, kept=settings.profiles_kept)
    weighted = profiles.with_total(profiles.weighted(p, settings.corpus_size), empty if trash is None else trash, empty if swear is None else swear)
    sims = stage("noun_similarity", lambda: profiles.cosine_distances(weighted).select(F.col("post2_md5").alias("a"), F.col("post1_md5").alias("b"), F.round("sim", 6).alias("sim")))
    by_word = rates.select(F.col("word_md5").alias("word"), "trend")
    chosen_topics = stage("topics", lambda: align.best_clusters(topics.greedy_topics(sims, by_word, settings.trending_kept, settings.topic_neighbours, settings.topic_distance, settings.trash_distance), by_word, settings.clusters_aligned, settings.best_members))
    recent = counters.recent_sum(bigrams, ["source1", "word1", "source2", "word2"], after(settings.count_days))
    total = counters.recent_sum(bigrams, ["word1"], after(settings.count_days)).withColumnRenamed("word1", "word_md5")
    quiet = counters.drop_noise(recent, total, settings.bigram_noise).select("source1", "word1", "source2", "word2", "cnt")
    titles = stage("titles", lambda: align.align_topics(chosen_topics.select("centroid", "members"), quiet, post_cnt))
    published = chosen_topics.join(titles.select("centroid"), "centroid").orderBy(F.desc("best_trend"), "centroid").limit(settings.clusters_published)
    asked = published.select(F.col("centroid").alias("topic"), F.explode("members").alias("word"))
    recent_tweets = tweets.where(F.col("created_at") >= int((now - timedelta(days=2)).strftime("%Y%m%d%H%M%S")))
    found = retrieve.matching(retrieve.with_text_key(recent_tweets, "created_at"), index, asked, settings.tweets_per_day)
    stage("relevant", lambda: retrieve.relevant(found, index, settings.tweets_per_cluster))
    return out
