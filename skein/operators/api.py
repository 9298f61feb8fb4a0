"""Questions to the published results: snapshots, relevant tweets, series of a word, annotations, topic pages."""

from __future__ import annotations

from typing import NamedTuple
from urllib.parse import parse_qs

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.config import SETTINGS
from skein.functions.scalars import bound, digest, hour_label, query_string, title, trend_class, trend_text, with_links
from skein.operators.trend import _hours, slopes
from skein.plans import frames as fr
from skein.runtime import table


class Page(NamedTuple):
    """Parameters of a page request."""

    limit: int = 20
    offset: int = 0
    skip: int = 0


def page_of(query: str) -> Page:
    """From a query string; what is missing or no number has its default."""
    given = parse_qs(query.lstrip("?"))
    number = lambda k, default: int(v) if (v := given.get(k, [""])[0]).isdigit() else default
    return Page(number("limit", 20), number("offset", 0), number("skip", 0))


def snapshot(clusters: DataFrame, date: str | None = None, before: str | None = None, skip: int = 0) -> DataFrame:
    """The snapshot that was valid at ``date``; else the last one before ``before``; else the last but ``skip``.

    The table may hold a date more than once; the greatest text counts then.  No such snapshot, no row.
    """
    once = clusters.where("cluster_date is not null").groupBy("cluster_date").agg(F.max("cluster").alias("cluster"))
    if date is not None:
        once = once.where(F.col("cluster_date") <= date)
    elif before is not None:
        once = once.where(F.col("cluster_date") < before)
    return once.orderBy(F.desc("cluster_date")).offset(0 if date is not None or before is not None else skip).limit(1)


def relevant_at(relevant: DataFrame, date: str) -> DataFrame:
    return relevant.where(F.col("cluster_date") == date)


def word_trend(counters: DataFrame, word: str, time1: str, time2: str) -> DataFrame:
    """(hour, cnt) of a word between two typed times, in order; the word ``0`` asks for all words together."""
    word = word.strip()
    rows = counters if word == SETTINGS.all_words else counters.where(F.col("word_md5") == digest(F.lit(word)))
    a, b = bound(F.lit(time1)), bound(F.lit(time2))
    within = rows.where((F.col("tenminute") >= F.least(a, b)) & (F.col("tenminute") < F.greatest(a, b)))
    return within.groupBy(F.floor(F.col("tenminute") / 10).cast("bigint").alias("hour")).agg(F.sum("cnt").cast("bigint").alias("cnt")).orderBy("hour")


def mark_set(spark: SparkSession, update_time: int, username: str, exp_name: str, exp_descr: str, marks: list[dict[str, str]]) -> DataFrame:
    """A row for the log of annotations, from the values of a form."""
    rows = spark.createDataFrame([(update_time, username, exp_name, exp_descr, marks)], "update_time bigint, username string, exp_name string, exp_descr string, marks array<map<string,string>>")
    return rows.withColumn("marks", F.to_json("marks"))


def topics_of(clusters: DataFrame) -> DataFrame:
    """(cluster_date, topic, members: array<struct<id, text, trend>>, members_md5, gen_title), one row a topic."""
    j = clusters.where("cluster_date is not null").select("cluster_date", F.try_parse_json("cluster").alias("j"))
    t = j.select("cluster_date", F.posexplode(F.expr("try_variant_get(j, '$.clusters', 'array<variant>')")).alias("topic", "t"))
    members = F.expr("transform(try_variant_get(t, '$.members', 'array<variant>'), m -> struct(try_variant_get(m, '$.id', 'bigint') as id, try_variant_get(m, '$.text', 'string') as text, try_variant_get(m, '$.trend', 'double') as trend))")
    return t.select("cluster_date", "topic", members.alias("members"), F.expr("try_variant_get(t, '$.members_md5', 'string')").alias("members_md5"), F.expr("try_variant_get(t, '$.gen_title', 'string')").alias("gen_title")).where(F.size("members") > 0)


def member_trends(topics: DataFrame) -> DataFrame:
    """Adds max_trend (0 at least), avg_trend and the number of members."""
    trends = F.transform("members", lambda m: F.coalesce(m["trend"], F.lit(0.0)))
    total = F.aggregate(trends, F.lit(0.0), lambda a, x: a + x)
    return topics.withColumns({"max_trend": F.greatest(F.lit(0.0), F.array_max(trends)), "avg_trend": total / F.size("members"), "members_len": F.size("members")})


def published(topics: DataFrame, n: int = SETTINGS.clusters_published) -> DataFrame:
    """The n topics of each snapshot with the greatest max_trend, falling ones not excluded."""
    w = Window.partitionBy("cluster_date").orderBy(F.desc("max_trend"), "topic")
    return topics.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def page(topics: DataFrame, p: Page) -> DataFrame:
    """A page of topics by mean trend of their members."""
    return topics.orderBy(F.desc("avg_trend"), "cluster_date", "topic").offset(p.offset).limit(p.limit)


def unique_members(members: Column) -> Column:
    """Members without those whose text came before."""
    return F.aggregate(members, F.slice(members, 1, 0), lambda seen, m: F.when(F.exists(seen, lambda s: s["text"].eqNullSafe(m["text"])), seen).otherwise(F.array_append(seen, m)))


def with_relevant(topics: DataFrame, relevant: DataFrame) -> DataFrame:
    """Topics with what is stored for the same members, the first by date."""
    first = relevant.groupBy("members_md5").agg(F.min_by("relevant", "cluster_date").alias("relevant"))
    return topics.join(first, "members_md5")


# ---- queries


def _members(s: SparkSession, d: str) -> DataFrame:
    return member_trends(topics_of(table(s, d, "clusters").distinct()))


_KEY = ("cluster_date", "topic")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*_KEY, "members_len", F.round("max_trend", 6).alias("max_trend"), F.round("avg_trend", 6).alias("avg_trend"))


def _word_trend(s: SparkSession, d: str) -> DataFrame:
    return word_trend(fr.word_time(s, d), " 0 ", "20140309", "201403071")


def _labels(s: SparkSession, d: str) -> DataFrame:
    h = _hours(s, d).groupBy("hour").agg(F.sum("cnt").cast("bigint").alias("cnt"))
    return h.select("hour", hour_label("hour").alias("label"), query_string({"hour": F.col("hour"), "q": F.lit("a b")}).alias("link"))


def _classes(s: SparkSession, d: str) -> DataFrame:
    t = slopes(_hours(s, d), "word_md5", "hour", "cnt").select("word_md5", F.round("trend", 3).alias("trend"))
    return t.select("word_md5", trend_class("trend", F.lit("20140310000000")).alias("old_class"), trend_class("trend", F.lit("20170101000000")).alias("new_class"), (trend_text("trend").startswith("+")).alias("grows"))


QUERIES = {
    "t7_latest_snapshot": lambda s, d: snapshot(table(s, d, "clusters"), skip=1).select("cluster_date", F.md5("cluster").alias("text_md5")),
    "t8_snapshot_at": lambda s, d: snapshot(table(s, d, "clusters"), date="20140305120000").select("cluster_date"),
    "t8_snapshot_before": lambda s, d: snapshot(table(s, d, "clusters"), before="20140304000000").select("cluster_date"),
    "u11_word_trend": _word_trend,
    "a16_topic_trends": lambda s, d: _rounded(_members(s, d)),
    "t4_published_topics": lambda s, d: published(_members(s, d)).select(*_KEY, "rank"),
    "t4_first_two_topics": lambda s, d: published(_members(s, d), 2).select(*_KEY, "rank"),
    "t12_topic_page": lambda s, d: _rounded(page(_members(s, d).withColumn("avg_trend", F.round("avg_trend", 6)), Page(20, 10))),
    "d9_unique_members": lambda s, d: _members(s, d).select(*_KEY, F.size(unique_members(F.col("members"))).alias("n"), title(F.transform(unique_members(F.col("members")), lambda m: m["text"])).alias("title")),
    "j17_topics_of_members": lambda s, d: with_relevant(_members(s, d).select(*_KEY, "members_md5"), _members(s, d).select("members_md5", "cluster_date", F.col("cluster_date").alias("relevant"))).select(*_KEY, "relevant"),
    "x25_trend_classes": _classes,
    "x26_labels": _labels,
    "x26_linked_texts": lambda s, d: fr.tweets_once(s, d, "tw_text").where(F.col("tw_text").contains("http")).select("id", with_links("tw_text").alias("html")),
}

from skein.operators.trend import _H, _TR  # noqa: E402

_T = """j as (select distinct cluster_date, k, cluster from clusters where cluster_date is not null and json_valid(cluster)),
  t as (select cluster_date, unnest(json_extract(cluster::json, '$.clusters[*]')) t, generate_subscripts(json_extract(cluster::json, '$.clusters[*]'), 1)::int - 1 topic from j),
  m as (select cluster_date, topic, t->>'$.members_md5' members_md5, json_extract(t, '$.members[*]') ms from t), tt as (select *, list_transform(ms, lambda x: coalesce(try_cast(x->>'$.trend' as double), 0)) tr, list_transform(ms, lambda x: x->>'$.text') txt from m where len(ms) > 0),
  tp as (select cluster_date, topic, members_md5, txt, len(ms)::int members_len, greatest(0, list_max(tr)) max_trend, list_sum(tr) / len(ms) avg_trend from tt)"""
_ONE = "one as (select cluster_date, max(cluster) cluster from clusters where cluster_date is not null group by 1)"
_PUBLISHED = f"with {_T} select cluster_date, topic, r as \"rank\" from (select *, row_number() over (partition by cluster_date order by max_trend desc, topic)::int r from tp) where r <= "
SQL = {
    "t7_latest_snapshot": f"with {_ONE} select cluster_date, md5(cluster) text_md5 from one order by 1 desc limit 1 offset 1",
    "t8_snapshot_at": f"with {_ONE} select cluster_date from one where cluster_date <= '20140305120000' order by 1 desc limit 1",
    "t8_snapshot_before": f"with {_ONE} select cluster_date from one where cluster_date < '20140304000000' order by 1 desc limit 1",
    "u11_word_trend": f"with {fr.WT} select tenminute // 10 as hour, sum(cnt)::bigint cnt from wt where tenminute >= 20140307100 and tenminute < 20140309000 group by 1",
    "a16_topic_trends": f"with {_T} select cluster_date, topic, members_len, round(max_trend, 6) max_trend, round(avg_trend, 6) avg_trend from tp",
    "t4_published_topics": _PUBLISHED + "15",
    "t4_first_two_topics": _PUBLISHED + "2",
    "t12_topic_page": f"with {_T} select cluster_date, topic, members_len, round(max_trend, 6) max_trend, round(avg_trend, 6) avg_trend from tp order by round(avg_trend, 6) desc, 1, 2 limit 20 offset 10",
    "d9_unique_members": f"""with {_T} select cluster_date, topic, (len(list_distinct(txt)) + (len(list_filter(txt, lambda x: x is null)) > 0)::int)::int n,
  array_to_string(list_filter(txt, lambda x, i: list_position(txt, x) = i), ' ') title from tp""",
    "j17_topics_of_members": f"with {_T}, f as (select members_md5, min(cluster_date) relevant from tp group by 1) select cluster_date, topic, relevant from tp join f using (members_md5)",
    "x25_trend_classes": f"""with {_TR}, r as (select word_md5, round(trend, 3) t from tr) select word_md5, case when abs(t) >= 15 then 'strong' when abs(t) >= 3 then 'mild' else 'flat' end old_class,
  case when abs(t) >= 0.5 then 'strong' when abs(t) >= 0.1 then 'mild' else 'flat' end new_class, t > 0 grows from r""",
    "x26_labels": f"with {_H}, s as (select distinct hour::varchar h from h) select h::bigint as hour, substr(h, 7, 2) || '.' || substr(h, 5, 2) || ' ' || substr(h, 9, 2) || ':00' as label, 'hour=' || h || '&q=a+b' as link from s",
    "x26_linked_texts": rf"""with {fr.TW} select id, regexp_replace(tw_text, '(https?://[^\s<]+)', '<a href="\1">\1</a>', 'g') html from tw where contains(tw_text, 'http')""",
}
