"""Conversations rebuilt from message rows (problem 7).

Messages bear no conversation id.  Conversations are the connected components of the reply links, found by
alternating large-star and small-star joins, then ordered and validated.  As every message answers at most
one, a component has at most one message that answers nothing; a component without one leads to a missing
message or in a circle and is broken.

Rules: rows with equal id are one message (least created_at, any of the equal texts).  in_reply_to_id null or
0 is no answer.  Dropped are conversations of fewer than 2 messages or 2 usernames (letter case aside, null is
no name), with a message whose text is null or only white space and mentions, or with a message created before
the one it answers (a null time is before nothing).  Rows without id are left out.  Empty input gives none.

Turn numbers need no conversation in one task: a conversation is cut into cells of one minute, numbered
within the cell, and the cells' counts are summed up before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.components import components
from skein.runtime import cut, table

#: White space: what Unicode calls so (no-break included) and the four separators U+001C to U+001F.
_SPACE = r"\p{IsWhite_Space}\x1c-\x1f"
_BARE = rf"^(?:[{_SPACE}]|(?<![^{_SPACE}])@[^{_SPACE}]*+)*+$"


def bare(text: Column) -> Column:
    """True where a text is null or holds nothing but white space and mentions."""
    return F.coalesce(text.rlike(_BARE), F.lit(True))


def _messages(tweets: DataFrame) -> DataFrame:
    return (
        tweets.where("id is not null")
        .select("id", F.when(F.col("in_reply_to_id") != 0, F.col("in_reply_to_id")).alias("parent"), "created_at", F.lower("username").alias("user"), bare(F.col("tw_text")).alias("bare"))
        .groupBy("id")
        .agg(F.max("parent").alias("parent"), F.min("created_at").alias("created_at"), F.max("user").alias("user"), F.min("bare").alias("bare"))
    )


def conversations(tweets: DataFrame) -> DataFrame:
    """(conv_id, turn, id, user, created_at): the turns of every whole conversation, in order."""
    messages = cut(_messages(tweets))
    parents = messages.select(F.col("id").alias("parent"), F.col("created_at").alias("parent_at"))
    links = messages.where("parent is not null").join(parents, "parent").select("id", "parent", F.coalesce(F.col("created_at") < F.col("parent_at"), F.lit(False)).alias("early"))
    links = cut(links)
    found = components(links, "id", "parent")
    rows = cut(
        messages.join(found, messages["id"] == found["vertex"])
        .join(links.where("early").select(F.col("id").alias("early_id")).distinct(), F.col("id") == F.col("early_id"), "left")
        .select("component", "id", "parent", "created_at", "user", (F.col("bare") | F.col("early_id").isNotNull()).alias("bad")),
        messages,
        links,
    )
    whole = (
        rows.groupBy("component")
        .agg(F.max(F.when(F.col("parent").isNull(), F.col("id"))).alias("conv_id"), (F.min("user") != F.max("user")).alias("answered"), F.max("bad").alias("bad"))
        .where("conv_id is not null and answered and not bad")
        .select("component", "conv_id")
    )
    turns = rows.join(whole, "component").select("conv_id", "id", "user", "created_at", F.floor(F.col("created_at") / 100).alias("cell"))
    cells = turns.groupBy("conv_id", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("conv_id", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    order = Window.partitionBy("conv_id", "cell").orderBy("created_at", "id")
    return (
        turns.withColumn("k", F.row_number().over(order))
        .join(offsets.withColumnsRenamed({"conv_id": "c", "cell": "s"}), F.col("conv_id").eqNullSafe(F.col("c")) & F.col("cell").eqNullSafe(F.col("s")))
        .select("conv_id", (F.col("before") + F.col("k")).cast("bigint").alias("turn"), "id", "user", "created_at")
    )


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations(table(spark, d, "tweets")).select("conv_id", "turn", "id")


def p7_turns(spark: SparkSession, d: str) -> DataFrame:
    """The turns with the role of their speaker: author of the first tweet, or other."""
    turns = conversations(table(spark, d, "tweets"))
    first = turns.where("id = conv_id").select("conv_id", F.col("user").alias("author"))
    return turns.join(first, "conv_id").select("conv_id", "turn", "id", F.when(F.col("user") == F.col("author"), "author").otherwise("other").alias("role"))


QUERIES = {"p7_found": p7_found, "p7_turns": p7_turns}

_WITH = r"""with recursive t as (select id, max(case when in_reply_to_id <> 0 then in_reply_to_id end) parent, min(created_at) created_at, max(lower(username)) u,
    bool_and(tw_text is null or regexp_matches(regexp_replace(tw_text, '(^|[\s\x{00a0}\x{1c}-\x{1f}\x{85}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1680}])@[^\s\x{00a0}\x{1c}-\x{1f}\x{85}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1680}]*', '\1', 'g'),
      '^[\s\x{00a0}\x{1c}-\x{1f}\x{85}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1680}]*$')) bare
    from tweets where id is not null group by id),
  w as (select id conv_id, id, u, created_at, bare bad from t where parent is null
    union all select w.conv_id, t.id, t.u, t.created_at, t.bare or coalesce(t.created_at < w.created_at, false) from w join t on t.parent = w.id),
  good as (select conv_id from w group by conv_id having count(*) >= 2 and count(distinct u) >= 2 and not bool_or(bad)),
  turns as (select conv_id, row_number() over (partition by conv_id order by created_at nulls first, id)::bigint turn, id, u from w join good using (conv_id))"""
SQL = {
    "p7_found": f"{_WITH} select conv_id, turn, id from turns",
    "p7_turns": f"{_WITH} select x.conv_id, x.turn, x.id, case when x.u = y.u then 'author' else 'other' end \"role\" from turns x join turns y on y.id = x.conv_id",
}
