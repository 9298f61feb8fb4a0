"""The queue of users to be crawled, as batch operators; its streaming state is in ``streaming.jobs``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.scalars import to_time
from skein.plans import frames as fr


def due(users: DataFrame, now: str, retry_seconds: int) -> DataFrame:
    """Users that are not blocked and were never done, or so long ago (done_time: yyyyMMddHHmmss or empty)."""
    age = F.unix_timestamp(to_time(F.lit(now))) - F.unix_timestamp(to_time("done_time"))
    return users.where("coalesce(blocked_user, 0) = 0").where((F.coalesce("done_time", F.lit("")) == "") | (age > retry_seconds))


def next_user(users: DataFrame, now: str, retry_seconds: int) -> DataFrame:
    return due(users, now, retry_seconds).orderBy(F.desc("reply_cnt"), F.asc("since_id"), "username").limit(1)


def known(users: DataFrame) -> DataFrame:
    """Users that were done before: since_id not 0 and a done time."""
    return users.where("since_id <> 0 and done_time <> ''")


def window_start(now: str, days: int = 7) -> str:
    """Midnight so many days before, as yyyyMMddHHmmss."""
    from datetime import datetime, timedelta

    return (datetime.strptime(now[:8], "%Y%m%d") - timedelta(days=days)).strftime("%Y%m%d%H%M%S")


def mark_done(users: DataFrame, name: str, now: str, max_id: int = 0, denied: bool = False) -> DataFrame:
    """The user's row after a crawl: done time, last id if greater, blocked if access was denied."""
    me = F.col("username") == name
    return users.withColumns(
        {
            "done_time": F.when(me, F.lit(now)).otherwise(F.col("done_time")),
            "since_id": F.when(me, F.greatest("since_id", F.lit(max_id))).otherwise(F.col("since_id")),
            "blocked_user": F.when(me & F.lit(denied), 1).otherwise(F.col("blocked_user")),
        }
    )


def partner_counts(tweets: DataFrame, users: DataFrame) -> DataFrame:
    """(username, reply_cnt): one for each mention of a partner that was never seen or is newer than its done time."""
    m = tweets.where("in_reply_to_username is not null").select(F.col("in_reply_to_username").alias("username"), "created_at")
    u = users.select("username", F.col("done_time").try_cast("bigint").alias("done"))
    return m.join(u, "username", "left").where("done is null or created_at > done").groupBy("username").agg(F.count("*").alias("reply_cnt"))


# ---- queries


def _users(s: SparkSession, d: str) -> DataFrame:
    """The authors as queue: last tweet as since_id and, for every other, its time as done time."""
    t = fr.tweets_once(s, d, "username", "user_id", "created_at").where("username is not null and user_id is not null")
    last = t.groupBy("username").agg(F.max("id").alias("since_id"), F.count("*").alias("reply_cnt"), F.max("created_at").alias("at"))
    return last.select("username", "since_id", "reply_cnt", F.when(F.col("reply_cnt") > 50, 1).otherwise(0).alias("blocked_user"), F.when(F.col("since_id") % 2 == 0, F.col("at").cast("string")).otherwise("").alias("done_time"))


QUERIES = {
    "f14_due_users": lambda s, d: due(_users(s, d), "20140310000000", 86400).select("username", "reply_cnt"),
    "t9_next_user": lambda s, d: next_user(_users(s, d), "20140310000000", 86400).select("username", "reply_cnt", "since_id"),
    "g33_known_users": lambda s, d: known(_users(s, d)).select("username", "since_id"),
    "g22_partner_counts": lambda s, d: partner_counts(fr.tweets_once(s, d, "in_reply_to_username", "created_at"), _users(s, d)),
}
_U = f"{fr.TW}, us as (select username, max(id) since_id, count(*) reply_cnt, max(created_at) at_ from tw where username is not null and user_id is not null group by 1), u as (select username, since_id, reply_cnt, case when reply_cnt > 50 then 1 else 0 end blocked_user, case when since_id % 2 = 0 then at_ end done from us)"
_DUE = "blocked_user = 0 and (done is null or epoch(timestamp '2014-03-10') - epoch(strptime(done::varchar, '%Y%m%d%H%M%S')) > 86400)"
SQL = {
    "f14_due_users": f"with {_U} select username, reply_cnt from u where {_DUE}",
    "t9_next_user": f"with {_U} select username, reply_cnt, since_id from u where {_DUE} order by reply_cnt desc, since_id, username limit 1",
    "g33_known_users": f"with {_U} select username, since_id from u where done is not null",
    "g22_partner_counts": f"with {_U} select in_reply_to_username username, count(*) reply_cnt from tw left join u on u.username = in_reply_to_username where in_reply_to_username is not null and (done is null or created_at > done) group by 1",
}
