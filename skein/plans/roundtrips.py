"""Queries that write with the sinks and read back with the sources, in a folder of their own, and run the streams.

Their SQL says what must come back, from the same tables.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice, takewhile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.config import SETTINGS
from skein.functions import analysis, scalars
from skein.functions.scalars import day, to_time
from skein.operators import api, crawl, evaluate, profiles, topics
from skein.plans import frames as fr
from skein.runtime import shared_folder, ship, table
from skein.schemas import read_or_empty
from skein.sources import readers, sinks
from skein.streaming import jobs

#: Where old and new rows of a table part, by arrival and by day.
PART, DAY = "2014-03-05 00:00:00", 20140305


def _folder(s: SparkSession) -> str:
    return f"{shared_folder(s)}/{s.sparkContext.applicationId}/trip-{uuid.uuid4().hex}"


def _put(s: SparkSession, path: str, text: str) -> None:
    fs, p = sinks._files(s, path)
    out = fs.create(p, True)
    out.write(text.encode())
    out.close()


def _days(s: SparkSession, d: str) -> DataFrame:
    """Tweets once, by the day of the tweet."""
    return fr.tweets_once(s, d, "created_at", "username").where("created_at is not null").withColumn("dt", day("created_at"))


def _arrived(s: SparkSession, d: str, after: bool) -> DataFrame:
    t = table(s, d, "tweets").where("id is not null and fetched_at is not null").select("id", "fetched_at", "username", "created_at")
    at = F.col("fetched_at") >= F.lit(PART).cast("timestamp")
    return t.where(at if after else ~at)


def _counted(df: DataFrame) -> DataFrame:
    return df.groupBy("dt").agg(F.count("*").alias("n"))


# ---- feed and streams


def _feed(s: SparkSession, d: str) -> str:
    """The tweets as messages of the feed, one JSON a line, in several files."""
    t = fr.tweets_once(s, d, "tw_text", "username", "user_id", "in_reply_to_username", "in_reply_to_id", "created_at")
    at = F.date_format(to_time("created_at"), "EEE MMM dd HH:mm:ss Z yyyy")
    user = F.struct(F.col("username").alias("screen_name"), F.col("user_id").alias("id"))
    m = t.select(F.to_json(F.struct("id", F.col("tw_text").alias("text"), at.alias("created_at"), user.alias("user"), F.col("in_reply_to_username").alias("in_reply_to_screen_name"), F.col("in_reply_to_id").alias("in_reply_to_status_id"))).alias("value"))
    path = _folder(s)
    m.unionByName(s.createDataFrame([("{broken",), ("{}",)], "value string")).write.text(path)
    return path


def _told(m: DataFrame) -> DataFrame:
    return m.select("id", F.md5("tw_text").alias("text_md5"), "username", F.coalesce("user_id", F.lit(-1)).alias("user_id"), "in_reply_to_username", F.coalesce("in_reply_to_id", F.lit(-1)).alias("in_reply_to_id"), "created_at", F.col("dt").cast("bigint").alias("dt"))


def _streamed(s: SparkSession, d: str, runs: int = 1) -> DataFrame:
    """The feed as a stream of a few files a batch into a table by day; further runs must add nothing."""
    feed, out = _feed(s, d), _folder(s)
    for _ in range(runs):
        jobs.write_by_day(jobs.deduplicated(readers.stream_messages(s, feed, 3), "id", "ts", "60 days"), f"{out}/rows", f"{out}/log").awaitTermination()
    return s.read.parquet(f"{out}/rows")


def _events(s: SparkSession, d: str) -> DataFrame:
    return fr.tweets_once(s, d, "created_at").where("created_at is not null").select("id", to_time("created_at").alias("ts"))


def _sliding(s: SparkSession, d: str) -> DataFrame:
    src, out = _folder(s), _folder(s)
    _events(s, d).write.parquet(src)
    stream = s.readStream.schema("id bigint, ts timestamp").parquet(src)
    jobs.write_batches(jobs.windowed_counts(stream, "ts", [], "3 hours", "60 days", "1 hour"), f"{out}/rows", f"{out}/log").awaitTermination()
    return jobs.latest_counts(s, f"{out}/rows", ["start"]).select(F.date_format("start", "yyyyMMddHH").cast("bigint").alias("start"), "cnt")


def _late(s: SparkSession, d: str) -> DataFrame:
    """Hourly counts of a stream whose second batch repeats all tweets, 20 days too late for the watermark."""
    src, out = _folder(s), _folder(s)
    for shift in (0, 20):
        _events(s, d).select(F.col("id") + shift, (F.col("ts") - F.expr(f"interval {shift} days")).alias("ts")).coalesce(1).write.mode("append").parquet(src)
        stream = s.readStream.schema("id bigint, ts timestamp").parquet(src)
        jobs.write_batches(jobs.windowed_counts(stream, "ts", [], "1 hour", "1 day"), f"{out}/rows", f"{out}/log").awaitTermination()
    return jobs.latest_counts(s, f"{out}/rows", ["start"]).select(F.date_format("start", "yyyyMMddHH").cast("bigint").alias("hour"), "cnt")


def _queue(s: SparkSession, d: str) -> DataFrame:
    """The crawl queue's state after all mentions, where partners with an even number of letters were done once."""
    src, out = _folder(s), _folder(s)
    m = fr.tweets_once(s, d, "in_reply_to_username", "created_at").where("in_reply_to_username is not null and created_at is not null")
    mentions = m.select(F.col("in_reply_to_username").alias("username"), F.lit("mention").alias("kind"), F.col("created_at").alias("at"), F.lit(0).cast("bigint").alias("since_id"))
    done = mentions.where(F.length("username") % 2 == 0).select("username").distinct().select("username", F.lit("done").alias("kind"), F.lit(DAY * 1_000_000).alias("at"), F.length("username").cast("bigint").alias("since_id"))
    mentions.unionByName(done).write.parquet(src)
    stream = s.readStream.schema("username string, kind string, at bigint, since_id bigint").parquet(src)
    jobs.write_batches(jobs.crawl_queue(stream), f"{out}/rows", f"{out}/log").awaitTermination()
    last = s.read.parquet(f"{out}/rows").groupBy("username").agg(F.max_by(F.struct("reply_cnt", "since_id", "done_time"), "batch").alias("q"))
    return last.select("username", "q.*")


# ---- services


def serve(user: str, max_id: int | None, since_id: int, count: int, path: str) -> list[tuple]:
    """A page of a user's rows of a table by user and id, newest first: the service of ``paged``."""
    most = (1 << 63) - 1 if max_id is None else max_id
    mine = takewhile(lambda r: r[2] == user and r[0] > since_id, _sorted(path, ("username", "id")).down((user, most)))
    return list(islice(mine, count))


def find(ids: list[int], path: str) -> list[tuple]:
    """The rows of a table by id with these ids: the service of ``lookup``."""
    rows = _sorted(path, ("id",))
    return [r for i in sorted(set(ids)) for r in islice(rows.down((i,)), 1) if r[0] == i]


#: Rows of a block of a service's table, the least that is read of it; blocks that a process holds.
BLOCK, HELD = 4096, 4


class _Sorted:
    """A table sorted by unique keys, as a service has it: the first key of each block is held, and the blocks read last."""

    def __init__(self, path: str, by: tuple[str, ...]) -> None:
        from pyarrow import fs
        from pyarrow.parquet import ParquetFile

        self.files, at = readers._open(path)
        self.by, self.found, self.block = by, [], lru_cache(HELD)(self._block)
        for f in self.files.get_file_info(fs.FileSelector(at)):
            if f.base_name.endswith(".parquet"):
                with self.files.open_input_file(f.path) as opened:
                    p = ParquetFile(opened)
                    for g in range(p.num_row_groups):
                        first = next(p.iter_batches(1, [g], list(by))).select(list(by)).to_pylist()[0]
                        self.found.append((tuple(first.values()), f.path, g, p.metadata))
        self.found.sort(key=lambda b: b[0])
        self.firsts = [b[0] for b in self.found]

    def _block(self, i: int) -> tuple[list[tuple], list[tuple]]:
        from pyarrow.parquet import ParquetFile

        _, at, group, metadata = self.found[i]
        with self.files.open_input_file(at) as f:
            t = ParquetFile(f, metadata=metadata).read_row_group(group, list(TOLD))
        columns = {c: t[c].to_pylist() for c in TOLD}
        return list(zip(*[columns[c] for c in self.by])), list(zip(*columns.values()))

    def down(self, key: tuple) -> Iterator[tuple]:
        """The rows from ``key`` downwards."""
        for i in reversed(range(bisect_right(self.firsts, key))):
            keys, rows = self.block(i)
            for j in reversed(range(bisect_right(keys, key))):
                yield rows[j]


#: The table of the last call, by process.
_sorted = lru_cache(1)(_Sorted)

#: What the services tell of a tweet.
TOLD = ("id", "tw_text", "username", "created_at")


def _service(s: SparkSession, d: str, *by: str) -> str:
    """A folder of tweets sorted by ``by``, in blocks; those without a key cannot be asked for."""
    ship(s)  # a source takes along the packages that are there when it is registered
    for source in (readers.PagedSource, readers.LookupSource):
        s.dataSource.register(source)
    path = _folder(s)
    t = fr.tweets_once(s, d, *TOLD[1:]).dropna(subset=list(by))
    t.orderBy(*by).write.option("parquet.block.row.count.limit", BLOCK).parquet(path)
    return path


def _lines(s: SparkSession, df: DataFrame) -> str:
    """A folder of files with a key a line, in the order of the keys: neighbours are in the same blocks of a service."""
    path, key = _folder(s), F.col(df.columns[0])
    df.repartitionByRange(max(8, s.sparkContext.defaultParallelism), key).sortWithinPartitions(key).select(key.cast("string")).write.text(path)
    return path


def _paged(s: SparkSession, d: str) -> DataFrame:
    """The timelines of all partners that write themselves, above an id, page by page."""
    service = _service(s, d, "username", "id")
    t = fr.tweets_once(s, d, "username", "in_reply_to_username")
    users = t.select("username").distinct().join(t.select(F.col("in_reply_to_username").alias("username")).distinct(), "username", "left_semi")
    options = {"users_path": _lines(s, users), "since_id": SINCE, "fetch": "skein.plans.roundtrips:serve", "service": service}
    return s.read.format("paged").options(**options).load().select("id", "username", "created_at")


def _looked_up(s: SparkSession, d: str) -> DataFrame:
    service = _service(s, d, "id")
    ids = table(s, d, "tweets").where("in_reply_to_id <> 0").select("in_reply_to_id").distinct()
    return s.read.format("lookup").options(ids_path=_lines(s, ids), fetch="skein.plans.roundtrips:find", service=service).load().select("id", "username")


#: An id within the tables' range.
SINCE = 553_000_000_000_000_000


# ---- files of shards and chunks


def _shards(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s)
    for r in _days(s, d).select("dt").distinct().collect():  # as many as days
        _put(s, f"{path}/tweets_{r.dt}.db", "x")
    _put(s, f"{path}/tweets_new.db", "x")
    return readers.shard_days(s, path).select("day")


def _chunks(s: SparkSession, d: str) -> DataFrame:
    """Of the days' chunk files those that have both parts: facts are there for even days."""
    path = _folder(s)
    for r in _days(s, d).select("dt").distinct().collect():
        for part in ("index.txt", "facts.xml")[: 1 + (r.dt % 2 == 0)]:
            _put(s, f"{path}/{r.dt}_7.{part}", "x")
    return readers.ready_chunks(s, path).select("day", "chunk")


def _index(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s)
    lines = _days(s, d).select("dt", "id", F.concat_ws("\t", "id", "created_at").alias("value"))
    lines.repartition("dt").sortWithinPartitions("dt", "id").select("dt", "value").write.partitionBy("dt").text(path)
    return readers.read_index(s, path).select(F.col("dt").cast("bigint").alias("dt"), "di", "id", "created_at")


def _written_chunks(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s)
    sinks.write_chunks(fr.tweets_once(s, d, "created_at", "tw_text").withColumn("tw_text", F.regexp_replace("tw_text", r"[\s\"\\]+", " ")), path, 1000)
    back = s.read.option("sep", "\t").schema("id bigint, created_at bigint, tw_text string, chunk int").csv(path)
    ends = back.groupBy("chunk").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    apart = ends.alias("x").join(ends.alias("y"), F.expr("x.chunk < y.chunk and x.hi >= y.lo")).agg(F.count("*").alias("crossing")).scalar()
    return back.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.count("created_at").alias("times")).withColumn("crossing", apart)


def _markup(s: SparkSession, d: str) -> str:
    """A document of the extractor's markup for each word of the dictionary, its surface in quotes; 500 or so a file."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    w = fr.dictionary(s, d).where("noun <> ''")
    text = safe(F.concat(F.lit('<l><b># <N n0="" lemma="x">"'), safe(F.col("noun")), F.lit('"</N> <P n1="" lemma="y">по</P></b></l>')))
    tag = F.col("noun").startswith("#").cast("int").cast("string")
    number = F.col("noun").rlike(r"^\p{N}+$").cast("int").cast("string")
    value = F.concat(
        F.lit('<document di="'), F.col("noun_md5").cast("string"), F.lit('"><facts><SimpleFact FactID="0" LeadID="0" FieldsInfo="n0;n1;"><Noun val="'), safe(F.upper("noun")),
        F.lit('"/><Prep val="ПО"/><IsHashTag val="'), tag, F.lit('"/><IsNumber val="'), number, F.lit('"/></SimpleFact></facts><Leads><Lead text="'), text, F.lit('" id="0"/></Leads></document>'),
    )
    files = w.select(value.alias("value"), F.pmod(F.xxhash64("noun_md5"), F.lit(1 + w.count() // 500)).alias("part")).groupBy("part")
    path = _folder(s)
    files.agg(F.concat(F.lit("<fdo_objects>"), F.array_join(F.collect_list("value"), "\n"), F.lit("</fdo_objects>")).alias("value")).repartition("part").write.partitionBy("part").text(path)
    return path


def _facts(s: SparkSession, d: str) -> DataFrame:
    return readers.nouns_of_facts(readers.read_facts(s, _markup(s, d)))


def _surfaces(s: SparkSession, d: str) -> DataFrame:
    f = _facts(s, d)
    return f.select("di", "pos", scalars.surface("fact.noun", "fact.prep").alias("surface"), F.col("fact.noun_lemma").alias("lemma"), F.col("fact.is_hash_tag").alias("tag"), F.col("fact.is_number").alias("number"))


def _quarantined(s: SparkSession, d: str) -> DataFrame:
    """Documents that can be read, and those that were set aside."""
    rows = table(s, d, "tweets_nouns").select("id", F.when(F.col("noun_md5").isNull(), F.lit("<broken>")).alias("_corrupt"))
    path = _folder(s)
    good = sinks.quarantine(rows, path)
    return good.agg(F.count("*").alias("n")).select(F.lit("good").alias("kind"), "n").unionByName(s.read.text(f"{path}/__trash__").groupBy("value").agg(F.count("*").alias("n")).select(F.lit("bad").alias("kind"), "n"))


# ---- documents and triples


def _array_file(df: DataFrame, by: str, row: Column) -> str:
    """A file for each value of ``by`` that holds one JSON array."""
    path = _folder(df.sparkSession)
    rows = df.groupBy(F.col(by).alias("__by")).agg(F.to_json(F.collect_list(row)).alias("value"))
    rows.repartition("__by").write.partitionBy("__by").text(path)
    return path


def _read_clusters(s: SparkSession, d: str) -> DataFrame:
    t = api.topics_of(table(s, d, "clusters").distinct())
    path = _array_file(t, "cluster_date", F.struct("members", F.size("members").alias("members_len"), "members_md5", "gen_title"))
    back = s.read.schema(readers.CLUSTER).json(path, multiLine=True)
    return back.groupBy("members_md5").agg(F.count("*").alias("topics"), F.sum("members_len").cast("bigint").alias("members"), F.sum(F.size("members")).cast("bigint").alias("read"))


def _read_bigrams(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "word_mates").where("word2 is not null and cnt >= 1").groupBy("word1", "word2").agg(F.sum("cnt").alias("count"))
    end = lambda i: F.struct(F.col(f"word{i}").alias("sourceMd5"), F.struct(F.col(f"word{i}").alias("wordMd5"), (F.col("count") + i).alias("count")).alias("word")).alias(f"s{i}")
    path = _array_file(m.withColumn("part", F.col("word1") % 16), "part", F.struct(end(1), end(2), "count"))
    return readers.read_bigrams(s, path)


def _read_profiles(s: SparkSession, d: str) -> DataFrame:
    m = fr.matrix(s, d)
    rows = m.groupBy("post_md5").agg(F.map_from_entries(F.collect_list(F.struct(F.col("reply_md5").cast("string"), F.col("reply_cnt").cast("double")))).alias("row"))
    files = rows.groupBy((F.col("post_md5") % 16).alias("part")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("post_md5").cast("string"), "row")))).alias("value"))
    path = _folder(s)
    files.repartition("part").write.partitionBy("part").text(path)
    return readers.read_profiles(s, path).select("post", "reply", F.col("weight").cast("bigint").alias("weight"))


def _triples(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s)
    sinks.write_triples(fr.distances(s, d), path, "a", "b", "sim")
    return readers.read_triples(s, path)


def _gold(s: SparkSession, d: str) -> DataFrame:
    """(a, b, human, measured, deviation): gold files of foreign words, their translations, and the measured pairs.

    A stand-in for judgements: pairs of words that occur together, the more often the more alike.  Of every
    seventh word there is no translation.
    """
    words = fr.dictionary(s, d).where("noun <> ''")
    mates = table(s, d, "word_mates").where("word1 <> word2 and cnt >= 1").groupBy(F.least("word1", "word2").alias("a"), F.greatest("word1", "word2").alias("b")).agg(F.least(F.sum("cnt"), F.lit(10)).alias("h"))
    gold, translated = _folder(s), _folder(s)
    mates.select(F.concat(F.lit("w"), "a").alias("Word 1"), F.concat(F.lit("w"), "b").alias("Word 2"), F.col("h").alias("Human (mean)")).write.csv(gold, sep="\t", header=True)
    text = F.when(F.col("noun_md5") % 7 == 0, F.concat(F.lit("-"), "noun")).otherwise(F.concat("noun", F.lit(", also this")))
    words.select(F.concat_ws("\t", F.concat(F.lit("w"), "noun_md5"), text).alias("value")).write.text(translated)
    pairs = evaluate.gold_pairs(readers.read_gold(s, gold), readers.read_translations(s, translated))
    return evaluate.against_gold(pairs, fr.distances(s, d))


def _gold_correlation(s: SparkSession, d: str) -> DataFrame:
    c = evaluate.correlations(_gold(s, d).select("a", "b", "human", F.round("measured", 6).alias("measured")), "human", "measured")
    return c.select("n", F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"))


def _database(s: SparkSession, d: str) -> DataFrame:
    """Imported into a database, which is put where all processes can open it, and read in parallel ranges of the key."""
    url = sinks.write_database(fr.counts(s, d), "post_cnt", _folder(s))
    return readers.read_database(s, url, "post_cnt", "post_md5", (0, 1 << 32), 4)


# ---- changes of tables


def _ignored(s: SparkSession, d: str) -> DataFrame:
    path, order = _folder(s), [F.col(c) for c in ("fetched_at", "username", "created_at")]
    sinks.append(sinks.keep_first(_arrived(s, d, False), ["id"], *order), path)
    sinks.append(sinks.insert_or_ignore(_arrived(s, d, True), s.read.parquet(path), ["id"], *order), path)
    return s.read.parquet(path).select("id", "username", "created_at")


def _replaced(s: SparkSession, d: str) -> DataFrame:
    order = [F.col(c) for c in ("fetched_at", "username", "created_at")]
    old = sinks.keep_first(_arrived(s, d, False), ["id"], *order)
    return sinks.replace_rows(old, _arrived(s, d, True), ["id"], *order).select("id", "username", "created_at")


def _swapped(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s)
    for part in (_days(s, d).where(F.col("dt") < DAY), _days(s, d)):
        sinks.swap(part, path)
    return _counted(sinks.stored(s, path))


def _changed_days(s: SparkSession, d: str, change: str) -> DataFrame:
    """A table by day after one day was written again without its odd ids, deleted, or all old days were."""
    path = _folder(s)
    sinks.overwrite_days(_days(s, d), path)
    if change == "overwritten":
        sinks.overwrite_days(_days(s, d).where((F.col("dt") == DAY) & (F.col("id") % 2 == 0)), path)
    elif change == "dropped":
        sinks.drop_days(s, path, days=[DAY])
    else:
        sinks.retain(s, path, 20140310, SETTINGS.retention_days)
    return _counted(s.read.parquet(path)).withColumn("dt", F.col("dt").cast("bigint"))


def _progress(s: SparkSession, d: str, by_id: bool) -> DataFrame:
    ids = table(s, d, "tweets").select("id").distinct().withColumn("id_done", F.lit(0))
    done = sinks.mark_done(ids, ids=table(s, d, "tweet_chains").select(F.col("reply_id").alias("id"))) if by_id else sinks.mark_done(ids, last_id=SINCE)
    return done.groupBy("id_done").agg(F.count("*").alias("n"))


def _json(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s)
    sinks.write_json(table(s, d, "post_reply_cnt"), path)
    back = s.read.schema("post_md5 bigint, reply_md5 bigint, reply_cnt bigint").json(path)
    return back.groupBy("post_md5").agg(F.count("*").alias("n"), F.count("reply_cnt").alias("known"), F.sum("reply_cnt").alias("total"))


def _annotations(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s)
    for i, user in enumerate("ab"):
        sinks.append(api.mark_set(s, 20140310, user, "e", "test", [{"topic_density": str(3 + i), "spam": str(i)}, {"topic_density": "5", "spam": "0"}]), path)
    return evaluate.marks_long(s.read.parquet(path)).select("username", "mark", "metric", "value")


def _unspoilt(s: SparkSession, d: str) -> DataFrame:
    long = evaluate.marks_long(evaluate._mark_sets(s, d), without_spam=True)
    return evaluate.mark_averages(long).where("metric in ('topic_density', 'topic_relevance')").select("update_time", "metric", F.round("average", 6).alias("average"))


# ---- times, texts and crawls


def _zones(s: SparkSession, d: str) -> DataFrame:
    t = fr.tweets_once(s, d, "created_at").where("created_at is not null").withColumn("ts", to_time("created_at"))
    return t.select("id", scalars.to_digits(scalars.local("ts", "Europe/Moscow")).alias("there"), scalars.to_digits(scalars.utc("ts", "Europe/Moscow")).alias("back"), F.unix_timestamp("ts").alias("unix"))


def _recent(s: SparkSession, d: str) -> DataFrame:
    now = fr.tweets_once(s, d, "created_at").agg(F.max(to_time("created_at")).alias("now"))
    return now.select(F.posexplode(scalars.recent_days(F.col("now"), 4)).alias("back", "day"))


def _lexical(s: SparkSession, d: str) -> DataFrame:
    f = analysis.analyse(fr.tweets_once(s, d, "tw_text").where("tw_text is not null"))
    some = lambda c: F.size(F.filter("facts", lambda x: x[c])).alias(c)
    return f.select("id", F.size("facts").alias("facts"), some("is_hash_tag"), some("is_number"), F.size(F.filter("facts", lambda x: x["prep"].isNotNull())).alias("with_prep"))


def _after_crawl(s: SparkSession, d: str) -> DataFrame:
    users = crawl._users(s, d)
    last = crawl.mark_done(users, "svodka_lenty_x", "20140311000000", 999_000_000_000_000_000, True)
    return last.select("username", "since_id", F.col("blocked_user").cast("int").alias("blocked_user"), "done_time")


def _window(s: SparkSession, d: str) -> DataFrame:
    start = int(crawl.window_start("20140310120000"))
    return fr.tweets_once(s, d, "created_at").where(F.col("created_at") >= start).select("id")


def _fuzzy(s: SparkSession, d: str) -> DataFrame:
    p = profiles.weighted(profiles._profiles(s, d, SETTINGS.profiles_kept))
    return topics.fuzzy_means(p.select(F.col("post_md5").alias("key"), F.col("reply_md5").alias("dim"), F.col("weight").cast("double").alias("weight")), 8).withColumn("weight", F.round("weight", 6))


QUERIES = {
    "s1_messages": lambda s, d: _told(readers.read_messages(s, _feed(s, d))),
    "s1_streamed_messages": lambda s, d: _told(_streamed(s, d)),
    "st_exactly_once": lambda s, d: _streamed(s, d, 2).agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids")),
    "st_sliding_windows": _sliding,
    "st_late_rows": _late,
    "st_crawl_queue": _queue,
    "s2_paged_timelines": _paged,
    "s3_looked_up_tweets": _looked_up,
    "s4_shard_days": _shards,
    "s5_ready_chunks": _chunks,
    "s6_facts": lambda s, d: readers.read_facts(s, _markup(s, d)).select(F.col("_di").alias("di"), F.size("facts.SimpleFact").alias("facts"), F.col("Leads.Lead")[0]["_id"].alias("lead")),
    "u2_surfaces": _surfaces,
    "a15_fact_counts": lambda s, d: evaluate.fact_counts(_facts(s, d)).select("total", "most", *[F.round(c, 6).alias(c) for c in ("mean", "is_hash_tag", "is_number")]),
    "s7_index": _index,
    "s9_database": _database,
    "s10_clusters": _read_clusters,
    "s10_bigrams": _read_bigrams,
    "s10_profiles": _read_profiles,
    "s11_triples": _triples,
    "s12_gold_pairs": lambda s, d: _gold(s, d).select("a", "b", "human", F.round("measured", 6).alias("measured"), F.round("deviation", 6).alias("deviation")),
    "u8_gold_correlation": _gold_correlation,
    "s13_missing_tables": lambda s, d: read_or_empty(s, f"{_folder(s)}/none", "post_cnt").unionByName(read_or_empty(s, f"{d}/post_cnt.parquet", "post_cnt")).groupBy("post_md5").agg(F.count("*").alias("n")),
    "k1_ignored_inserts": _ignored,
    "k3_replaced_rows": _replaced,
    "k4_swapped_table": _swapped,
    "k5_dropped_day": lambda s, d: _changed_days(s, d, "dropped"),
    "k5_overwritten_day": lambda s, d: _changed_days(s, d, "overwritten"),
    "k10_retained_days": lambda s, d: _changed_days(s, d, "retained"),
    "k6_done_up_to": lambda s, d: _progress(s, d, False),
    "k6_done_by_id": lambda s, d: _progress(s, d, True),
    "k7_json": _json,
    "k9_annotations": _annotations,
    "k11_quarantine": _quarantined,
    "g26_chunks": _written_chunks,
    "f16_without_spam": _unspoilt,
    "f17_asked_page": lambda s, d: api._rounded(api.page(api._members(s, d).withColumn("avg_trend", F.round("avg_trend", 6)), api.page_of("?limit=7&offset=3&skip=x"))),
    "x2_large_digests": lambda s, d: fr.dictionary(s, d).select("noun", scalars.digest_large("noun").alias("key")),
    "x7_zones": _zones,
    "x8_recent_days": _recent,
    "x14_surfaces": lambda s, d: fr.dictionary(s, d).select("noun_md5", scalars.surface(scalars.unquote(F.concat(F.lit("«"), "noun", F.lit('"'))), F.when(F.col("noun_md5") % 2 == 0, "по")).alias("surface")),
    "x18_numbers": lambda s, d: fr.counts(s, d).select("post_md5", scalars.trend_text(F.col("post_cnt") / 4.0 - 3).alias("text")),
    "u1_lexical_facts": _lexical,
    "g21_after_crawl": _after_crawl,
    "g21_crawl_window": _window,
    "u5_fuzzy_means": _fuzzy,
}

_TOLD = f"{fr.TW}, fd as (select * from tw where tw_text is not null and regexp_matches(tw_text, '^[^\\n]*[а-яА-Я]'))"
_DT = f"{fr.TW}, dy as (select id, created_at, username, created_at // 1000000 dt from tw where created_at is not null)"
_ARR = f"ar as (select id, fetched_at, username, created_at, fetched_at >= timestamptz '{PART}+00' late from tweets where id is not null and fetched_at is not null)"
_FIRST = "row_number() over (partition by id order by fetched_at, username nulls first, created_at nulls first) = 1"
_WORDS = f"{fr.DICT}, ws as (select * from dict where noun <> '')"
_GOLD = f"""{_WORDS}, {fr.DIST}, mt as (select least(word1, word2) a, greatest(word1, word2) b, least(sum(cnt), 10)::double h from word_mates where word1 <> word2 and cnt >= 1 group by 1, 2),
  tr as (select noun_md5 w, {fr.sql_digest("t")} k from (select noun_md5, regexp_extract(noun || ', also this', '^\\s*([^,\\s]+)', 1) t from ws where noun_md5 % 7 <> 0 and not starts_with(noun, '-')) where t <> ''),
  gp as (select least(x.k, y.k) a, greatest(x.k, y.k) b, avg(h) human from mt join tr x on x.w = mt.a join tr y on y.w = mt.b where x.k <> y.k group by 1, 2),
  gd as (select a, b, human, round(10 * (1 - sim), 6) measured, round(10 * (1 - sim) - human, 6) deviation from gp join dist using (a, b))"""
_HOURS = "h as (select time_bucket(interval 1 hour, strptime(created_at::varchar, '%Y%m%d%H%M%S')) t from tw where created_at is not null)"
_PREPS = ", ".join(f"'{p}'" for p in analysis._PREPOSITIONS)
_PAGED = """select t.id, t.username, t.created_at from tw t where t.username in (select in_reply_to_username from tw) and t.id > {}"""
SQL = {
    "s1_messages": f"with {_TOLD} select id, md5(tw_text) text_md5, username, coalesce(user_id, -1) user_id, in_reply_to_username, coalesce(in_reply_to_id, -1) in_reply_to_id, created_at, created_at // 1000000 dt from fd",
    "s1_streamed_messages": f"with {_TOLD} select id, md5(tw_text) text_md5, username, coalesce(user_id, -1) user_id, in_reply_to_username, coalesce(in_reply_to_id, -1) in_reply_to_id, created_at, created_at // 1000000 dt from fd",
    "st_exactly_once": f"with {_TOLD} select count(*) n, count(distinct id) ids from fd",
    "st_sliding_windows": f"with {fr.TW}, {_HOURS} select strftime(t - to_hours(k::int), '%Y%m%d%H')::bigint as start, count(*) cnt from h, range(3) r(k) group by 1",
    "st_late_rows": f"with {fr.TW}, {_HOURS} select strftime(t, '%Y%m%d%H')::bigint as hour, count(*) cnt from h group by 1",
    "st_crawl_queue": f"""with {fr.TW}, m as (select in_reply_to_username username, created_at from tw where in_reply_to_username is not null and created_at is not null), e as (select *, length(username) % 2 = 0 once from m)
select username, count(*) filter (not once or created_at > {DAY}000000) reply_cnt, case when once then length(username) else 0 end::bigint since_id, case when once then {DAY}000000 else 0 end::bigint done_time from e group by username, once""",
    "s2_paged_timelines": f"with {fr.TW} {_PAGED.format(SINCE)}",
    "s3_looked_up_tweets": f"with {fr.TW} select id, username from tw where id in (select in_reply_to_id from tweets where in_reply_to_id <> 0)",
    "s4_shard_days": f"with {_DT} select distinct dt as day from dy",
    "s5_ready_chunks": f"with {_DT} select distinct dt as day, 7::bigint chunk from dy where dt % 2 = 0",
    "s6_facts": f"with {_WORDS} select noun_md5 di, 1::int facts, 0::int lead from ws",
    "u2_surfaces": f"with {_WORDS} select noun_md5 di, 0::int pos, 'по ' || case when starts_with(noun, '#') then '#' else '' end || replace(noun, '\"', '') surface, lower(upper(noun)) lemma, starts_with(noun, '#') tag, regexp_full_match(noun, '\\p{{N}}+') \"number\" from ws",
    "a15_fact_counts": f"with {_WORDS} select count(*) total, 1::bigint most, 1.0::double mean, round(avg(starts_with(noun, '#')::int), 6) is_hash_tag, round(avg(regexp_full_match(noun, '\\p{{N}}+')::int), 6) is_number from ws",
    "s7_index": f"with {_DT} select dt, row_number() over (partition by dt order by id)::int di, id, created_at from dy",
    "s9_database": f"with {fr.PC} select post_md5, post_cnt from pc",
    "s10_clusters": f"with {api._T} select members_md5, count(*) topics, sum(members_len)::bigint members, sum(members_len)::bigint as read from tp group by 1",
    "s10_bigrams": "select word1 source1, word1, word2 source2, word2, (sum(cnt) + 1)::bigint word1_cnt, sum(cnt)::bigint cnt from word_mates where word1 is not null and word2 is not null and cnt >= 1 group by word1, word2",
    "s10_profiles": f"with {fr.MX} select post_md5 post, reply_md5 reply, reply_cnt weight from mx",
    "s11_triples": f"with {fr.DIST} select a p1, b p2, round(sim, 6) dist from dist",
    "s12_gold_pairs": f"with {_GOLD} select * from gd",
    "u8_gold_correlation": f"""with {_GOLD}, r as (select *, row_number() over (order by human, a, b) rx, row_number() over (order by measured, a, b) ry from gd)
select count(*) n, round(corr(human, measured), 6) pearson, round(1 - 6 * sum((rx - ry) ** 2) / nullif(count(*) * (count(*)::double ** 2 - 1), 0), 6) spearman from r""",
    "s13_missing_tables": "select post_md5, count(*) n from post_cnt group by 1",
    "k1_ignored_inserts": f"with {_ARR} select id, username, created_at from ar qualify {_FIRST}",
    "k3_replaced_rows": f"""with {_ARR}, o as (select * from ar where not late qualify {_FIRST}), n as (select * from ar where late qualify row_number() over (partition by id order by fetched_at desc, username desc nulls last, created_at desc nulls last) = 1)
select id, username, created_at from o where id not in (select id from n) union all select id, username, created_at from n""",
    "k4_swapped_table": f"with {_DT} select dt, count(*) n from dy group by 1",
    "k5_dropped_day": f"with {_DT} select dt, count(*) n from dy where dt <> {DAY} group by 1",
    "k5_overwritten_day": f"with {_DT} select dt, count(*) n from dy where dt <> {DAY} or id % 2 = 0 group by 1",
    "k10_retained_days": f"with {_DT} select dt, count(*) n from dy where dt > 20140306 group by 1",
    "k6_done_up_to": f"select (id <= {SINCE})::int id_done, count(*) n from (select distinct id from tweets) group by 1",
    "k6_done_by_id": "select (id in (select reply_id from tweet_chains where reply_id is not null))::int id_done, count(*) n from (select distinct id from tweets) group by 1",
    "k7_json": "select post_md5, count(*) n, count(reply_cnt) known, sum(reply_cnt)::bigint total from post_reply_cnt group by 1",
    "k9_annotations": """select username, mark::int mark, metric, value::double as value from (values ('a', 0, 3, 0, 0, 0, 0, 1), ('a', 1, 5, 0, 1, 0, 0, 0), ('b', 0, 4, 1, 0, 1, 0, 0), ('b', 1, 5, 0, 1, 0, 0, 0)) v(username, mark, topic_density, spam, true_positive, false_positive, true_negative, false_negative)
  unpivot (value for metric in (topic_density, spam, true_positive, false_positive, true_negative, false_negative))""",
    "k11_quarantine": "select case when noun_md5 is null then 'bad' else 'good' end kind, count(*) n from tweets_nouns group by 1",
    "g26_chunks": f"with {fr.TW} select count(*) n, count(distinct id) ids, count(created_at) times, 0::bigint crossing from tw",
    "f16_without_spam": f"with {evaluate._MK} select update_time, unnest(['topic_density', 'topic_relevance']) metric, unnest([round(avg(dens), 6), round(avg(rel), 6)]) average from p where spam = 0 group by 1",
    "f17_asked_page": f"with {api._T} select cluster_date, topic, members_len, round(max_trend, 6) max_trend, round(avg_trend, 6) avg_trend from tp order by round(avg_trend, 6) desc, 1, 2 limit 7 offset 3",
    "x2_large_digests": f"with {fr.DICT} select noun, (('0x' || substr(md5(noun), 1, 16))::uhugeint * 18446744073709551616::uhugeint + ('0x' || substr(md5(noun), 17, 16))::uhugeint)::varchar as \"key\" from dict",
    "x7_zones": f"""with {fr.TW}, t as (select id, strptime(created_at::varchar, '%Y%m%d%H%M%S') ts from tw where created_at is not null)
select id, strftime(timezone('Europe/Moscow', timezone('UTC', ts)), '%Y%m%d%H%M%S')::bigint there, strftime(timezone('UTC', timezone('Europe/Moscow', ts)), '%Y%m%d%H%M%S')::bigint back, epoch(ts)::bigint unix from t""",
    "x8_recent_days": f"with {fr.TW}, n as (select max(strptime(created_at::varchar, '%Y%m%d%H%M%S'))::date d from tw) select k::int back, strftime(d - k::int, '%Y%m%d')::bigint as day from n, range(4) r(k)",
    "x14_surfaces": f"with {fr.DICT} select noun_md5, case when noun_md5 % 2 = 0 then 'по ' else '' end || regexp_replace(noun, '[\"''«»]', '', 'g') surface from dict",
    "x18_numbers": f"with {fr.PC} select post_md5, case when post_cnt / 4.0 - 3 > 0 then '+' else '' end || printf('%.2f', (post_cnt / 4.0 - 3)::double) as text from pc",
    "u1_lexical_facts": rf"""with {fr.TW}, w as (select id, regexp_extract_all(tw_text, '#?[\p{{L}}\p{{N}}_]+(?:-[\p{{L}}\p{{N}}_]+)*') ws from tw where tw_text is not null), p as (select id, unnest(ws) w, generate_subscripts(ws, 1) i, ws from w),
  f as (select id, count(*) facts, count(*) filter (starts_with(w, '#')) tags, count(*) filter (regexp_full_match(w, '\p{{N}}+')) numbers, count(*) filter (i > 1 and lower(ws[i - 1]) in ({_PREPS})) preps from p where lower(w) not in ({_PREPS}) group by id)
select w.id, coalesce(facts, 0)::int facts, coalesce(tags, 0)::int is_hash_tag, coalesce(numbers, 0)::int is_number, coalesce(preps, 0)::int with_prep from w left join f on f.id = w.id""",
    "g21_after_crawl": f"with {crawl._U}, me as (select *, username = 'svodka_lenty_x' me from u) select username, case when me then greatest(since_id, 999000000000000000) else since_id end since_id, case when me then 1 else blocked_user end::int blocked_user, case when me then '20140311000000' else coalesce(done::varchar, '') end done_time from me",
    "g21_crawl_window": f"with {fr.TW} select id from tw where created_at >= 20140303000000",
}
