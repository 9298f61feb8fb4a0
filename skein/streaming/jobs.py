"""Structured Streaming: ingest, windowed counters, deduplication and the crawl queue's state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skein.functions.scalars import to_time
from skein.runtime import shared_folder, ship


def deduplicated(stream: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """The first row of each key; keys are remembered for as long as rows may be late."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, at: str, keys: list[str], width: str, late: str | None = None, slide: str | None = None) -> DataFrame:
    """(window start, keys, cnt) in event time; windows are dropped from the state when the watermark passes."""
    s = stream.withWatermark(at, late) if late else stream
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return s.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("cnt")).select(F.col("w.start").alias("start"), *keys, "cnt")


def write_by_day(stream: DataFrame, path: str, checkpoint: str, day: str = "dt") -> StreamingQuery:
    """Appends to a table partitioned by day; files are committed exactly once by the sink's log."""
    return stream.writeStream.format("parquet").partitionBy(day).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_batches(stream: DataFrame, path: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Writes every micro-batch to its own folder, named by its number, so a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_counts(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last value of every key of an update-mode counter."""
    rows = spark.read.parquet(path)
    return rows.groupBy(*keys).agg(F.max_by("cnt", "batch").alias("cnt"))


QUEUE = "username string, reply_cnt bigint, since_id bigint, done_time bigint"


def crawl_queue(events: DataFrame, forget: int | None = None) -> DataFrame:
    """State of the crawl queue by user, from events (username, kind, at, since_id).

    ``mention`` adds one to the user's reply counter if the user was never done, or if it is newer than the
    user's done time; ``done`` sets done time and last seen id and starts the counter anew; ``block`` sets the
    counter to -1 for good.  Events of one batch are taken in order of time.  The state of a user without events
    for ``forget`` milliseconds is dropped; by default it is kept.
    """
    ship(events.sparkSession)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count, since, done = state.get if state.exists else (0, 0, 0)
        if count >= 0:
            e = pd.concat(batches).sort_values(["at", "kind"])
            kind, at = e["kind"].to_numpy(), e["at"].to_numpy()
            blocked = kind == "block"
            end = int(blocked.argmax()) if blocked.any() else len(kind)
            ends = np.flatnonzero(kind[:end] == "done")
            new = 0
            if len(ends):
                since, done, new, count = int(max(since, e["since_id"].to_numpy()[ends].max())), int(at[ends[-1]]), int(ends[-1]) + 1, 0
            count = -1 if blocked.any() else count + int(((kind[new:] == "mention") & (at[new:] > done)).sum())
        state.update((count, since, done))
        if forget is not None:
            state.setTimeoutDuration(forget)
        yield pd.DataFrame({"username": [key[0]], "reply_cnt": [count], "since_id": [since], "done_time": [done]})

    timeout = GroupStateTimeout.NoTimeout if forget is None else GroupStateTimeout.ProcessingTimeTimeout
    return events.groupBy("username").applyInPandasWithState(update, QUEUE, "reply_cnt bigint, since_id bigint, done_time bigint", "update", timeout)


def word_hours_of_files(spark: SparkSession, folder: str) -> DataFrame:
    """Tweets per hour of the tweets table, run as a stream of its files until all are read.

    Repeated tweets are dropped within the watermark, which spans the table here since the files are in no
    order.  The result is read from the stream's own output.
    """
    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{folder}/tweets.parquet").schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(f"{folder}/tweets.parque[t]")  # a pattern, as the table may be one file
    rows = deduplicated(source.where("created_at is not null").select("id", to_time("created_at").alias("ts")), "id", "ts", "60 days")
    write_batches(windowed_counts(rows, "ts", [], "1 hour"), f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    found = latest_counts(spark, f"{out}/rows", ["start"])
    return found.select(F.date_format("start", "yyyyMMddHH").cast("bigint").alias("hour"), F.col("cnt").alias("tweets"))
