"""Sinks and changes of stored tables, on parquet folders partitioned by day where a table has days.

Every change is a new write followed by a swap of folders; a failed job leaves the old table whole, and a swap
that was broken off is finished or undone by the next one or by ``recover``.
Deltas are merged by aggregation: counters are associative, so increments may be appended and summed.
"""

from __future__ import annotations

import shutil
import tempfile
import zipfile
from collections.abc import Sequence
from pathlib import Path

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.runtime import cut


def _files(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _files(spark, path)
    return fs.exists(p)


def keep_first(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row a key: the first by ``order``; a key's rows are reduced before the shuffle."""
    ranked = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.struct(*[F.col(c) for c in df.columns]).alias("row"))
    return df.groupBy(*keys).agg(F.min(ranked).alias("r")).select("r.row.*").select(*df.columns)


def insert_or_ignore(new: DataFrame, old: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The rows of ``new`` to be appended: one a key, and none whose key is stored already."""
    return keep_first(new, keys, *order).join(old.select(*keys).distinct(), list(keys), "left_anti").select(*new.columns)


def add_counts(old: DataFrame, delta: DataFrame, keys: Sequence[str], *counts: str) -> DataFrame:
    """Counters after additive upsert."""
    return old.unionByName(delta).groupBy(*keys).agg(*[F.sum(c).cast("bigint").alias(c) for c in counts])


def replace_rows(old: DataFrame, new: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """All rows of ``old`` whose key is not in ``new``, and the last row a key of ``new`` by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*[o.desc() for o in order])
    last = new.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")
    return old.join(last.select(*keys), list(keys), "left_anti").select(*old.columns).unionByName(last.select(*old.columns))


def recover(spark: SparkSession, path: str) -> None:
    """Finishes a swap that was broken off between its renames: the new table if it is whole, else the old one."""
    fs, p = _files(spark, path)
    if not fs.exists(p):
        for other, whole in ((f"{path}.new", f"{path}.new/_SUCCESS"), (f"{path}.old", f"{path}.old")):
            if fs.exists(_files(spark, whole)[1]):
                fs.rename(_files(spark, other)[1], p)
                return


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``swap`` keeps at ``path``."""
    recover(spark, path)
    return spark.read.parquet(path)


def swap(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Writes a new table beside the old one and puts it in its place."""
    spark = df.sparkSession
    recover(spark, path)
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{path}.new")
    fs, p = _files(spark, path)
    old, new = _files(spark, f"{path}.old")[1], _files(spark, f"{path}.new")[1]
    fs.delete(old, True)
    if fs.exists(p):
        fs.rename(p, old)
    fs.rename(new, p)
    fs.delete(old, True)


def overwrite_days(df: DataFrame, path: str, day: str = "dt") -> None:
    """Replaces just the days that ``df`` has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def drop_days(spark: SparkSession, path: str, keep: Column | None = None, day: str = "dt", days: Sequence[int] = ()) -> list[int]:
    """Deletes the partitions of the given days, or all for which ``keep`` over (dt) is not true; returns them.

    Only folder names are looked at, of which there are as many as days.
    """
    fs, p = _files(spark, path)
    found = [int(s.getPath().getName().partition("=")[2]) for s in fs.listStatus(p) if s.getPath().getName().startswith(f"{day}=")]
    gone = [d for d in found if d in set(days)]
    if keep is not None and found:
        gone += [r[0] for r in spark.createDataFrame([(d,) for d in found], f"{day} bigint").where(~F.coalesce(keep, F.lit(False))).collect()]
    for d in gone:
        fs.delete(_files(spark, f"{path}/{day}={d}")[1], True)
    return sorted(set(gone))


def retain(spark: SparkSession, path: str, today: int, days: int, day: str = "dt") -> list[int]:
    """Deletes what is older than ``days`` days before ``today`` (yyyyMMdd)."""
    as_date = lambda c: F.to_date(c.cast("string"), "yyyyMMdd")
    return drop_days(spark, path, as_date(F.col(day)) > F.date_sub(as_date(F.lit(today)), days), day)


def mark_done(progress: DataFrame, last_id: int | None = None, ids: DataFrame | None = None) -> DataFrame:
    """Progress rows with id_done = 1 up to ``last_id``, or for the given ids."""
    if ids is not None:
        done = ids.select("id").distinct().withColumn("__d", F.lit(1))
        return progress.join(done, "id", "left").select("id", F.coalesce("__d", "id_done").cast("int").alias("id_done"))
    return progress.select("id", F.when(F.col("id") <= last_id, 1).otherwise(F.col("id_done")).cast("int").alias("id_done"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_triples(df: DataFrame, path: str, a: str, b: str, value: str) -> None:
    """``a;b;value`` lines, the value with six decimals and a point."""
    df.select(F.concat_ws(";", F.col(a).cast("string"), F.col(b).cast("string"), F.format_string("%.6f", F.col(value)))).write.mode("overwrite").text(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_chunks(tweets: DataFrame, path: str, rows: int) -> None:
    """Index and text lines in chunks of about ``rows`` tweets in id order, a folder a chunk, id beside its text."""
    n = tweets.count()
    parts = max(1, -(-n // rows))
    tweets.select("id", "created_at", "tw_text").repartitionByRange(parts, "id").sortWithinPartitions("id").withColumn("chunk", F.spark_partition_id()).write.mode("overwrite").partitionBy("chunk").option("sep", "\t").csv(path)


def quarantine(facts: DataFrame, path: str) -> DataFrame:
    """Sets the documents that could not be read aside under ``__trash__``; returns the rest."""
    facts = cut(facts)
    bad = facts.where("_corrupt is not null")
    if not bad.isEmpty():
        bad.select("_corrupt").write.mode("append").text(f"{path}/__trash__")
    return facts.where("_corrupt is null")


def write_database(df: DataFrame, table: str, path: str) -> str:
    """Puts ``df``, of numbers, as a table into a new embedded database under ``path``; returns the address to read it.

    An embedded database is written by one process and not seen by others, so the tasks write files, the driver's
    database imports them one by one, and the closed database is packed into one file that all processes open at
    once to read.  It is opened by its name, so ``path`` must be in a folder that is mounted on all machines.
    """
    spark = df.sparkSession
    fs, rows = _files(spark, f"{path}/rows")
    if fs.getScheme() != "file":
        raise ValueError(f"{path}: an embedded database is read from a mounted folder")
    df.write.csv(f"{path}/rows")
    sql, work = spark._jvm.java.sql, Path(tempfile.mkdtemp(prefix="skein-db-"))
    try:
        url = f"jdbc:derby:{work}/db"
        c = sql.DriverManager.getConnection(f"{url};create=true")
        try:
            c.createStatement().execute(f"create table {table} (" + ", ".join(f'"{name}" {kind}' for name, kind in df.dtypes) + ")")
            load = c.prepareCall("call syscs_util.syscs_import_table(null, ?, ?, ',', '\"', 'UTF-8', 0)")
            load.setString(1, table.upper())
            for f in fs.listStatus(rows):
                if f.getLen() and f.getPath().getName().startswith("part-"):
                    load.setString(2, f.getPath().toUri().getPath())
                    load.execute()
        finally:
            c.close()
            try:
                sql.DriverManager.getConnection(f"{url};shutdown=true")
            except Py4JJavaError as e:  # how the database says that it is closed
                if e.java_exception.getSQLState() != "08006":
                    raise
        packed = work / "packed.jar"
        with zipfile.ZipFile(packed, "w") as z:  # stored, so pages are found without reading what is before them
            for f in sorted((work / "db").rglob("*")):
                if f.is_file() and f.name not in ("db.lck", "dbex.lck"):
                    z.write(f, f.relative_to(work))
        at = _files(spark, f"{path}/{table}.jar")[1]
        fs.copyFromLocalFile(False, True, _files(spark, f"file://{packed}")[1], at)
    finally:
        shutil.rmtree(work, ignore_errors=True)
    fs.delete(rows, True)
    return f"jdbc:derby:jar:({at.toUri().getPath()})db"
