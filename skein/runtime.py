"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import hashlib
import io
import shutil
import tempfile
import uuid
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[8]", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that tests and the bench use."""
    b = (
        SparkSession.builder.master(master)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut(df: DataFrame, *instead_of: DataFrame) -> DataFrame:
    """Write ``df`` as a table to the shared folder and continue from its files.

    The folder is the one the session names in ``spark.checkpoint.dir``; only where that is unset (tests on one
    machine) a temporary one is made.  The result survives lost executors.  Tables of ``instead_of`` that were
    made by this function are deleted when the new one is whole: the caller reads them no more.  What is left is
    deleted by ``clear`` and when the program ends.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    for old in instead_of:
        drop(old)
    out = spark.read.schema(df.schema).parquet(path)
    _tables[id(out)] = (weakref.ref(out), path)
    return out


_tables: dict[int, tuple[weakref.ref, str]] = {}


def drop(df: DataFrame) -> None:
    """Deletes the table of a DataFrame made by ``cut``; others stay."""
    ref, path = _tables.pop(id(df), (None, ""))
    if ref is not None and ref() is df:
        p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def clear(spark: SparkSession) -> None:
    """Deletes all tables that ``cut`` made for this application; results that read them are of no use any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{spark.sparkContext.applicationId}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    _tables.clear()


@atexit.register
def _end() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and _tables:
        try:
            clear(spark)
        except Exception:  # noqa: BLE001, S110 - the session may be gone by now
            pass
    for folder in _own_folder:
        shutil.rmtree(folder, ignore_errors=True)


_own_folder: list[str] = []
_shipped: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Where that is unset, a temporary one on this machine, if all tasks run on it; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="skein-"))
    return _own_folder[0]


def ship(spark: SparkSession) -> None:
    """Gives the executors' Python workers this package, once an application, by way of the shared folder."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    packed, root = io.BytesIO(), Path(__file__).parent
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(f"{root.name}/{p.relative_to(root).as_posix()}"), p.read_bytes())
    data = packed.getvalue()
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{root.name}-{sc.applicationId}-{hashlib.sha1(data).hexdigest()[:12]}.zip")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    out.write(data)
    out.close()
    sc.addPyFile(path.toString())
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
