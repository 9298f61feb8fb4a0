"""Sources: feed messages, shards and chunks, extracted facts, distances, gold pairs, paged and looked-up rows."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from skein.functions.scalars import day, feed_time, has_cyrillic, to_digits
from skein.schemas import CLUSTER, MARKS

# ---- feed messages

MESSAGE = "id bigint, text string, created_at string, user struct<screen_name: string, id: bigint>, in_reply_to_screen_name string, in_reply_to_status_id bigint"


def parse_messages(raw: DataFrame, column: str = "value") -> DataFrame:
    """Rows of the tweets table, with event time ``ts`` and day ``dt``, from JSON messages.

    Messages that are no JSON, without id or text, or without a Cyrillic letter on the first line are left
    out; the same expressions serve batch and stream.
    """
    m = raw.select(F.from_json(column, MESSAGE).alias("m")).where("m.id is not null and m.text is not null")
    ts = feed_time("m.created_at")
    return (
        m.where(has_cyrillic("m.text"))
        .select(F.col("m.id").alias("id"), F.col("m.text").alias("tw_text"), F.col("m.user.screen_name").alias("username"), F.col("m.user.id").alias("user_id"), F.col("m.in_reply_to_screen_name").alias("in_reply_to_username"), F.col("m.in_reply_to_status_id").alias("in_reply_to_id"), to_digits(ts).alias("created_at"), ts.alias("ts"))
        .withColumn("dt", day("created_at"))
    )


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Messages of text files, one JSON a line."""
    return parse_messages(spark.read.text(path))


def stream_messages(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Messages that arrive as files; a bounded number of files a micro-batch."""
    return parse_messages(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path))


# ---- shards and chunks


def shard_days(spark: SparkSession, folder: str, pattern: str = r"tweets_(\d{8})\.db$") -> DataFrame:
    """(path, day) of the files under ``folder`` whose name tells their day; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*").load(folder).select("path")
    return files.select("path", F.regexp_extract("path", pattern, 1).alias("day")).where("day <> ''").select("path", F.col("day").cast("bigint").alias("day"))


def ready_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """(day, chunk, index_path, facts_path) of the chunks that have both their index and their facts."""
    files = spark.read.format("binaryFile").load(folder).select("path")

    def part(suffix: str, name: str) -> DataFrame:
        pattern = rf"(\d{{8}})_(\d+)\.{suffix}$"
        found = files.select(F.regexp_extract("path", pattern, 1).alias("day"), F.regexp_extract("path", pattern, 2).alias("chunk"), F.col("path").alias(name))
        return found.where("day <> ''").select(F.col("day").cast("bigint").alias("day"), F.col("chunk").cast("bigint").alias("chunk"), name)

    return part(r"index\.txt", "index_path").join(part(r"facts\.xml", "facts_path"), ["day", "chunk"])


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(di, id, created_at) of an index file; di is the line's number from 1, which the facts refer to.

    Line numbers come from the file's byte order: the file is read as one value, since a chunk is small.
    """
    whole = spark.read.text(path, wholetext=True)
    given = [c for c in whole.columns if c != "value"]  # columns of the folder's partitions
    lines = whole.select(*given, F.posexplode(F.split(F.regexp_replace("value", r"\n$", ""), "\n")).alias("n", "line"))
    cells = F.split("line", "\t")
    return lines.select(*given, (F.col("n") + 1).alias("di"), F.get(cells, F.lit(0)).try_cast("bigint").alias("id"), F.get(cells, F.lit(1)).try_cast("bigint").alias("created_at"))


# ---- extracted facts

FACT_ROW = """_di bigint,
  facts struct<SimpleFact: array<struct<_FactID: int, _LeadID: int, _FieldsInfo: string, Noun: struct<_val: string>, Prep: struct<_val: string>,
    IsHashTag: struct<_val: int>, IsPersonName: struct<_val: int>, IsNumber: struct<_val: int>>>>,
  Leads struct<Lead: array<struct<_id: int, _text: string>>>, _corrupt string"""


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """One row a document of the extractor's XML; a document that cannot be read has its text in ``_corrupt``."""
    return spark.read.format("xml").option("rowTag", "document").option("columnNameOfCorruptRecord", "_corrupt").schema(FACT_ROW).load(path)


#: What markup writes for five characters, fixed values; the ampersand is the last to be read.
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def nouns_of_facts(facts: DataFrame) -> DataFrame:
    """(di, fact) with the surface text of noun and preposition from the lead that each fact names.

    A lead marks its parts: ``<N n3="" lemma="...">surface</N>``, ``<P n4="" lemma="...">surface</P>``.  The part
    that has the fact's marker among its attributes (the last, if several have it) is cut out by a pattern made of
    the marker, which a regular expression function can take a row at a time.  Quotes go, lemmas are lower-cased,
    and the surface of a hash tag gets its sign.  Without such a part the surface is null.
    """
    leads = facts.select(F.col("_di").alias("di"), F.explode("Leads.Lead").alias("lead")).select("di", F.col("lead._id").alias("lead_id"), F.col("lead._text").alias("lead_text"))
    rows = facts.select(F.col("_di").alias("di"), F.posexplode("facts.SimpleFact").alias("pos", "f"))
    marks = F.split(F.regexp_replace("f._FieldsInfo", ";+$", ""), ";")
    rows = rows.select("di", "pos", "f", F.col("f._LeadID").alias("lead_id"), F.get(marks, F.lit(0)).alias("noun_id"), F.get(marks, F.lit(1)).alias("prep_id")).join(leads, ["di", "lead_id"], "left")
    plain = lambda c: reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), _ENTITIES, c)
    tag = F.coalesce(F.col("f.IsHashTag._val") == 1, F.lit(False))

    def part(t: str, mark: str) -> Column:
        pattern = F.concat(F.lit(rf"(?s)^.*<{t}(?=\s)[^>]*\s"), F.col(mark), F.lit(rf"\s*=[^>]*>([^<]*).*?</{t}>"))
        return F.replace(plain(F.when(F.rlike("lead_text", pattern), F.call_function("regexp_extract", "lead_text", pattern, F.lit(1)))), F.lit('"'), F.lit(""))

    return rows.select(
        "di",
        "pos",
        F.struct(
            F.concat(F.when(tag, "#").otherwise(""), part("N", "noun_id")).alias("noun"),
            F.lower("f.Noun._val").alias("noun_lemma"),
            F.when(F.col("f.Prep._val").isNotNull(), part("P", "prep_id")).alias("prep"),
            F.lower("f.Prep._val").alias("prep_lemma"),
            "noun_id",
            "prep_id",
            F.col("lead_id").cast("string").alias("lead_id"),
            tag.alias("is_hash_tag"),
            F.coalesce(F.col("f.IsPersonName._val") == 1, F.lit(False)).alias("is_person_name"),
            F.coalesce(F.col("f.IsNumber._val") == 1, F.lit(False)).alias("is_number"),
        ).alias("fact"),
    )


# ---- documents, distances and gold standards


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """Clusters of a JSON file that holds one array."""
    return spark.read.schema(CLUSTER).json(path, multiLine=True)


BIGRAMS = "s1 struct<sourceMd5: bigint, text: string, word: struct<wordMd5: bigint, text: string, count: bigint>>, s2 struct<sourceMd5: bigint, text: string, word: struct<wordMd5: bigint, text: string, count: bigint>>, count bigint"


def read_bigrams(spark: SparkSession, path: str) -> DataFrame:
    """(source1, word1, source2, word2, word1_cnt, cnt) of a JSON file that holds one array of pairs."""
    ends = {"source1": "s1.sourceMd5", "word1": "s1.word.wordMd5", "source2": "s2.sourceMd5", "word2": "s2.word.wordMd5", "word1_cnt": "s1.word.count", "cnt": "count"}
    return spark.read.schema(BIGRAMS).json(path, multiLine=True).select(*[F.col(v).alias(k) for k, v in ends.items()])


def parse_marks(df: DataFrame, column: str = "marks") -> DataFrame:
    return df.withColumn("mark", F.explode(F.from_json(column, MARKS)))


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """(post, reply, weight) of a JSON map of maps."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, map<string, double>>").alias("m"))
    return whole.select(F.explode("m").alias("post", "row")).select(F.col("post").try_cast("bigint").alias("post"), F.explode("row").alias("reply", "weight")).withColumn("reply", F.col("reply").try_cast("bigint"))


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """(p1, p2, dist) of ``p1;p2;dist`` lines; a decimal comma is taken as a point."""
    rows = spark.read.csv(path, sep=";", schema="p1 bigint, p2 bigint, d string")
    return rows.select("p1", "p2", F.translate("d", ",", ".").try_cast("double").alias("dist"))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """(word1, word2, human_mean) of a tab separated file with a header."""
    return spark.read.csv(path, sep="\t", header=True, enforceSchema=True, schema="word1 string, word2 string, human_mean double")


def read_translations(spark: SparkSession, path: str) -> DataFrame:
    """(word, translation): the first alternative, cut at a comma, then at white space; ``-`` means none."""
    rows = spark.read.csv(path, sep="\t", schema="word string, t string")
    first = F.regexp_extract("t", r"^\s*([^,\s]+)", 1)
    return rows.where("t is not null and not startswith(t, '-')").select("word", first.alias("translation")).where("translation <> ''")


def read_database(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] = (0, 1), parts: int = 8, rows: int = 10_000) -> DataFrame:
    """A table of a relational database, fetched ``rows`` at a time and, given a key, in parallel ranges."""
    options: dict[str, Any] = {"url": url, "dbtable": table, "fetchsize": rows}
    if key:
        options |= {"partitionColumn": key, "lowerBound": bounds[0], "upperBound": bounds[1], "numPartitions": parts}
    return spark.read.format("jdbc").options(**options).load()


# ---- paged and looked-up rows of a service


class Busy(Exception):
    """A service asks to wait for ``seconds`` before the next call."""

    def __init__(self, seconds: float = 1.0) -> None:
        super().__init__(seconds)
        self.seconds = seconds


class _Part(InputPartition):
    def __init__(self, value: Any, since: int = 0, until: int | None = None) -> None:
        self.value, self.since, self.until = value, since, until


def _open(path: str):
    from pyarrow import fs

    files, at = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return files, at


def _keys(options: dict[str, str], name: str) -> list[InputPartition]:
    """Partitions of keys: of the option ``name`` (comma separated) each its own, of ``name``_path each file one."""
    given = options.get(f"{name}_path")
    if not given:
        return [_Part([k]) for k in options.get(name, "").split(",") if k]
    from pyarrow import fs

    files, at = _open(given)
    return [_Part(f"{given.rstrip('/')}/{f.base_name}") for f in files.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File and f.size and not f.base_name.startswith(("_", "."))]


def _listed(value: Any) -> list[str]:
    """The keys of a partition; those of a file, its lines, are read where the partition is."""
    if isinstance(value, list):
        return value
    files, at = _open(value)
    with files.open_input_stream(at) as f:
        return [k for k in f.read().decode().replace("\r\n", "\n").split("\n") if k.strip()]


def _called(options: dict[str, str], *values: Any) -> list[tuple]:
    extra = (options["service"],) if "service" in options else ()
    return retry(lambda: load(options["fetch"])(*values, *extra))


ROW = "id bigint, tw_text string, username string, created_at bigint"


class PagedSource(DataSource):
    """A service that gives a user's rows in pages, newest first, as a batch or as a stream.

    Options: ``users`` (comma separated) or ``users_path`` (a folder of files with a user a line), ``since_id``,
    ``page_size``, ``fetch``, a module path ``package.module:function`` of a callable (user, max_id, since_id, count)
    -> list of rows whose first value is the id, and ``service``, a further value for that callable.  A user or a
    file of users is one partition; pages go down by max_id until one is empty or since_id is reached.  As a stream
    its offset is the greatest id seen, so each batch has the rows above the last one's.  A service that is busy is
    waited for.  A user whose fetch raises PermissionError is given up, other errors are tried three times and then
    fail the job or, with ``on_error`` = skip, give up the user.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return ROW

    def reader(self, schema: Any) -> DataSourceReader:
        return _PagedReader(self.options)

    def streamReader(self, schema: Any) -> DataSourceStreamReader:
        return _PagedStream(self.options)


class _Paged:
    def __init__(self, options: dict[str, str]) -> None:
        self.options = dict(options)

    def pages(self, user: str, since: int, until: int | None) -> Iterator[tuple]:
        count, last = int(self.options.get("page_size", 200)), until
        while True:
            try:
                page = [r for r in _called(self.options, user, last, since, count) if r[0] > since]
            except PermissionError:
                return
            except Exception:
                if self.options.get("on_error") == "skip":
                    return
                raise
            yield from page
            if not page:
                return
            last = min(r[0] for r in page) - 1

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for user in _listed(partition.value):
            yield from self.pages(user, partition.since, partition.until)


class _PagedReader(_Paged, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return [_Part(p.value, int(self.options.get("since_id", 0))) for p in _keys(self.options, "users")]


class _PagedStream(_Paged, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"since_id": int(self.options.get("since_id", 0))}

    def latestOffset(self) -> dict:
        """The greatest id of the users' first rows; users of files are asked one by one here, on the driver."""
        newest = self.initialOffset()["since_id"]
        for part in _keys(self.options, "users"):
            for user in _listed(part.value):
                try:
                    newest = max([newest, *(r[0] for r in _called(self.options, user, None, newest, 1))])
                except PermissionError:
                    continue
        return {"since_id": newest}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Part(p.value, start["since_id"], end["since_id"]) for p in _keys(self.options, "users")] if end["since_id"] > start["since_id"] else []

    def commit(self, end: dict) -> None:
        """Nothing is kept by the service."""


class LookupSource(DataSource):
    """A service that gives rows by id, at most ``batch`` (100) ids a call.

    Options: ``ids`` (comma separated) or ``ids_path`` (a folder of files with an id a line, a partition each),
    ``batch``, ``service`` and ``fetch`` as for PagedSource, called with a list of ids.
    """

    @classmethod
    def name(cls) -> str:
        return "lookup"

    def schema(self) -> str:
        return ROW

    def reader(self, schema: Any) -> DataSourceReader:
        return _LookupReader(self.options)


class _LookupReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = dict(options)
        self.batch = int(self.options.get("batch", 100))

    def partitions(self) -> list[InputPartition]:
        if self.options.get("ids_path"):
            return _keys(self.options, "ids")
        ids = [i for i in self.options.get("ids", "").split(",") if i]
        return [_Part(ids[i : i + self.batch]) for i in range(0, len(ids), self.batch)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        ids = [int(i) for i in _listed(partition.value)]
        for i in range(0, len(ids), self.batch):
            yield from _called(self.options, ids[i : i + self.batch])


def load(path: str) -> Callable:
    import importlib

    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def retry(f: Callable, times: int = 3) -> Any:
    """The call's result; errors but PermissionError are tried again, the last is raised.

    A busy service is waited for, as long as it says, before the next try.
    """
    for left in reversed(range(times)):
        try:
            return f()
        except PermissionError:
            raise
        except Exception as e:
            if not left:
                raise
            if isinstance(e, Busy):
                time.sleep(e.seconds)
