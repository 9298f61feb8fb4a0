"""The whole run on a tiny stream, and every query on the smallest data."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from skein.config import Settings
from skein.functions.scalars import digest
from skein.plans import catalog
from skein.plans.pipeline import run
from tests.oracle import both, connect


def test_pipeline_finds_the_planted_topic(spark):
    rows, i = [], 0
    for day in (8, 9, 10):
        for h in range(8, 12):
            for k in range(12):
                i += 1
                rows.append((i, 20140300000000 + day * 10**6 + h * 10**4 + k * 100, [f"w{(i * j) % 11}" for j in (1, 2, 3)] + ["и", "в"]))
                if day == 10 and h >= 10 - k % 2:
                    i += 1
                    rows.append((i, 20140310000000 + h * 10**4 + k * 100 + 1, ["пожар", "на", "складе", "город", "дым", "огонь"]))
    lists = spark.createDataFrame(rows, "id bigint, created_at bigint, lemmas array<string>").withColumn("sources", F.col("lemmas"))
    tweets = lists.select("id", F.array_join("lemmas", " ").alias("tw_text"), F.lit("u").alias("username"), "created_at")
    index = lists.select("id", F.explode("lemmas").alias("w")).select("id", digest("w").alias("noun_md5")).distinct()
    trash = spark.createDataFrame([("и",), ("в",)], "w string").select(digest("w").alias("post_md5"))
    got = run(lists, tweets, index, datetime(2014, 3, 10, 12), trash=trash, settings=Settings(corpus_size=1e4, topic_distance=0.7))
    words = {r.k: r.w for r in spark.createDataFrame([(w,) for w in ("пожар", "на", "складе", "город", "дым", "огонь", *(f"w{j}" for j in range(11)))], "w string").select("w", digest("w").alias("k")).collect()}
    topics = [{words.get(m) for m in r.members} for r in got.tables["topics"].collect()]
    assert any(len(t & {"пожар", "на", "складе", "город", "дым", "огонь"}) >= 3 and not any(w and w[0] == "w" for w in t) for t in topics), topics
    assert got.tables["titles"].count() >= 1
    assert got.tables["relevant"].where("matched >= 2").count() >= 1
    assert set(got.seconds) == set(got.tables)


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, sf, con, name):
    if name in catalog.SQL:
        got, want = both(con, spark, sf, catalog.QUERIES[name], catalog.SQL[name])
        assert got == want
    else:
        assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
