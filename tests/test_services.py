"""The services of the paged and the looked-up source: whole answers, and no more read of the table than is asked for."""

from pathlib import Path

import pytest

from skein.plans import roundtrips
from skein.sources import readers

TWEET = "id bigint, fetched_at timestamp, username string, in_reply_to_username string, in_reply_to_id bigint, tw_text string, created_at bigint"
TOP = (1 << 63) - 1


@pytest.fixture(scope="module")
def tweets(spark, tmp_path_factory):
    """300 users of 20 tweets, one of 9000, one whose name has a space, one without a name, the greatest id; in a mixed order."""
    rows = [(i, f"u{i % 300}") for i in range(6000)] + [(10_000 + i, "hot") for i in range(9000)] + [(30_000, "a b"), (30_001, None), (TOP, "last")]
    d = tmp_path_factory.mktemp("services")
    made = [(i, None, u, None, (i - 1) * (i % 2), f"text {i}", 20140309120000) for i, u in rows]
    spark.createDataFrame(made, TWEET).repartition(3).write.parquet(str(d / "tweets.parquet"))
    return str(d), rows


def read_by(call):
    """The call's result and the bytes that this process read meanwhile."""
    told = lambda: int(Path("/proc/self/io").read_text().split()[1])
    before = told()
    return call(), told() - before


def size(folder):
    return sum(p.stat().st_size for p in Path(folder).glob("*.parquet"))


def test_pages_of_all_users_read_the_table_about_once(spark, tweets):
    d, rows = tweets
    service = roundtrips._service(spark, d, "username", "id")
    paged = readers._Paged({"fetch": "skein.plans.roundtrips:serve", "service": service})
    users = sorted({u for _, u in rows if u})
    got, read = read_by(lambda: [(r[0], r[2]) for u in users for r in paged.pages(u, 5, None)])
    assert sorted(got) == sorted((i, u) for i, u in rows if u and i > 5)
    assert read < 4 * size(service)
    page = roundtrips.serve("hot", 15_000, 14_990, 4, service)
    assert [r[0] for r in page] == [15_000, 14_999, 14_998, 14_997] and page[0] == (15_000, "text 15000", "hot", 20140309120000)
    assert roundtrips.serve("nobody", None, 0, 9, service) == []


def test_users_are_lines(spark, tweets):
    d, rows = tweets
    (Path(d) / "users").mkdir()
    (Path(d) / "users" / "0.txt").write_text("a b\nhot\n")
    service = roundtrips._service(spark, d, "username", "id")
    got = spark.read.format("paged").options(users_path=f"{d}/users", fetch="skein.plans.roundtrips:serve", service=service).load()
    assert sorted((r.id, r.username) for r in got.collect()) == sorted((i, u) for i, u in rows if u in ("a b", "hot"))


def test_ids_in_order_read_the_table_about_once(spark, tweets):
    d, rows = tweets
    service = roundtrips._service(spark, d, "id")
    ids = sorted(i for i, _ in rows) + [7_777, 40_000]
    asked = sorted(ids)
    reader = readers._LookupReader({"fetch": "skein.plans.roundtrips:find", "service": service})
    got, read = read_by(lambda: [r for n in range(0, len(asked), 100) for r in reader.read(readers._Part([str(i) for i in asked[n : n + 100]]))])
    assert sorted((r[0], r[2] or "") for r in got) == sorted((i, u or "") for i, u in rows)
    assert read < 4 * size(service)
    assert [r[0] for r in roundtrips.find([30_001, 5, 5, -1, TOP], service)] == [5, 30_001, TOP]
    looked_up = roundtrips.QUERIES["s3_looked_up_tweets"](spark, d).collect()
    wanted = {i - 1 for i, _ in rows if i % 2} - {0}
    assert sorted((r.id, r.username or "") for r in looked_up) == sorted((i, u or "") for i, u in rows if i in wanted)
