"""Sources, sinks and streams on small files."""

import json
import os
import re
from xml.sax.saxutils import quoteattr

import pytest
from pyspark.sql import functions as F

from skein.functions import scalars
from skein.operators.evaluate import fact_counts
from skein.schemas import read_or_empty
from skein.sources import readers, sinks
from skein.streaming import jobs

def document(di, lead, *facts, lead_id=0):
    """A document of the extractor's markup: in ``lead`` [N n0 x] stands for a marked part."""
    marked = re.sub(r"\[([NP]) (n\d+) ([^\]]*)\]", lambda m: f'<{m[1]} {m[2]}="" lemma="{m[3].lower()}">{m[3]}</{m[1]}>', lead)
    body = "".join(f'<SimpleFact FactID="{i}" LeadID="{lead_id}" FieldsInfo="{fields}" pos="1">{"".join(f"<{k} val={quoteattr(v)}/>" for k, v in parts.items())}</SimpleFact>' for i, (fields, parts) in enumerate(facts))
    return f'<document url="" di="{di}" bi="-1"><facts>{body}</facts><Leads><Lead text={quoteattr(f"<l><b><s>{marked}</s></b></l>")} id="{lead_id}"/></Leads></document>'


def xml(*documents):
    return "<?xml version='1.0' encoding='utf-8'?><fdo_objects>" + "".join(documents) + "</fdo_objects>"


def fact(fields, noun, tag=0, number=0, prep=None):
    return fields, {"Noun": noun} | ({"Prep": prep} if prep else {}) | {"IsHashTag": str(tag), "IsNumber": str(number)}


HASH_TAGS = [
    document(1, "# [N n0 some1]", fact("n0;", "SOME1", 1)),
    document(2, "[N n0 солнце]", fact("n0;", "СОЛНЦЕ")),
    document(3, "# [N n0 солнце]", fact("n0;", "СОЛНЦЕ", 1)),
    document(4, "по # [N n0 солнцу]", fact("n0;", "СОЛНЦЕ", 1)),
    document(5, "[P n1 по] [N n0 солнцу]", fact("n0;n1;", "СОЛНЦЕ", prep="ПО")),
]
NUMBERS = [document(18, "Об этом [N n2 сообщил] [P n1 в] [N n0 четверг], [N n3 30] [N n4 апреля]", fact("n0;n1;", "ЧЕТВЕРГ", prep="В"), fact("n2;", "СООБЩИТЬ"), fact("n3;", "30", number=1), fact("n4;", "АПРЕЛЬ"))]


def message(i, text, at="Sun Mar 09 12:30:00 +0000 2014"):
    return json.dumps({"id": i, "text": text, "created_at": at, "user": {"screen_name": f"u{i}", "id": i}, "in_reply_to_status_id": None}, ensure_ascii=False)


def test_messages_in_batch_and_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text("\n".join([message(1, "привет"), message(2, "hello"), "{broken", message(3, "мир", "Mon Mar 10 00:00:01 +0000 2014"), "{}", message(1, "привет")]))
    (src / "b.json").write_text(message(1, "привет") + "\n" + message(4, "да"))
    batch = readers.read_messages(spark, str(src))
    assert sorted((r.id, r.created_at, r.dt) for r in batch.dropDuplicates(["id"]).collect()) == [(1, 20140309123000, 20140309), (3, 20140310000001, 20140310), (4, 20140309123000, 20140309)]
    stream = jobs.deduplicated(readers.stream_messages(spark, str(src), 1), "id", "ts")
    jobs.write_by_day(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.id, r.dt) for r in out.collect()) == [(1, 20140309), (3, 20140310), (4, 20140309)]
    # started again, it finds nothing new
    jobs.write_by_day(jobs.deduplicated(readers.stream_messages(spark, str(src), 1), "id", "ts"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert out.count() == 3
    windows = jobs.windowed_counts(readers.stream_messages(spark, str(src)), "ts", [], "10 minutes", "1 day", "5 minutes")
    jobs.write_batches(windows, str(tmp_path / "w"), str(tmp_path / "wc")).awaitTermination()
    assert {r.cnt for r in jobs.latest_counts(spark, str(tmp_path / "w"), ["start"]).collect()} == {1, 4}


def test_crawl_state(spark, tmp_path):
    src = tmp_path / "ev"
    schema = "username string, kind string, at bigint, since_id bigint"
    first = [("a", "mention", 5, 0), ("a", "done", 6, 44), ("a", "mention", 3, 0), ("b", "mention", 1, 0)]
    second = [("a", "mention", 6, 0), ("a", "mention", 7, 0), ("b", "block", 2, 0), ("b", "mention", 3, 0)]
    run = lambda: jobs.write_batches(jobs.crawl_queue(spark.readStream.schema(schema).parquet(str(src))), str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    for rows in (first, second):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        run()
    rows = spark.read.parquet(str(tmp_path / "o"))
    last = rows.groupBy("username").agg(F.max_by(F.struct("reply_cnt", "since_id", "done_time"), "batch").alias("s"))
    assert {r.username: tuple(r.s) for r in last.collect()} == {"a": (1, 44, 6), "b": (-1, 0, 0)}


def read(spark, tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return readers.nouns_of_facts(sinks.quarantine(readers.read_facts(spark, str(p)), str(tmp_path)))


def surfaces(facts):
    return [(r.s, r.fact.is_hash_tag, r.fact.is_number) for r in facts.orderBy("di", "pos").select("fact", scalars.surface("fact.noun", "fact.prep").alias("s")).collect()]


def test_facts_of_hash_tags_and_numbers(spark, tmp_path):
    tags = read(spark, tmp_path, "tags.xml", xml(*HASH_TAGS))
    assert surfaces(tags) == [("#some1", True, False), ("солнце", False, False), ("#солнце", True, False), ("#солнцу", True, False), ("по солнцу", False, False)]
    numbers = read(spark, tmp_path, "numbers.xml", xml(*NUMBERS))
    assert surfaces(numbers) == [("в четверг", False, False), ("сообщил", False, False), ("30", False, True), ("апреля", False, False)]
    assert [r.fact.noun_lemma for r in tags.orderBy("di").collect()] == ["some1", "солнце", "солнце", "солнце", "солнце"]
    r = fact_counts(tags.unionByName(numbers)).first()
    assert (r.total, r.most, round(r.is_hash_tag, 3), round(r.is_number, 3)) == (9, 4, 0.333, 0.111)


def test_facts_of_odd_leads(spark, tmp_path):
    odd = xml(
        document(1, 'x [N n0 "солнцу"] [N n10 дню]', fact("n0;", "СОЛНЦЕ"), fact("n10;", "ДЕНЬ"), fact("n7;", "НЕТ"), lead_id=3),
        document(2, "[N n0 a&amp;amp;b]", fact("n0;", "A&B")),
        '<document di="3"><facts></facts></document>',
    )
    facts = read(spark, tmp_path, "odd.xml", odd)
    assert [(r.di, r.fact.noun, r.fact.noun_lemma) for r in facts.orderBy("di", "pos").collect()] == [(1, "солнцу", "солнце"), (1, "дню", "день"), (1, None, "нет"), (2, "a&amp;b", "a&b")]


def test_chunk_files(spark, tmp_path):
    (tmp_path / "20140309_1.facts.xml").write_text(xml(*NUMBERS))
    (tmp_path / "20140309_1.index.txt").write_text("11\t20140309120000\n12\t20140309120001\n")
    (tmp_path / "20140309_2.index.txt").write_text("")
    assert [(r.day, r.chunk) for r in readers.ready_chunks(spark, str(tmp_path)).collect()] == [(20140309, 1)]
    assert [tuple(r) for r in readers.read_index(spark, str(tmp_path / "20140309_1.index.txt")).collect()] == [(1, 11, 20140309120000), (2, 12, 20140309120001)]
    (tmp_path / "tweets_20140308.db").write_text("x")
    assert [r.day for r in readers.shard_days(spark, str(tmp_path)).collect()] == [20140308]


def test_small_files(spark, tmp_path):
    w = lambda n, s: (tmp_path / n).write_text(s) and str(tmp_path / n)
    assert [tuple(r) for r in readers.read_triples(spark, w("t.csv", "1;2;0,5\n3;4;0.25\n5;6;x\n")).collect()] == [(1, 2, 0.5), (3, 4, 0.25), (5, 6, None)]
    assert [tuple(r) for r in readers.read_translations(spark, w("tr.txt", "a\tкот, кошка\nb\t-нет\nc\tбольшой дом\nd\n")).collect()] == [("a", "кот"), ("c", "большой")]
    assert [tuple(r) for r in readers.read_gold(spark, w("g.tab", "Word 1\tWord 2\tHuman (mean)\nlove\tsex\t6.77\n")).collect()] == [("love", "sex", 6.77)]
    assert sorted(map(tuple, readers.read_profiles(spark, w("p.json", '{"1": {"2": 0.5, "3": 1}}')).collect())) == [(1, 2, 0.5), (1, 3, 1.0)]
    assert readers.read_clusters(spark, w("c.json", '[{"members": [{"id": 1, "text": "a"}], "members_len": 1}]')).first().members[0].id == 1
    pair = {"s1": {"sourceMd5": 10, "word": {"wordMd5": 1, "count": 9}}, "s2": {"sourceMd5": 20, "word": {"wordMd5": 2}}, "count": 5}
    assert [tuple(r) for r in readers.read_bigrams(spark, w("b.json", json.dumps([pair]))).collect()] == [(10, 1, 20, 2, 9, 5)]
    assert read_or_empty(spark, str(tmp_path / "none"), "noun_trend").columns == ["noun_md5", "trend"]


def fetch_page(user, max_id, since, count):
    if user == "denied":
        raise PermissionError
    if user == "broken":
        raise ValueError("broken")
    return [(i, "t", user, 1) for i in range(10, 0, -1) if max_id is None or i <= max_id][:count]


def fetch_ids(ids):
    return [(i, "t", "u", 1) for i in ids if i != 3]


def feed(user, max_id, since, count, path):
    """Rows 1, 2, ... up to the number in a file, newest first."""
    with open(path) as f:
        n = int(f.read())
    return [(i, "t", user, 1) for i in range(n, 0, -1) if max_id is None or i <= max_id][:count]


def test_paged_stream_goes_on_where_it_stopped(spark, tmp_path):
    spark.dataSource.register(readers.PagedSource)
    src = tmp_path / "n"
    for n in (5, 5, 9):
        src.write_text(str(n))
        stream = spark.readStream.format("paged").options(users="a", page_size=2, service=str(src), fetch="tests.test_sources_and_streams:feed").load()
        jobs.write_batches(stream, str(tmp_path / "o"), str(tmp_path / "c"), "append").awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "o")).collect()) == list(range(1, 10))


def test_services(spark, tmp_path):
    for source in (readers.PagedSource, readers.LookupSource):
        spark.dataSource.register(source)
    got = spark.read.format("paged").options(users="a,denied,b", page_size=3, since_id=4, fetch="tests.test_sources_and_streams:fetch_page").load()
    assert sorted((r.username, r.id) for r in got.collect()) == [(u, i) for u in "ab" for i in range(5, 11)]
    got = spark.read.format("lookup").options(ids="1,2,3,4,5", batch=2, fetch="tests.test_sources_and_streams:fetch_ids").load()
    assert sorted(r.id for r in got.collect()) == [1, 2, 4, 5]
    (tmp_path / "u").mkdir()
    for i, names in enumerate(("a\ndenied", "b\nbroken")):
        (tmp_path / "u" / f"{i}.txt").write_text(names)
    paged = {"users_path": str(tmp_path / "u"), "page_size": 3, "fetch": "tests.test_sources_and_streams:fetch_page"}
    got = spark.read.format("paged").options(**paged, since_id=4, on_error="skip").load()
    assert sorted((r.username, r.id) for r in got.collect()) == [(u, i) for u in "ab" for i in range(5, 11)]
    with pytest.raises(Exception, match="broken"):
        spark.read.format("paged").options(**paged).load().collect()
    (tmp_path / "i").mkdir()
    (tmp_path / "i" / "0.txt").write_text("1\n2\n3\n4")
    got = spark.read.format("lookup").options(ids_path=str(tmp_path / "i"), batch=2, fetch="tests.test_sources_and_streams:fetch_ids").load()
    assert sorted(r.id for r in got.collect()) == [1, 2, 4]
    seen = []
    with pytest.raises(readers.Busy):
        readers.retry(lambda: (seen.append(1), (_ for _ in ()).throw(readers.Busy(0.01))))
    assert len(seen) == 3
    calls = []
    with pytest.raises(ValueError):
        readers.retry(lambda: calls.append(1) or int("x"))
    assert len(calls) == 3


def test_sinks(spark, tmp_path):
    df = lambda rows: spark.createDataFrame(rows, "k bigint, v bigint")
    ids = lambda d: sorted(map(tuple, d.collect()))
    assert ids(sinks.insert_or_ignore(df([(1, 5), (2, 7), (2, 6)]), df([(1, 1)]), ["k"], F.col("v"))) == [(2, 6)]
    assert ids(sinks.add_counts(df([(1, 5)]), df([(1, 2), (3, 1)]), ["k"], "v")) == [(1, 7), (3, 1)]
    assert ids(sinks.replace_rows(df([(1, 5), (2, 2)]), df([(1, 2), (1, 3)]), ["k"], F.col("v"))) == [(1, 3), (2, 2)]
    path = str(tmp_path / "t")
    for rows in ([(1, 1)], [(2, 2)]):
        sinks.swap(df(rows), path)
    assert ids(spark.read.parquet(path)) == [(2, 2)] and sinks.exists(spark, path) and not sinks.exists(spark, path + ".new")
    os.rename(path, path + ".old")  # broken off between the renames
    assert ids(sinks.stored(spark, path)) == [(2, 2)]
    os.rename(path, path + ".old")
    df([(4, 4)]).write.parquet(path + ".new")
    assert ids(sinks.stored(spark, path)) == [(4, 4)]
    sinks.swap(df([(2, 2)]), path)
    sinks.append(df([(3, 3)]), path)
    assert spark.read.parquet(path).count() == 2
    days = str(tmp_path / "d")
    both = spark.createDataFrame([(1, 20140301), (2, 20140305), (3, 20140306)], "k bigint, dt bigint")
    sinks.overwrite_days(both, days)
    sinks.overwrite_days(spark.createDataFrame([(9, 20140305)], "k bigint, dt bigint"), days)
    assert sorted(r.k for r in spark.read.parquet(days).collect()) == [1, 3, 9]
    assert sinks.retain(spark, days, 20140306, 4) == [20140301]
    assert sinks.drop_days(spark, days, days=[20140306]) == [20140306]
    assert [r.k for r in spark.read.parquet(days).collect()] == [9]
    progress = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "id bigint, id_done int")
    assert ids(sinks.mark_done(progress, last_id=2)) == [(1, 1), (2, 1), (3, 0)]
    assert ids(sinks.mark_done(progress, ids=progress.where("id = 3"))) == [(1, 0), (2, 0), (3, 1)]
    sinks.write_triples(spark.createDataFrame([(1, 2, 1 / 3)], "a bigint, b bigint, d double"), str(tmp_path / "s"), "a", "b", "d")
    assert spark.read.text(str(tmp_path / "s")).first().value == "1;2;0.333333"
    sinks.write_json(df([(1, None)]), str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first().value == '{"k":1,"v":null}'
    t = spark.range(10).selectExpr("id", "id as created_at", "'x' as tw_text")
    sinks.write_chunks(t, str(tmp_path / "ch"), 4)
    assert len(list((tmp_path / "ch").glob("chunk=*"))) == 3
