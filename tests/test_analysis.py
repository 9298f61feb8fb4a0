from pyspark.sql import functions as F

from skein.functions.analysis import analyse, index_facts, pandas_analyzer, word_vectors
from skein.functions.scalars import digest


def test_default_facts(spark):
    df = spark.createDataFrame([(1, 5, "Солнце по Солнцу, #хэштег 30 апреля!"), (2, 5, ""), (3, 5, None)], "id bigint, created_at bigint, tw_text string")
    got = {r.id: r.facts for r in analyse(df).collect()}
    assert [(f.noun_lemma, f.prep, f.is_hash_tag, f.is_person_name, f.is_number) for f in got[1]] == [("солнце", None, False, False, False), ("солнцу", "по", False, True, False), ("#хэштег", None, True, False, False), ("30", None, False, False, True), ("апреля", None, False, False, False)]
    assert got[2] == [] and got[3] is None
    lists, words = index_facts(analyse(df))
    assert {r.id: r.sources for r in lists.collect()}[1][1] == "по солнцу"
    assert words.where(F.col("noun_md5") != digest("noun")).count() == 0 and words.count() == 6


def test_own_analyzer(spark):
    fact = dict.fromkeys(("noun", "noun_lemma", "prep", "prep_lemma", "noun_id", "prep_id", "lead_id"), "x") | dict.fromkeys(("is_hash_tag", "is_person_name", "is_number"), False)
    df = spark.createDataFrame([("a",), (None,)], "t string")
    assert [r.facts and len(r.facts) for r in analyse(df, "t", pandas_analyzer(lambda t: [fact])).collect()] == [1, None]


def test_word_vectors(spark):
    df = spark.createDataFrame([(["a", "b", "c"],)] * 50 + [(["d", "e", "f"],)] * 50 + [([],)], "lemmas array<string>")
    v = word_vectors(df, size=8, least=5).getVectors()
    assert {r.word for r in v.collect()} == set("abcdef")
