"""Scalar expressions against plain restatements and golden values."""

import hashlib
import math

from pyspark.sql import functions as F

from skein.functions import scalars as sc
from skein.schemas import empty


def values(spark, rows, schema, *exprs):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*exprs).collect()]


def fold(s):
    h = hashlib.md5(s.encode()).hexdigest()
    x = 0
    for i in range(4):
        x ^= int(h[8 * i : 8 * i + 8], 16)
    return x


def test_digests(spark):
    texts = ["", "__total__", "0", "слово", "a" * 1000, "😀"]
    got = values(spark, [(t,) for t in [*texts, None]], "t string", sc.digest("t"), sc.digest_large("t"))
    assert got == [(fold(t), str(int(hashlib.md5(t.encode()).hexdigest(), 16))) for t in texts] + [(None, None)]
    assert fold("__total__") == 40693175 and fold("0") == 3313040968


def test_windowed_pairs_by_length(spark):
    got = values(spark, [(list(map(str, range(n))),) for n in range(11)] + [(None,)], "w array<string>", F.size(sc.windowed_pairs("w")), F.size(sc.windowed_pairs("w", full=True)))
    assert [g[0] for g in got[:-1]] == [0, 0, 0, 0, 1, 3, 6, 10, 14, 18, 22]
    assert [g[1] for g in got[:-1]] == [sum(max(0, n - k + 1) for k in range(2, 6)) for n in range(11)]
    assert got[-1][0] in (None, -1, 0)


def test_adjacent_pairs(spark):
    w = spark.createDataFrame([(["a", "b", "c", "d"], ["A", "B", "C", "D"])], "w array<string>, s array<string>")
    got = w.select(F.explode(sc.windowed_pairs(sc.zipped("w", "s").alias("z"), 2)).alias("p")).collect()
    assert [(r.p.w1.word, r.p.w1.source, r.p.w2.word, r.p.w2.source) for r in got] == [("a", "A", "b", "B")]


def test_times(spark):
    got = values(spark, [(20140309123456,), (None,)], "c bigint", sc.tenminute("c"), sc.hour("c"), sc.day("c"), sc.to_digits(sc.to_time("c")))
    assert got == [(20140309123, 2014030912, 20140309, 20140309123456), (None,) * 4]
    got = values(spark, [("Wed Aug 27 13:08:45 +0000 2008",), ("Wed Aug 27 13:08:45 +0200 2008",), ("x",), (None,)], "c string", sc.to_digits(sc.feed_time("c")))
    assert got == [(20080827130845,), (20080827110845,), (None,), (None,)]
    a, b = sc.time_bounds("x", "y")
    assert values(spark, [("201403091", "20140308")], "x string, y string", a, b) == [(20140308000, 20140309100)]
    assert values(spark, [("2014-03-02",)], "d string", sc.recent_days(F.col("d").cast("date"), 3)) == [([20140302, 20140301, 20140228],)]
    assert values(spark, [("2014-03-09 12:00:00",)], "d string", sc.utc(F.col("d").cast("timestamp"), "Europe/Moscow").cast("string"), sc.local(F.col("d").cast("timestamp"), "Europe/Moscow").cast("string")) == [("2014-03-09 08:00:00", "2014-03-09 16:00:00")]


def test_texts(spark):
    rows = [("abc\nдом",), ("xдy",), ("ё",), ("",), (None,)]
    assert [r[0] for r in values(spark, rows, "t string", sc.has_cyrillic("t"))] == [False, True, False, False, None]
    assert [r[0] for r in values(spark, rows, "t string", sc.has_cyrillic("t", 3, whole=True))] == [True, False, False, False, None]
    got = values(spark, [("@a b @c d\n'e' x@y",), (None,)], "t string", sc.clean_text("t"))
    assert got == [(" b d \\'e\\' x@y",), (None,)]
    assert values(spark, [("  a  b\tc ",), ("",)], "t string", sc.tokens("t")) == [(["a", "b", "c"],), ([],)]
    assert values(spark, [("n", "p"), ("n", None)], "n string, p string", sc.surface("n", "p")) == [("p n",), ("n",)]
    assert values(spark, [("«a\"b'»",)], "t string", sc.unquote("t")) == [("ab",)]
    assert values(spark, [("see http://x.y/z now",)], "t string", sc.with_links("t")) == [('see <a href="http://x.y/z">http://x.y/z</a> now',)]


def test_weights(spark):
    got = values(spark, [(3, 100), (3, 5_000_000)], "c bigint, d bigint", sc.tf_idf("c", "d"), sc.word_score("d"))
    assert math.isclose(got[0][0], (1 + math.log(3)) * math.log(4e6 / 100)) and got[1][0] == 0 and got[1][1] < 0
    got = [r[0] for r in values(spark, [(5, 10), (5, 100), (0, 5), (3, 0), (20, 10)], "p int, w int", sc.pair_distance("p", "w"))]
    assert int(1000 * got[0]) == 693 and int(1000 * got[1]) == 2995 and got[2] == math.inf and math.isnan(got[3]) and got[4] < 0
    assert values(spark, [(0.3, "20170101000000"), (0.3, "20140101000000"), (20.0, "20140101000000")], "t double, d string", sc.trend_class("t", "d"), sc.trend_text("t")) == [("mild", "+0.30"), ("flat", "+0.30"), ("strong", "+20.00")]


def test_keys_of_members(spark):
    got = values(spark, [([1, 22],)], "ids array<bigint>", sc.members_key("ids"))
    assert got == [(hashlib.md5(b"1,22").hexdigest(),)]
    assert values(spark, [(["a", "b", "a"],)], "t array<string>", sc.title("t")) == [("a b",)]
    assert empty(spark, "bigram_day").columns == ["tenminute", "word1", "word2", "source1", "source2", "cnt"]
    assert empty(spark, "word_mates_20140309", like="word_mates").columns[:2] == ["word1", "word2"]
