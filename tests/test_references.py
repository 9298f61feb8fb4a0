from skein.operators.references import orphans


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_match_modes_by_null_mask(spark):
    refs = spark.createDataFrame([(1, "a", 1), (2, "a", 9), (3, None, 1), (4, None, 9), (5, "a", None), (6, "z", None), (7, None, None)], "i int, x string, y int")
    targets = spark.createDataFrame([("a", 1), ("b", 2), (None, 9)], "k string, l int")
    ids = lambda mode: [r.i for r in orphans(refs, targets, ["x", "y"], ["k", "l"], mode).orderBy("i").collect()]
    assert ids("simple") == [2]
    assert ids("partial") == [2, 6]
    assert ids("full") == [2, 3, 4, 5, 6]


def test_repeats_clashing_columns_and_empty(spark):
    refs = spark.createDataFrame([(1, 5), (1, 5), (2, 6), (3, None)], "id bigint, ref bigint")
    targets = spark.createDataFrame([(6, 1), (6, 2), (None, 3)], "id bigint, ref bigint")
    assert rows(orphans(refs, targets, ["ref"], ["id"])) == [(1, 5), (1, 5)]
    assert len(rows(orphans(refs, targets.limit(0), ["ref"], ["id"]))) == 3
    assert rows(orphans(refs.limit(0), targets, ["ref"], ["id"])) == []
