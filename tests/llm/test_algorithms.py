"""Pair counts, groups, neighbours, term counts and distinctiveness, against brute force."""

import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from skein.llm.components import components
from skein.llm.density import density_groups, density_peaks, topic_pairs
from skein.llm.gram import block_rows, gram, gram_by, with_expected
from skein.llm.neighbours import directions, fit_forest, fit_tree, leaf_of, nearest
from skein.llm.poisson import fit_mixture, histograms, occurrences, two_poisson
from skein.llm.trie import BurstTrie, term_counts


def test_gram_counts_pairs_once_a_record_in_blocks(spark):
    rnd = random.Random(1)
    records = [[rnd.randrange(40) for _ in range(rnd.randrange(30))] for _ in range(60)] + [[], [7], [None, 3, 3, 5], list(range(40))]
    df = spark.createDataFrame([(r, "x") for r in records], "items array<int>, item1 string")
    want = Counter(p for r in records for p in combinations(sorted({x for x in r if x is not None}), 2))
    for width in (4, 256):
        got = {(r.item1, r.item2): r.n for r in gram(df, "items", block=width).collect()}
        assert got == want
    assert gram(df.limit(0), "items").collect() == []


def test_gram_weights_sides_and_expectation(spark):
    df = spark.createDataFrame([([1], [2], 3), ([1], [2], 4), ([2], [1], 5), ([1], [3], None), ([1], [3], 0), ([4], [4], 2)], "l array<int>, r array<int>, w int")
    got = {(r.item1, r.item2): (r.n, r.m1, r.m2, r.total) for r in with_expected(gram(df, "l", "r", "w"), symmetric=False).collect()}
    assert got == {(1, 2): (7, 7, 7, 14), (2, 1): (5, 5, 5, 14), (4, 4): (2, 2, 2, 14)}
    by = spark.createDataFrame([("a", [1, 2]), ("a", [2, 1]), ("b", [1, 2, 3])], "k string, items array<int>")
    assert sorted(map(tuple, gram_by(by, "k", "items").collect())) == [("a", 1, 2, 2), ("b", 1, 2, 1), ("b", 1, 3, 1), ("b", 2, 3, 1)]


def test_a_long_record_is_spread_over_tasks_and_a_repeated_one_is_multiplied_once(spark):
    long = spark.createDataFrame([(list(range(3000)),)], "items array<int>")
    rows = block_rows(long, "items", None, None, 256)
    tasks = Counter(r.p for r in rows.select(F.spark_partition_id().alias("p")).collect())
    assert len(tasks) >= 4 and sum(tasks.values()) == 12 * 13 // 2
    got = gram(long, "items").agg(F.count("*").alias("n"), F.min("n").alias("lo"), F.max("n").alias("hi")).first()
    assert tuple(got) == (3000 * 2999 // 2, 1, 1)
    same = spark.range(5000).select(F.array(F.lit("b"), F.lit("a")).alias("items"), F.lit(2).alias("w"))
    assert [tuple(r) for r in block_rows(same, "items", None, "w", 256).collect()] == [("", ["a", "b"], ["a", "b"], 10_000)]
    assert [tuple(r) for r in gram(same, "items", weight="w").collect()] == [("a", "b", 10_000)]


def _groups(links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {x: find(x) for x in root}


def test_groups_and_components_equal_union_find(spark):
    rnd = random.Random(2)
    links = [(rnd.randrange(150), rnd.randrange(150)) for _ in range(110)] + [(i, i + 1) for i in range(200, 240)] + [(300, x) for x in range(301, 360)] + [(5, None), (None, 6), (400, 400)]
    df = spark.createDataFrame([(a, b, rnd.choice([0.1, 0.2, None])) for a, b in links], "a bigint, b bigint, d double")
    want = _groups(links)
    assert {r.record: r.group for r in density_groups(df, "a", "b", "d").collect()} == want
    assert {r.vertex: r.component for r in components(df, "a", "b").collect()} == want
    assert density_groups(df.limit(0), "a", "b", "d").collect() == [] and components(df.limit(0), "a", "b").collect() == []


def test_density_peaks_are_chosen_by_density_and_distance(spark):
    # two stars round 1 and 10, joined by 5; 5 is nearer to 10
    links = [(1, 2, 0.1), (1, 3, 0.1), (1, 4, 0.2), (1, 5, 0.4), (10, 11, 0.1), (10, 12, 0.1), (10, 13, 0.3), (10, 5, 0.2), (2, 3, None), (7, 8, 0.3)]
    df = spark.createDataFrame(links, "a bigint, b bigint, d double")
    got = {r.record: (r.peak, r.density) for r in density_peaks(df, "a", "b", "d").collect()}
    assert got == {1: (1, 4), 2: (1, 2), 3: (1, 2), 4: (1, 1), 5: (10, 2), 10: (10, 4), 11: (10, 1), 12: (10, 1), 13: (10, 1), 7: (7, 1), 8: (7, 1)}
    near = {r.record: r.peak for r in density_peaks(df, "a", "b", "d", apart=0.25).collect()}
    assert near[13] == 13 and near[8] == 8 and near[4] == 1
    assert density_peaks(df.limit(0), "a", "b", "d").collect() == []


def test_topics_need_whole_json_and_enough_dates(spark):
    topic = '{"clusters": [{"members": [{"id": 1}, {"id": "2"}, {"id": "x"}, {"id": 2}]}, {"members": []}, {}]}'
    rows = [(f"2014030{i}000000", topic) for i in (1, 2, 3)] + [("20140304000000", topic[:-3]), ("20140305000000", None), ("20140306000000", ""), (None, topic), ("20140301000000", topic)]
    df = spark.createDataFrame(rows, "cluster_date string, cluster string")
    assert [(r.item1, r.item2, r.dates) for r in topic_pairs(df, 3).collect()] == [(1, 2, 3)]
    assert topic_pairs(df, 4).collect() == []


def _vectors(n=900, seed=3):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, 64))
    v[n // 2 :] = v[: n - n // 2] + rng.standard_normal((n - n // 2, 64)) * rng.uniform(0.05, 0.6, (n - n // 2, 1))
    return v.astype(np.float32)


def test_neighbours_against_brute_force(spark):
    v = _vectors()
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(0, v[0].tolist()), (2001, None), (2002, []), (2003, [0.0] * 64), (2004, [float("nan")] * 64), (2005, [1.0] * 63), (None, v[1].tolist())]
    df = spark.createDataFrame(rows, "id bigint, vec array<float>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    dist = 1 - unit @ unit.T
    np.fill_diagonal(dist, 9)
    near = {(i, int(j)) for i in range(len(v)) for j in np.argsort(dist[i])[:5] if dist[i, j] <= 0.15}
    got = {(r.id1, r.id2) for r in nearest(df, "id", "vec", 5, 0.15).collect()}
    assert got <= near and len(got) >= 0.97 * len(near)
    wide = {(i, int(j)) for i in range(0, len(v), 50) for j in np.argsort(dist[i])[:10]}
    found = {(r.id1, r.id2) for r in nearest(df, "id", "vec", 10, queries="id % 50 = 0").collect()}
    assert len(found) == len(wide) and len(found & wide) >= 0.9 * len(wide)
    assert nearest(df.limit(0), "id", "vec", 5, 0.15).collect() == []


def _of_words(ids, v, k, radius):
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    dist, near = 1 - np.einsum("ik,jk->ij", unit, unit), {}
    for a in set(ids.tolist()):
        least = {}
        for i in np.flatnonzero(ids == a):
            for j in np.flatnonzero((ids != a) & (dist[i] <= radius)):
                least[int(ids[j])] = min(dist[i, j], least.get(int(ids[j]), 9))
        near[a] = [b for _, b in sorted((d, b) for b, d in least.items())][:k]
    return near


def test_neighbours_of_words_with_several_vectors(spark):
    rng = np.random.default_rng(8)
    v = rng.standard_normal(64) + rng.standard_normal((400, 64)) * 0.2
    ids = np.concatenate([np.full(200, 50), rng.integers(0, 80, 200)])  # word 50 has half of the rows
    v[390:] = v[380]  # equal vectors of different words
    v = v.astype(np.float32)
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v)], "id bigint, vec array<float>")
    for k, radius, queries in ((5, 0.15, None), (10, 2.0, "id % 10 = 0")):
        want = {(a, b): r for a, near in _of_words(ids, v, k, radius).items() if queries is None or a % 10 == 0 for r, b in enumerate(near, 1)}
        got = {(r.id1, r.id2): r.rank for r in nearest(df, "id", "vec", k, radius, queries).collect()}
        assert len(got) == len(want) and len(got.items() & want.items()) >= 0.97 * len(want)


def test_equal_distances_go_to_the_smaller_id(spark):
    rows = [(1000 - i, [1.0] * 64) for i in range(700)] + [(5000, [1.0] * 63 + [1.5])]
    df = spark.createDataFrame(rows, "id bigint, vec array<float>")
    least = list(range(301, 307))
    for queries in (None, "id % 50 = 0"):
        got = {}
        for r in nearest(df, "id", "vec", 5, 0.15, queries).orderBy("id1", "rank").collect():
            got.setdefault(r.id1, []).append(r.id2)
        assert len(got) == (701 if queries is None else 15) and all(near == [x for x in least if x != a][:5] for a, near in got.items())


def test_neighbours_of_many_equal_vectors_stay_bounded(spark):
    df = spark.createDataFrame([(i, [1.0 + (i > 600)] * 32 + [1.0] * 32) for i in range(700)], "id bigint, vec array<float>")
    per = Counter(r.id1 for r in nearest(df, "id", "vec", 5, 0.15).collect())
    assert len(per) == 700 and set(per.values()) == {5}


def test_neighbours_do_not_depend_on_the_order_of_rows(spark):
    v = _vectors(1200, 4)
    v[:200] = v[0]  # a sixth are equal
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    runs = []
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "id bigint, vec array<float>").repartition(3 + seed)
        runs.append([{tuple(r) for r in nearest(df, "id", "vec", 5, 0.15, leaf=leaf, block=block).collect()} for leaf, block in ((4096, 4096), (100, 50))])
    assert runs[0] == runs[1]
    whole, cut_up = runs[0]
    assert len(cut_up & whole) >= 0.99 * len(whole) and {(a, b) for a, b, *_ in whole if a < 200} == {(a, b) for a in range(200) for b in [x for x in range(6) if x != a][:5]}


def test_trees_are_added_until_neighbours_share_a_leaf():
    u = np.random.default_rng(5).standard_normal((4000, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    few, more = fit_forest(u, 16, 0.15), fit_forest(u, 64, 0.15)
    assert 1 < len(few) < 16 and len(few) < len(more) < 64  # the rows moved grow with the trees, not with the leaves
    assert fit_forest(u, 16, 2.0) == [[]] and fit_forest(u, 1, 0.15) == [[]] and fit_forest(u[:0], 8, 0.15) == [[]]
    close = u[:1] + 1e-3 * u  # all within the radius of one another: never split
    assert set(leaf_of(close @ directions(0), fit_tree(close @ directions(0), 8, 0.15**0.5)).tolist()) == {0}


def test_tree_halves_its_sample():
    p = np.random.default_rng(1).standard_normal((1024, 16))
    assert Counter(leaf_of(p, fit_tree(p, 8)).tolist()) == {i: 128 for i in range(8)}


def test_burst_trie_counts_and_orders():
    rnd = random.Random(4)
    keys = [bytes(rnd.choices(b"ab", k=rnd.randrange(9))) for _ in range(3000)] + [b"", b"a" * 200, b"a" * 201]
    t = BurstTrie(4)
    for k in keys:
        t.add(k, 1, 2)
    assert [(k, c[0], c[1]) for k, c in t.items()] == [(k, n, 2 * n) for k, n in sorted(Counter(keys).items())]


def test_term_counts(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice([None, *range(30)]), rnd.choice([None, *range(-3, 9)])) for _ in range(2000)]
    want = {t: (sum(x == t for _, x in rows), len({i for i, x in rows if x == t and i is not None})) for t in range(-3, 9)}
    df = spark.createDataFrame(rows, "id bigint, w bigint").withColumn("term", F.lit("clash"))
    for limit in (3, 500_000):
        got = {r.term: (r.occurrences, r.records) for r in term_counts(df, "id", "w", 4, limit).collect()}
        assert got.pop(None)[1] == 30 and got == want
    words = spark.createDataFrame([(1, ""), (1, ""), (2, "ы" * 5000), (2, None)], "id bigint, w string")
    assert {r.term: (r.occurrences, r.records) for r in term_counts(words, "id", "w").collect()} == {None: (0, 2), "": (2, 1), "ы" * 5000: (1, 1)}
    assert term_counts(words.limit(0), "id", "w").where("term is not null").collect() == []


def test_mixture_recovers_its_parameters():
    rng = np.random.default_rng(6)
    n, share, low, high = 200_000, 0.2, 0.5, 7.0
    x = np.where(rng.random(n) < share, rng.poisson(high, n), rng.poisson(low, n))
    counts = np.bincount(x)[None].astype(float)
    s, a, b = fit_mixture(np.arange(counts.shape[1]).astype(float), counts[0], np.array([counts.shape[1]]), 300)
    assert abs(s[0] - share) < 0.01 and abs(a[0] - low) < 0.03 and abs(b[0] - high) < 0.1


def test_mixture_is_fitted_to_the_end():
    rng = np.random.default_rng(7)
    x = np.where(rng.random((8, 2000)) < 0.3, rng.poisson(1.6, (8, 2000)), rng.poisson(0.7, (8, 2000)))
    values = np.tile(np.arange(16.0), (8, 1))
    counts = np.array([np.bincount(r, minlength=16) for r in x], float)
    share, low, high = (p[:, None] for p in fit_mixture(values.ravel(), counts.ravel(), np.full(8, 16)))
    elite = 1 / (1 + (1 - share) / share * np.exp(high - low) * (low / high) ** values)
    e = (elite * counts).sum(1)
    again = e / counts.sum(1), ((1 - elite) * counts * values).sum(1) / (counts.sum(1) - e), (elite * counts * values).sum(1) / e
    assert all(np.allclose(a, p[:, 0], rtol=1e-7) for a, p in zip(again, (share, low, high)))
    alone = [fit_mixture(values[i], counts[i], np.array([16])) for i in range(8)]
    assert all(np.allclose(p[:, 0], [a[k][0] for a in alone], rtol=1e-6) for k, p in enumerate((share, low, high)))


def test_two_poisson_scores_by_count(spark):
    rows = [(p, 1, 1) for p in range(40)] + [(p, 1, 30) for p in range(40, 50)] + [(p, 2, 2) for p in range(60)] + [(1, 1, 1), (1, None, 3), (None, 1, 3), (2, 3, None), (2, 3, 0)]
    df = occurrences(spark.createDataFrame(rows, "p bigint, t bigint, c bigint"), "p", "t", "c")
    hist = histograms(df)
    assert {r.term: (r.d, r.total) for r in hist.collect()} == {1: (50, 60), 2: (60, 60)}
    got = {(r.record, r.term): r.elite for r in two_poisson(df, hist).collect()}
    assert len(got) == 110 and got[45, 1] > 0.99 and got[3, 1] < 0.01 and all(0 <= x <= 1 and not math.isnan(x) for x in got.values())
    assert two_poisson(df.limit(0), histograms(df.limit(0))).collect() == []
