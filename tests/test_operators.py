"""Order-dependent and iterative operators, against golden cases and plain models."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from skein.operators import align, api, crawl, evaluate, profiles, topics, trend
from skein.operators.align import Pair, best_path


def pairs(*rows):
    return [Pair(a, b, c, d, align.distance(n, k)) for a, b, c, d, n, k in rows]


def ends(path):
    return [x for p in path for x in (p.source1, p.source2)]


def test_golden_paths():
    assert ends(best_path(pairs((11, 1, 20, 2, 10, 6), (20, 2, 30, 3, 20, 4), (10, 1, 20, 2, 10, 5)), 2)) == [11, 20, 20, 30]
    assert ends(best_path(pairs((11, 1, 20, 2, 10, 3), (20, 2, 30, 3, 20, 4), (10, 1, 20, 2, 10, 5)), 2)) == [10, 20, 20, 30]
    assert ends(best_path(pairs((11, 1, 20, 2, 10, 6), (10, 1, 20, 2, 10, 5)), 2)) == [11, 20]
    assert ends(best_path(pairs((10, 1, 20, 2, 10, 5), (11, 1, 20, 2, 10, 6)), 2)) == [11, 20]
    assert ends(best_path(pairs((10, 1, 20, 2, 10, 5), (20, 2, 30, 3, 20, 4), (11, 1, 21, 2, 10, 6), (21, 2, 30, 3, 20, 4)), 2)) == [11, 21, 21, 30]
    assert int(1000 * align.distance(10, 5)) == 693 and int(1000 * align.distance(100, 5)) == 2995
    assert best_path([], 3) == [] and best_path(pairs((1, 1, 2, 2, 0, 0)), 2) == []


def test_no_word_twice():
    p = best_path(pairs((1, 1, 2, 2, 10, 9), (2, 2, 1, 1, 10, 9), (2, 2, 3, 3, 10, 1)), 3)
    assert ends(p) == [1, 2, 2, 3]


def test_aligned_topics(spark):
    t = spark.createDataFrame([(1, [1, 2, 3]), (7, [7]), (8, [8, 9])], "centroid bigint, members array<bigint>")
    b = spark.createDataFrame([(10, 1, 20, 2, 5), (20, 2, 30, 3, 4), (11, 1, 20, 2, 1), (70, 7, 10, 1, 2), (71, 7, 10, 1, 3)], "source1 bigint, word1 bigint, source2 bigint, word2 bigint, cnt bigint")
    w = spark.createDataFrame([(1, 10), (2, 20)], "word_md5 bigint, cnt bigint")
    got = {r.centroid: (r.members, r.sources) for r in align.align_topics(t, b, w).collect()}
    assert got == {1: ([1, 2, 3], [10, 20, 30]), 7: ([7], [71])}
    texts = spark.createDataFrame([(1, "a"), (2, "b"), (10, "A"), (20, "B"), (30, "C")], "noun_md5 bigint, noun string")
    d = {r.centroid: r for r in align.describe_aligned(align.align_topics(t, b, w), texts, texts, spark.createDataFrame([(2, 1.5)], "word bigint, trend double"), w).collect()}
    assert d[1].gen_title == "A B C" and [(m.id, m.stem_text, m.trend, m.post_cnt) for m in d[1].members] == [(1, "a", 0.0, 10), (2, "b", 1.5, 20), (3, None, 0.0, 0)]


def test_greedy_topics_take_and_drop(spark):
    total = 40693175
    sims = [(1, 2, 0.1), (1, 3, 0.2), (2, 4, 0.1), (5, total, 0.5), (5, 6, 0.1), (6, 8, 0.3), (7, total, 0.44), (9, 7, 0.1), (10, 11, 0.46)]
    df = spark.createDataFrame([(min(a, b), max(a, b), d) for a, b, d in sims], "a bigint, b bigint, sim double")
    t = spark.createDataFrame([(1, 9.0), (2, 8.0), (4, 7.0), (5, 6.0), (6, 5.0), (7, 4.0), (9, 3.0), (10, 2.0)], "word bigint, trend double")
    got = {r.centroid: r.members for r in topics.greedy_topics(df, t).collect()}
    # 2 is taken by 1; 5 and 7 are near the total row; 4 was not taken and takes 2 again; 10 has no neighbour
    assert got == {1: [1, 2, 3], 4: [4, 2], 6: [6, 5, 8], 9: [9, 7]}


def test_medoids_and_fuzzy_means_find_two_groups(spark):
    rnd = random.Random(1)
    rows = [(a, b, 0.1 + 0.05 * rnd.random() if (a < 10) == (b < 10) else 0.9) for a in range(20) for b in range(a + 1, 20)]
    df = spark.createDataFrame(rows, "a bigint, b bigint, sim double")
    got = [(r.k, r.word, r.medoid, r.ratio) for r in topics.medoids(df, (2, 5), seed=3).collect()]
    two = {w: m for k, w, m, _ in got if k == 2}
    assert len(got) == 40 and len(set(two.values())) == 2 and all((two[w] < 10) == (w < 10) for w in two)
    vectors = spark.createDataFrame([(i, (0 if i < 6 else 10) + j, 1.0 + rnd.random()) for i in range(12) for j in range(3)], "key bigint, dim bigint, weight double")
    u = {}
    for r in topics.fuzzy_means(vectors, 2).collect():
        u.setdefault(r.key, {})[r.cluster] = r.weight
    assert all(math.isclose(sum(x.values()), 1) for x in u.values())
    label = {k: max(x, key=x.get) for k, x in u.items()}
    assert len({label[i] for i in range(6)}) == 1 and label[0] != label[6]


def test_medoids_against_a_dense_matrix(spark):
    rnd, n, forced = random.Random(5), 60, 40693175
    names = [*range(n - 1), forced]
    sims = {(a, b): round(rnd.random() * 1.04, 6) for i, a in enumerate(names) for b in names[i + 1 :] if rnd.random() < 0.2}
    df = spark.createDataFrame([(a, b, x) for (a, b), x in sims.items()], "a bigint, b bigint, sim double")
    words = sorted({w for p in sims for w in p})
    d = np.ones((len(words), len(words)))
    for (a, b), x in sims.items():
        i, j = words.index(a), words.index(b)
        d[i, j] = d[j, i] = x
    np.fill_diagonal(d, 0)
    first = [r.word for r in spark.createDataFrame([(w,) for w in words if w != forced], "word bigint").orderBy(F.xxhash64(F.lit(0), "word")).collect()]
    trash, off = [3, 4], ~np.eye(len(words), dtype=bool)
    got = {}
    for r in topics.medoids(df, (4, 9, 500), trash=trash).collect():
        got.setdefault(r.k, {})[r.word] = (r.medoid, r.ratio)
    for k in (4, 9, 500):
        centres = [words.index(w) for w in [forced, *(w for w in first if w not in trash)][:k]]
        while True:
            label, new = d[:, centres].argmin(1), list(centres)
            for i in range(1, len(centres)):
                members = np.flatnonzero(label == i)
                able = [m for m in members if words[m] not in trash]
                if able:
                    new[i] = able[int(np.round(d[np.ix_(able, members)].sum(1), 9).argmin())]
            if new == centres:
                break
            centres = new
        same = label[:, None] == label[None]
        ratio = (d[same & off].mean() if (same & off).any() else 1) / d[~same].mean()
        assert {w: m for w, (m, _) in got[k].items()} == {w: words[centres[i]] for w, i in zip(words, label)}
        assert all(math.isclose(x, ratio, rel_tol=1e-6) for _, x in got[k].values())


def test_medoids_see_every_pair_and_the_grid_of_the_settings(spark, tmp_path):
    rows = [(a, b, 0.2 if a % 2 == b % 2 else 0.7) for a in range(90) for b in range(a + 1, 90)]  # 4005 pairs
    spark.createDataFrame([*rows, (900, 901, 0.5)], "post1_md5 bigint, post2_md5 bigint, sim double").write.parquet(str(tmp_path / "noun_similarity.parquet"))
    got = {(r.k, r.word) for r in topics.QUERIES["u4_medoids"](spark, str(tmp_path)).collect()}
    assert got == {(k, w) for k in (800, 900, 1000, 1100) for w in [*range(90), 900, 901]}


def test_cosine_distances_against_numpy(spark):
    rng = np.random.default_rng(2)
    m = rng.random((40, 15)) * (rng.random((40, 15)) < 0.3)
    cells = [(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m))] + [(99, 0, 0.0)]
    df = spark.createDataFrame(cells, "post_md5 bigint, reply_md5 bigint, weight double")
    norm = np.linalg.norm(m, axis=1)
    rows = [i for i in range(40) if norm[i]]
    want = {(i, j): 1 - m[i] @ m[j] / norm[i] / norm[j] for i in rows for j in rows if i > j} | {(99, j): 1.0 for j in rows}
    for block in (7, 256):
        got = {(r.post1_md5, r.post2_md5): r.sim for r in profiles.cosine_distances(df, block).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_distances_keep_the_profiles_of_the_settings(spark, tmp_path):
    n = 310
    counts = [(i, 6 + i) for i in range(n)]
    cells = [(i, 1000 + (i + j) % 40, 1 + (i * j) % 3) for i in range(n) for j in range(4)]
    spark.createDataFrame(counts, "post_md5 bigint, post_cnt bigint").write.parquet(str(tmp_path / "post_cnt.parquet"))
    spark.createDataFrame(cells, "post_md5 bigint, reply_md5 bigint, reply_cnt bigint").write.parquet(str(tmp_path / "post_reply_cnt.parquet"))
    for name in ("a11_distances", "u7_latent_cosines"):
        got = {frozenset((r.post1_md5, r.post2_md5)) for r in profiles.QUERIES[name](spark, str(tmp_path)).collect()}
        assert len(got) == n * (n - 1) // 2, name


def test_idf_cancels_in_distances(spark):
    p = spark.createDataFrame([(1, 1, 3, 10), (1, 2, 1, 10), (2, 1, 2, 5000), (2, 3, 4, 5000)], "post_md5 bigint, reply_md5 bigint, reply_cnt bigint, post_cnt bigint")
    plain = p.select("post_md5", "reply_md5", (1 + F.log("reply_cnt")).alias("weight"))
    a, b = (profiles.cosine_distances(x).first().sim for x in (profiles.weighted(p), plain))
    assert abs(a - b) < 1e-12


def test_slopes_equal_the_line_of_the_filled_series(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("a", 3, 5), ("a", 4, 10), ("a", 5, 2), ("b", 3, 4)], "w string, h int, c bigint")
    got = {r.w: (r.trend, r.intercept, r.delta) for r in trend.slopes(df, "w", "h", "c").collect()}
    assert np.allclose(got["a"], (13, -3, 52)) and np.allclose(got["b"][0], np.polyfit(range(1, 6), [0, 0, 100, 0, 0], 1)[0])
    assert trend.slopes(df.where("h = 1"), "w", "h", "c").first().trend is None


def test_ordinal_ranks(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("v"))
    got = {r.id: r.rank for r in trend.ordinal(df, "rank", F.desc("v"), F.asc("id")).collect()}
    assert [i for i, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(range(1000), key=lambda i: (-(i % 7), i)) and sorted(got.values()) == list(range(1000))


def test_robustness_stops_at_zero(spark):
    df = spark.createDataFrame([([7, 3, 1, 0, 5],), ([7],), ([0, 5],)], "n array<bigint>")
    got = [r.r for r in df.select(evaluate.robustness(F.col("n")).alias("r")).collect()]
    assert math.isclose(got[0], np.polyfit([1, 2, 3, 4], [-math.log2((n + 1) / 8) for n in (7, 3, 1, 0)], 1)[0]) and got[1] is None and got[2] is None


def test_marks(spark):
    sets = spark.createDataFrame([(1, "u", "e", '[{"topic_density": "4", "spam": "0"}, {"topic_density": "2", "spam": "1"}, {"topic_density": "5", "spam": "1", "x": "no"}]'), (1, "u", "d", "[]"), (2, "u", "e", None)], "update_time bigint, username string, exp_name string, marks string")
    a = {r.metric: r.average for r in evaluate.mark_averages(evaluate.marks_long(sets)).collect()}
    assert {k: round(v, 3) for k, v in a.items()} == {"topic_density": 3.667, "spam": 0.667, "true_positive": 0.333, "false_positive": 0.333, "true_negative": 0.333, "false_negative": 0.0}
    clean = {r.metric: r.average for r in evaluate.mark_averages(evaluate.marks_long(sets, without_spam=True)).collect()}
    assert clean["topic_density"] == 4 and clean["spam"] == 0
    assert evaluate.mark_totals(evaluate.mark_averages(evaluate.marks_long(sets))).first().total == 73.4


def test_gold(spark):
    gold = spark.createDataFrame([("cat", "dog", 5.0), ("cat", "cat", 9.0), ("cat", "none", 1.0)], "word1 string, word2 string, human_mean double")
    tr = spark.createDataFrame([("cat", "кот"), ("dog", "пёс")], "word string, translation string")
    g = evaluate.gold_pairs(gold, tr)
    assert g.count() == 1
    d = g.select("a", "b", F.lit(0.25).alias("sim"))
    assert evaluate.against_gold(g, d).first().deviation == 2.5
    assert evaluate.correlations(d.limit(0).withColumn("x", F.lit(1)).withColumn("y", F.lit(1)), "x", "y").first().n == 0


def test_fact_counts_of_nothing(spark):
    from skein.schemas import FACT

    r = evaluate.fact_counts(spark.createDataFrame([], f"di int, fact {FACT}")).first()
    assert r.total == 0 and r.mean is None and r.is_number is None


def test_snapshots_and_pages(spark):
    c = spark.createDataFrame([("20140301000000", None, "a"), ("20140302000000", 1, "b"), ("20140302000000", 1, "c"), ("20140303000000", None, None), (None, None, "x")], "cluster_date string, k bigint, cluster string")
    at = lambda **k: [tuple(r) for r in api.snapshot(c, **k).collect()]
    assert at() == [("20140303000000", None)] and at(skip=1) == [("20140302000000", "c")] and at(skip=9) == []
    assert at(date="20140302000000") == [("20140302000000", "c")] and at(before="20140302000000") == [("20140301000000", "a")] and at(date="2013") == []
    assert api.page_of("?limit=5&offset=x&skip=2") == api.Page(5, 0, 2) and api.page_of("") == api.Page()
    r = api.mark_set(spark, 1, "u", "e", "d", [{"spam": "1"}]).first()
    assert r.marks == '[{"spam":"1"}]'
    assert [x.cluster_date for x in api.relevant_at(c, "20140301000000").collect()] == ["20140301000000"]


def test_crawl_queue(spark):
    users = spark.createDataFrame([("a", 5, 1, 0, ""), ("b", 9, 1, 1, ""), ("c", 7, 0, 0, "20140309000000"), ("d", 5, 0, 0, "20140101000000")], "username string, reply_cnt bigint, since_id bigint, blocked_user int, done_time string")
    assert crawl.next_user(users, "20140309000100", 3600).first().username == "d"
    assert [r.username for r in crawl.known(users).collect()] == []
    done = {r.username: (r.done_time, r.since_id, r.blocked_user) for r in crawl.mark_done(users, "a", "20140310000000", 50, True).collect()}
    assert done["a"] == ("20140310000000", 50, 1) and done["c"] == ("20140309000000", 0, 0)
    assert crawl.window_start("20140310123456") == "20140303000000"
    t = spark.createDataFrame([("c", 20140308000000), ("c", 20140309000001), ("new", 1), (None, 1)], "in_reply_to_username string, created_at bigint")
    assert {r.username: r.reply_cnt for r in crawl.partner_counts(t, users).collect()} == {"c": 1, "new": 1}


def test_vector_ops(spark):
    v = lambda *rows: spark.createDataFrame(rows, "key bigint, dim bigint, weight double")
    a, b = v((1, 1, 1.0), (2, 1, 3.0)), v((1, 1, 1.0), (2, 2, 1.0))
    got = {r.key: (r.dims, r.cosine, r.half_l1, r.rank_like, r.missed) for r in profiles.compare_vectors(a, b).collect()}
    assert got == {1: (1, 1.0, 0.0, None, 0), 2: (2, 0.0, 2.0, -9.0, 2)}
    assert {(r.key, r.dim): r.weight for r in profiles.add_vectors(a, b, -1).collect()} == {(1, 1): 0.0, (2, 1): 3.0, (2, 2): -1.0}
