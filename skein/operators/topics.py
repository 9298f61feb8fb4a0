"""Topics: nearest neighbours, greedy selection, medoids and fuzzy means, and what is published of them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.config import SETTINGS
from skein.functions.scalars import digest_large, members_key, title
from skein.operators.counters import symmetric
from skein.operators.profiles import MOST
from skein.operators.trend import word_trends
from skein.plans import frames as fr
from skein.runtime import cut, ship, table


def neighbours(sims: DataFrame, k: int = SETTINGS.topic_neighbours, within: float = SETTINGS.topic_distance) -> DataFrame:
    """(word, neighbour, dist, rank): the k nearest of each word below ``within``; ties to the smaller key."""
    near = symmetric(sims.where(F.col("sim") < within), "a", "b", "sim")
    w = Window.partitionBy("a").orderBy("sim", "b")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("a").alias("word"), F.col("b").alias("neighbour"), F.col("sim").alias("dist"), "rank")


def with_diagonal(sims: DataFrame) -> DataFrame:
    """The symmetric distances with 0 of every word to itself."""
    both = symmetric(sims, "a", "b", "sim")
    return both.unionByName(both.select("a").distinct().select("a", F.col("a").alias("b"), F.lit(0.0).alias("sim")))


def greedy_topics(sims: DataFrame, trend: DataFrame, seeds: int = SETTINGS.trending_kept, k: int = SETTINGS.topic_neighbours, within: float = SETTINGS.topic_distance, trash: float = SETTINGS.trash_distance, total: int = SETTINGS.total_key, trash_kept: int = SETTINGS.trash_kept) -> DataFrame:
    """(centroid, members): words by falling trend take their neighbours as a topic.

    A word that was taken as a neighbour opens no topic; neither do the total row and its ``trash_kept`` nearest
    neighbours within ``trash``.  A topic that has the total row is dropped, but its members stay taken.  The choice depends on
    the order, so it is one task, over at most ``seeds`` words with at most k neighbours each; neighbours and
    trash are cut in Spark.  Without a total row nothing is trash.  Ties of trend go to the smaller key.
    """
    ship(sims.sparkSession)
    near = neighbours(sims, k, within)
    to_total = symmetric(sims, "a", "b", "sim").where((F.col("a") == total) & (F.col("sim") < trash)).orderBy("sim", "b").limit(trash_kept).select(F.col("b").alias("word"))
    words = trend.join(symmetric(sims, "a", "b", "sim").select(F.col("a").alias("word")).distinct(), "word", "left_semi").where("trend is not null")
    ranked = words.join(to_total, "word", "left_anti").where(F.col("word") != total).orderBy(F.desc("trend"), "word").limit(seeds)
    lists = near.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("rank", "neighbour"))).alias("n"))
    rows = ranked.join(lists, "word").select("word", "trend", F.transform("n", lambda x: x["neighbour"]).alias("n"), F.lit(1).alias("one"))

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        for word, near_ in rows.sort_values(["trend", "word"], ascending=[False, True])[["word", "n"]].itertuples(index=False):
            if word in taken:
                continue
            taken.update(near_)
            if total not in near_:
                out.append((word, [word, *near_]))
        return pd.DataFrame({"centroid": pd.Series([c for c, _ in out], dtype="int64"), "members": pd.Series([m for _, m in out], dtype=object)})

    return rows.groupBy("one").applyInPandas(choose, "centroid bigint, members array<bigint>")


def describe_topics(topics: DataFrame, texts: DataFrame, trend: DataFrame) -> DataFrame:
    """Topics with their members' texts and trends and the key of the member list, best trend of centroid first."""
    rows = topics.select("centroid", "members", F.posexplode("members").alias("pos", "word"))
    rows = rows.join(texts.select(F.col("noun_md5").alias("word"), F.col("noun").alias("text")), "word", "left").join(trend.select("word", "trend"), "word", "left")
    member = F.struct("pos", F.struct(F.col("word").alias("id"), "text", F.lit(0).alias("post_cnt"), F.round(F.coalesce("trend", F.lit(0.0)), 3).alias("trend")).alias("m"))
    grouped = rows.groupBy("centroid", "members").agg(F.transform(F.array_sort(F.collect_list(member)), lambda x: x["m"]).alias("m"))
    return grouped.select(
        "centroid",
        F.col("m").alias("members"),
        F.size("m").alias("members_len"),
        digest_large(F.array_join(F.transform("members", lambda x: x.cast("string")), ",")).alias("members_md5"),
        F.element_at("m", 1)["text"].alias("centroid_text"),
        title(F.transform("m", lambda x: x["text"])).alias("title"),
        F.element_at("m", 1)["trend"].alias("trend"),
    ).orderBy(F.desc("trend"), "centroid")


def without_marker(topics: DataFrame, members: Column, marker: int = SETTINGS.total_key) -> DataFrame:
    return topics.where(~F.exists(members, lambda m: m == marker))


def cohesion(sims: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, size, intra, extra): mean distance of members to each other and to all other words.

    A single member has the distance 1 to its own; pairs never measured count as 1.  Means come from sums over
    measured pairs and the numbers of pairs, so unmeasured pairs are never made.
    """
    s = symmetric(sims, "a", "b", "sim").join(labels.select(F.col("word").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("word").alias("b"), F.col("label").alias("lb")), "b")
    near = lambda c: F.sum(F.when(c, 1 - F.col("sim")).cast("decimal(18,9)")).cast("double")
    sums = s.groupBy(F.col("la").alias("label")).agg(
        near(F.col("la") == F.col("lb")).alias("si"), near(F.col("la") != F.col("lb")).alias("se")
    )
    sizes = labels.groupBy("label").agg(F.count("*").alias("size"))
    n = labels.agg(F.count("*").alias("n")).scalar()
    inner, outer = F.col("size") * (F.col("size") - 1), F.col("size") * (F.col("n") - F.col("size"))
    mean = lambda c, pairs: 1 - F.coalesce(F.try_divide(F.coalesce(c, F.lit(0.0)), pairs), F.lit(0.0))
    return sizes.withColumn("n", n).join(sums, "label", "left").select("label", "size", mean(F.col("si"), inner).alias("intra"), mean(F.col("se"), outer).alias("extra"))


def medoids(sims: DataFrame, grid: Sequence[int], rounds: int = SETTINGS.medoid_rounds, trash: Sequence[int] = (), forced: int | None = SETTINGS.total_key, seed: int = 0) -> DataFrame:
    """(k, word, medoid, ratio): k-medoids for each k of ``grid``; ratio is mean distance within
    clusters over that between them, the smaller the better.

    Words join the nearest medoid; a cluster's medoid becomes the member of least total distance that is no
    trash word.  Pairs never measured count as 1 and are never made: a word without a medoid nearer than that
    joins the first it was not measured with, and totals come from sums over measured pairs.  All k take a round
    together, as joins; the driver holds the medoids.  The first are those of smallest hash; ties to the smaller key.
    """
    both = cut(symmetric(sims, "a", "b", "sim"))
    words = cut(both.select(F.col("a").alias("word")).distinct())
    spark, able = sims.sparkSession, ~F.col("word").isin(*trash) if trash else F.lit(True)
    fixed = [r.word for r in words.where(F.col("word") == F.lit(forced)).collect()]
    free = words.where(able & ~F.col("word").isin(*fixed)) if fixed else words.where(able)
    first = fixed + [r.word for r in free.orderBy(F.xxhash64(F.lit(seed), "word"), "word").limit(max(grid)).collect()]
    centres = {k: first[: max(k, len(fixed))] for k in grid}

    def assigned(ks: Sequence[int], *instead_of: DataFrame) -> DataFrame:
        """(k, word, pos): the place of the word's medoid among those of k."""
        c = F.broadcast(spark.createDataFrame([(k, i, w) for k in ks for i, w in enumerate(centres[k])], "k int, pos int, word bigint"))
        near = both.join(c.withColumnRenamed("word", "b"), "b").select("k", F.col("a").alias("word"), F.col("sim").cast("double").alias("dist"), "pos")
        near = near.unionByName(c.select("k", "word", F.lit(0.0).alias("dist"), "pos"))
        best = near.groupBy("k", "word").agg(F.min(F.struct("dist", "pos")).alias("m"), F.collect_set("pos").alias("known"))
        every = words.select("word", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(len(centres[k])).alias("n")) for k in ks))).alias("g")).select("word", "g.*")
        unknown = F.when(F.col("known").isNull(), 0).otherwise(F.array_min(F.array_except(F.sequence(F.lit(0), F.size("known")), "known")))
        far = F.when(unknown < F.col("n"), F.struct(F.lit(1.0).alias("dist"), unknown.alias("pos")))
        return cut(every.join(best, ["k", "word"], "left").select("k", "word", F.least("m", far)["pos"].alias("pos")), *instead_of)

    def within(labels: DataFrame) -> DataFrame:
        """(k, pos, word, gain): what the measured pairs of a cluster lack to 1, by word."""
        pairs = both.join(labels.withColumnRenamed("word", "a"), "a").join(labels.withColumnRenamed("word", "b"), ["b", "k", "pos"])
        return pairs.groupBy("k", "pos", F.col("a").alias("word")).agg(F.sum((1 - F.col("sim")).cast("decimal(18,9)")).alias("gain"))

    moving, labels = list(centres), ()
    for _ in range(rounds):
        labels = (assigned(moving, *labels),)
        members = labels[0].where(F.col("pos") >= len(fixed))
        gains = members.where(able).join(within(members), ["k", "pos", "word"], "left").withColumn("loss", -F.coalesce("gain", F.lit(0).cast("decimal(18,9)")))
        new = {k: list(centres[k]) for k in moving}
        for r in gains.groupBy("k", "pos").agg(F.min(F.struct("loss", "word")).alias("m")).collect():
            new[r.k][r.pos] = r.m.word
        moving = [k for k in moving if new[k] != centres[k]]
        centres |= new
        if not moving:
            break
    done = assigned(list(centres), *labels)
    near, every = F.col("gain").cast("double"), both.agg(F.sum((1 - F.col("sim")).cast("decimal(18,9)")).cast("double").alias("all"))
    sizes = done.groupBy("k", "pos").agg(F.count("*").alias("size")).groupBy("k").agg(F.sum("size").alias("n"), F.sum(F.col("size") * F.col("size")).alias("square"))
    sums = within(done).groupBy("k").agg(F.sum("gain").alias("gain"))
    mean = lambda c, pairs: 1 - F.coalesce(F.try_divide(c, pairs), F.lit(0.0))
    intra = mean(F.coalesce(near, F.lit(0.0)), F.col("square") - F.col("n"))
    extra = mean(F.col("all") - F.coalesce(near, F.lit(0.0)), F.col("n") * F.col("n") - F.col("square"))
    ratios = sizes.join(sums, "k", "left").crossJoin(every).select("k", (intra / extra).alias("ratio"))
    names = F.broadcast(spark.createDataFrame([(k, i, w) for k in centres for i, w in enumerate(centres[k])], "k int, pos int, medoid bigint"))
    return done.join(names, ["k", "pos"]).join(F.broadcast(ratios), "k").select("k", "word", "medoid", "ratio")


def fuzzy_means(vectors: DataFrame, k: int, power: float = 2.0, rounds: int = 50, seed: int = 0) -> DataFrame:
    """(key, cluster, weight): fuzzy c-means over sparse vectors (key, dim, weight) by cosine distance.

    Centres are the members' means weighted by membership.  One task holds the matrix, so more than ``MOST`` rows
    are an error (the pipeline keeps 2000).
    """
    ship(vectors.sparkSession)
    n = vectors.select("key").distinct().count()
    if n > MOST:
        raise ValueError(f"{n} rows are more than the {MOST} that one task holds")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        keys, i = np.unique(rows["key"].to_numpy(), return_inverse=True)
        dims, j = np.unique(rows["dim"].to_numpy(), return_inverse=True)
        x = np.zeros((len(keys), len(dims)))
        x[i, j] = rows["weight"]
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        u = np.random.default_rng(seed).dirichlet(np.ones(k), len(keys))
        for _ in range(rounds):
            c = (u**power).T @ x
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
            inverse = np.maximum(1 - x @ c.T, 1e-12) ** (-1 / (power - 1))
            u = inverse / inverse.sum(1, keepdims=True)
        return pd.DataFrame({"key": np.repeat(keys, k), "cluster": np.tile(np.arange(k), len(keys)), "weight": u.ravel()})

    return vectors.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(run, "key bigint, cluster int, weight double")


# ---- queries


def _trend(s: SparkSession, d: str) -> DataFrame:
    return word_trends(s, d).select(F.col("word_md5").alias("word"), F.round("trend", 6).alias("trend"))


def _topics(s: SparkSession, d: str) -> DataFrame:
    return greedy_topics(fr.distances(s, d), _trend(s, d))


def _described(s: SparkSession, d: str) -> DataFrame:
    t = describe_topics(_topics(s, d), fr.dictionary(s, d), _trend(s, d))
    return t.select("centroid", "members_len", "members_md5", "centroid_text", "title", F.to_json("members").alias("members"), "trend")


def _labels(s: SparkSession, d: str) -> DataFrame:
    """Each word labelled by the smallest of itself and its nearest neighbour, as a plain clustering."""
    near = neighbours(fr.distances(s, d), 1, 2.0)
    return near.select("word", F.least("word", "neighbour").alias("label"))


def _snapshot_members(s: SparkSession, d: str) -> DataFrame:
    """(cluster_date, topic, id): the members of all published topics, repeated ones too, digits only."""
    j = table(s, d, "clusters").where("cluster_date is not null").select("cluster_date", F.try_parse_json("cluster").alias("j"))
    t = j.select("cluster_date", F.posexplode(F.expr("try_variant_get(j, '$.clusters', 'array<variant>')")).alias("topic", "t"))
    m = t.select("cluster_date", "topic", F.explode(F.expr("try_variant_get(t, '$.members', 'array<variant>')")).alias("m"))
    return m.select("cluster_date", "topic", F.expr("try_variant_get(m, '$.id', 'bigint')").alias("id"), F.expr("try_variant_get(m, '$.text', 'string')").alias("text")).where("id is not null")


def _without_total(s: SparkSession, d: str) -> DataFrame:
    t = neighbours(fr.distances(s, d)).groupBy("word").agg(F.array_sort(F.collect_list("neighbour")).alias("n"))
    return without_marker(t, F.col("n")).select("word", F.array_join(F.transform("n", lambda x: x.cast("string")), ",").alias("members"), members_key("n").alias("members_md5"))


QUERIES = {
    "w3_nearest_words": lambda s, d: neighbours(fr.distances(s, d)),
    "g1_symmetric_distances": lambda s, d: with_diagonal(fr.distances(s, d)),
    "d1_measured_words": lambda s, d: fr.distances(s, d).select(F.col("a").alias("word")).union(fr.distances(s, d).select("b")).distinct(),
    "u3_greedy_topics": lambda s, d: _topics(s, d).select("centroid", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members")),
    "g13_topics": _described,
    "f13_without_total": _without_total,
    "a28_cohesion": lambda s, d: cohesion(fr.distances(s, d), _labels(s, d)).select("label", "size", *[(F.floor(F.col(c) * 1e6 + 0.5) / 1e6).alias(c) for c in ("intra", "extra")]),
    "u4_medoids": lambda s, d: medoids(fr.distances(s, d), SETTINGS.medoid_grid).select("k", "word", "medoid", F.round("ratio", 6).alias("ratio")),
    "g10_published_words": lambda s, d: _snapshot_members(s, d).groupBy("id").agg(F.count("*").alias("n")),
    "g11_words_of_pairs": lambda s, d: fr.distances(s, d).where("sim < 0.45").select(F.explode(F.array("a", "b")).alias("word")).distinct(),
}

from skein.operators.trend import _TR  # noqa: E402

_SYM = f"{fr.DIST}, sy as (select a, b, sim from dist union all select b, a, sim from dist)"
_NN = f"{_SYM}, nn as (select a word, b neighbour, sim dist, row_number() over (partition by a order by sim, b)::int \"rank\" from sy where sim < 0.45 qualify row_number() over (partition by a order by sim, b) <= 8)"
_MEM = "mem as (select cluster_date, topic, try_cast(json_extract_string(m, '$.id') as bigint) id from (select cluster_date, topic, unnest(json_extract(t, '$.members[*]')) m from (select cluster_date, generate_subscripts(ts, 1) topic, unnest(ts) t from (select cluster_date, json_extract(cluster::json, '$.clusters[*]') ts from clusters where cluster_date is not null and json_valid(cluster)))))"
_GREEDY = f"""{_TR}, {_NN}, bad as (select 40693175::bigint w union select b from (select b from sy where a = 40693175 and sim < 0.6 order by sim, b limit 2000)),
  ln as (select word, list(neighbour order by dist, neighbour) n from nn group by 1),
  sd as (select word_md5 word, trend from (select word_md5, round(trend, 6) trend from tr) where word_md5 in (select a from sy) and word_md5 not in (select w from bad) and trend is not null order by trend desc, word_md5 limit 2000),
  rk as (select row_number() over (order by trend desc, word)::bigint i, word, n from sd join ln using (word)),
  walk as (select 0::bigint i, []::bigint[] taken, false picked union all
    select rk.i, case when list_contains(taken, rk.word) then taken else list_concat(taken, rk.n) end, not list_contains(taken, rk.word) from walk join rk on rk.i = walk.i + 1)"""
SQL = {
    "u3_greedy_topics": f"with recursive {_GREEDY} select word centroid, array_to_string(list_prepend(word, n), ',') members from walk join rk using (i) where picked and not list_contains(n, 40693175)",
    "w3_nearest_words": f"with {_NN} select * from nn",
    "g1_symmetric_distances": f"with {_SYM} select * from sy union all select distinct a, a, 0.0::double from sy",
    "d1_measured_words": f"with {fr.DIST} select a word from dist union select b from dist",
    "f13_without_total": f"""with {_NN}, l as (select word, list(neighbour order by neighbour) n from nn group by 1)
select word, array_to_string(n, ',') members, md5(array_to_string(n, ',')) members_md5 from l where not list_contains(n, 40693175)""",
    "a28_cohesion": f"""with {_SYM}, lb as (select a word, least(a, b) label from (select *, row_number() over (partition by a order by sim, b) r from sy where sim < 2) where r = 1),
  n as (select count(*) n from lb), sz as (select label, count(*) size from lb group by 1),
  sm as (select x.label, sum(case when x.label = y.label then 1 - sim end::decimal(18,9))::double si, sum(case when x.label <> y.label then 1 - sim end::decimal(18,9))::double se from sy join lb x on x.word = a join lb y on y.word = b group by 1)
select label, size, floor((1 - coalesce(coalesce(si, 0) / nullif(size * (size - 1), 0), 0)) * 1e6 + 0.5) / 1e6 intra, floor((1 - coalesce(coalesce(se, 0) / nullif(size * (n - size), 0), 0)) * 1e6 + 0.5) / 1e6 extra from sz cross join n left join sm using (label)""",
    "g10_published_words": f"with {_MEM} select id, count(*) n from mem where id is not null group by 1",
    "g11_words_of_pairs": f"with {fr.DIST} select a word from dist where sim < 0.45 union select b from dist where sim < 0.45",
}
