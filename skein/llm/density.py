"""Groups of similar records (problem 2): density peaks over a neighbour graph.

Density of a record is the number of its neighbours.  Every record points to its nearest denser neighbour (ties of
density: the smaller id is the denser), if that is nearer than ``apart``; records without one are the peaks, chosen
so by density and distance.  Following the pointers labels every record with its peak.

Where connected groups are asked for, neighbouring peaks are records of the next level, on which the same is done,
until no two peaks are neighbours.  Each level at least halves the records that still have neighbours, so levels grow
with the logarithm.

Nulls: links with a null end are left out; a null distance counts as the greatest.  Repeated links count
once, with their least distance; a self link is ignored.  Empty input gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.gram import gram_by
from skein.runtime import cut, drop, table

#: digest of the text "__total__", a fixed value of the data model.
TOTAL_KEY = 40693175


def _edges(links: DataFrame, a: str, b: str, dist: str) -> DataFrame:
    ends = links.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"), F.coalesce(F.col(dist), F.lit(float("inf"))).alias("dist"))
    return cut(ends.groupBy("u", "v").agg(F.min("dist").alias("dist")))


def _peaks(edges: DataFrame, apart: float = float("inf")) -> DataFrame:
    """(u, p, density): every record of the edges with its peak, as a table of ``cut``."""
    arcs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "dist"))
    density = arcs.groupBy("u").agg(F.count("*").alias("density"))
    seen = arcs.where(F.col("dist") <= apart).join(density, "u").join(density.select(F.col("u").alias("v"), F.col("density").alias("density_v")), "v")
    denser = seen.where((F.col("density_v") > F.col("density")) | ((F.col("density_v") == F.col("density")) & (F.col("v") < F.col("u"))))
    up = denser.groupBy("u").agg(F.min(F.struct("dist", "v")).alias("m")).select("u", F.col("m.v").alias("p"))
    pointers = cut(density.join(up, "u", "left").select("u", F.coalesce("p", "u").alias("p"), "density", F.lit(True).alias("moved")))
    while not pointers.where("moved").isEmpty():  # each jump halves the way that is left; two are made at a time
        jumped = pointers
        for _ in range(2):
            far = jumped.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            jumped = jumped.join(far, "p").select("u", F.col("pp").alias("p"), "density", (F.col("p") != F.col("pp")).alias("moved"))
        pointers = cut(jumped, pointers)
    return pointers


def density_peaks(links: DataFrame, a: str, b: str, dist: str, apart: float = float("inf")) -> DataFrame:
    """(record, peak, density): every record that has a link, with the density peak it belongs to."""
    edges = _edges(links, a, b, dist)
    found = _peaks(edges, apart)
    drop(edges)
    return found.select(F.col("u").alias("record"), F.col("p").alias("peak"), "density")


def density_groups(links: DataFrame, a: str, b: str, dist: str) -> DataFrame:
    """(record, group): every record that has a link, with the smallest id of the records it is connected to."""
    edges = _edges(links, a, b, dist)
    labels = edges.select(F.explode(F.array("u", "v")).alias("record")).distinct().select("record", F.col("record").alias("peak"))
    while not edges.isEmpty():
        stored = _peaks(edges)
        pointers = stored.select("u", "p")
        labels = cut(labels.join(pointers, labels["peak"] == pointers["u"], "left").select("record", F.coalesce("p", "peak").alias("peak")), labels)
        at = lambda end: pointers.select(F.col("u").alias(end), F.col("p").alias(f"{end}_peak"))
        edges = cut(
            edges.join(at("u"), "u")
            .join(at("v"), "v")
            .where("u_peak <> v_peak")
            .groupBy(F.least("u_peak", "v_peak").alias("u"), F.greatest("u_peak", "v_peak").alias("v"))
            .agg(F.min("dist").alias("dist")),
            edges,
            stored,
        )
    names = labels.groupBy("peak").agg(F.min("record").alias("group"))
    return labels.join(names, "peak").select("record", "group")


def topic_pairs(clusters: DataFrame, least_dates: int) -> DataFrame:
    """(item1, item2): words that the topics of at least so many different snapshots list together.

    A snapshot whose text is null or no complete JSON says nothing; neither do members whose id is no number
    or string of digits, nor topics without members.
    """
    topics = (
        clusters.where("cluster_date is not null")
        .select("cluster_date", F.try_parse_json("cluster").alias("j"))
        .select("cluster_date", F.explode(F.expr("try_variant_get(j, '$.clusters', 'array<variant>')")).alias("topic"))
        .select("cluster_date", F.expr("transform(try_variant_get(topic, '$.members', 'array<variant>'), m -> try_variant_get(m, '$.id', 'bigint'))").alias("ids"))
        .distinct()
    )
    # (item, date) records would lose the topic, so each date is a Gram matrix of its own, counted 0 or 1
    by_date = gram_by(topics, "cluster_date", "ids")
    return by_date.groupBy("item1", "item2").agg(F.count("*").alias("dates")).where(F.col("dates") >= least_dates)


def measured(spark: SparkSession, d: str) -> DataFrame:
    """(item1, item2, sim): every measured pair once, with its least distance."""
    sims = table(spark, d, "noun_similarity").where("sim is not null and not isnan(sim)").select(F.least("post1_md5", "post2_md5").alias("item1"), F.greatest("post1_md5", "post2_md5").alias("item2"), "sim").where("item1 <> item2")
    return sims.groupBy("item1", "item2").agg(F.min("sim").alias("sim"))


def links_of(spark: SparkSession, d: str, near: float = 0.45, trash: float = 0.6, least_dates: int = 3) -> DataFrame:
    """(item1, item2, sim) between words that are not trash; sim is null where only topics link them."""
    sims = measured(spark, d)
    to_total = sims.where(F.lit(TOTAL_KEY).isin(F.col("item1"), F.col("item2")) & (F.col("sim") < trash)).select(F.when(F.col("item1") == TOTAL_KEY, F.col("item2")).otherwise(F.col("item1")).alias("w"))
    total = spark.range(1).select(F.lit(TOTAL_KEY).cast("bigint").alias("w"))
    bad = to_total.unionByName(total).distinct()
    links = sims.where(F.col("sim") < near).unionByName(topic_pairs(table(spark, d, "clusters"), least_dates).select("item1", "item2", F.lit(None).cast("double").alias("sim")))
    for end in ("item1", "item2"):
        links = links.join(bad.select(F.col("w").alias(end)), end, "left_anti")
    return links.select("item1", "item2", "sim")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The members of every group of at least 3 connected words; cluster_key is the smallest of them."""
    groups = density_groups(links_of(spark, d), "item1", "item2", "sim")
    large = groups.groupBy("group").agg(F.count("*").alias("size")).where("size >= 3")
    return groups.join(large, "group").select(F.col("group").alias("cluster_key"), F.col("record").alias("noun_md5"))


def p2_groups(spark: SparkSession, d: str, typical: int = 3) -> DataFrame:
    """Each group with its size and its ``typical`` members closest to the others, with their density peaks.

    Closest: least mean of all measured distances to other members (a pair linked by topics and never measured
    counts as distance 1), then more of them, then smaller id.  One row a typical member.
    """
    links = cut(links_of(spark, d).groupBy("item1", "item2").agg(F.min("sim").alias("sim")))
    groups = cut(density_groups(links, "item1", "item2", "sim"))
    peaks = density_peaks(links, "item1", "item2", "sim").select("record", "peak")
    large = groups.groupBy("group").agg(F.count("*").alias("size")).where("size >= 3")
    known = measured(spark, d).unionByName(links).groupBy("item1", "item2").agg(F.min("sim").alias("sim"))
    of = lambda end, name: groups.select(F.col("record").alias(end), F.col("group").alias(name))
    inside = known.join(of("item1", "g"), "item1").join(of("item2", "h"), "item2").where("g = h")
    arcs = inside.select("item1", "sim").unionByName(inside.select(F.col("item2").alias("item1"), "sim"))
    near = arcs.groupBy(F.col("item1").alias("record")).agg((F.sum(F.coalesce("sim", F.lit(1.0)).cast("decimal(18,9)")).cast("double") / F.count("*")).alias("mean_dist"), F.count("*").alias("n_known"))
    best = Window.partitionBy("group").orderBy("mean_dist", F.desc("n_known"), "record")
    ranked = groups.join(near, "record").join(large, "group").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= typical)
    return ranked.join(peaks, "record").select(F.col("group").alias("cluster_key"), "size", "rank", F.col("record").alias("noun_md5"), (F.floor(F.col("mean_dist") * 1e6 + 0.5) / 1e6).alias("mean_dist"), "peak")


QUERIES = {"p2_found": p2_found, "p2_groups": p2_groups}

_WITH = """with recursive sims as (select least(post1_md5, post2_md5) a, greatest(post1_md5, post2_md5) b, min(sim) sim from noun_similarity
    where sim is not null and not isnan(sim) and post1_md5 <> post2_md5 group by 1, 2),
  bad as (select 40693175::bigint w union select case when a = 40693175 then b else a end from sims where (a = 40693175 or b = 40693175) and sim < 0.6),
  ok as (select cluster_date, cluster::json j from clusters where cluster_date is not null and json_valid(cluster)),
  topic as (select row_number() over () r, cluster_date, t from (select cluster_date, unnest(json_extract(j, '$.clusters[*]')) t from ok)),
  member as (select distinct r, cluster_date, try_cast(json_extract_string(m, '$.id') as bigint) w from (select r, cluster_date, unnest(json_extract(t, '$.members[*]')) m from topic)),
  mates as (select x.w a, y.w b from member x join member y on x.r = y.r and x.w < y.w group by 1, 2 having count(distinct x.cluster_date) >= 3),
  links as (select a, b, min(sim) sim from (select a, b, sim from sims where sim < 0.45 union all select a, b, null from mates)
    where a not in (select w from bad) and b not in (select w from bad) group by a, b),
  arcs as (select a, b, sim from links union select b, a, sim from links),
  walk as (select distinct a w, a g from arcs union select arcs.b, walk.g from walk join arcs on arcs.a = walk.w),
  grp as (select w, min(g) g from walk group by w),
  big as (select g, count(*) size from grp group by g having count(*) >= 3)"""
SQL = {
    "p2_found": f"{_WITH} select grp.g cluster_key, grp.w noun_md5 from grp join big using (g)",
    "p2_groups": f"""{_WITH}, known as (select a, b, min(sim) sim from (select * from sims union all select * from links) group by a, b),
  inside as (select known.a, known.b, sim from known join grp x on x.w = known.a join grp y on y.w = known.b where x.g = y.g), both_ as (select a, b, sim from inside union all select b, a, sim from inside),
  near as (select a w, sum(coalesce(sim, 1.0)::decimal(18,9))::double / count(*) mean_dist, count(*) n_known from both_ group by a),
  dn as (select a w, count(*) density from arcs group by a),
  up as (select a w, b p from (select arcs.a, arcs.b, row_number() over (partition by arcs.a order by coalesce(sim, 'inf'::double), arcs.b) r from arcs join dn x on x.w = arcs.a join dn y on y.w = arcs.b where y.density > x.density or (y.density = x.density and arcs.b < arcs.a)) where r = 1),
  pk as (select w, w peak from dn where w not in (select w from up) union all select up.w, pk.peak from up join pk on up.p = pk.w)
select cluster_key, size, rank, noun_md5, mean_dist, peak from (select grp.g cluster_key, size, row_number() over (partition by grp.g order by near.mean_dist, n_known desc, grp.w)::int rank,
  grp.w noun_md5, floor(near.mean_dist * 1e6 + 0.5) / 1e6 mean_dist from grp join big using (g) join near using (w)) join pk on pk.w = noun_md5 where rank <= 3""",
}
