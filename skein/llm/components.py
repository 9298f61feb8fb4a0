"""Connected components by alternating large-star and small-star joins.

Large-star links every larger neighbour of a vertex to the least vertex of its neighbourhood, small-star
links the vertex and its smaller neighbours to the least of these.  Repeated in turn, the links become stars
round the least vertex of each component.  Both are a grouped minimum joined back to the links, so that a
vertex with a third of all links is reduced before the shuffle and split by adaptive execution after it.
Every round is written to the shared folder and replaces the one before; its size is that of the links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.runtime import cut


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(vertex, component): every vertex that has a link to another, with the least vertex it is connected to.

    Links with a null end and links of a vertex to itself are ignored, repeated links count once.  No links,
    no rows.
    """
    edges = cut(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    state = None
    while True:
        arcs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = arcs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = arcs.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        edges = cut(small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct(), edges)
        # unchanged links are stars: compare count and an order-free digest of them
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("vertex")).distinct().select("vertex", F.col("vertex").alias("component"))
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(roots)
