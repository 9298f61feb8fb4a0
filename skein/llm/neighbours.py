"""Most similar vectors for every vector (problem 3): stable projections, kd-trees, chi-square stopping test.

Equal vectors are one class, which stands for them with its ``k + 1`` smallest ids; no more of them can be among
the k nearest of any.  Classes are normalised and projected to ``DIMS`` dimensions by Gaussian (2-stable)
directions.  The squared projected distance of two vectors is their squared distance times a chi-square variable.

Index: kd-trees, each over projections of its own, fitted on at most ``SAMPLE`` sampled rows; every class is
put into one leaf of each tree, so the rows moved grow with the number of trees only.  Trees are added until of the
sampled vectors and neighbours made for them at the distance ``radius`` at most ``MISS`` share no leaf in any.  A
node whose points all lie within the radius is not split, so that dense groups stay together.  If more trees than
leaves were needed, as for a wide radius, there is one leaf for all.  Leaves beyond ``block`` rows are met in parts.

Search: in its leaf a class takes its ``FIRST`` nearest projected neighbours and verifies them; the distance of the
(k+1)-th different id tightens the chi-square test, and it goes on with the next ones until the test rules all the
rest out.  Distances are rounded to 12 decimals, so that a pair has the same one wherever it meets; the nearest are
ranked by distance, then id.  At last the lists of a class are given to all its ids, without their own.

A vector is usable if it has ``WIDTH`` finite values, not all 0; others take no part.  Null ids are left out,
repeated rows count once, a word with several vectors has each of them and its least distance counts.  Empty input
gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.runtime import cut, ship, table

WIDTH, DIMS, SEED = 64, 24, 20140301
#: Sampled rows that trees are fitted on; pairs made to measure them; rows of a leaf aimed at and of a part of a larger one.
SAMPLE, PROBES, LEAF, BLOCK = 20_000, 4_000, 8192, 32768
#: Quantile of the chi-square distribution of 24 degrees of freedom at 0.995: a fixed value.
CHI2 = 45.559
#: Pairs at the radius that may share no leaf.
MISS = 0.001
#: Projected neighbours verified first; rows and columns of a tile, which fits into a core's cache; pairs gathered at a time.
FIRST, ROWS, COLUMNS, PAIRS = 64, 256, 2048, 50_000
#: Leaves beyond ``block`` that may be broadcast.
LARGE = 100_000

Splits = list[tuple[int, float]]
Edges = tuple[np.ndarray, np.ndarray, np.ndarray]


def directions(tree: int) -> np.ndarray:
    return np.random.default_rng(SEED + tree).standard_normal((WIDTH, DIMS)).astype(np.float32)


def _unit(raw: np.ndarray) -> np.ndarray:
    scaled = raw.astype(np.float64)
    scaled /= np.abs(scaled).max(1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def fit_tree(points: np.ndarray, leaves: int, apart: float = 0.0) -> Splits:
    """Splits (dimension, threshold) of a complete kd-tree in heap order: widest dimension, at its median.

    A node whose widest deviation is not above ``apart`` gets the threshold infinity: all of it stays left.
    """
    splits, groups = [], [points]
    while len(groups) < leaves:
        halves = []
        for g in groups:
            spread = g.var(0) if len(g) else np.zeros(points.shape[1])
            dim = int(np.argmax(spread))
            at = float(np.median(g[:, dim])) if spread[dim] > apart**2 else np.inf
            splits.append((dim, at))
            halves += [g[g[:, dim] <= at], g[g[:, dim] > at]]
        groups = halves
    return splits


def leaf_of(points: np.ndarray, splits: Splits) -> np.ndarray:
    node = np.zeros(len(points), np.int64)
    if splits:
        dims, at = np.array([s[0] for s in splits]), np.array([s[1] for s in splits])
        for _ in range((len(splits) + 1).bit_length() - 1):
            node = 2 * node + 1 + (points[np.arange(len(points)), dims[node]] > at[node])
    return node - len(splits)


def fit_forest(sample: np.ndarray, leaves: int, radius: float) -> list[Splits]:
    """Trees for unit vectors: as many as let at most ``MISS`` of the pairs made at ``radius`` share no leaf."""
    if leaves < 2 or radius >= 1 or not len(sample):
        return [[]]
    rng = np.random.default_rng(SEED)
    u = sample[rng.integers(0, len(sample), PROBES)]
    w = rng.standard_normal(u.shape)
    w -= (w * u).sum(1, keepdims=True) * u
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    v = (1 - radius) * u + np.sqrt(1 - (1 - radius) ** 2) * w
    trees, apart = [], np.ones(PROBES, bool)
    while apart.mean() > MISS:
        if len(trees) == leaves:
            return [[]]
        d = directions(len(trees))
        trees.append(fit_tree(sample @ d, leaves, np.sqrt(radius)))
        apart &= leaf_of(u @ d, trees[-1]) != leaf_of(v @ d, trees[-1])
    return trees


def _kept(row: np.ndarray, ids: np.ndarray, dist: np.ndarray, k: int) -> Edges:
    """Of edges (row, id, distance), each pair once with its least, the k first of each row by distance and id."""
    order = np.lexsort((dist, ids, row))
    row, ids, dist = row[order], ids[order], dist[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (ids[1:] != ids[:-1])
    row, ids, dist = row[first], ids[first], dist[first]
    order = np.lexsort((ids, dist, row))
    row, ids, dist = row[order], ids[order], dist[order]
    near = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[near], ids[near], dist[near]


def _tighten(most: np.ndarray, edges: Edges, k: int) -> None:
    """Sets the distance of the k-th edge of each row that has so many; edges are as ``_kept`` gives them."""
    row = edges[0]
    full = np.flatnonzero(np.append(row[1:] != row[:-1], True)[: len(row)] & (np.arange(len(row)) - np.searchsorted(row, row) == k - 1))
    most[row[full]] = edges[2][full]


def _nearest_of_tile(q: np.ndarray, data: np.ndarray, ruled_out: np.ndarray, ids: np.ndarray, sizes: np.ndarray, k: int, radius: float) -> Edges:
    """Edges of a whole tile, among them the k nearest different ids of each query; ``ids`` are those of the rows of data."""
    dist = np.round(1 - q @ data.T, 12)
    dist[ruled_out] = np.inf
    order = np.argsort(ids, kind="stable")
    names, group = np.unique(ids[order], return_index=True)
    dist = np.minimum.reduceat(dist[:, np.repeat(np.arange(len(data)), sizes)[order]], group, axis=1)
    last = min(k, len(names)) - 1
    row, col = np.nonzero(dist <= np.minimum(np.partition(dist, last, axis=1)[:, last], radius)[:, None])
    return row, names[col], dist[row, col]


def search(queries: np.ndarray, data: np.ndarray, ids: list[np.ndarray], k: int, radius: float, seen: np.ndarray | None = None) -> Edges:
    """(row of queries, id, cosine distance) of the k nearest different ids within ``radius``.

    Both are unit vectors; ``ids`` holds those of each row of ``data``; ``seen`` are the directions to project to.
    """
    d = directions(0) if seen is None else seen
    flat, starts = (np.concatenate(ids), np.cumsum([0, *map(len, ids)])) if len(ids) else (np.empty(0, np.int64), np.zeros(1, np.int64))
    data_p, query_p = data.astype(np.float32) @ d, queries.astype(np.float32) @ d
    # one product of these gives the squared distances
    one = np.hstack([-2 * query_p, (query_p**2).sum(1, keepdims=True), np.ones((len(query_p), 1), np.float32)]).astype(np.float32)
    two = np.hstack([data_p, np.ones((len(data_p), 1), np.float32), (data_p**2).sum(1, keepdims=True)]).astype(np.float32)
    wide, found = np.float32(CHI2 * 2 * radius + 1e-3), []
    for start in range(0, len(queries), ROWS):
        q, hits, dense = queries[start : start + ROWS], [], []
        for c in range(0, len(two), COLUMNS):
            near = one[start : start + ROWS] @ two[c : c + COLUMNS].T
            hit = np.flatnonzero(near <= wide)
            if len(hit) * 8 > near.size:  # so many to verify that one product is less work than gathering them
                dense.append(_nearest_of_tile(q, data[c : c + COLUMNS], near > wide, flat[starts[c] : starts[min(c + COLUMNS, len(data))]], np.diff(starts[c : c + COLUMNS + 1]), k, radius))
                hit = hit[:0]
            hits.append((hit // near.shape[1], hit % near.shape[1] + c, near.ravel()[hit]))
        if not hits:
            continue
        at, to, near = map(np.concatenate, zip(*hits))

        def verified(at: np.ndarray, to: np.ndarray) -> np.ndarray:
            dist = np.empty(len(at))
            for i in range(0, len(at), PAIRS):
                s = slice(i, i + PAIRS)
                dist[s] = 1 - np.einsum("ij,ij->i", q[at[s]], data[to[s]])
            return np.round(dist, 12)

        def edges(at: np.ndarray, to: np.ndarray, most: np.ndarray) -> Edges:
            dist = verified(at, to)
            ok = dist <= most[at]
            at, to, dist = at[ok], to[ok], dist[ok]
            size = starts[to + 1] - starts[to]
            slot = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            return np.repeat(at, size), flat[np.repeat(starts[to], size) + slot], np.repeat(dist, size)

        most, first = np.full(len(q), radius), None
        if dense:
            first = _kept(*map(np.concatenate, zip(*dense)), k)
            _tighten(most, first, k)
        count = np.bincount(at, minlength=len(q))
        if count.max(initial=0) > FIRST:
            order = np.lexsort((near, at))
            at, to, near = at[order], to[order], near[order]
            nearest_ = (np.arange(len(at)) - np.searchsorted(at, at) < FIRST) & (count[at] > FIRST)
            verified_ = edges(at[nearest_], to[nearest_], most)
            first = _kept(*(map(np.concatenate, zip(first, verified_)) if first else verified_), k)
            _tighten(most, first, k)
            left = ~nearest_ & (near <= (CHI2 * 2 * most[at] + 1e-3).astype(np.float32))
            at, to = at[left], to[left]
        rest = edges(at, to, most)
        row, i, dist = _kept(*(map(np.concatenate, zip(first, rest)) if first else rest), k)
        found.append((row + start, i, dist))
    return tuple(map(np.concatenate, zip(*found))) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def _vectors(raw: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(raw.to_pylist()), np.float32).reshape(-1, WIDTH)


def _classed(batches):
    """(id, cls, raw): cls is the MD5 of the vector's bytes."""
    for b in batches:
        if b.num_rows:
            raw = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, WIDTH) + np.float32(0)
            parts = [r.tobytes() for r in raw]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([hashlib.md5(p).digest() for p in parts], pa.binary()), pa.array(parts, pa.binary())], ["id", "cls", "raw"])


def _routed(forest: list[Splits]):
    def route(batches):
        for b in batches:
            if b.num_rows:
                unit = _unit(_vectors(b.column(2)))
                leaf = np.stack([leaf_of(unit @ directions(t), s) if s else np.zeros(len(unit), np.int64) for t, s in enumerate(forest)], 1).astype(np.int32)
                offsets = np.arange(len(unit) + 1, dtype=np.int32) * len(forest)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(leaf.ravel()))], ["cls", "ids", "raw", "asked", "leaf"])

    return route


def _met(k: int, radius: float):
    def meet(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        role = t["role"].to_numpy()
        unit = _unit(_vectors(t["raw"]))
        asked, there = np.flatnonzero(role & 2), np.flatnonzero(role & 1)
        lists, tree = t["ids"].to_pylist(), t["tree"][0].as_py()
        row, ids, dist = search(unit[asked], unit[there], [np.array(lists[i], np.int64) for i in there], k, radius, directions(tree))
        return pa.table({"cls": t["cls"].take(pa.array(asked[row])), "id2": ids, "dist": dist})

    return meet


def nearest(vectors: DataFrame, id_col: str, vec_col: str, k: int, radius: float = 2.0, queries: str | None = None, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """(id1, id2, dist, rank): the k nearest id2 of every id1 within a cosine distance of ``radius``.

    ``queries`` is a condition over ``id`` that selects the query rows; all rows are searched.
    """
    spark, v = vectors.sparkSession, F.col(vec_col)
    ship(spark)
    usable = vectors.select(F.col(id_col).cast("bigint").alias("id"), v.cast("array<float>").alias("vec")).where(
        F.col("id").isNotNull() & (F.size("vec") == WIDTH) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    )
    rows = cut(usable.mapInArrow(_classed, "id bigint, cls binary, raw binary").dropDuplicates(["id", "cls"]))
    asking = rows.where(queries) if queries else rows
    n = rows.count()
    sample = np.unique(np.array([np.frombuffer(r.raw, np.float32) for r in rows.orderBy(F.xxhash64("id", "cls")).limit(SAMPLE).collect()], np.float32).reshape(-1, WIDTH), axis=0)
    leaves = 1 << max(0, -(-n // leaf) - 1).bit_length()
    forest = fit_forest(_unit(sample) if len(sample) else sample, leaves, radius)
    by_id = Window.partitionBy("cls").orderBy("id")
    few = rows.withColumn("n", F.row_number().over(by_id)).where(F.col("n") <= k + 1)
    classes = few.groupBy("cls").agg(F.collect_list("id").alias("ids"), F.any_value("raw").alias("raw"))
    if queries:
        classes = classes.join(asking.select("cls", F.lit(True).alias("asked")).distinct(), "cls", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
    else:
        classes = classes.withColumn("asked", F.lit(True))
    routed = cut(classes.mapInArrow(_routed(forest), "cls binary, ids array<bigint>, raw binary, asked boolean, leaf array<int>"))
    spread = routed.select("cls", "ids", "raw", "asked", F.posexplode("leaf").alias("tree", "leaf"))
    parts = lambda c: F.greatest(F.lit(1), F.ceil(c / block)).cast("int")
    large = cut(
        routed.select("asked", F.posexplode("leaf").alias("tree", "leaf")).groupBy("tree", "leaf").agg(F.count("*").alias("n"), F.count_if("asked").alias("nq")).where(F.col("n") > block).select("tree", "leaf", parts(F.col("n")).alias("ts"), parts(F.col("nq")).alias("qs"))
    )
    size = large.count()
    if size:
        spread = spread.join(F.broadcast(large) if size <= LARGE else large, ["tree", "leaf"], "left")
        own, other = (F.pmod(F.xxhash64("cls", F.lit(s)), F.col(c)).cast("int") for s, c in ((0, "ts"), (1, "qs")))
        cell = lambda q, t, role: F.struct(q.cast("int").alias("q"), t.cast("int").alias("t"), F.lit(role).alias("role"))
        target = F.transform(F.sequence(F.lit(0), F.col("qs") - 1), lambda q: cell(q, own, 1))
        query = F.transform(F.sequence(F.lit(0), F.col("ts") - 1), lambda t: cell(other, t, 2))
        zero = F.lit(0)
        cells = F.when(F.col("ts").isNotNull(), F.concat(target, F.when(F.col("asked"), query).otherwise(F.slice(query, 1, 0)))).otherwise(F.array(F.when(F.col("asked"), cell(zero, zero, 3)).otherwise(cell(zero, zero, 1))))
        spread = spread.select("cls", "ids", "raw", "tree", "leaf", F.inline(cells))
    else:
        spread = spread.select("cls", "ids", "raw", "tree", "leaf", F.lit(0).alias("q"), F.lit(0).alias("t"), F.when(F.col("asked"), 3).otherwise(1).alias("role"))
    met = spread.groupBy("tree", "leaf", "q", "t").applyInArrow(_met(k + 1, radius), "cls binary, id2 bigint, dist double")
    of = lambda key: Window.partitionBy(key).orderBy("dist", "id2")
    lists = met.groupBy("cls", "id2").agg(F.min("dist").alias("dist")).withColumn("n", F.row_number().over(of("cls"))).where(F.col("n") <= k + 1).drop("n")
    found = asking.select(F.col("id").alias("id1"), "cls").join(lists, "cls").where("id1 <> id2")
    best = found.groupBy("id1", "id2").agg(F.min("dist").alias("dist"))
    return best.withColumn("rank", F.row_number().over(of("id1"))).where(F.col("rank") <= k)


def p3_found(spark: SparkSession, d: str, k: int = 5, radius: float = 0.15) -> DataFrame:
    near = nearest(table(spark, d, "noun_vectors"), "noun_md5", "vec", k, radius)
    return near.select(F.least("id1", "id2").alias("post1_md5"), F.greatest("id1", "id2").alias("post2_md5")).distinct()


def p3_nearest(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    """The k nearest words, however far, of every word whose id is divisible by 50, in the form of noun_similarity."""
    near = nearest(table(spark, d, "noun_vectors"), "noun_md5", "vec", k, queries="id % 50 = 0")
    return near.select(F.col("id1").alias("post1_md5"), F.col("id2").alias("post2_md5"), F.round("dist", 6).alias("sim"))


QUERIES = {"p3_found": p3_found, "p3_nearest": p3_nearest}
_WITH = """with v as (select distinct noun_md5, vec::double[] vec from noun_vectors where noun_md5 is not null and len(vec) = 64
    and len(list_filter(vec, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(vec, lambda x: x <> 0)) > 0),
  pairs as (select a.noun_md5 a, b.noun_md5 b, min(1 - list_cosine_similarity(a.vec, b.vec)) d from v a join v b on a.noun_md5 <> b.noun_md5 {} group by 1, 2),
  ranked as (select *, row_number() over (partition by a order by d, b) k from pairs)"""
SQL = {"p3_found": _WITH.format("") + " select distinct least(a, b) post1_md5, greatest(a, b) post2_md5 from ranked where k <= 5 and d <= 0.15"}
