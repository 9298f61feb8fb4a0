"""Readable titles: the best word order of a topic by a path search over its bigrams."""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.config import SETTINGS
from skein.functions.scalars import members_key, pair_distance
from skein.operators.counters import QUERIES as COUNTERS
from skein.operators.counters import recent_sum
from skein.operators.topics import _topics as greedy
from skein.operators.topics import _trend, neighbours
from skein.plans import frames as fr
from skein.runtime import cut, ship


class Pair(NamedTuple):
    """An ordered bigram: surface form and word of both ends, and its distance."""

    source1: int
    word1: int
    source2: int
    word2: int
    distance: float


class _Step:
    """A pair at a depth of the search, with the best way to it so far."""

    __slots__ = ("pair", "depth", "distance", "before", "done")

    def __init__(self, pair: Pair, depth: int) -> None:
        self.pair, self.depth, self.distance, self.before, self.done = pair, depth, math.inf, None, False


def distance(word_cnt: float, pair_cnt: float) -> float:
    if not word_cnt:
        return math.nan
    return -math.log(pair_cnt / word_cnt) if pair_cnt else math.inf


def best_path(pairs: Sequence[Pair], depth: int) -> list[Pair]:
    """The longest chain of at most ``depth`` pairs, each beginning with the surface form and word that the one
    before ends with, no word repeated; of equal length the one of least total distance.

    Steps are settled in order of distance (ties: lower depth, then order of the pairs), each keeping one best
    way; a step that repeats a word of that way is not taken, so the search is greedy as label setting is.  A
    NaN or infinite distance is never taken.
    """
    layers = [[_Step(p, i) for p in pairs] for i in range(depth)]
    starts: dict[tuple[int, int], list[int]] = {}
    for i, p in enumerate(pairs):
        starts.setdefault((p.source1, p.word1), []).append(i)
    queue: list[tuple[float, int, int]] = []
    ends: dict[tuple[int, int], _Step] = {}

    def reach(at: tuple[int, int], length: float, before: _Step | None) -> None:
        step = layers[at[0]][at[1]]
        if not step.done and length < step.distance:
            step.distance, step.before = length, before
            heapq.heappush(queue, (length, *at))
            ends[at] = step

    if depth:
        for i, p in enumerate(pairs):
            reach((0, i), p.distance, None)
    while queue:
        length, layer, i = heapq.heappop(queue)
        step = layers[layer][i]
        if step.done or length > step.distance:
            continue
        step.done = True
        if layer + 1 == depth:
            continue
        used, back = set(), step
        while back is not None:
            used.add(back.pair.word1)
            back = back.before
        for j in starts.get((step.pair.source2, step.pair.word2), ()):
            p = pairs[j]
            if p.word1 in used or p.word2 in used:
                continue
            nxt = layers[layer + 1][j]
            old = nxt.distance
            reach((layer + 1, j), length + p.distance, step)
            if nxt.distance < old:
                ends.pop((layer, i), None)
    best: list[Pair] = []
    least = math.inf
    for at in sorted(ends):
        chain, back = [], ends[at]
        while back is not None:
            chain.append(back.pair)
            back = back.before
        if len(chain) > len(best) or (len(chain) == len(best) and ends[at].distance < least):
            best, least = chain[::-1], ends[at].distance
    return best


def align_topics(topics: DataFrame, bigrams: DataFrame, words: DataFrame) -> DataFrame:
    """(centroid, members, sources): each topic's words in the order of its best path, with surface forms.

    ``bigrams`` are (source1, word1, source2, word2, cnt), ``words`` (word_md5, cnt).  Bigrams are joined to the
    topics in Spark by both ends at once; a topic's few pairs are searched in one group.  Topics of a single word keep
    it with its most frequent surface form; topics without a path are dropped.
    """
    ship(topics.sparkSession)
    one = topics.select("centroid", F.size("members").alias("size"), F.explode("members").alias("word"))
    ordered = F.flatten(F.transform("members", lambda a: F.transform("members", lambda b: F.struct(a.alias("word1"), b.alias("word2")))))
    wanted = topics.select("centroid", F.size("members").alias("size"), F.explode(F.array_distinct(ordered)).alias("p")).select("centroid", "size", "p.*").where("word1 <> word2")
    inside = bigrams.join(wanted, ["word1", "word2"])
    total = words.select(F.col("word_md5").alias("word1"), F.col("cnt").alias("word_cnt"))
    inside = inside.join(total, "word1", "left").withColumn("distance", pair_distance("cnt", F.coalesce("word_cnt", F.lit(0))))

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["source1", "word1", "source2", "word2"])
        path = best_path([Pair(*r) for r in rows[["source1", "word1", "source2", "word2", "distance"]].itertuples(index=False)], int(rows["size"].iloc[0]))
        if not path:
            return pd.DataFrame({c: pd.Series([], dtype=t) for c, t in (("centroid", "int64"), ("members", object), ("sources", object))})
        return pd.DataFrame({"centroid": [rows["centroid"].iloc[0]], "members": [[path[0].word1, *(p.word2 for p in path)]], "sources": [[path[0].source1, *(p.source2 for p in path)]]})

    many = inside.where("size > 1").groupBy("centroid").applyInPandas(search, "centroid bigint, members array<bigint>, sources array<bigint>")
    forms = surface_forms(bigrams)
    single = one.where("size = 1").join(forms.withColumnRenamed("word", "w"), F.col("word") == F.col("w"), "left").select("centroid", F.array("word").alias("members"), F.array("source").alias("sources"))
    return many.unionByName(single)


def surface_forms(bigrams: DataFrame) -> DataFrame:
    """(word, source): the surface form that a word most often begins a bigram with; ties to the smaller key."""
    forms = bigrams.groupBy(F.col("word1").alias("word"), F.col("source1").alias("source")).agg(F.sum("cnt").alias("cnt"))
    return forms.groupBy("word").agg(F.min(F.struct((-F.col("cnt")).alias("c"), "source")).alias("m")).select("word", F.col("m.source").alias("source"))


def describe_aligned(aligned: DataFrame, words: DataFrame, sources: DataFrame, trend: DataFrame, counts: DataFrame) -> DataFrame:
    """(centroid, members, gen_title, members_md5): members in title order as structs of id, surface text, stem,
    trend and count; texts not known are null, trends and counts 0."""
    rows = aligned.select("centroid", "members", F.posexplode(F.arrays_zip("members", "sources")).alias("pos", "m")).select("centroid", "members", "pos", F.col("m.members").alias("word"), F.col("m.sources").alias("source"))
    for df, key, name, new in ((words, "word", "noun", "stem_text"), (sources, "source", "noun", "text")):
        rows = rows.join(df.select(F.col("noun_md5").alias(key), F.col(name).alias(new)), key, "left")
    rows = rows.join(trend.select("word", "trend"), "word", "left").join(counts.select(F.col("word_md5").alias("word"), F.col("cnt").alias("post_cnt")), "word", "left")
    member = F.struct("pos", F.struct(F.col("word").alias("id"), "text", "stem_text", F.coalesce("trend", F.lit(0.0)).alias("trend"), F.coalesce("post_cnt", F.lit(0)).alias("post_cnt")).alias("m"))
    grouped = rows.groupBy("centroid").agg(F.first("members").alias("ids"), F.transform(F.array_sort(F.collect_list(member)), lambda x: x["m"]).alias("members"))
    return grouped.select("centroid", "members", F.array_join(F.transform("members", lambda m: m["text"]), " ").alias("gen_title"), members_key("ids").alias("members_md5"))


def best_clusters(topics: DataFrame, trend: DataFrame, n: int = SETTINGS.clusters_aligned, best: int = SETTINGS.best_members) -> DataFrame:
    """(centroid, members, best_trend, strength): the n topics whose ``best`` members' trends sum to most.

    best_trend is the largest trend of a member.
    """
    t = topics.select("centroid", F.explode("members").alias("word")).join(trend, "word", "left").groupBy("centroid").agg(F.sort_array(F.collect_list(F.coalesce("trend", F.lit(0.0))), asc=False).alias("t"))
    sums = t.select("centroid", F.element_at("t", 1).alias("best_trend"), F.aggregate(F.slice("t", 1, best), F.lit(0.0), lambda a, x: a + x).alias("strength"))
    return topics.join(sums, "centroid").orderBy(F.desc("strength"), "centroid").limit(n)


def with_texts(bigrams: DataFrame, words: DataFrame) -> DataFrame:
    """Bigrams as pairs of structs with the texts of both words; pairs with an unknown word are left out."""
    text = lambda i: words.select(F.col("noun_md5").alias(f"word{i}"), F.col("noun").alias(f"text{i}"))
    end = lambda i: F.struct(F.col(f"source{i}").alias("source_md5"), F.struct(F.col(f"word{i}").alias("word_md5"), F.col(f"text{i}").alias("text")).alias("word"))
    return bigrams.join(text(1), "word1").join(text(2), "word2").select(end(1).alias("s1"), end(2).alias("s2"), F.col("cnt").alias("count"))


# ---- queries


def _bigrams(s: SparkSession, d: str) -> DataFrame:
    return recent_sum(COUNTERS["a4_bigrams"](s, d), ["source1", "word1", "source2", "word2"], fr.bucket(3))


def _aligned(s: SparkSession, d: str) -> DataFrame:
    words = recent_sum(fr.word_time(s, d), ["word_md5"], fr.bucket(3))
    b = cut(_bigrams(s, d))
    a = align_topics(greedy(s, d), b, words)
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return a.select("centroid", joined("members").alias("members"), joined("sources").alias("sources"), members_key("members").alias("members_md5"))


def _neighbour_topics(s: SparkSession, d: str) -> DataFrame:
    n = neighbours(fr.distances(s, d)).groupBy("word").agg(F.collect_list("neighbour").alias("n"))
    return n.select(F.col("word").alias("centroid"), F.concat(F.array("word"), "n").alias("members"))


QUERIES = {
    "x13_pair_distances": lambda s, d: _bigrams(s, d).join(_bigrams(s, d).groupBy("word1").agg(F.sum("cnt").alias("w")), "word1").select("source1", "word1", "source2", "word2", F.round(pair_distance("cnt", "w"), 6).alias("distance")),
    "a32_surface_forms": lambda s, d: surface_forms(_bigrams(s, d)),
    "u6_aligned_titles": _aligned,
    "t6_best_clusters": lambda s, d: best_clusters(_neighbour_topics(s, d), _trend(s, d)).select("centroid", F.size("members").alias("members_len"), F.round("best_trend", 6).alias("best_trend"), F.round("strength", 6).alias("strength")),
    "g12_bigrams_with_texts": lambda s, d: with_texts(_bigrams(s, d), fr.dictionary(s, d)).select(F.col("s1.source_md5").alias("source1"), F.col("s1.word.text").alias("text1"), F.col("s2.source_md5").alias("source2"), F.col("s2.word.text").alias("text2"), "count"),
    "f12_pairs_of_topics": lambda s, d: _bigrams(s, d).where("word1 <> word2").join(fr.distances(s, d).where("sim < 0.45").select(F.explode(F.array("a", "b")).alias("word1")).distinct(), "word1", "left_semi").select("source1", "word1", "source2", "word2", "cnt"),
}

from skein.operators.counters import _BG  # noqa: E402
from skein.operators.topics import _SYM  # noqa: E402
from skein.operators.trend import _TR  # noqa: E402

_B3 = f"{_BG}, b3 as (select source1, word1, source2, word2, sum(cnt)::bigint cnt from bg where tenminute > {fr.bucket(3)} group by all)"
SQL = {
    "x13_pair_distances": f"with {_B3}, w as (select word1, sum(cnt) w from b3 group by 1) select source1, word1, source2, word2, round(-ln(cnt / w), 6) + 0 distance from b3 join w using (word1)",
    "a32_surface_forms": f"with {_B3} select word1 word, source1 source from (select word1, source1, sum(cnt) c from b3 group by 1, 2) qualify row_number() over (partition by word1 order by c desc, source1) = 1",
    "t6_best_clusters": f"""with {_TR}, {_SYM}, nn as (select a word, b neighbour from sy where sim < 0.45 qualify row_number() over (partition by a order by sim, b) <= 8),
  m as (select word centroid, word w from (select distinct word from nn) union all select word, neighbour from nn), t as (select centroid, coalesce(round(trend, 6), 0) t, row_number() over (partition by centroid order by coalesce(round(trend, 6), 0) desc) r from m left join tr on word_md5 = w)
select centroid, count(*)::int members_len, max(t) best_trend, round(sum(case when r <= 3 then t end), 6) strength from t group by 1 order by sum(case when r <= 3 then t end) desc, 1 limit 30""",
    "g12_bigrams_with_texts": f"with {_B3}, {fr.DICT} select source1, x.noun text1, source2, y.noun text2, cnt as \"count\" from b3 join dict x on x.noun_md5 = word1 join dict y on y.noun_md5 = word2",
    "f12_pairs_of_topics": f"with {_B3}, {fr.DIST}, k as (select a w from dist where sim < 0.45 union select b from dist where sim < 0.45) select source1, word1, source2, word2, cnt from b3 where word1 <> word2 and word1 in (select w from k)",
}
