"""Word profiles: the sparse matrix of posts by replies, its weights, and distances between its rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.config import SETTINGS
from skein.functions.scalars import tf_idf
from skein.plans import frames as fr
from skein.runtime import ship

#: Rows of a block in the distance computation; rows of a matrix that one task may hold.
BLOCK, MOST = 256, 10_000


def top_replies(m: DataFrame, n: int = SETTINGS.reply_dimensions) -> DataFrame:
    """(reply_md5, posts): the replies that most posts have; ties to the smaller key."""
    return m.groupBy("reply_md5").agg(F.count("*").alias("posts")).orderBy(F.desc("posts"), "reply_md5").limit(n)


def profiles(m: DataFrame, counts: DataFrame, replies: DataFrame, least: int = SETTINGS.post_min_freq, blocked: Sequence[int] = (), kept: int | None = None) -> DataFrame:
    """(post_md5, reply_md5, reply_cnt, post_cnt) of the posts counted more than ``least`` times, on the given
    dimensions; with ``kept``, of the most frequent posts only."""
    posts = counts.where(F.col("post_cnt") > least)
    if blocked:
        posts, m = posts.where(~F.col("post_md5").isin(*blocked)), m.where(~F.col("reply_md5").isin(*blocked))
    if kept is not None:
        posts = posts.join(m.select("post_md5").distinct(), "post_md5", "left_semi").orderBy(F.desc("post_cnt"), "post_md5").limit(kept)
    return m.join(posts, "post_md5").join(replies.select("reply_md5"), "reply_md5", "left_semi").select("post_md5", "reply_md5", "reply_cnt", "post_cnt")


def weighted(p: DataFrame, n: float = SETTINGS.corpus_size) -> DataFrame:
    """(post_md5, reply_md5, weight): (1 + ln reply_cnt) times the idf of the row's word."""
    return p.select("post_md5", "reply_md5", tf_idf("reply_cnt", "post_cnt", n).alias("weight"))


def with_total(p: DataFrame, trash: DataFrame, dropped: DataFrame | None = None, key: int = SETTINGS.total_key) -> DataFrame:
    """Adds the row ``key``: the sum of the rows of trash words.  Rows of ``dropped`` words go, though they stay
    dimensions of others."""
    total = p.join(trash.select("post_md5").distinct(), "post_md5", "left_semi").groupBy("reply_md5").agg(F.sum("weight").alias("weight")).select(F.lit(key).cast("bigint").alias("post_md5"), "reply_md5", "weight")
    rows = p if dropped is None else p.join(dropped.select("post_md5").distinct(), "post_md5", "left_anti")
    return rows.unionByName(total)


def row_totals(p: DataFrame) -> DataFrame:
    """(post_md5, total, post_cnt), the most frequent first."""
    return p.groupBy("post_md5").agg(F.sum("reply_cnt").cast("bigint").alias("total"), F.max("post_cnt").alias("post_cnt")).orderBy(F.desc("post_cnt"), "post_md5")


def classic_tf_idf(p: DataFrame, docs: float = SETTINGS.corpus_size) -> DataFrame:
    """(post_md5, reply_md5, weight): share of the row times ln(docs / sum of the column)."""
    row, column = Window.partitionBy("post_md5"), Window.partitionBy("reply_md5")
    return p.select("post_md5", "reply_md5", (F.col("reply_cnt") / F.sum("reply_cnt").over(row) * F.log(F.lit(docs) / F.sum("reply_cnt").over(column))).alias("weight"))


def entropy_weights(p: DataFrame) -> DataFrame:
    """(post_md5, reply_md5, weight): log2(cnt + 1) over the row's entropy.

    The entropy is the sum of -q ln q over the row's cells, q being the share of all rows that have the cell's
    value in its column.  A row without entropy keeps null weights.
    """
    rows = p.select("post_md5").distinct().agg(F.count("*").alias("n")).scalar()
    logged = p.select("post_md5", "reply_md5", F.log2(F.col("reply_cnt") + 1).alias("v"), "reply_cnt")
    same = p.groupBy("reply_md5", "reply_cnt").agg(F.count("*").alias("c"))
    q = F.col("c") / rows
    cells = logged.join(same, ["reply_md5", "reply_cnt"]).select("post_md5", "reply_md5", "v", (-q * F.log(q)).alias("e"))
    total = cells.groupBy("post_md5").agg(F.sum("e").alias("entropy"))
    return cells.join(total, "post_md5").select("post_md5", "reply_md5", F.try_divide("v", "entropy").alias("weight"))


# ---- vectors as (key, dim, weight) rows


def add_vectors(a: DataFrame, b: DataFrame, factor: float = 1.0) -> DataFrame:
    """a + factor * b, cell by cell; with factor -1 the difference."""
    return a.unionByName(b.withColumn("weight", F.col("weight") * factor)).groupBy("key", "dim").agg(F.sum("weight").alias("weight"))


def log_vectors(v: DataFrame, cnt: str | None = None) -> DataFrame:
    """log2(weight + 1), divided by log2 of the row's count if given."""
    w = F.log2(F.col("weight") + 1)
    return v.withColumn("weight", F.try_divide(w, F.log2(F.col(cnt))) if cnt else w)


def compare_vectors(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, dims, cosine, half_l1, rank_like, missed) of the rows that either of two dumps of vectors has.

    half_l1 is half the sum of absolute differences, rank_like the Spearman formula over the weights as they
    are (null for one dimension), missed the cells that only one dump has.
    """
    both = a.select("key", "dim", F.col("weight").alias("x")).join(b.select("key", "dim", F.col("weight").alias("y")), ["key", "dim"], "full")
    x, y = F.coalesce("x", F.lit(0.0)), F.coalesce("y", F.lit(0.0))
    return both.groupBy("key").agg(
        F.count("*").alias("dims"),
        F.coalesce(F.try_divide(F.sum(x * y), F.sqrt(F.sum(x * x) * F.sum(y * y))), F.lit(0.0)).alias("cosine"),
        (F.sum(F.abs(x - y)) / 2).alias("half_l1"),
        (1 - F.try_divide(6 * F.sum((x - y) * (x - y)), F.count("*").cast("double") * (F.pow(F.count("*"), 2) - 1))).alias("rank_like"),
        F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("missed"),
    )


def _blocked(t: pa.Table) -> pa.Table:
    post, reply, weight, side = (t[c].to_numpy() for c in ("post_md5", "reply_md5", "weight", "side"))
    dims, col = np.unique(reply, return_inverse=True)

    def dense(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, row = np.unique(post[which], return_inverse=True)
        m = np.zeros((len(keys), len(dims)))
        m[row, col[which]] = weight[which]
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        return keys, np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)

    (a, x), (b, y) = dense(side == 0), dense(side == 1)
    d = 1 - x @ y.T
    i, j = np.nonzero(a[:, None] > b[None]) if t["same"][0].as_py() else np.indices(d.shape).reshape(2, -1)
    return pa.table({"post1_md5": np.maximum(a[i], b[j]), "post2_md5": np.minimum(a[i], b[j]), "sim": np.where(np.abs(d[i, j]) < 1e-15, 0.0, d[i, j])})


def cosine_distances(p: DataFrame, block: int = BLOCK) -> DataFrame:
    """(post1_md5, post2_md5, sim): 1 - cosine of every two rows, post1_md5 the larger; 1 for rows without norm.

    The result has a row for every pair, as its readers expect, so the caller has cut the rows down (the
    pipeline keeps 2000).  Rows are put into blocks of about ``block``; a task multiplies two blocks, whose
    cells it holds, and never more.
    """
    ship(p.sparkSession)
    n = p.select("post_md5").distinct().count()
    k = max(1, -(-n // block))
    b = F.pmod(F.xxhash64("post_md5"), F.lit(k)).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda o: F.struct(F.least("b", o).alias("lo"), F.greatest("b", o).alias("hi")))
    spread = p.select("post_md5", "reply_md5", F.col("weight").cast("double").alias("weight"), b.alias("b")).withColumn("pair", F.explode(pairs))
    same = F.col("pair.lo") == F.col("pair.hi")
    sides = F.when(same, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.when(F.col("b") == F.col("pair.lo"), 0).otherwise(1)))
    cells = spread.select("post_md5", "reply_md5", "weight", same.alias("same"), (F.col("pair.lo") * k + F.col("pair.hi")).alias("pair"), F.explode(sides).alias("side"))
    return cells.groupBy("pair").applyInArrow(_blocked, "post1_md5 bigint, post2_md5 bigint, sim double")


def latent_cosines(p: DataFrame, k: int = 50) -> DataFrame:
    """(post1_md5, post2_md5, sim): cosine similarity of rows in the space of the k greatest singular values.

    One task takes the eigenvectors of the rows' products.  It holds the matrix, so more than ``MOST`` rows are an
    error (the pipeline keeps 2000).
    """
    ship(p.sparkSession)
    n = p.select("post_md5").distinct().count()
    if n > MOST:
        raise ValueError(f"{n} rows are more than the {MOST} that one task holds")

    def reduce(t: pa.Table) -> pa.Table:
        keys, row = np.unique(t["post_md5"].to_numpy(), return_inverse=True)
        dims, col = np.unique(t["reply_md5"].to_numpy(), return_inverse=True)
        m = np.zeros((len(keys), len(dims)))
        m[row, col] = t["weight"].to_numpy()
        square, u = np.linalg.eigh(m @ m.T)  # rising, so the greatest are the last
        x = u[:, -k:] * np.sqrt(np.maximum(square[-k:], 0))
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
        i, j = np.triu_indices(len(keys), 1)
        return pa.table({"post1_md5": keys[i], "post2_md5": keys[j], "sim": (x @ x.T)[i, j]})

    return p.select("post_md5", "reply_md5", F.col("weight").cast("double").alias("weight"), F.lit(1).alias("all")).groupBy("all").applyInArrow(reduce, "post1_md5 bigint, post2_md5 bigint, sim double")


# ---- queries


def _profiles(s: SparkSession, d: str, kept: int | None = None, dims: int = SETTINGS.reply_dimensions) -> DataFrame:
    m = fr.matrix(s, d)
    return profiles(m, fr.counts(s, d), top_replies(m, dims), kept=kept)


def _trash(s: SparkSession, d: str, n: int = 10) -> DataFrame:
    """The words most posts have as replies stand in for the list of trash words."""
    return top_replies(fr.matrix(s, d), n).select(F.col("reply_md5").alias("post_md5"))


def _rounded(df: DataFrame, c: str) -> DataFrame:
    return df.withColumn(c, F.round(c, 6))


def _compared(s: SparkSession, d: str) -> DataFrame:
    v = lambda df: df.select(F.col("post_md5").alias("key"), F.col("reply_md5").alias("dim"), F.col("reply_cnt").cast("double").alias("weight"))
    p = _profiles(s, d)
    a, b = v(p), v(p.where("reply_cnt >= 2")).withColumn("weight", F.col("weight") + 1)
    return compare_vectors(a, b).select("key", "dims", F.round("cosine", 6).alias("cosine"), F.round("half_l1", 6).alias("half_l1"), F.round("rank_like", 6).alias("rank_like"), "missed")


def _vector_sum(s: SparkSession, d: str) -> DataFrame:
    p = _profiles(s, d).select(F.col("post_md5").alias("key"), F.col("reply_md5").alias("dim"), F.col("reply_cnt").cast("double").alias("weight"))
    return _rounded(log_vectors(add_vectors(p, p.where("weight > 1"), -0.5)), "weight")


QUERIES = {
    "a12_top_replies": lambda s, d: top_replies(fr.matrix(s, d)),
    "a12_first_fifty": lambda s, d: top_replies(fr.matrix(s, d), 50),
    "x9_first_fifty": lambda s, d: _rounded(weighted(_profiles(s, d, 50)), "weight"),
    "j4_profiles": _profiles,
    "a13_row_totals": lambda s, d: row_totals(_profiles(s, d)),
    "x9_weights": lambda s, d: _rounded(weighted(_profiles(s, d, SETTINGS.profiles_kept)), "weight"),
    "a14_total_row": lambda s, d: _rounded(with_total(weighted(_profiles(s, d)), _trash(s, d), _trash(s, d, 2)), "weight"),
    "x11_classic_tf_idf": lambda s, d: _rounded(classic_tf_idf(_profiles(s, d, SETTINGS.profiles_kept)), "weight"),
    "x12_entropy_weights": lambda s, d: _rounded(entropy_weights(_profiles(s, d)), "weight"),
    "x20_vector_sums": _vector_sum,
    "j12_compared_profiles": _compared,
    "a11_distances": lambda s, d: _rounded(cosine_distances(weighted(_profiles(s, d, SETTINGS.profiles_kept))), "sim"),
    "u7_latent_cosines": lambda s, d: _rounded(latent_cosines(weighted(_profiles(s, d, SETTINGS.profiles_kept))), "sim"),
    "f7_blocked_posts": lambda s, d: profiles(fr.matrix(s, d), fr.counts(s, d), top_replies(fr.matrix(s, d)), blocked=(SETTINGS.total_key, 797835322)).groupBy("post_md5").agg(F.count("*").alias("n")),
    "a29_profile_sizes": lambda s, d: _profiles(s, d).groupBy("post_md5").agg(F.count("*").cast("double").alias("n")).agg(F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev("n"), 6).alias("sd"), F.round(F.skewness("n"), 4).alias("skew"), F.median("n").alias("median"), F.min("n").alias("least"), F.max("n").alias("most"), F.sum("n").alias("total")),
}

_P = f"{fr.MX}, {fr.PC}, tr as (select reply_md5, count(*) posts from mx group by 1 order by 2 desc, 1 limit 8000), pr as (select post_md5, reply_md5, reply_cnt, post_cnt from mx join pc using (post_md5) where post_cnt > 5 and reply_md5 in (select reply_md5 from tr))"


def _kept(n: int) -> str:
    return f"{_P}, kp as (select post_md5 from pc where post_cnt > 5 and post_md5 in (select post_md5 from mx) order by post_cnt desc, post_md5 limit {n}), pk as (select * from pr where post_md5 in (select post_md5 from kp))"


_W = "(1 + ln(reply_cnt)) * case when post_cnt <= 4e6 then ln(4e6 / post_cnt) else 0 end"
SQL = {
    "a12_top_replies": f"with {_P} select * from tr",
    "a12_first_fifty": f"with {_P} select * from tr order by posts desc, reply_md5 limit 50",
    "x9_first_fifty": f"with {_kept(50)} select post_md5, reply_md5, round({_W}, 6) weight from pk",
    "j4_profiles": f"with {_P} select * from pr",
    "a13_row_totals": f"with {_P} select post_md5, sum(reply_cnt)::bigint total, max(post_cnt) post_cnt from pr group by 1",
    "x9_weights": f"with {_kept(2000)} select post_md5, reply_md5, round({_W}, 6) weight from pk",
    "a14_total_row": f"""with {_P}, w as (select post_md5, reply_md5, {_W} weight from pr), t as (select reply_md5 p, row_number() over (order by posts desc, reply_md5) r from tr)
select post_md5, reply_md5, round(weight, 6) weight from w where post_md5 not in (select p from t where r <= 2)
union all select 40693175::bigint, reply_md5, round(sum(weight), 6) from w where post_md5 in (select p from t where r <= 10) group by reply_md5""",
    "x11_classic_tf_idf": f"with {_kept(2000)} select post_md5, reply_md5, round(reply_cnt / sum(reply_cnt) over (partition by post_md5) * ln(4e6 / sum(reply_cnt) over (partition by reply_md5)), 6) weight from pk",
    "x12_entropy_weights": f"""with {_P}, n as (select count(distinct post_md5) n from pr), c as (select post_md5, reply_md5, log2(reply_cnt + 1) v, count(*) over (partition by reply_md5, reply_cnt) / n.n q from pr, n)
select post_md5, reply_md5, round(v / nullif(sum(-q * ln(q)) over (partition by post_md5), 0), 6) weight from c""",
    "x20_vector_sums": f"with {_P} select post_md5 as \"key\", reply_md5 dim, round(log2(reply_cnt::double - case when reply_cnt > 1 then 0.5 * reply_cnt else 0 end + 1), 6) weight from pr",
    "j12_compared_profiles": f"""with {_P}, c as (select post_md5, reply_cnt::double x, case when reply_cnt >= 2 then reply_cnt + 1.0::double end y from pr)
select post_md5 as \"key\", count(*) dims, round(coalesce(sum(x * coalesce(y, 0)) / nullif(sqrt(sum(x * x) * sum(coalesce(y * y, 0))), 0), 0), 6) cosine, round(sum(abs(x - coalesce(y, 0))) / 2, 6) half_l1, round(1 - 6 * sum((x - coalesce(y, 0)) ** 2) / nullif(count(*) * (count(*)::double ** 2 - 1), 0), 6) rank_like, count(*) filter (y is null) missed from c group by 1""",
    "a11_distances": f"""with {_kept(2000)}, w as (select post_md5 p, reply_md5 r, {_W} v from pk), n as (select p, sqrt(sum(v * v)) norm from w group by 1), dot as (select a.p p1, b.p p2, sum(a.v * b.v) s from w a join w b on a.r = b.r and a.p > b.p group by all)
select a.p post1_md5, b.p post2_md5, round(case when a.norm = 0 or b.norm = 0 then 1 else 1 - coalesce(s, 0) / (a.norm * b.norm) end, 6) sim from n a join n b on a.p > b.p left join dot on p1 = a.p and p2 = b.p""",
    "f7_blocked_posts": f"with {_P} select post_md5, count(*) n from pr where post_md5 not in (40693175, 797835322) and reply_md5 not in (40693175, 797835322) group by 1",
    "a29_profile_sizes": f"with {_P}, s as (select count(*)::double n from pr group by post_md5), m as (select avg(n) a from s) select round(avg(n), 6) mean, round(stddev_samp(n), 6) sd, round(avg((n - a) ** 3) / pow(avg((n - a) ** 2), 1.5), 4) skew, median(n) median, min(n) least, max(n) most, sum(n) total from s, m",
}
