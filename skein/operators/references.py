"""References to records that do not exist (problem 6).

References are grouped by null mask: those with the same set of non-null key columns are compared with
the targets on just these columns, by one anti-join per mask.  What a partly null reference means is
declared by the match mode, as in SQL's foreign keys:

* ``simple``: a reference with a null in any column refers to nothing and is never an orphan;
* ``partial``: it must match some target on its non-null columns; all null refers to nothing;
* ``full``: all null refers to nothing, partly null is always an orphan.

Null handling: nulls in target keys match nothing.  Empty tables: no references give no rows, no targets
make every reference an orphan.  Repeated references are kept as often as they occur; the p6 queries
reduce them.  Columns of the references other than the keys pass through unchanged, also when they bear
the names of target columns, since targets are reduced to renamed keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.runtime import table


def orphans(refs: DataFrame, targets: DataFrame, ref_cols: Sequence[str], target_cols: Sequence[str], match: str = "simple") -> DataFrame:
    """The rows of ``refs`` whose key has no row in ``targets``.

    Targets are reduced to their distinct keys before the shuffle.  A key that holds a large share of the
    references is split by adaptive execution, which can divide the left side of an anti-join.
    """
    if match not in ("simple", "partial", "full"):
        raise ValueError(match)
    parts: list[DataFrame] = []
    for mask in product((True, False), repeat=len(ref_cols)):
        if not any(mask) or (match == "simple" and not all(mask)):
            continue
        group = refs.where(reduce(lambda a, b: a & b, (F.col(f"`{c}`").isNotNull() if there else F.col(f"`{c}`").isNull() for c, there in zip(ref_cols, mask))))
        if match == "full" and not all(mask):
            parts.append(group)
            continue
        used = [(r, t, f"__target_{i}") for i, (r, t, there) in enumerate(zip(ref_cols, target_cols, mask)) if there]
        keys = targets.select(*(F.col(f"`{t}`").alias(k) for _, t, k in used)).na.drop().distinct()
        parts.append(group.join(keys, reduce(lambda a, b: a & b, (group[f"`{r}`"] == keys[k] for r, _, k in used)), "left_anti"))
    return reduce(DataFrame.unionByName, parts) if parts else refs.limit(0)


def _references(spark: SparkSession, d: str) -> dict[str, tuple[DataFrame, DataFrame, str]]:
    """By table: its references (row_id, missing_key), the targets and their key."""
    tweets, nouns = table(spark, d, "tweets"), table(spark, d, "nouns")
    return {
        "tweets": (tweets.where("in_reply_to_id <> 0").select(F.col("id").alias("row_id"), F.col("in_reply_to_id").alias("missing_key")), tweets, "id"),
        "tweet_chains": (table(spark, d, "tweet_chains").select(F.col("reply_id").alias("row_id"), F.col("post_id").alias("missing_key")), tweets, "id"),
        "tweets_nouns": (table(spark, d, "tweets_nouns").select(F.col("id").alias("row_id"), F.col("noun_md5").alias("missing_key")), nouns, "noun_md5"),
    }


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Each orphan reference once (ref_table, row_id, missing_key)."""
    return reduce(
        DataFrame.unionByName,
        (orphans(refs, targets, ["missing_key"], [key]).distinct().select(F.lit(name).alias("ref_table"), "row_id", "missing_key") for name, (refs, targets, key) in _references(spark, d).items()),
    )


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans and late targets per table and day of the referring tweet.

    ``n_missing``: different references whose target is nowhere; ``n_late``: those whose target exists but
    was fetched after the referring tweet (first arrivals compared; dictionary rows bear no arrival, so
    tweets_nouns has none).  ``day`` is yyyyMMdd of created_at, null if that is null.
    """
    seen = table(spark, d, "tweets").groupBy("id").agg(F.min("fetched_at").alias("arrived"), F.min("created_at").alias("created_at"))
    referring = seen.select(F.col("id").alias("row_id"), F.col("arrived").alias("ref_arrived"), F.substring(F.col("created_at").cast("string"), 1, 8).alias("day"))
    missing = p6_found(spark, d).select("ref_table", "row_id", F.lit(1).alias("missing"), F.lit(0).alias("late"))
    target = seen.select(F.col("id").alias("missing_key"), F.col("arrived").alias("target_arrived"))
    late = reduce(
        DataFrame.unionByName,
        (
            refs.distinct().join(target, "missing_key").join(referring, "row_id").where("target_arrived > ref_arrived").select(F.lit(name).alias("ref_table"), "row_id", F.lit(0).alias("missing"), F.lit(1).alias("late"))
            for name, (refs, _, key) in _references(spark, d).items()
            if key == "id"
        ),
    )
    return (
        missing.unionByName(late)
        .join(referring.select("row_id", "day"), "row_id", "left")
        .groupBy("ref_table", "day")
        .agg(F.sum("missing").cast("bigint").alias("n_missing"), F.sum("late").cast("bigint").alias("n_late"))
    )


QUERIES = {"p6_found": p6_found, "p6_report": p6_report}

_REFS = """
  select distinct 'tweets' ref_table, id row_id, in_reply_to_id missing_key from tweets where in_reply_to_id <> 0
  union all select distinct 'tweet_chains', reply_id, post_id from tweet_chains where post_id is not null
  union all select distinct 'tweets_nouns', id, noun_md5 from tweets_nouns where noun_md5 is not null"""
_FOUND = f"""select ref_table, row_id, missing_key from ({_REFS}) r
where case when ref_table = 'tweets_nouns' then not exists (select 1 from nouns n where n.noun_md5 = missing_key)
  else not exists (select 1 from tweets t where t.id = missing_key) end"""
SQL = {
    "p6_found": _FOUND,
    "p6_report": f"""with seen as (select id, min(fetched_at) arrived, min(created_at) created_at from tweets group by id),
  marks as (select ref_table, row_id, 1 missing, 0 late from ({_FOUND}) f
    union all select r.ref_table, r.row_id, 0, 1 from ({_REFS}) r join seen t on t.id = r.missing_key join seen s on s.id = r.row_id
      where r.ref_table <> 'tweets_nouns' and t.arrived > s.arrived)
select ref_table, substr(created_at::varchar, 1, 8) as day, sum(missing)::bigint n_missing, sum(late)::bigint n_late
from marks left join seen on seen.id = marks.row_id group by all""",
}
