"""Pairwise comparison: which pairs of a query's candidates meet, and win rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPPONENTS, LIMIT = 3, 64


def pair_schedule(candidates: DataFrame, opponents: int = OPPONENTS, limit: int = LIMIT) -> DataFrame:
    """(query_id, ordinal, left_id, right_id) of the comparisons to run.

    Every pair where at most ``limit`` pairs exist; else a ring: each candidate meets the
    next, then the one after, up to ``opponents``, cut at ``limit``. So of a pool of 66 or
    more some candidates stay unmatched. The ids of a query are gathered in order (pools are
    shortlists); pairs are made by index inside the row, without a self-join.
    """
    pools = candidates.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "doc_id"))), lambda x: x["doc_id"]).alias("ids")).withColumn("n", F.size("ids")).filter("n > 1")
    n = F.col("n")
    every = F.flatten(F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.transform(F.sequence(i + 1, n - 1), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    steps = F.sequence(F.lit(1), F.least(F.lit(opponents), n - 1))
    ring = F.flatten(F.transform(steps, lambda d: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("i"), ((i + d) % n).alias("j"), d.alias("d")))))
    # over half the way round, a pair has been met from its other end; half way it is met twice
    fresh = F.transform(F.filter(ring, lambda x: (2 * x["d"] < n) | ((2 * x["d"] == n) & (x["i"] < x["j"]))), lambda x: F.struct(x["i"].alias("i"), x["j"].alias("j")))
    chosen = F.when(n * (n - 1) / 2 <= limit, every).otherwise(F.slice(fresh, 1, limit))
    rows = pools.select("query_id", "ids", F.posexplode(chosen).alias("ordinal", "pair"))
    return rows.select("query_id", F.col("ordinal").cast("long").alias("ordinal"), F.get("ids", F.col("pair.i")).alias("left_id"), F.get("ids", F.col("pair.j")).alias("right_id"))


def win_rates(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Mean win probability of each candidate over its matches; 0 without any.

    A query of one candidate has nothing to compare: its candidate keeps the score that it came
    with (0 without one). ``verdicts``: query_id, left_id, right_id, p_left, p_right; null where
    the scorer gave none.
    """
    side = lambda k: F.struct(F.col(f"{k}_id").alias("doc_id"), F.coalesce(f"p_{k}", F.lit(0.0)).alias("p"))
    sides = verdicts.filter("p_left is not null or p_right is not null").select("query_id", F.explode(F.array(side("left"), side("right"))).alias("s"))
    rate = sides.groupBy("query_id", "s.doc_id").agg(F.avg("s.p").alias("__rate"), F.count(F.lit(1)).alias("matches"))
    came = F.col("score").cast("double") if "score" in candidates.columns else F.lit(None).cast("double")
    alone = F.count(F.lit(1)).over(Window.partitionBy("query_id")) == 1
    rows = candidates.withColumn("__came", F.when(alone, came)).drop("score").join(rate, ["query_id", "doc_id"], "left")
    rows = rows.withColumn("score", F.coalesce("__rate", "__came", F.lit(0.0))).withColumn("matches", F.coalesce("matches", F.lit(0))).drop("__rate", "__came")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "ordinal")))
