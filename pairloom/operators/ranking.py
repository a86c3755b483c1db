"""Rankings: stable ranks, rank metrics, top-k, fusion, filters and movers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .classify import ROUTE, mixed_queries

QUERY = [*ROUTE, "query_id"]


def ranked(pairs: DataFrame, keys: list[str] = QUERY, by: tuple[str, ...] = ("score",)) -> DataFrame:
    """``rank`` from 1 by the columns of ``by`` falling (null as 0), then input order; rank_delta."""
    order = [*(F.coalesce(c, F.lit(0.0)).desc() for c in by), F.col("ordinal")]
    at = F.row_number().over(Window.partitionBy(*keys).orderBy("ordinal")) - 1
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).withColumn("rank_delta", at - (F.col("rank") - 1))


def top_k(pairs: DataFrame, k: int | None, keys: list[str] = QUERY) -> DataFrame:
    """The first ``k`` of each query by score; 0 or None keeps all."""
    if not k:
        return ranked(pairs, keys)
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "ordinal")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def rank_metrics(pairs: DataFrame, k: int = 10, keys: list[str] = QUERY) -> DataFrame:
    """By query: first_relevant, ndcg, mrr and recall at k, and the ids of the first five."""
    rows = pairs.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "ordinal")))
    hit, near = F.col("label") > 0, F.col("rank") <= k
    found = rows.groupBy(*keys).agg(
        F.sum("label").cast("long").alias("relevant"),
        F.min(F.when(hit, F.col("rank"))).alias("first_relevant"),
        F.coalesce(F.sum(F.when(hit & near, F.col("label") / F.log2(F.col("rank") + F.lit(1.0)))), F.lit(0.0)).alias("__dcg"),
        F.coalesce(F.max(F.when(hit & near, F.lit(1.0) / F.col("rank"))), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.sum(F.when(hit & near, F.lit(1.0))), F.lit(0.0)).alias("__hits"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= 5, F.struct("rank", "doc_id")))), lambda x: x["doc_id"]).alias("top"),
    )
    ideal = F.when(F.col("relevant") > 0, F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k).cast("long"), F.col("relevant")).cast("int")), F.lit(0.0), lambda s, r: s + F.lit(1.0) / F.log2(r + F.lit(1.0))))
    return found.select(*keys, "first_relevant", "top", F.coalesce(F.col("__dcg") / ideal, F.lit(0.0)).alias("ndcg"), "mrr", F.when(F.col("relevant") > 0, F.col("__hits") / F.col("relevant")).otherwise(F.lit(0.0)).alias("recall"))


def summary(rows: DataFrame, metrics: list[str], keys: list[str] = ROUTE) -> DataFrame:
    """Mean and standard error of each metric (0 for less than two rows), and n."""
    mean = [F.avg(m).alias(f"mean_{m}") for m in metrics]
    error = [F.coalesce(F.stddev_samp(m) / F.sqrt(F.count(m)), F.lit(0.0)).alias(f"stderr_{m}") for m in metrics]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *mean, *error)


def top_k_hit(pairs: DataFrame, k: int, keys: list[str] = ROUTE) -> DataFrame:
    """Share of mixed queries with a relevant document among their first ``k``."""
    first = top_k(pairs, k, [*keys, "query_id"]).groupBy(*keys, "query_id").agg(F.max("label").alias("hit"))
    return first.join(mixed_queries(pairs, keys), [*keys, "query_id"], "left_semi").groupBy(*keys).agg(F.avg("hit").alias("hit_rate"))


def random_top_k(pairs: DataFrame, k: int, keys: list[str] = ROUTE) -> DataFrame:
    """The same share expected of a random order: one less the chance to draw no relevant one."""
    miss = F.aggregate(F.sequence(F.lit(0), F.least(F.lit(k).cast("long"), F.col("n")).cast("int") - 1), F.lit(1.0), lambda p, i: p * F.greatest(F.col("n") - F.col("relevant") - i, F.lit(0)) / (F.col("n") - i))
    return mixed_queries(pairs, keys).groupBy(*keys).agg(F.avg(F.lit(1.0) - miss).alias("hit_rate"))


def min_max(score: Column, keys: list[str]) -> Column:
    """Scores of each query moved to 0..1, rounded to 10 digits; a flat list becomes all 1."""
    w = Window.partitionBy(*keys)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(low == high, F.lit(1.0)).otherwise(F.bround((score - low) / (high - low), 10))


def fused(a: Column, b: Column, weight: float) -> Column:
    return F.lit(weight) * a + F.lit(1 - weight) * b


def hybrid(first: DataFrame, second: DataFrame, weight: float = 0.3, keys: list[str] = QUERY, route: str = "hybrid") -> DataFrame:
    """Two routes' scores of the same pairs, each moved to 0..1, fused with ``weight`` on the first."""
    on = [k for k in keys if k != "route"]
    a = first.withColumn("__a", min_max(F.col("score"), on)).drop("score", "route")
    b = second.withColumn("__b", min_max(F.col("score"), on)).select(*on, "doc_id", "__b")
    return a.join(b, [*on, "doc_id"]).withColumn("score", fused(F.col("__a"), F.col("__b"), weight)).withColumn("route", F.lit(route)).drop("__a", "__b")


def relevance_filter(pairs: DataFrame, least: float = 0.2, keep_min: int = 1, keys: list[str] = QUERY) -> DataFrame:
    """Pairs from ``least`` on, in order; where a query has none, its best ``keep_min``."""
    w = Window.partitionBy(*keys)
    rows = pairs.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "ordinal"))).withColumn("__top", F.max("score").over(w))
    return rows.filter((F.col("score") >= least) | ((F.col("__top") < least) & (F.col("rank") <= keep_min))).drop("__top")


def movers(before: DataFrame, after: DataFrame, limit: int = 10) -> DataFrame:
    """Queries whose first relevant document rose most: gain, was, now, query_id, question."""
    was = before.select("query_id", F.col("first_relevant").alias("was"))
    rows = after.join(was, "query_id").filter(F.col("was") > F.col("first_relevant"))
    rows = rows.select((F.col("was") - F.col("first_relevant")).alias("gain"), "was", F.col("first_relevant").alias("now"), "query_id", F.substring("question", 1, 60).alias("question"))
    return rows.orderBy(*(F.desc(c) for c in ("gain", "was", "now", "query_id", "question"))).limit(limit)
