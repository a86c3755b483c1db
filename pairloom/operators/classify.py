"""Routes as binary classifiers: threshold metrics, calibration and their bundle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import curves, scan

ROUTE = ["dataset", "route"]
BINS, HALF = 10, 0.5
#: Rows of a task that works by query.
TASK_ROWS = 250_000


def mixed_queries(pairs: DataFrame, keys: list[str] = ROUTE) -> DataFrame:
    """Queries with both a positive and a negative: keys, query_id, n and relevant."""
    found = pairs.groupBy(*keys, "query_id").agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("long").alias("relevant"))
    return found.filter((F.col("relevant") > 0) & (F.col("relevant") < F.col("n")))


def per_query(pairs: DataFrame, metric: str, keys: list[str] = ROUTE) -> DataFrame:
    """``pr_auc`` or ``roc_auc`` of each mixed query.

    Long tables are dealt by query over tasks of about ``TASK_ROWS`` rows, in which all that follows is done; a
    shuffle's usual number of tasks would give each of them more and more rows.
    """
    tasks = -(-pairs.count() // TASK_ROWS)
    if tasks > 1:
        pairs = pairs.repartition(max(tasks, pairs.sparkSession.sparkContext.defaultParallelism), "query_id")
    points = curves.curve(pairs, [*keys, "query_id"], small=True)
    found = (curves.average_precision if metric == "pr_auc" else curves.roc_auc)(points, [*keys, "query_id"], "value")
    return found.filter("value is not null")


def mean_per_query(pairs: DataFrame, metric: str, keys: list[str] = ROUTE) -> DataFrame:
    return per_query(pairs, metric, keys).groupBy(*keys).agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("queries"))


def half_columns() -> list[Column]:
    hit = F.count_if((F.col("score") >= HALF) & (F.col("label") == 1)).cast("double")
    return [(hit / F.greatest(F.count_if(F.col("score") >= HALF), F.lit(1))).alias("precision_at_half"), (hit / F.greatest(F.sum("label"), F.lit(1))).alias("recall_at_half")]


def brier_column() -> Column:
    return F.avg(F.pow(F.col("score") - F.col("label"), F.lit(2.0))).alias("brier")


def at_half(pairs: DataFrame, keys: list[str] = ROUTE) -> DataFrame:
    """Precision and recall of scores from 0.5 on; empty denominators count as 1."""
    return pairs.groupBy(*keys).agg(*half_columns())


def calibration_bins(pairs: DataFrame, keys: list[str] = ROUTE, bins: int = BINS) -> DataFrame:
    """Equal-count bins by (score, ordinal): bin, count, mean_score, positive_rate.

    Rows are ranked within score ranges and raised by the ranges below, so that no task
    sorts all pairs; the first ``rows mod bins`` bins hold one row more.
    """
    rows = scan.ranged(pairs.select(*keys, "score", "ordinal", "label"), keys, "score", F.count(F.lit(1)).alias("__total"))
    rows = scan.with_totals_before(rows, keys, [F.asc("score"), F.asc("ordinal")], {"__rank": F.lit(1)})
    small, more = F.floor(F.col("__total") / bins), F.col("__total") % bins
    edge = more * (small + 1)
    at = F.when(F.col("__rank") < edge, F.floor(F.col("__rank") / (small + 1))).otherwise(more + F.floor((F.col("__rank") - edge) / F.greatest(small, F.lit(1))))
    return rows.groupBy(*keys, (at + 1).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"), F.avg("score").alias("mean_score"), F.avg("label").alias("positive_rate"))


def ece(pairs: DataFrame, keys: list[str] = ROUTE, bins: int = BINS) -> DataFrame:
    """Expected calibration error over equal-count bins."""
    table = calibration_bins(pairs, keys, bins)
    return table.groupBy(*keys).agg((F.sum(F.col("count") * F.abs(F.col("positive_rate") - F.col("mean_score"))) / F.sum("count")).alias("ece"))


def brier(pairs: DataFrame, keys: list[str] = ROUTE) -> DataFrame:
    return pairs.groupBy(*keys).agg(brier_column())


def judge_metrics(pairs: DataFrame, probabilistic: bool, keys: list[str] = ROUTE, bins: int = BINS) -> DataFrame:
    """One row per route with every classification metric; ``error`` where a class is missing."""
    sure = [*half_columns(), brier_column()] if probabilistic else []
    out = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("pairs"), F.avg("label").alias("positive_rate"), (F.min("label") == F.max("label")).alias("__one"), *sure)
    parts = [curves.summary(curves.curve(pairs, keys), keys), mean_per_query(pairs, "roc_auc", keys).withColumnsRenamed({"value": "per_query_roc_auc", "queries": "per_query_count"})]
    if probabilistic:
        parts.append(ece(pairs, keys, bins))
    for part in parts:
        out = out.join(part, keys, "left")
    out = out.withColumn("error", F.when(F.col("__one"), F.lit("only one class")))
    values = [c for c in out.columns if c not in (*keys, "pairs", "positive_rate", "__one", "error")]
    return out.withColumns({c: F.when(~F.col("__one"), F.col(c)) for c in values}).withColumn("per_query_count", F.coalesce("per_query_count", F.when(~F.col("__one"), F.lit(0)))).drop("__one")


def distractor_stats(pairs: DataFrame, keys: list[str] = ROUTE) -> DataFrame:
    """Own pairs apart from foreign ones: count, mean score and share from 0.5 on of the latter.

    A pair is a query's own where the document's id begins with the query's id.
    """
    foreign = ~F.col("doc_id").startswith(F.col("query_id"))
    return pairs.groupBy(*keys).agg(F.count_if(~foreign).alias("own"), F.count_if(foreign).alias("count"), F.avg(F.when(foreign, F.col("score"))).alias("mean_score"), F.avg(F.when(foreign, (F.col("score") >= HALF).cast("double"))).alias("share_at_half"))
