"""Score curves: running counts over distinct scores, the base of every threshold metric.

Pairs are first added up by distinct score, with a weight. A curve of few groups is long, so
its running sums are those of score ranges (``scan``), as many as it has scores for. No window ever
holds a whole pooled curve.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan


def by_score(pairs: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """Weighted positives (tp) and pairs (n) of each distinct score."""
    w = F.lit(1) if weight is None else weight
    return pairs.groupBy(*keys, "score").agg(F.sum(w * F.col("label")).cast("long").alias("tp"), F.sum(w).cast("long").alias("n"))


def curve(pairs: DataFrame, keys: list[str], weight: Column | None = None, small: bool = False) -> DataFrame:
    """By keys and score: tp, n, ctp and cn (running from the highest score), p and total.

    ``small`` is for curves of many small groups, as one for each query; else groups are few, and long.
    """
    points = by_score(pairs, keys, weight)
    if small:
        group = Window.partitionBy(*keys)
        down = group.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
        return points.withColumns({"p": F.sum("tp").over(group), "total": F.sum("n").over(group), "ctp": F.sum("tp").over(down), "cn": F.sum("n").over(down)})
    points = scan.ranged(points, keys, "score", F.sum("tp").alias("p"), F.sum("n").alias("total"))
    points = scan.with_totals_before(points, keys, [F.desc("score")], {"ctp": F.col("tp"), "cn": F.col("n")}, descending=True)
    return points.withColumns({"ctp": F.col("ctp") + F.col("tp"), "cn": F.col("cn") + F.col("n")})


def _both() -> Column:
    return (F.max("p") > 0) & (F.max("p") < F.max("total"))


def _precision() -> Column:
    return F.col("ctp").cast("double") / F.col("cn")


def ap_column() -> Column:
    """Sum over distinct scores of recall gained times precision; null with one class only."""
    return F.when(_both(), F.sum(F.col("tp").cast("double") / F.greatest("p", F.lit(1)) * _precision()))


def roc_column() -> Column:
    """Share of (positive, negative) pairs in the right order, ties a half; null with one class."""
    neg, below = F.col("n") - F.col("tp"), F.col("p") - F.col("ctp")
    lost = neg.cast("double") * below + neg.cast("double") * F.col("tp") / F.lit(2.0)
    pairs = F.max("p").cast("double") * (F.max("total") - F.max("p"))
    return F.when(_both(), F.lit(1.0) - F.sum(lost) / F.greatest(pairs, F.lit(1.0)))


def f1_column() -> Column:
    """Struct of the best F1 (f1, s: minus the threshold, pr, re); of equal ones the lowest threshold."""
    precision, recall = _precision(), F.col("ctp").cast("double") / F.greatest("p", F.lit(1))
    f1 = 2 * precision * recall / F.greatest(precision + recall, F.lit(1e-12))
    return F.when(_both(), F.max(F.struct(f1.alias("f1"), (-F.col("score")).alias("s"), precision.alias("pr"), recall.alias("re"))))


def f1_parts(b: str) -> list[Column]:
    return [F.col(f"{b}.f1").alias("best_f1"), (-F.col(f"{b}.s")).alias("best_f1_threshold"), F.col(f"{b}.pr").alias("best_f1_precision"), F.col(f"{b}.re").alias("best_f1_recall")]


def average_precision(points: DataFrame, keys: list[str], name: str = "pr_auc") -> DataFrame:
    return points.groupBy(*keys).agg(ap_column().alias(name))


def roc_auc(points: DataFrame, keys: list[str], name: str = "roc_auc") -> DataFrame:
    return points.groupBy(*keys).agg(roc_column().alias(name))


def best_f1(points: DataFrame, keys: list[str]) -> DataFrame:
    """Best F1 over thresholds with precision and recall."""
    return points.groupBy(*keys).agg(f1_column().alias("b")).select(*keys, *f1_parts("b"))


def summary(points: DataFrame, keys: list[str]) -> DataFrame:
    """pr_auc, roc_auc and the best F1 in one pass over the curve."""
    return points.groupBy(*keys).agg(ap_column().alias("pr_auc"), roc_column().alias("roc_auc"), f1_column().alias("b")).select(*keys, "pr_auc", "roc_auc", *f1_parts("b"))


def precision_at_recall(points: DataFrame, keys: list[str], keep: float = 0.9) -> DataFrame:
    """The highest score at which ``keep`` of the positives survive, and precision from there."""
    ok = F.col("ctp") >= F.lit(keep) * F.col("p")
    best = F.max(F.when(ok & (F.col("p") > 0), F.struct("score", (F.col("ctp").cast("double") / F.col("cn")).alias("precision"))))
    out = points.groupBy(*keys).agg(best.alias("b"))
    return out.select(*keys, F.col("b.precision").alias("precision"), F.col("b.score").alias("threshold"))
