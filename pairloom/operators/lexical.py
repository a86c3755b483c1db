"""Lexical baselines over candidate pools: length, term overlap, BM25, and their sanity report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.text import term_counts

from . import scan

K1, B = 1.5, 0.75
KEY = ["query_id", "ordinal", "doc_id", "label"]


def counted(pool: DataFrame) -> DataFrame:
    """KEY, and of each text what the baselines are told by: its characters, and its terms as :func:`term_counts` has them."""
    rows = pool.select(*KEY, F.length("text").cast("double").alias("chars"), term_counts(F.col("question"), F.col("text")).alias("__t"))
    return rows.select(*KEY, "chars", "__t.asked", "__t.bag", "__t.found")


def _share() -> Column:
    held = F.when(F.col("found").isNotNull(), F.size("found"))
    return F.when(F.col("asked") > 0, held / F.col("asked").cast("double")).otherwise(F.lit(0.0))


def overlap(pool: DataFrame) -> DataFrame:
    """Share of a question's terms that a document holds; 0 for a question without terms."""
    return _overlap(counted(pool))


def _overlap(rows: DataFrame) -> DataFrame:
    return rows.select(*KEY, _share().alias("score"))


def length(pool: DataFrame) -> DataFrame:
    return pool.select(*KEY, F.length("text").cast("double").alias("score"))


def bm25(pool: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """BM25 of each candidate within its query's pool; documents without a query term score 0.

    Texts are read for the query's statistics (its question's terms by documents, a row a query) and
    for the scores; rows of :func:`counted` that are kept save the second reading.
    """
    return _bm25(counted(pool), k1, b)


def _bm25(rows: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    rows = rows.withColumn("found", F.coalesce("found", F.array().cast("array<struct<term:string,times:int>>")))
    each = rows.select("query_id", "bag", F.explode(F.concat(F.array(F.lit(None).cast("string")), "found.term")).alias("term"))  # null: the document itself
    df = each.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("df"), F.avg("bag").alias("bag"))
    every = F.col("term").isNull()
    by_term = F.map_from_entries(F.collect_list(F.when(~every, F.struct("term", "df"))))
    stats = df.groupBy("query_id").agg(F.max(F.when(every, F.col("bag"))).alias("__avg"), F.max(F.when(every, F.col("df"))).alias("__n"), by_term.alias("__df"))

    def part(x: Column) -> Column:
        df, tf = F.col("__df")[x["term"]], x["times"].cast("double")
        idf = F.log((F.col("__n") - df + 0.5) / (df + 0.5) + 1)
        return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("bag") / F.col("__avg")))

    return rows.join(stats, "query_id").select(*KEY, F.aggregate("found", F.lit(0.0), lambda score, x: score + part(x)).alias("score"))


def baseline_scores(pool: DataFrame, dataset: str = "pool") -> DataFrame:
    """Pairs of the three baseline routes."""
    return baselines_of(counted(pool), dataset)


def baselines_of(rows: DataFrame, dataset: str = "pool") -> DataFrame:
    """The same of rows of :func:`counted`."""
    parts = {"length": rows.select(*KEY, F.col("chars").alias("score")), "term_overlap": _overlap(rows), "bm25": _bm25(rows)}
    out = [part.withColumn("route", F.lit(name)) for name, part in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).withColumn("dataset", F.lit(dataset)).select("dataset", "route", *KEY, "score")


def sanity_report(pool: DataFrame) -> DataFrame:
    """Count, mean and exact median of length and overlap by label.

    Texts are read once: distinct scores are counted and kept, and everything else is told by these.
    """
    measures = F.map_from_arrays(F.array(F.lit("length"), F.lit("term_overlap")), F.array(F.col("chars"), _share()))
    rows = counted(pool).select("label", F.explode(measures).alias("measure", "score"))
    by = ["measure", "label"]
    points = rows.groupBy(*by, "score").agg(F.count(F.lit(1)).alias("n")).persist()
    known = F.sum(F.when(F.col("score").isNotNull(), F.col("n")))
    found = points.groupBy(*by).agg(F.sum("n").alias("count"), (F.sum(F.col("score") * F.col("n")) / known).alias("mean"))
    return found.join(scan.quantile(points, by, "score", 0.5, "median", times="n"), by, "left")
