"""Saved runs: pairs by dataset and route, and a manifest that says which routes are whole.

A route counts as saved when its manifest row is there, which is written last: what a killed run left half done
is run again and replaced. The row holds what the run was like; the queries that failed are a table beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: A manifest's columns, besides the dataset and route that it is partitioned by.
MANIFEST = "seconds double, pairs long, queries long, failed long, dropped long"


def _part(spark: SparkSession, path: str, name: str) -> str:
    return f"{path}/_{name}"  # hidden from readers of the pairs


def commit(spark: SparkSession, path: str, dataset: str, route: str, seconds: float | None = None, expected: DataFrame | None = None) -> None:
    """Say that the saved pairs of a route are whole: their numbers, and what of ``expected`` (query_id, a row a pair) they lack.

    A query without any pair has failed; pairs missing of the others are dropped.
    """
    own = load_pairs(spark, path).filter((F.col("dataset") == dataset) & (F.col("route") == route))
    got = own.groupBy("query_id").agg(F.count(F.lit(1)).alias("got"))
    want = got.select("query_id", F.col("got").alias("want")) if expected is None else expected.groupBy("query_id").agg(F.count(F.lit(1)).alias("want"))
    met = want.join(got, "query_id", "full").select("query_id", F.coalesce("want", "got").alias("want"), F.coalesce("got", F.lit(0)).alias("got"))
    said = [F.lit(seconds).cast("double").alias("seconds"), F.coalesce(F.sum("got"), F.lit(0)).alias("pairs"), F.count_if(F.col("got") > 0).alias("queries"), F.count_if(F.col("got") == 0).alias("failed")]
    lost = F.coalesce(F.sum(F.when(F.col("got") > 0, F.col("want") - F.col("got"))), F.lit(0)).alias("dropped")
    name = [F.lit(dataset).alias("dataset"), F.lit(route).alias("route")]
    for part, rows in (("failed", met.filter("got = 0").select("query_id", *name)), ("manifest", met.agg(*said, lost).select("*", *name))):
        rows.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset", "route").parquet(_part(spark, path, part))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, route, seconds, pairs, queries, failed, dropped) of the routes that are whole."""
    at = _part(spark, path, "manifest")
    names = "dataset string, route string"
    if not exists(spark, at):
        return spark.createDataFrame([], f"{names}, {MANIFEST}")
    return spark.read.schema(f"{MANIFEST}, {names}").parquet(at).select("dataset", "route", *(c.split()[0] for c in MANIFEST.split(", ")))


def failed_queries(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, route, query_id) of the queries that a route gave no pair of."""
    at = _part(spark, path, "failed")
    names = "dataset string, route string, query_id string"
    return spark.read.schema("query_id string, dataset string, route string").parquet(at).select("dataset", "route", "query_id") if exists(spark, at) else spark.createDataFrame([], names)


def save_pairs(pairs: DataFrame, path: str) -> None:
    """Write pairs partitioned by dataset and route; only the routes given are replaced."""
    pairs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset", "route").parquet(path)


def load_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Saved pairs; columns that only some routes have (as a service's rank) are null elsewhere."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def measured(spark: SparkSession, path: str, dataset: str) -> set[str]:
    """Routes of a dataset that are saved whole; pairs aren't read for that."""
    return {r["route"] for r in manifest(spark, path).filter(F.col("dataset") == dataset).select("route").collect()}


def datasets(spark: SparkSession, path: str, wanted: list[str]) -> list[str]:
    """Those wanted that are saved, in the order given; raises without any."""
    have = {r["dataset"] for r in load_pairs(spark, path).select("dataset").distinct().collect()} if exists(spark, path) else set()
    found = [d for d in wanted if d in have]
    if not found:
        raise ValueError(f"none of {', '.join(wanted)} is saved in {path}")
    return found
