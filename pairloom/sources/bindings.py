"""The driver's tables as the pairs, pools and vectors that operators take, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pairs(spark: SparkSession, sf_dir: str, route: str, score: Column) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.lit("events").alias("dataset"), F.lit(route).alias("route"), F.col("user_id").cast("string").alias("query_id"), F.col("event_id").cast("string").alias("doc_id"), F.col("event_id").alias("ordinal"), (F.col("event_type") == "purchase").cast("int").alias("label"), score.alias("score"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: purchases among a user's events, by value."""
    return _pairs(spark, sf_dir, "value", F.col("value"))


def prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, "prob", F.least(F.col("value") / 500.0, F.lit(1.0)))


def pairs_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, "other", (F.col("event_id") * 7919 % 1000) / 1000.0)


def pairs_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores that know something of the label."""
    return _pairs(spark, sf_dir, "informed", F.col("value") / 500.0 + F.when(F.col("event_type") == "purchase", 0.25).otherwise(0.0))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem: returned lines among an order's, by price; (line, part, supplier, price) is the key."""
    x = table(spark, sf_dir, "lineitem")
    key = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return x.select(F.lit("lines").alias("dataset"), F.lit("price").alias("route"), F.col("l_orderkey").cast("string").alias("query_id"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long")).alias("doc_id"), key.alias("ordinal"), (F.col("l_returnflag") == "R").cast("int").alias("label"), F.col("l_extendedprice").alias("score"))


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark items as questions over the documents whose id falls to them; label: quality."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"))
    size = items.agg(F.count(F.lit(1)).alias("size"))
    good = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").join(F.broadcast(size)).withColumn("item_id", F.col("doc_id") % F.col("size"))
    rows = docs.join(items, "item_id").join(good, "doc_id", "left")
    return rows.select(F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("query_id"), F.col("doc_id").alias("ordinal"), F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("quality", F.lit(0)).alias("label"), "question", "text")


#: Queries that are put side by side with the vectors at a time.
QUERY_BLOCK = 1024


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates, document vectors and query vectors: ids divisible by 20 ask all vectors, in blocks."""
    e = table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").cast("string").alias("query_id"), F.col("embedding").alias("query_vector"), F.col("label").alias("ql"))
    d = e.select(F.col("vec_id").cast("string").alias("doc_id"), F.col("vec_id").alias("ordinal"), F.col("embedding").alias("vector"), F.col("label").alias("dl"))
    blocks = max(1, -(-q.count() // QUERY_BLOCK))
    asked = q.select("query_id", "ql", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block"))
    every = d.select("doc_id", "ordinal", "dl", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    candidates = every.join(asked, "block").select("query_id", "ordinal", "doc_id", (F.col("ql") == F.col("dl")).cast("int").alias("label"))
    return candidates, d.select("doc_id", "vector"), q.select("query_id", "query_vector")


_EVENTS = "CAST(user_id AS VARCHAR) AS query_id, CAST(event_id AS VARCHAR) AS doc_id, event_id AS ordinal, CAST(event_type = 'purchase' AS INTEGER) AS label"
#: The bindings as common table expressions.
SQL = {
    "pairs": f"pairs AS (SELECT {_EVENTS}, value AS score FROM events)",
    "prob": f"prob AS (SELECT {_EVENTS}, least(value / 500.0::DOUBLE, 1.0::DOUBLE) AS score FROM events)",
    "pairs_b": f"pairs_b AS (SELECT {_EVENTS}, (event_id * 7919 % 1000) / 1000.0::DOUBLE AS score FROM events)",
    "pairs_c": f"pairs_c AS (SELECT {_EVENTS}, value / 500.0::DOUBLE + CASE WHEN event_type = 'purchase' THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS score FROM events)",
    "lines": "lines AS (SELECT CAST(l_orderkey AS VARCHAR) AS query_id, l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(round(l_extendedprice * 100) AS BIGINT) AS doc_id, l_linenumber AS o1, l_partkey AS o2, l_suppkey AS o3, CAST(l_returnflag = 'R' AS INTEGER) AS label, l_extendedprice AS score FROM lineitem)",
    "pool": "pool AS (SELECT 'q' || b.item_id AS query_id, d.doc_id AS ordinal, CAST(d.doc_id AS VARCHAR) AS doc_id, CAST(coalesce(l.quality, 0) AS INTEGER) AS label, b.text AS question, d.text FROM documents d JOIN benchmark b ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id)",
}


def with_sql(*names: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names)
