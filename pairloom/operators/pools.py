"""Candidate pools: capped grouping, seeded orders, samples and distractor padding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import streams


def shuffle_key(*parts: Column) -> Column:
    """Hash order: md5 of the parts joined by colons."""
    return F.md5(F.concat_ws(":", *(p.cast("string") for p in parts)))


def capped_candidates(rows: DataFrame, cap: int | None = None, exact: bool = False) -> DataFrame:
    """Candidates of each query, relevant ones first where there are more than ``cap``, in hash order.

    ``rows``: query_id, doc_id (compared as text), ordinal, label. Queries without a relevant
    candidate are dropped. ``exact``: in the order of Python's ``random``, seeded by the query and its size.
    """
    by_query = Window.partitionBy("query_id")
    rows = rows.withColumn("__relevant", F.sum("label").over(by_query)).filter("__relevant > 0").drop("__relevant")
    if cap:
        rows = rows.withColumn("__at", F.row_number().over(by_query.orderBy(F.desc("label"), "ordinal"))).filter(F.col("__at") <= cap).drop("__at")
    if exact:
        return streams.exact_shuffled(rows, [F.col("doc_id").cast("string"), F.desc("label"), F.asc("ordinal")] if cap else [F.col("doc_id").cast("string"), F.asc("ordinal")], with_size=True)
    size = F.count(F.lit(1)).over(by_query)
    rows = rows.withColumn("__n", size)
    order = by_query.orderBy(shuffle_key(F.col("query_id"), F.col("__n"), F.col("doc_id")), F.col("doc_id").cast("string"), "ordinal")
    return rows.withColumn("position", (F.row_number().over(order) - 1).cast("long")).drop("__n")


def sample_queries(queries: DataFrame, count: int, seed: int = 0) -> DataFrame:
    """``count`` queries by hash order, or all of them."""
    return queries.orderBy(shuffle_key(F.lit(seed), F.col("query_id")), "query_id").limit(count)


#: Buckets of the hash ring that places are numbered in (the highest bits of a place).
RING_BITS = 12


def _place(*parts: Column) -> Column:
    """A place on the ring, from 0 to 2^32 - 1."""
    return F.conv(F.substring(shuffle_key(*parts), 1, 8), 16, 10).cast("long")


def distractor_padding(candidates: DataFrame, total: int, seed: int = 0) -> DataFrame:
    """Each query's own candidates and, up to ``total``, hash-drawn ones of other queries (label 0).

    ``candidates``: query_id, doc_id, text, label. All candidates stand on a hash ring; a query
    takes the first strangers from its own place on. It lacks ``total`` less its own, and at most
    its own can be in the way, so ``total`` places in a row always hold what it needs: those are
    looked up by their number on the ring, one row each. Where the ring holds fewer strangers,
    all of them are taken.
    """
    here = candidates.select("query_id", "doc_id", "text", _place(F.lit(seed), F.lit("doc"), F.col("query_id"), F.col("doc_id")).alias("__at"))
    own = candidates.groupBy("query_id").agg(F.count(F.lit(1)).alias("__own")).filter(F.col("__own") < total)
    size = candidates.agg(F.count(F.lit(1)).alias("__size"))
    marks = own.select("query_id", F.lit(None).cast("string").alias("doc_id"), F.lit(None).cast("string").alias("text"), _place(F.lit(seed), F.lit("query"), F.col("query_id")).alias("__at"))
    # a mark stands before the candidates of its place, so its number is that of the first of them
    ring = here.withColumn("__doc", F.lit(1)).unionByName(marks.withColumn("__doc", F.lit(0))).withColumn("__bucket", F.shiftrightunsigned("__at", 32 - RING_BITS))
    before = Window.partitionBy("__bucket").orderBy("__at", "__doc", "doc_id", "query_id").rowsBetween(Window.unboundedPreceding, -1)
    below = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = ring.groupBy("__bucket").agg(F.sum("__doc").alias("n")).select("__bucket", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("__base"))
    ring = ring.withColumn("__n", F.coalesce(F.sum("__doc").over(before), F.lit(0))).join(F.broadcast(base), "__bucket").withColumn("__n", F.col("__n") + F.col("__base"))
    places = ring.filter("__doc = 0").select("query_id", F.col("__n").alias("__start")).join(own, "query_id").join(F.broadcast(size))
    steps = F.sequence(F.lit(0).cast("long"), F.least(F.lit(total).cast("long"), F.col("__size")) - 1)
    places = places.select("query_id", "__own", "__size", "__start", F.explode(steps).alias("__step")).withColumn("__n", (F.col("__start") + F.col("__step")) % F.col("__size"))
    strangers = ring.filter("__doc = 1").select(F.col("query_id").alias("__of"), "doc_id", "text", "__n")
    met = places.join(strangers, "__n").filter(F.col("__of") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("__step"))
    drawn = met.withColumn("__rank", rank).filter(F.col("__rank") <= total - F.col("__own"))
    mine = candidates.select("query_id", "doc_id", "text", "label", F.lit(True).alias("own"))
    return mine.unionByName(drawn.select("query_id", "doc_id", "text", F.lit(0).cast("int").alias("label"), F.lit(False).alias("own")))
