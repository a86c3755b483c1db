"""Data quality: construction against verification, merged runs, bookkeeping of scored pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHECKS = ("needs_multiple_docs", "non_factoid", "answerable_from_facts")


def verification_findings(built: DataFrame, verdicts: DataFrame, checks: DataFrame) -> DataFrame:
    """Every disagreement: id, doc_id, kind, expected, found, note.

    ``built``: id, doc_id, facts. ``verdicts``: id, ordinal, doc_id, facts_stated,
    leak_phrase, note; of repeated ones the last counts, those of unknown documents don't.
    ``checks``: id, one boolean for each of CHECKS and note; an absent check is no failure.
    Questions without a row in ``checks`` are unverified and give no findings.
    """
    known = checks.select("id").distinct()
    last = verdicts.groupBy("id", "doc_id").agg(F.max_by(F.struct("facts_stated", "leak_phrase", "note"), "ordinal").alias("v"))
    rows = built.join(known, "id", "left_semi").join(last, ["id", "doc_id"], "left")
    as_set = lambda c: F.array_sort(F.array_distinct(F.coalesce(F.col(c), F.expr("cast(array() as array<string>)"))))
    rows = rows.select("id", "doc_id", "v", as_set("facts").alias("expected"), as_set("v.facts_stated").alias("found"))
    nothing, no_list = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    missing = rows.filter("v is null").select("id", "doc_id", F.lit("missing_verdict").alias("kind"), no_list.alias("expected"), no_list.alias("found"), nothing.alias("note"))
    differ = rows.filter("v is not null and expected <> found").select("id", "doc_id", F.lit("fact_mismatch").alias("kind"), "expected", "found", F.col("v.note").alias("note"))
    leak = rows.filter("v.leak_phrase").select("id", "doc_id", F.lit("leak_phrase").alias("kind"), no_list.alias("expected"), no_list.alias("found"), F.col("v.note").alias("note"))
    each = F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).alias("ok")) for c in CHECKS))
    failed = checks.select("id", "note", F.explode(each).alias("c")).filter(~F.col("c.ok")).select("id", nothing.alias("doc_id"), F.col("c.kind").alias("kind"), no_list.alias("expected"), no_list.alias("found"), "note")
    return missing.unionByName(differ).unionByName(leak).unionByName(failed)


def unverified(built: DataFrame, checks: DataFrame) -> DataFrame:
    return built.select("id").distinct().join(checks, "id", "left_anti")


def merge_results(parts: DataFrame) -> DataFrame:
    """The last successful part of each route, or its last error.

    ``parts``: route, part (rising), error (null for a success) and any other columns.
    """
    best = F.row_number().over(Window.partitionBy("route").orderBy(F.col("error").isNotNull(), F.desc("part")))
    return parts.withColumn("__best", best).filter("__best = 1").drop("__best")


def inconsistent_query_counts(counts: DataFrame) -> DataFrame:
    """Routes with their query counts, if these differ; else nothing. ``counts``: route, queries."""
    spread = counts.agg(F.min("queries").alias("lo"), F.max("queries").alias("hi"))
    return counts.join(F.broadcast(spread)).filter("lo <> hi").drop("lo", "hi")


def dropped_pairs(expected: DataFrame, scored: DataFrame) -> DataFrame:
    """Queries without any scored pair (failed), and pairs missing of the others (dropped)."""
    want = expected.groupBy("query_id").agg(F.count(F.lit(1)).alias("want"))
    got = scored.groupBy("query_id").agg(F.count(F.lit(1)).alias("got"))
    rows = want.join(got, "query_id", "left")
    return rows.agg(F.count_if(F.col("got").isNull()).alias("failed"), F.coalesce(F.sum(F.when(F.col("got").isNotNull(), F.col("want") - F.col("got"))), F.lit(0)).cast("long").alias("dropped"))


def dataset_summary(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count_distinct("query_id").alias("queries"), F.count(F.lit(1)).alias("pairs"), F.sum("label").cast("long").alias("relevant"))


def answer_summary(rows: DataFrame) -> DataFrame:
    """Accuracy, containment and evidence rate over rows without an error, and counts.

    ``rows``: correct, contains, parsed, evidence_in_prompt, error.
    """
    ok = F.col("error").isNull()
    mean = lambda c: F.coalesce(F.avg(F.when(ok, F.col(c).cast("double"))), F.lit(0.0)).alias(c)
    out = rows.agg(mean("correct"), mean("contains"), mean("evidence_in_prompt"), F.count_if(ok & ~F.col("parsed")).alias("unparsed"), F.count_if(~ok).alias("errors"), F.count_if(ok).alias("scored"), F.count(F.lit(1)).alias("queries"))
    return out.withColumnsRenamed({"correct": "accuracy", "evidence_in_prompt": "evidence_rate"})
