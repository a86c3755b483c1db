"""Runs: score routes once, resume by route, and measure them."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators import answers, bootstrap, classify, lexical, pools, quality, ranking, routes, streams
from pairloom.operators.registry import Registry, Route, in_rank_order
from pairloom.sources import runs

#: Rank metrics of a comparison, and the sizes of a dilution: candidates and how many a request.
RANK_METRICS = ("ndcg", "mrr", "recall")
DILUTIONS = ((10, 1), (10, 10), (100, 5), (100, 10), (100, 25), (100, 50), (100, 100))


def _reason(e: Exception) -> str:
    return (str(e).splitlines() or [type(e).__name__])[0][:300]


def score_routes(spark: SparkSession, pool: DataFrame, found: dict[str, Route], path: str, dataset: str, on_result: Callable[[str], None] | None = None) -> dict[str, str]:
    """Save the pairs of each route that isn't saved yet; routes that failed, with the reason.

    Each route is saved when it is done, so a run that ends early goes on from there. A failed
    route doesn't end the others, and is run again next time.
    """
    errors = {}
    for name, route in found.items():
        if name not in runs.measured(spark, path, dataset):
            began = time.monotonic()
            try:
                ranked = in_rank_order(route(pool))
                runs.save_pairs(ranked.select(F.lit(dataset).alias("dataset"), F.lit(name).alias("route"), *routes.KEY, "score", F.col("rank").cast("int").alias("rank")), path)
                runs.commit(spark, path, dataset, name, time.monotonic() - began, pool)
            except Exception as e:  # noqa: BLE001  reported by route
                errors[name] = _reason(e)
        if on_result:
            on_result(name)
    return errors


def run_judge(spark: SparkSession, pool: DataFrame, found: dict[str, Route], path: str, dataset: str) -> DataFrame:
    """Classification metrics of the baselines (scored at every run) and of the routes, and errors.

    The baselines' texts are read once: what is counted in them is kept until the pairs are saved.
    """
    counted = lexical.counted(pool).persist()
    try:
        counted.count()  # else each of the baselines' jobs would set out to fill the cache
        runs.save_pairs(lexical.baselines_of(counted, dataset), path)
    finally:
        counted.unpersist()
    errors = score_routes(spark, pool, found, path, dataset)
    pairs = runs.load_pairs(spark, path).filter(F.col("dataset") == dataset)
    sure = F.substring_index("route", "@", 1).isin(*routes.PROBABILISTIC)
    metrics = classify.judge_metrics(pairs.filter(~sure), False).unionByName(classify.judge_metrics(pairs.filter(sure), True), allowMissingColumns=True)
    failed = spark.createDataFrame([(dataset, r, e) for r, e in errors.items()], "dataset string, route string, error string")
    return metrics.unionByName(failed, allowMissingColumns=True)


def run_dilution(pools_: dict[tuple[int, int], DataFrame], route: Callable[[int], Route], path: str | None = None) -> DataFrame:
    """Metrics of each (pool, batch): own pairs judged, foreign ones described, requests counted.

    With a ``path``, pairs are saved by setting, and settings that are saved aren't scored again;
    without one the scored pairs are cached.
    """
    out = None
    for (pool, batch), rows in pools_.items():
        name, spark = f"pool={pool},batch={batch}", rows.sparkSession
        scored = None
        if path is None or name not in runs.measured(spark, path, "dilution"):
            scored = route(batch)(rows).select(F.lit("dilution").alias("dataset"), F.lit(name).alias("route"), *routes.KEY, "score")
        if path is not None:
            if scored is not None:
                began = time.monotonic()
                runs.save_pairs(scored, path)
                runs.commit(spark, path, "dilution", name, time.monotonic() - began, rows)
            scored = runs.load_pairs(spark, path).filter((F.col("dataset") == "dilution") & (F.col("route") == name))
        else:
            scored = scored.persist()  # every metric reads it; a route isn't asked again
        own = scored.filter(F.col("doc_id").startswith(F.col("query_id")))
        requests = rows.groupBy("query_id").agg(F.ceil(F.count(F.lit(1)) / batch).alias("r")).agg(F.sum("r").alias("requests"))
        by_query = classify.mean_per_query(own, "pr_auc").select(*classify.ROUTE, F.col("value").alias("query_pr_auc"))
        part = classify.distractor_stats(scored).join(classify.judge_metrics(own, True), classify.ROUTE, "left").join(by_query, classify.ROUTE, "left").join(F.broadcast(requests))
        part = part.withColumn("pool", F.lit(pool)).withColumn("batch", F.lit(batch))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def dilution_pools(candidates: DataFrame, settings: tuple[tuple[int, int], ...] = DILUTIONS, seed: int = 0) -> dict[tuple[int, int], DataFrame]:
    """Each setting's pool: own candidates, and strangers up to its size."""
    questions = candidates.select("query_id", "question").distinct()
    out = {}
    for total, batch in settings:
        padded = pools.distractor_padding(candidates, total, seed).join(questions, "query_id")
        key = pools.shuffle_key(F.lit(seed), F.col("query_id"), F.col("doc_id"))
        out[total, batch] = padded.withColumn("ordinal", F.conv(F.substring(key, 1, 15), 16, 10).cast("long"))
    return out


def dilution_difference(path: str, spark: SparkSession, samples: int, seed: int, first: str = "pool=10,batch=10", second: str = "pool=10,batch=1") -> dict | None:
    """Differences of two saved settings' own pairs, with intervals; None where one isn't saved."""
    if not {first, second} <= runs.measured(spark, path, "dilution"):
        return None
    pairs = runs.load_pairs(spark, path).filter(F.col("dataset") == "dilution").filter(F.col("doc_id").startswith(F.col("query_id")))
    a, b = (pairs.filter(F.col("route") == r) for r in (first, second))
    draws = streams.exact_draws(a, samples, seed)
    by_query = [classify.per_query(x, "pr_auc").select("query_id", "value") for x in (a, b)]
    means = [x.agg(F.avg("value")).first()[0] for x in by_query]
    points = [classify.judge_metrics(x, True).first()["pr_auc"] for x in (a, b)]
    spans = bootstrap.bootstrap_mean_diff(*by_query, draws).first().asDict(), bootstrap.paired_bootstrap(a, b, draws, "pr_auc").first().asDict()
    return {n: s | {"first": v[0], "second": v[1]} for n, v, s in zip(("by query", "of all"), (means, points), spans, strict=True)}


def evaluate_routes(pairs: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """Rank metrics by query, and their means and standard errors by route."""
    rows = ranking.rank_metrics(pairs, k)
    return rows, ranking.summary(rows, list(RANK_METRICS))


def evaluate(spark: SparkSession, pool: DataFrame, found: dict[str, Route], path: str, dataset: str, k: int = 10, on_result: Callable[[str], None] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """Every route over the same pool: summary rows of those that are saved, and what failed.

    A saved order is kept as it came: it ranks by ``rank``, so a service's order isn't sorted again.
    """
    errors = score_routes(spark, pool, found, path, dataset, on_result)
    saved = runs.load_pairs(spark, path) if runs.exists(spark, path) else spark.createDataFrame([], "dataset string, route string, query_id string, ordinal long, doc_id string, label int, score double, rank int")
    pairs = saved.filter((F.col("dataset") == dataset) & F.col("route").isin(*found))
    told = runs.manifest(spark, path).select("dataset", "route", "seconds", "failed", "dropped")
    return evaluate_routes(in_saved_order(pairs), k)[1].join(F.broadcast(told), ["dataset", "route"], "left"), errors  # a row a route


def in_saved_order(pairs: DataFrame) -> DataFrame:
    """Pairs whose score falls with the saved rank, for rank metrics of orders that score doesn't give."""
    return pairs.withColumn("score", F.coalesce(-F.col("rank").cast("double"), F.col("score"))) if "rank" in pairs.columns else pairs


def sweep(registry: Registry, sizes: list[int], base: str = "pointwise") -> dict[str, Route]:
    """One route for each number of candidates in a request."""
    return registry.build([f"{base}@{n}" for n in sizes])


def selected_routes(found: dict[str, Route], usefulness: routes.Scorer, redundancy: routes.Scorer, top_k: int, budget_chars: int) -> dict[str, Route]:
    """The routes with context selection behind their first ``top_k``; names get ``+select``."""

    def behind(route: Route) -> Route:
        def ranked(pool: DataFrame) -> DataFrame:
            top = in_rank_order(route(pool)).filter(F.col("rank") <= top_k).select(*routes.KEY, "score", "rank")
            texts = pool.select("query_id", "doc_id", "question", "text")
            decided = answers.judged_context(top.join(texts, ["query_id", "doc_id"]), usefulness, redundancy, budget_chars)
            return answers.in_context(top, decided)

        return ranked

    return {f"{name}+select": behind(route) for name, route in found.items()}


def answer_runs(spark: SparkSession, pool: DataFrame, queries: DataFrame, found: dict[str, Route], generator: answers.Generator, path: str, dataset: str, top_k: int = answers.TOP_K) -> tuple[list[dict], dict[str, dict], dict[str, str]]:
    """Answers of every pipeline, saved by dataset and route: summaries, paired differences to the first, and errors."""
    errors = {}
    for name, route in found.items():
        if name in runs.measured(spark, path, dataset):
            continue
        try:
            ranked = in_rank_order(route(pool)).select("query_id", "doc_id", "label", "rank").join(pool.select("query_id", "doc_id", "text"), ["query_id", "doc_id"])
            began = time.monotonic()
            rows = answers.answer_queries(ranked, queries, generator, top_k)
            runs.save_pairs(rows.withColumn("dataset", F.lit(dataset)).withColumn("route", F.lit(name)), path)
            runs.commit(spark, path, dataset, name, time.monotonic() - began, queries)
        except Exception as e:  # noqa: BLE001  reported by route
            errors[name] = _reason(e)
    done = [n for n in found if n in runs.measured(spark, path, dataset)]
    saved = {n: runs.load_pairs(spark, path).filter((F.col("dataset") == dataset) & (F.col("route") == n)) for n in done}
    summaries = [{"name": n, **quality.answer_summary(rows).first().asDict()} for n, rows in saved.items()]
    paired = {n: bootstrap.paired_difference(saved[done[0]], rows).first().asDict() for n, rows in saved.items() if n != done[0]}
    return summaries, paired, errors
