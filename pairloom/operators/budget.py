"""Request budgets: how many candidates fit, fixed batches, next-fit and greedy folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.arrays import running
from pairloom.functions.text import estimate_tokens

#: Hard token limits of a request and the share of them that is used (fixed values).
PAIR_BUDGET, TOTAL_BUDGET, MARGIN = 32_000, 65_536, 0.9


def json_cost(text: Column) -> Column:
    """Estimated tokens of a text as the only value of a JSON object with the usual spaces."""
    body = F.to_json(F.struct(text.alias("text")))
    return estimate_tokens(F.regexp_replace(body, r'^\{"text":', '{"text": '))


def fitting_batch_size(candidates: DataFrame, overhead: int, pair_budget: int = PAIR_BUDGET) -> DataFrame:
    """By query: the longest prefix whose costs stay in the room, at least 1, and the count.

    ``candidates``: query_id, ordinal, cost. ``overhead``: tokens of the empty state and the
    longest question.
    """
    room = int(pair_budget * MARGIN) - overhead
    running = F.sum("cost").over(Window.partitionBy("query_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0))
    rows = candidates.withColumn("__used", running)
    return rows.groupBy("query_id").agg(F.greatest(F.count_if(F.col("__used") <= room), F.lit(1)).alias("fits"), F.count(F.lit(1)).alias("candidates"))


def request_batches(candidates: DataFrame, size: int | Column) -> DataFrame:
    """Batch number and position in the batch, in input order."""
    at = F.row_number().over(Window.partitionBy("query_id").orderBy("ordinal")) - 1
    size = F.lit(size) if isinstance(size, int) else size
    return candidates.withColumn("batch", F.floor(at / size).cast("long")).withColumn("position", (at % size).cast("long"))


def next_fit_batches(items: DataFrame, state_tokens: int | str, max_items: int | None = None, total_budget: int = TOTAL_BUDGET, pair_budget: int = PAIR_BUDGET) -> DataFrame:
    """Items in order into requests; a request that an item would overfill is closed.

    ``items``: query_id, ordinal, cost. ``state_tokens``: a number, or the column that has each
    query's. Raises where the state alone, or the state and one item, is over its budget. A fold
    over each query's costs, since it is no prefix sum.
    """
    most, limit = max_items or 2**31 - 1, int(total_budget * MARGIN)
    if isinstance(state_tokens, int) and limit <= state_tokens:
        raise ValueError("the state alone is over the budget")
    tokens = F.lit(state_tokens) if isinstance(state_tokens, int) else F.max(state_tokens)
    item = F.struct("ordinal", F.col("cost").cast("long").alias("cost"))
    lists = items.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items"), tokens.cast("long").alias("state"))
    over = F.raise_error(F.lit("the state alone is over the budget")).cast("long")
    lists = lists.withColumn("state", F.when(F.col("state") >= limit, over).otherwise(F.col("state")))
    start = F.expr("named_struct('batch', 0L, 'used', 0L, 'n', 0)")

    def step(a: Column, x: Column) -> tuple[Column, Column]:
        too_much = F.raise_error(F.lit("an item is over the budget beside the state")).cast("long")
        cost = F.when(x["cost"] + F.col("state") > pair_budget, too_much).otherwise(x["cost"])
        close = (a["n"] > 0) & ((a["n"] >= most) | (a["used"] + cost > limit - F.col("state")))
        batch = a["batch"] + close.cast("long")
        used = F.when(close, F.lit(0).cast("long")).otherwise(a["used"]) + cost
        after = F.struct(batch.alias("batch"), used.alias("used"), (F.when(close, F.lit(0)).otherwise(a["n"]) + 1).alias("n"))
        return after, batch

    said = running(F.col("items"), "struct<batch:bigint,used:bigint,n:int>", "bigint", start, step)["said"]
    rows = lists.select("query_id", F.explode(F.arrays_zip(F.col("items"), said.alias("batch"))).alias("x"))
    return rows.select("query_id", F.col("x.items.ordinal").alias("ordinal"), F.col("x.batch").alias("batch"))


def greedy_context(candidates: DataFrame, budget_chars: int = 8000, min_usefulness: float = 1.0, max_redundancy: float = 0.5) -> DataFrame:
    """Decision for each candidate: selected, not_useful, redundant or over_budget; used_chars by query.

    ``candidates``: query_id, ordinal, doc_id, chars, usefulness, redundancy. Taken by
    usefulness falling, then input order; one over budget is passed, later ones may still
    fit. Where none is selected, the first is.
    """
    item = F.struct((-F.coalesce("usefulness", F.lit(0.0))).alias("order"), "ordinal", "doc_id", F.col("chars").cast("long").alias("chars"), F.coalesce("usefulness", F.lit(0.0)).alias("useful"), F.coalesce("redundancy", F.lit(0.0)).alias("redundancy"))
    lists = candidates.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items"))

    def step(used: Column, x: Column) -> tuple[Column, Column]:
        said = F.when(x["useful"] < min_usefulness, "not_useful").when(x["redundancy"] >= max_redundancy, "redundant").when(used + x["chars"] > budget_chars, "over_budget").otherwise("selected")
        return used + F.when(said == "selected", x["chars"]).otherwise(F.lit(0).cast("long")), said

    rows = lists.withColumn("__fold", running(F.col("items"), "bigint", "string", F.lit(0), step)).withColumn("__none", ~F.array_contains("__fold.said", "selected"))
    used = F.when(F.col("__none"), F.get("items", F.lit(0))["chars"]).otherwise(F.col("__fold.state"))
    rows = rows.select("query_id", used.alias("used_chars"), "__none", F.posexplode(F.arrays_zip("items", F.col("__fold.said").alias("said"))).alias("at", "x"))
    return rows.select("query_id", F.col("x.items.ordinal").alias("ordinal"), F.col("x.items.doc_id").alias("doc_id"), F.when(F.col("__none") & (F.col("at") == 0), "selected").otherwise(F.col("x.said")).alias("decision"), "used_chars")


def context_retention(decided: DataFrame) -> DataFrame:
    """What a selection kept over all queries.

    ``decided``: query_id, chars, label, decision.
    """
    kept = F.col("decision") == "selected"
    by_query = decided.groupBy("query_id").agg(
        F.sum("chars").alias("chars"), F.sum(F.when(kept, F.col("chars")).otherwise(0)).alias("kept_chars"),
        F.count(F.lit(1)).alias("docs"), F.count_if(kept).alias("kept_docs"),
        F.sum("label").alias("relevant"), F.sum(F.when(kept, F.col("label")).otherwise(0)).alias("kept_relevant"),
    )
    names = ("chars", "kept_chars", "docs", "kept_docs", "relevant", "kept_relevant")
    return by_query.agg(F.count(F.lit(1)).alias("queries"), *(F.sum(c).cast("long").alias(c) for c in names), F.count_if(F.col("kept_relevant") > 0).alias("answerable"))
