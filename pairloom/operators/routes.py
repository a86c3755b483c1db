"""Scoring routes: producers of pairs, from vectors, scorers, comparisons or both.

A scorer answers typed questions about candidates. The offline scorer looks answers up in a
scripted table, so every route can be run and tested without a service; a hosted one plugs
in through :mod:`pairloom.services`, which opens its client once per task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.vectors import all_cosines, cosine_of, dot
from pairloom.schema import PROBABILITY

from . import budget, lexical, pairwise, ranking

#: Names of the routes; those that end in probabilities are calibrated (fixed values).
ROUTES = ("embedding", "hosted_rerank", "pointwise", "pointwise_plain", "crossencode", "pairwise", "hybrid", *("length", "term_overlap", "bm25"))
PROBABILISTIC = ("pointwise", "pointwise_plain", "crossencode", "pairwise", "hybrid")
CONFIDENCE, DEFAULT_PROBABILITY, LEVELS = 0.9, 0.5, 4
KEY = ["query_id", "ordinal", "doc_id", "label"]
Scorer = Callable[[DataFrame], DataFrame]


def embedding(candidates: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """Cosine of query and document vectors; ``vectors``: doc_id, vector; ``queries``: query_id, query_vector.

    A norm is taken once a vector, not once a pair.
    """
    norm = lambda c: F.sqrt(dot(F.col(c), F.col(c)))
    have, asked = vectors.withColumn("__n", norm("vector")), queries.withColumn("__q", norm("query_vector"))
    rows = candidates.join(have, "doc_id").join(asked, "query_id")
    return rows.select(*KEY, cosine_of(F.col("query_vector"), F.col("vector"), F.col("__q"), F.col("__n")).alias("score"))


def embedding_of_all(vectors: DataFrame, queries: DataFrame, digits: int | None = None) -> DataFrame:
    """The like for all vectors as candidates of every query, tile by tile; both: id, vector and label."""
    return all_cosines(vectors, queries, digits)


def offline_probability(asked: DataFrame, scripted: DataFrame, default: float = DEFAULT_PROBABILITY) -> DataFrame:
    """``asked`` with ``value``: the scripted one of question_id, or the default."""
    return asked.join(scripted.select("question_id", F.col("value").alias("__v")), "question_id", "left").withColumn("value", F.coalesce("__v", F.lit(default))).drop("__v")


def offline_score(asked: DataFrame, scripted: DataFrame) -> DataFrame:
    """``asked`` with ``score``: the scripted one of question_id, or 0."""
    return offline_probability(asked, scripted, 0.0).withColumnRenamed("value", "score")


def offline_choice(asked: DataFrame, winners: DataFrame, options: tuple[str, ...], confidence: float = CONFIDENCE) -> DataFrame:
    """``asked`` with ``choice`` and its probabilities: the winner's is the confidence, the rest is shared.

    Without a scripted winner the first option wins.
    """
    rest = (1 - confidence) / max(len(options) - 1, 1)
    rows = asked.join(winners.select("question_id", F.col("winner").alias("__w")), "question_id", "left").withColumn("choice", F.coalesce("__w", F.lit(options[0]))).drop("__w")
    p = F.create_map(*(x for o in options for x in (F.lit(o), F.when(F.col("choice") == o, F.lit(confidence)).otherwise(F.lit(rest)))))
    return rows.withColumn("probabilities", p)


def pointwise(candidates: DataFrame, scorer: Scorer, batch_size: int | None = 10, overhead: int = 400) -> DataFrame:
    """A probability per candidate, asked in batches that fit the request; unanswered ones are 0.

    ``candidates``: KEY and text. The scorer gets them with question_id, batch and position,
    and returns question_id and value, and may add error: a query with a failed request has no
    rows then, and is counted by :func:`quality.dropped_pairs`.
    """
    costs = candidates.select("query_id", "ordinal", budget.json_cost(F.col("text")).alias("cost"))
    fits = budget.fitting_batch_size(costs, overhead)
    size = F.col("fits") if batch_size is None else F.least(F.col("fits"), F.lit(batch_size))
    asked = budget.request_batches(candidates.join(fits, "query_id"), size).drop("fits", "candidates").withColumn("question_id", F.concat_ws("/", "query_id", "doc_id"))
    said = scorer(asked)
    answers = said.select("question_id", "value").dropDuplicates(["question_id"])
    rows = asked.join(answers, "question_id", "left").select(*KEY, "batch", "position", F.coalesce("value", F.lit(0.0)).alias("score"))
    if "error" not in said.columns:
        return rows
    failed = asked.join(said.filter("error is not null").select("question_id"), "question_id", "left_semi").select("query_id").distinct()
    return rows.join(failed, "query_id", "left_anti")


def hosted_rerank(candidates: DataFrame, service: Scorer) -> DataFrame:
    """Whole lists ranked by a service in one call each; its order is trusted and not sorted again.

    ``candidates``: KEY, question and text. The service gets query_id, question and documents (in
    input order), and returns query_id, results (array of index and score, best first) and error.
    Candidates that it leaves out have no row, nor have queries that failed or have no candidate.
    """
    docs = F.array_sort(F.collect_list(F.struct("ordinal", "doc_id", "label", "text")))
    lists = candidates.groupBy("query_id").agg(F.first("question").alias("question"), docs.alias("docs"))
    said = service(lists.select("query_id", "question", F.transform("docs", lambda d: d["text"]).alias("documents")))
    found = said.filter("error is null").select("query_id", F.posexplode("results").alias("at", "r"))
    rows = lists.join(found, "query_id").withColumn("d", F.get("docs", F.col("r.index"))).filter("d is not null")
    delta = F.col("r.index") - F.col("at")
    return rows.select("query_id", F.col("d.ordinal").alias("ordinal"), F.col("d.doc_id").alias("doc_id"), F.col("d.label").alias("label"), F.col("r.score").alias("score"), (F.col("at") + 1).alias("rank"), delta.alias("rank_delta"))


def crossencode(candidates: DataFrame, scorer: Scorer, grades: Scorer | None = None) -> DataFrame:
    """One request a pair; ties by the grade, where one is asked for, then by input order."""
    asked = budget.request_batches(candidates, 1).withColumn("question_id", F.concat_ws("/", "query_id", "doc_id"))
    rows = pointwise(candidates, scorer, 1).withColumn("question_id", F.concat_ws("/", "query_id", "doc_id"))
    grade = grades(asked).select("question_id", F.col("score").alias("grade")) if grades else None
    rows = rows.join(grade, "question_id", "left") if grades else rows.withColumn("grade", F.lit(0.0))
    return ranking.ranked(rows.select(*KEY, "score", F.coalesce("grade", F.lit(0.0)).alias("grade")), ["query_id"], ("score", "grade"))


def compared(candidates: DataFrame, chooser: Scorer, opponents: int = pairwise.OPPONENTS, limit: int = pairwise.LIMIT) -> DataFrame:
    """Mean win probability over the scheduled comparisons.

    The chooser gets query_id, left_id, right_id, question_id and adds probabilities of a and b.
    """
    asked = pairwise.pair_schedule(candidates, opponents, limit).withColumn("question_id", F.concat_ws("/", "query_id", "left_id", "right_id"))
    said = chooser(asked).select("query_id", "left_id", "right_id", F.col("probabilities")["a"].alias("p_left"), F.col("probabilities")["b"].alias("p_right"))
    return pairwise.win_rates(candidates, said)


def level_share(score: Column, levels: int = LEVELS) -> Column:
    """A graded score as 0..1."""
    return score / F.lit(float(levels - 1))


def score_fusion(candidates: DataFrame, grades: DataFrame, weight: float = 0.3, levels: int = LEVELS, vector: Column | None = None) -> DataFrame:
    """Graded scores fused with the vector score (moved to 0..1 unless given so), ranked.

    ``candidates``: KEY and vector_score; ``grades``: query_id, doc_id, grade (absent: 0).
    """
    rows = candidates.join(grades, ["query_id", "doc_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0.0)))
    v = ranking.min_max(F.col("vector_score"), ["query_id"]) if vector is None else vector
    rows = rows.withColumn("score", ranking.fused(v, level_share(F.col("grade"), levels), weight))
    return ranking.ranked(rows, ["query_id"])


def baselines(pool: DataFrame, dataset: str = "pool") -> DataFrame:
    return lexical.baseline_scores(pool, dataset)


def known_route(name: str) -> str:
    """``name`` without its batch part (``pointwise@5``, ``pointwise@all``); raises on others."""
    base = name.split("@")[0]
    if base not in ROUTES:
        raise ValueError(f"unknown route {name}; there are {', '.join(ROUTES)}")
    return base


def batch_of(name: str, default: int = 10) -> int | None:
    """Batch size in a route's name; None for all candidates at once."""
    _, _, size = name.partition("@")
    return default if not size else None if size == "all" else int(size)


def request_payload(asked: DataFrame, question_col: str = "question") -> DataFrame:
    """One request a batch: its state (query and candidate texts by position) as JSON."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: F.struct(x["text"].alias("text")))
    rows = asked.groupBy("query_id", "batch").agg(F.first(question_col).alias("query"), texts.alias("candidates"))
    return rows.select("query_id", "batch", F.to_json(F.struct("query", "candidates")).alias("state"))


def parse_answers(rows: DataFrame, json_col: str = "answer") -> DataFrame:
    """Typed answers out of JSON: probability, choice, score or probabilities; an unknown type raises."""
    x = F.from_json(json_col, "type string, value double, choice string, score double, legend array<string>, probabilities map<string,double>")
    kind = F.when(x["type"].isin(PROBABILITY, "choice", "score"), x["type"]).otherwise(F.raise_error(F.concat(F.lit("unknown answer type "), F.coalesce(x["type"], F.lit("none")))))
    return rows.select("*", kind.alias("type"), F.when(x["type"] == PROBABILITY, x["value"]).alias("probability"), F.when(x["type"] == "choice", x["choice"]).alias("choice"), F.when(x["type"] == "score", x["score"]).alias("score"), x["probabilities"].alias("probabilities"))
