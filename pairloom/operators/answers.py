"""Answers from the top passages of a ranking, and how right they are.

Only the ranking differs between pipelines: questions, pools, the number of passages, the prompt
and the generator are the same for all, so a difference in the answers is the ranking's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions import text as T

from . import budget

Generator = Callable[[DataFrame], DataFrame]
TOP_K = 5


def prompts(ranked: DataFrame, queries: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """(query_id, question, golds, evidence_in_prompt, prompt) of every query with a gold answer.

    ``ranked``: query_id, rank, text, label. ``queries``: query_id, question, answers. A query
    without passages is asked all the same.
    """
    asked = queries.filter(F.size(F.coalesce("answers", F.array().cast("array<string>"))) > 0)
    top = ranked.filter(F.col("rank") <= top_k)
    context = F.array_sort(F.collect_list(F.struct("rank", "text")))
    by_query = top.groupBy("query_id").agg(context.alias("context"), (F.max("label") > 0).alias("evidence"))
    passages = F.array_join(F.transform(F.coalesce("context", F.array().cast("array<struct<rank:int,text:string>>")), lambda x: F.concat(F.lit("- "), F.coalesce(x["text"], F.lit("")))), "\n\n")
    body = F.concat(F.lit("# Passages\n"), passages, F.lit("\n\n# Question\n"), F.coalesce("question", F.lit("")))
    rows = asked.join(by_query, "query_id", "left")
    return rows.select("query_id", "question", F.col("answers").alias("golds"), F.coalesce("evidence", F.lit(False)).alias("evidence_in_prompt"), body.alias("prompt"))


def answer_queries(ranked: DataFrame, queries: DataFrame, generator: Generator, top_k: int = TOP_K) -> DataFrame:
    """One row per query with a gold answer: what was generated, whether it is right, and errors.

    The generator gets query_id, question and prompt, and returns query_id, generated and error.
    A failed call is no wrong answer: its row has an error and is left out of means. So is a
    query that the generator returns nothing for.
    """
    asked = prompts(ranked, queries, top_k)
    said = generator(asked.select("query_id", "question", "prompt")).select("query_id", "generated", "error")
    rows = asked.join(said, "query_id", "left")
    rows = rows.withColumn("error", F.when(F.col("error").isNotNull() | F.col("generated").isNotNull(), F.col("error")).otherwise(F.lit("no answer came back")))
    ok = F.col("error").isNull()
    rows = rows.withColumn("answer", F.when(ok, F.col("generated")).otherwise(F.lit("")))
    rows = rows.withColumn("score", T.score_answer(F.col("answer"), F.col("golds")))
    flag = lambda name: F.coalesce(ok & F.col(f"score.{name}"), F.lit(False))
    return rows.select(
        "query_id",
        "question",
        "golds",
        "evidence_in_prompt",
        "answer",
        F.col("score.extracted").alias("extracted"),
        flag("exact").alias("correct"),
        flag("contains").alias("contains"),
        flag("parsed").alias("parsed"),
        F.col("score.matched").alias("matched"),
        "error",
    )


def scripted(answers: DataFrame) -> Generator:
    """A generator that looks answers up: ``answers`` of query_id, generated and error."""
    return lambda asked: asked.select("query_id").join(answers.select("query_id", "generated", "error"), "query_id", "left")


def judged_context(top: DataFrame, usefulness: Callable, redundancy: Callable, budget_chars: int) -> DataFrame:
    """``top`` with chars and the decision of the greedy selection.

    ``top``: query_id, rank, doc_id, label, question and text. ``usefulness`` is a scorer that
    gives score by question_id, and ``redundancy`` one that gives value.
    """
    asked = top.select("query_id", "doc_id", "question", "text", "rank", "label", F.col("rank").cast("long").alias("ordinal"))
    asked = asked.withColumn("question_id", F.concat_ws("/", "query_id", "doc_id")).withColumn("batch", F.lit(0).cast("long")).withColumn("position", F.col("ordinal") - 1)
    said = asked.join(usefulness(asked).select("question_id", F.col("score").alias("usefulness")), "question_id", "left")
    said = said.join(redundancy(asked).select("question_id", F.col("value").alias("redundancy")), "question_id", "left")
    said = said.select("query_id", "ordinal", "doc_id", "label", F.length("text").alias("chars"), "usefulness", "redundancy")
    decided = budget.greedy_context(said, budget_chars).select("query_id", "doc_id", "decision")
    return said.select("query_id", "doc_id", "label", "chars").join(decided, ["query_id", "doc_id"])


def in_context(ranked: DataFrame, decided: DataFrame) -> DataFrame:
    """``ranked`` with the selected passages only, ranked anew in the same order."""
    kept = ranked.join(decided.filter("decision = 'selected'").select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
