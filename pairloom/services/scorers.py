"""Scorers over a service: typed questions about a batch of candidates, split by budget, answered in tasks."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.text import estimate_tokens
from pairloom.operators import budget, routes
from pairloom.schema import PROBABILITY

from .client import Retry, Transport, served

ANSWER = f"struct<type:string,{PROBABILITY}:double,choice:string,score:double,probabilities:map<string,double>>"


def _question(prompt: dict, **paths: Column) -> Column:
    """A prompt as JSON, with columns in place of ``{name}``."""
    out = F.lit(json.dumps(prompt, ensure_ascii=False))
    for name, value in paths.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def path_of(position: Column) -> Column:
    """Where a candidate's text stands in the state."""
    return F.concat(F.lit("candidates["), position.cast("string"), F.lit("].text"))


def requests(asked: DataFrame, prompt: dict, model: str, max_questions: int | None = None) -> DataFrame:
    """(request_id, body, question_ids) that ask ``prompt`` of every row.

    ``asked``: query_id, batch, position, question_id, question, text. The state is that of the
    whole batch in each request; questions that are too much for one go over several.
    """
    state = routes.request_payload(asked).withColumn("state_tokens", estimate_tokens("state"))
    each = asked.select("query_id", "batch", "question_id", F.col("position").alias("ordinal"), _question(prompt, path=path_of(F.col("position"))).alias("ask"))
    each = each.withColumn("group_id", F.concat_ws("#", "query_id", F.col("batch").cast("string")))
    whole = each.join(state, ["query_id", "batch"])
    sized = whole.select(F.col("group_id").alias("query_id"), "ordinal", estimate_tokens("ask").alias("cost"), "state_tokens")
    split = budget.next_fit_batches(sized, "state_tokens", max_questions).withColumnRenamed("query_id", "group_id").withColumnRenamed("batch", "part")
    rows = whole.join(split, ["group_id", "ordinal"])
    pairs = F.array_sort(F.collect_list(F.struct("ordinal", "question_id", "ask")))
    grouped = rows.groupBy("group_id", "part").agg(F.first("state").alias("state"), pairs.alias("q"))
    items = F.array_join(F.transform("q", lambda x: F.concat(F.lit('"'), F.regexp_replace(x["question_id"], r'(["\\])', r"\\$1"), F.lit('": '), x["ask"])), ", ")
    body = F.concat(F.lit('{"model": ' + json.dumps(model) + ', "state": '), F.col("state"), F.lit(', "questions": {'), items, F.lit("}}"))
    return grouped.select(F.concat_ws("#", "group_id", F.col("part").cast("string")).alias("request_id"), body.alias("body"), F.transform("q", lambda x: x["question_id"]).alias("question_ids"))


def answered(asked: DataFrame, connect: Callable[[], Transport], prompt: dict, model: str, max_questions: int | None = None, retry: Retry | None = None) -> DataFrame:
    """(question_id, answer, error) of every question; both null where the response leaves it out."""
    sent = requests(asked, prompt, model, max_questions)
    said = served(sent, connect, retry=retry)
    rows = sent.select("request_id", F.explode("question_ids").alias("question_id")).join(said, "request_id")
    answers = F.from_json("response", f"struct<answers:map<string,{ANSWER}>>")["answers"]
    return rows.select("question_id", F.try_element_at(answers, F.col("question_id")).alias("answer"), "error")


def probability_scorer(connect: Callable[[], Transport], prompt: dict, model: str = "default", retry: Retry | None = None) -> routes.Scorer:
    """A scorer for :func:`routes.pointwise`: question_id, value and error."""
    return lambda asked: answered(asked, connect, prompt, model, retry=retry).select("question_id", F.col(f"answer.{PROBABILITY}").alias("value"), "error")


def grade_scorer(connect: Callable[[], Transport], prompt: dict, model: str = "default", retry: Retry | None = None) -> routes.Scorer:
    """A scorer of grades for :func:`routes.crossencode`: question_id and score."""
    return lambda asked: answered(asked, connect, prompt, model, retry=retry).select("question_id", F.col("answer.score").alias("score"))


def choice_scorer(pool: DataFrame, connect: Callable[[], Transport], prompt: dict, model: str = "default", retry: Retry | None = None) -> routes.Scorer:
    """A chooser for :func:`routes.compared`: one request a pair; a failed one has no probabilities."""

    def choose(asked: DataFrame) -> DataFrame:
        side = lambda k: pool.select("query_id", F.col("doc_id").alias(f"{k}_id"), F.col("text").alias(k), *([F.col("question")] if k == "left" else []))
        rows = asked.join(side("left"), ["query_id", "left_id"]).join(side("right"), ["query_id", "right_id"])
        texts = F.array(F.struct(F.col("left").alias("text")), F.struct(F.col("right").alias("text")))
        state = F.to_json(F.struct(F.col("question").alias("query"), texts.alias("candidates")))
        ask = _question(prompt, left=path_of(F.lit(0)), right=path_of(F.lit(1)))
        body = F.concat(F.lit('{"model": ' + json.dumps(model) + ', "state": '), state, F.lit(', "questions": {"pair": '), ask, F.lit("}}"))
        said = served(rows.select(F.col("question_id").alias("request_id"), body.alias("body")), connect, retry=retry)
        answers = F.from_json("response", f"struct<answers:map<string,{ANSWER}>>")["answers"]
        said = said.select(F.col("request_id").alias("question_id"), F.try_element_at(answers, F.lit("pair"))["probabilities"].alias("probabilities"))
        return asked.join(said, "question_id", "left")

    return choose


def reranker(connect: Callable[[], Transport], model: str = "default", retry: Retry | None = None) -> routes.Scorer:
    """A service that ranks whole lists, for :func:`routes.hosted_rerank`: query_id, results and error."""

    def rank(lists: DataFrame) -> DataFrame:
        body = F.to_json(F.struct(F.lit(model).alias("model"), F.col("question").alias("query"), "documents"))
        said = served(lists.select(F.col("query_id").alias("request_id"), body.alias("body")), connect, retry=retry)
        found = F.from_json("response", "struct<results:array<struct<index:int,score:double>>>")["results"]
        return said.select(F.col("request_id").alias("query_id"), found.alias("results"), "error")

    return rank


def generator(connect: Callable[[], Transport], system: str, model: str = "default", max_tokens: int = 2048, retry: Retry | None = None) -> routes.Scorer:
    """A service that writes answers, for :func:`answers.answer_queries`: query_id, generated and error."""

    def write(prompts: DataFrame) -> DataFrame:
        body = F.to_json(F.struct(F.lit(model).alias("model"), F.lit(system).alias("system"), F.col("prompt"), F.lit(max_tokens).alias("max_tokens")))
        said = served(prompts.select(F.col("query_id").alias("request_id"), body.alias("body")), connect, retry=retry)
        text = F.from_json("response", "struct<text:string>")["text"]
        return said.select(F.col("request_id").alias("query_id"), F.when(F.col("error").isNull(), F.coalesce(text, F.lit(""))).alias("generated"), "error")

    return write
