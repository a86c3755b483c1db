"""Command line: prepare pools, run routes, answers and dilutions, and report what is saved.

A dataset is a folder with the Parquet tables ``pool`` (query_id, ordinal, doc_id, label, question,
text) and ``queries`` (query_id, question, answers). Without ``--url`` services are played from the
table ``--scripted`` (question_id; value, grade, winner), so that every command runs offline.
"""

from __future__ import annotations

import argparse
import os
import sys
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom import queries
from pairloom.operators import answers, bootstrap, budget, classify, lexical, pools, quality, ranking, registry, routes
from pairloom.plans import judge, report, sections
from pairloom.services import client, preflight, prompts, scorers
from pairloom.sources import loaders, runs

#: Use cases and the operators behind them (documentation).
USE_CASES = {
    "relevance filtering": "operators.ranking.relevance_filter",
    "pointwise scoring": "operators.routes.pointwise",
    "pairwise comparison": "operators.routes.compared",
    "cross-encoding": "operators.routes.crossencode",
    "context selection": "operators.budget.greedy_context",
}
SCRIPTED = "question_id string, value double, grade double, winner string"
#: Routes of the judge run, and of the answer run (fixed values of this command line).
JUDGED = "embedding,hosted_rerank,pointwise,pointwise_plain,crossencode"
ANSWERED = "embedding,hosted_rerank,pointwise"


# --- services ---


def _connect(a: argparse.Namespace, path: str = "") -> partial:
    return partial(client.http, a.url.rstrip("/") + path, os.environ.get(a.key_env, ""))


def _scripted(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return spark.read.schema(SCRIPTED).parquet(a.scripted) if a.scripted else spark.createDataFrame([], SCRIPTED)


def services(spark: SparkSession, a: argparse.Namespace) -> registry.Registry:
    """Routes over the service at ``--url``, or over the scripted table."""
    vectors = None
    if a.vectors:
        vectors = tuple(spark.read.parquet(f"{a.vectors}/{t}") for t in ("vectors", "query_vectors"))
    if not a.url:
        return registry.offline(_scripted(spark, a), vectors)
    ask = _connect(a, "/questions")
    parts = {
        "scorer": lambda: scorers.probability_scorer(ask, prompts.RELEVANT, a.model),
        "plain": lambda: scorers.probability_scorer(ask, prompts.RELEVANT_PLAIN, a.model),
        "grader": lambda: scorers.grade_scorer(ask, prompts.GRADE, a.model),
        "chooser": lambda: lambda pool: scorers.choice_scorer(pool, ask, prompts.BETTER, a.model),
        "reranker": lambda: scorers.reranker(_connect(a, "/rerank"), a.model),
    }
    return registry.Registry(**parts, **({"vectors": lambda: vectors} if vectors else {}))


def checks(a: argparse.Namespace) -> dict:
    """One small request to each service; offline ones need none."""
    if not a.url:
        return dict.fromkeys(("scorer", "reranker", "generator"), lambda: "offline") | ({"vectors": lambda: a.vectors} if a.vectors else {})
    question = {"ok": prompts.RELEVANT_PLAIN | {"instructions": "Is the passage at candidates[0].text relevant to the query?"}}
    state = {"query": "boiling point of water", "candidates": [{"text": "At sea level water boils at 100 degrees Celsius."}]}
    small = {
        "scorer": ("/questions", {"model": a.model, "state": state, "questions": question}),
        "reranker": ("/rerank", {"model": a.model, "query": "boiling point of water", "documents": ["100 degrees"]}),
        "generator": ("/answers", {"model": a.model, "system": prompts.ANSWER, "prompt": "# Passages\n\n# Question\nready?", "max_tokens": 64}),
    }
    found = {name: lambda at=at, body=body: client.ask(_connect(a, at)(), body) for name, (at, body) in small.items()}
    return found | ({"vectors": lambda: a.vectors} if a.vectors else {})


# --- datasets ---


def save_dataset(spark: SparkSession, root: str, name: str, found: DataFrame, candidates: DataFrame) -> dict:
    """Write a dataset's tables; its numbers of queries, pairs and relevant ones."""
    pool = candidates if "question" in candidates.columns else candidates.join(found.select("query_id", "question"), "query_id")
    pool = pool.select("query_id", F.col("position").cast("long").alias("ordinal"), "doc_id", "label", "question", "text")
    pool.write.mode("overwrite").parquet(f"{root}/{name}/pool")
    found.select("query_id", "question", "answers").write.mode("overwrite").parquet(f"{root}/{name}/queries")
    return quality.dataset_summary(spark.read.parquet(f"{root}/{name}/pool")).first().asDict()


def load_dataset(spark: SparkSession, path: str, count: int, seed: int, cap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(pool, queries), a sample of the queries where there are more, capped pools with relevant ones first."""
    pool, found = (spark.read.parquet(f"{path}/{t}") for t in ("pool", "queries"))
    chosen = pools.sample_queries(found.select("query_id").distinct(), count, seed)
    pool, found = (x.join(chosen, "query_id", "left_semi") for x in (pool, found))
    if cap:
        pool = pools.capped_candidates(pool, cap).drop("ordinal").withColumnRenamed("position", "ordinal")
    return pool, found


def _told(summary: dict) -> str:
    return f"{summary['queries']} queries, {summary['pairs']} pairs, {summary['relevant']} relevant"


def prepare(spark: SparkSession, a: argparse.Namespace) -> int:
    found, candidates = loaders.read_flat(spark, a.flat, a.candidates)
    text = queries.T.passage_text(F.col("title"), F.col("text"))
    print(f"{a.name}: {_told(save_dataset(spark, a.out, a.name, found, candidates.withColumn('text', text)))}")
    return 0


def prepare_judge(spark: SparkSession, a: argparse.Namespace) -> int:
    for name, (found, candidates) in loaders.public_bundle(spark, a.raw).items():
        print(f"{name}: {_told(save_dataset(spark, a.out, name, found, candidates))}")
    if a.built:
        found, candidates, _ = loaders.read_synthetic(spark, *a.built)
        print(f"synthetic: {_told(save_dataset(spark, a.out, 'synthetic', found, candidates))}")
    return 0


# --- runs ---


def _ready(a: argparse.Namespace, names: list[str], **more: bool) -> None:
    preflight.preflight(checks(a), preflight.needed(names, **more))


def _failed(errors: dict[str, str]) -> None:
    for name, reason in errors.items():
        print(f"{name} failed: {reason}")


def _compared(rows: list[dict], errors: dict[str, str], baseline: str) -> str:
    return report.comparison_table([*rows, *({"route": n, "error": e} for n, e in errors.items())], baseline, judge.RANK_METRICS)


def evaluate(spark: SparkSession, a: argparse.Namespace, found: dict | None = None) -> int:
    names = a.routes.split(",") if found is None else []
    if found is None:
        _ready(a, names)
        found = services(spark, a).build(names)
    pool, _ = load_dataset(spark, a.data, a.queries, a.seed, a.candidates)
    summary, errors = judge.evaluate(spark, pool, found, a.out, a.name, a.k, lambda n: print(f"{n}: done"))
    rows = sorted((r.asDict() for r in summary.collect()), key=lambda r: list(found).index(r["route"]))  # a row a route
    print(_compared(rows, errors, a.baseline if names else next(iter(found))))
    return 0


def sweep(spark: SparkSession, a: argparse.Namespace) -> int:
    _ready(a, ["pointwise"])
    return evaluate(spark, a, judge.sweep(services(spark, a), [int(n) for n in a.batches.split(",")]))


def answer(spark: SparkSession, a: argparse.Namespace) -> int:
    names = a.routes.split(",")
    _ready(a, names, select=a.select, generate=True)
    made = services(spark, a)
    found = made.build(names)
    if a.select:
        found = judge.selected_routes(found, made.part("grader"), made.part("scorer"), a.top_k, a.budget)
    pool, asked = load_dataset(spark, a.data, a.queries, a.seed, a.candidates)
    if a.url:
        generator = scorers.generator(_connect(a, "/answers"), prompts.ANSWER, a.model)
    else:
        none = "query_id string, generated string, error string"
        generator = answers.scripted(spark.read.schema(none).parquet(a.answers) if a.answers else spark.createDataFrame([], none))
    rows, paired, errors = judge.answer_runs(spark, pool, asked, found, generator, a.out, a.name, a.top_k)
    print(f"wording {prompts.wording_id(prompts.ANSWER)}, {a.top_k} passages")
    print(report.answers_table(rows, next(iter(found)), paired))
    _failed(errors)
    return 0


def run_judge(spark: SparkSession, a: argparse.Namespace) -> int:
    names = a.routes.split(",")
    _ready(a, names)
    pool, _ = load_dataset(spark, f"{a.data}/{a.dataset}", a.queries, a.seed)
    metrics = judge.run_judge(spark, pool, services(spark, a).build(names), a.out, a.dataset)
    print(report.judge_table(r.asDict() for r in metrics.collect()))  # a row a route
    return 0


def dilution(spark: SparkSession, a: argparse.Namespace) -> int:
    _ready(a, ["pointwise"])
    settings = tuple(tuple(map(int, x.split(":"))) for x in a.settings.split(","))
    pool, _ = load_dataset(spark, a.data, 2**31 - 1, a.seed)
    made = services(spark, a)
    rows = judge.run_dilution(judge.dilution_pools(pool, settings, a.seed), lambda n: made.build([f"pointwise@{n}"])[f"pointwise@{n}"], a.out)
    print(sections.dilution([r.asDict() for r in rows.orderBy("pool", "batch").collect()]))  # a row a setting
    return 0


# --- reports ---


def _diluted(spark: SparkSession, path: str, samples: int, seed: int) -> tuple[list[dict], dict | None] | None:
    names = sorted(runs.measured(spark, path, "dilution"), key=lambda n: [int(x.partition("=")[2]) for x in n.split(",")])
    if not names:
        return None
    saved = runs.load_pairs(spark, path).filter(F.col("dataset") == "dilution")
    sizes = {n: tuple(int(x.partition("=")[2]) for x in n.split(",")) for n in names}
    pools_ = {sizes[n]: saved.filter(F.col("route") == n) for n in names}
    rows = judge.run_dilution(pools_, lambda _: None, path).orderBy("pool", "batch").collect()  # all are saved: no route is asked
    return [r.asDict() for r in rows], judge.dilution_difference(path, spark, samples, seed)


def report_judge(spark: SparkSession, path: str, datasets: list[str], first: str, second: str, samples: int, seed: int, plain: str = "pointwise_plain", dilution_path: str | None = None) -> str:
    """Every section of the saved datasets, in the order given; raises where none is saved."""
    diluted = _diluted(spark, dilution_path, samples, seed) if dilution_path and runs.exists(spark, dilution_path) else None
    found = runs.datasets(spark, path, datasets)
    return report.report(sections.judge_sections(runs.load_pairs(spark, path), found, first, second, plain, samples, seed, diluted))


def report_ranks(spark: SparkSession, a: argparse.Namespace) -> int:
    """The comparison of saved runs: of each route the last run that has it, and the queries that rose."""
    parts = []
    for path in a.results.split(","):
        parts += [(path, r) for r in sorted(runs.measured(spark, path, a.name))]
    last = {route: path for path, route in parts}  # a later run's route replaces an earlier one's
    if not last:
        print(f"nothing of {a.name} is saved in {a.results}")
        return 1
    pairs = None
    for route, path in last.items():
        one = judge.in_saved_order(runs.load_pairs(spark, path).filter((F.col("dataset") == a.name) & (F.col("route") == route))).select("dataset", "route", *routes.KEY, "score")
        pairs = one if pairs is None else pairs.unionByName(one)
    by_query, summary = judge.evaluate_routes(pairs, a.k)
    rows = [r.asDict() for r in summary.orderBy("route").collect()]  # a row a route
    print(report.comparison_table(rows, a.baseline, judge.RANK_METRICS))
    uneven = {r["route"]: r["queries"] for r in quality.inconsistent_query_counts(summary.select("route", F.col("n").alias("queries"))).collect()}
    if uneven:
        print(f"routes differ in their queries: {uneven}")
    if {a.baseline, a.movers} <= set(last):
        named = by_query.join(spark.read.parquet(f"{a.data}/queries").select("query_id", "question"), "query_id") if a.data else by_query.withColumn("question", F.lit(""))
        before, after = (named.filter(F.col("route") == r) for r in (a.baseline, a.movers))
        print(report.movers_table(r.asDict() for r in ranking.movers(before, after, a.limit).collect()))
    return 0


def context(spark: SparkSession, a: argparse.Namespace) -> int:
    """What selection leaves of the first passages of each query."""
    _ready(a, ["pointwise"], select=True)
    pool, _ = load_dataset(spark, a.data, a.queries, a.seed, a.candidates)
    made = services(spark, a)
    top = registry.in_rank_order(made.build(["pointwise"])["pointwise"](pool)).filter(F.col("rank") <= a.top_k).select("query_id", "doc_id", "label", "rank")
    texts = pool.select("query_id", "doc_id", "question", "text")
    decided = answers.judged_context(top.join(texts, ["query_id", "doc_id"]), made.part("grader"), made.part("scorer"), a.budget)
    kept = budget.context_retention(decided).first().asDict()
    print(report.grid(kept, [kept.values()]))
    return 0


def synthetic_check(spark: SparkSession, built: list[str], verified: list[str]) -> int:
    """Baselines' metrics and disagreements; 1 if there is any, or an unverified question."""
    _, candidates, facts = loaders.read_synthetic(spark, *built)
    verdicts, known = loaders.read_verdicts(spark, *verified)
    print(report.judge_table(r.asDict() for r in classify.judge_metrics(lexical.baseline_scores(candidates, "synthetic"), False).collect()))
    findings = quality.verification_findings(facts, verdicts, known)
    missing = quality.unverified(facts, known)
    for r in findings.collect():  # findings of a generator's questions, to be read one by one
        print(r["id"], r["doc_id"] or "", r["kind"], r["note"] or "")
    for r in missing.collect():
        print(r["id"], "unverified")
    return int(not findings.isEmpty() or not missing.isEmpty())


# --- the parser ---


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pairloom")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, do, *options: tuple, service: bool = False) -> None:
        c = sub.add_parser(name)
        c.set_defaults(do=do)
        for flag, kind in options:
            c.add_argument(flag, **(kind if isinstance(kind, dict) else {"default": kind, "type": type(kind)}))
        if service:
            for flag, default in (("--url", ""), ("--key-env", "SERVICE_KEY"), ("--model", "default"), ("--scripted", ""), ("--vectors", ""), ("--answers", "")):
                c.add_argument(flag, default=default)

    must, some = {"required": True}, {"nargs": "+", "required": True}
    data, out, name, seed = ("--data", must), ("--out", must), ("--name", "flat"), ("--seed", 0)
    command("queries", None)
    command("usecases", None)
    command("run", lambda spark, a: queries.queries()[a.query](spark, a.sf_dir).show(50, truncate=60), ("query", {}), ("sf_dir", {}))
    command("prepare", prepare, ("--flat", must), out, name, ("--candidates", 100))
    command("prepare-judge", prepare_judge, ("--raw", must), out, ("--built", {"nargs": "*", "default": []}))
    ranks = (data, out, name, ("--queries", 100), ("--candidates", 30), ("--k", 10), seed)
    command("evaluate", evaluate, *ranks, ("--routes", ",".join(registry.STANDARD)), ("--baseline", "embedding"), service=True)
    command("sweep", sweep, *ranks, ("--batches", "1,5,10,25,100"), service=True)
    select = {"action": "store_true"}
    command("answer", answer, *ranks, ("--routes", ANSWERED), ("--top-k", 5), ("--select", select), ("--budget", 1500), service=True)
    command("judge", run_judge, data, out, ("--dataset", must), ("--routes", JUDGED), ("--queries", 10_000), seed, service=True)
    settings = ",".join(f"{n}:{b}" for n, b in judge.DILUTIONS)
    command("dilution", dilution, data, out, ("--settings", settings), seed, service=True)
    command("context", context, data, ("--queries", 50), ("--candidates", 30), ("--top-k", 10), ("--budget", 1500), seed, service=True)
    command("synthetic-check", lambda spark, a: synthetic_check(spark, a.built, a.verified), ("--built", some), ("--verified", some))
    headline = (("--first", "pointwise"), ("--second", "hosted_rerank"), ("--plain", "pointwise_plain"))
    draws = (("--samples", bootstrap.SAMPLES), ("--seed", bootstrap.SEED))
    command("report-judge", _report_judge, ("path", {}), ("datasets", {"nargs": "+"}), *headline, *draws, ("--dilution", ""))
    command("report", report_ranks, ("--results", must), name, ("--data", ""), ("--k", 10), ("--baseline", "embedding"), ("--movers", "crossencode"), ("--limit", 10))
    command("check", _check, service=True)
    return p


def _report_judge(spark: SparkSession, a: argparse.Namespace) -> int:
    try:
        print(report_judge(spark, a.path, a.datasets, a.first, a.second, a.samples, a.seed, a.plain, a.dilution or None))
    except ValueError as e:
        print(f"{e}: run judge first")
        return 1
    return 0


def _check(spark: SparkSession, a: argparse.Namespace) -> int:
    for name, said in preflight.preflight(checks(a), {"scorer"}).items():
        print(f"{name}: {said}")
    return 0


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    if a.command == "queries":
        print("\n".join(queries.queries()))
        return 0
    if a.command == "usecases":
        print(report.grid(["use case", "operator"], USE_CASES.items()))
        return 0
    env = loaders.parse_env(open(".env").read(), dict(os.environ)) if os.path.isfile(".env") else {}
    os.environ.update(env)
    try:
        return a.do(SparkSession.builder.getOrCreate(), a) or 0
    except preflight.NotReady as e:
        print(f"not ready: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
