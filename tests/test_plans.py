"""Runs, reports and the command line on small datasets, all services played."""

import json

import pytest
from pyspark.sql import functions as F

from pairloom import cli
from pairloom.operators import registry
from pairloom.plans import judge, report, sections
from pairloom.sources import loaders, runs

PAIRS = "dataset string, route string, query_id string, doc_id string, ordinal long, label int, score double"


def saved(spark, path, routes, dataset="small", queries=10):
    """Pairs whose first document of three is relevant, with each route's three scores."""
    rows = [(dataset, r, f"q{q}", f"q{q}-{i}", i, int(i == 0), float(s)) for r, scores in routes.items() for q in range(queries) for i, s in enumerate(scores)]
    runs.save_pairs(spark.createDataFrame(rows, PAIRS), path)


GOOD, POOR = (0.9, 0.4, 0.2), (0.3, 0.6, 0.2)


@pytest.fixture
def dataset(spark, tmp_path):
    rows = [(f"q{q}", f"question {q}?", [f"answer {q}"], f"q{q}-{i}", "title", f"text {i} of {q} " * (i + 1), int(i < 1 + q % 2)) for q in range(8) for i in range(5)]
    spark.createDataFrame(rows, "q_id string, question string, answers array<string>, passage_row_id string, title string, text string, label int").coalesce(1).write.parquet(str(tmp_path / "flat"))
    assert cli.main(["prepare", "--flat", str(tmp_path / "flat"), "--out", str(tmp_path / "data"), "--name", "flat", "--candidates", "4"]) == 0
    pairs = [(f"q{q}/q{q}-{i}", 0.9 - 0.2 * i, float(3 - i % 4), None) for q in range(8) for i in range(5)]
    spark.createDataFrame(pairs, cli.SCRIPTED).write.parquet(str(tmp_path / "scripted"))
    vectors = spark.createDataFrame([(f"q{q}-{i}", [1.0, float(i)]) for q in range(8) for i in range(5)], "doc_id string, vector array<double>")
    vectors.write.parquet(str(tmp_path / "vec/vectors"))
    spark.createDataFrame([(f"q{q}", [1.0, 4.0]) for q in range(8)], "query_id string, query_vector array<double>").write.parquet(str(tmp_path / "vec/query_vectors"))
    said = [(f"q{q}", f"<answer>answer {q}</answer>" if q % 3 else None, None if q % 3 else "throttled") for q in range(8)]
    spark.createDataFrame(said, "query_id string, generated string, error string").write.parquet(str(tmp_path / "answers"))
    return tmp_path


def offline(at):
    return ["--scripted", str(at / "scripted"), "--vectors", str(at / "vec"), "--answers", str(at / "answers")]


# --- rendering ---


def test_numbers_and_differences_are_those_shown():
    assert report.THREE.less(0.931, 0.932) == "\u22120.001" and report.THREE.less(0.5, 0.5) == "+0.000"
    assert report.TWO.less(0.125, 0.114) == "+0.01"  # 0.12 less 0.11, not 0.011 rounded
    assert report.THREE.value(None) == "-" and report.PERCENT.value(0.5) == "50%" and report.POINTS.value(0.4215) in ("42.1%", "42.2%")
    assert report.THREE.difference(0.5, 0.2, {"low": 0.1, "high": 0.4}) == "+0.300 (+0.100 to +0.400)"
    assert report.THREE.span(None, 1.0) == "-"


def test_tables():
    row = {"route": "r", "mean_ndcg": 0.5, "stderr_ndcg": 0.1, "n": 3}
    other = {"route": "s", "mean_ndcg": 0.4, "stderr_ndcg": 0.1, "n": 3}
    text = report.comparison_table([row, other, {"route": "t", "error": "no key"}], "r", ["ndcg"])
    assert "| r | 0.500 \u00b1 0.100 | 3 |" in text and "(\u22120.100)" in text and "no key" in text
    assert "| +4 | 5 | 1 | q | why |" in report.movers_table([{"gain": 4, "was": 5, "now": 1, "query_id": "q", "question": "why"}])
    rows = [{"name": n, "accuracy": a, "stderr": 0.1, "contains": 1.0, "evidence_rate": 0.5, "unparsed": 0, "errors": 1, "scored": 4} for n, a in (("x", 0.5), ("y", 0.75))]
    assert "(+0.250 \u00b1 0.200)" in report.answers_table(rows, "x", {"y": {"mean": 0.25, "stderr": 0.2}})
    assert report.answers_table(rows, "z").startswith("no results of the baseline z; there are x, y")
    assert "one class" in report.judge_table([{"route": "r", "error": "only one class"}])


# --- the judge report ---


def test_report_has_every_section(spark, tmp_path):
    path = str(tmp_path / "pairs")
    saved(spark, path, {"pointwise": GOOD, **dict.fromkeys(("bm25", "embedding", "hosted_rerank", "pointwise_plain"), POOR)})
    text = cli.report_judge(spark, path, ["absent", "small"], "pointwise", "hosted_rerank", 40, 0)
    for title in ("Order within each query", "Scores across queries", "top of the list", "One threshold", "With criteria"):
        assert title in text
    assert "Candidates in one request" not in text and "absent" not in text
    assert "| small | pointwise | 100% | 100% |" in text and "| small | hosted_rerank | 0% | 100% |" in text
    assert "+0.500 (+0.500 to +0.500)" in text  # the mean by query: 1 against 0.5, in all samples


def test_sections_are_left_out_where_a_route_is_absent(spark, tmp_path):
    path = str(tmp_path / "pairs")
    saved(spark, path, {"pointwise": GOOD, "hosted_rerank": POOR})
    saved(spark, path, {"pointwise": GOOD, "pointwise_plain": POOR}, "lone")
    text = cli.report_judge(spark, path, ["small", "lone"], "pointwise", "hosted_rerank", 20, 0)
    assert "With criteria" not in text and "lone" not in text and "| small | pointwise | 10 | 1.000 |" in text
    assert not any(sections.judge_sections(runs.load_pairs(spark, path), ["small"], "pointwise", "nothing", "none", 20, 0).values())


def test_report_fails_where_nothing_is_saved(tmp_path, capsys, spark):
    assert cli.main(["report-judge", str(tmp_path / "none"), "small"]) == 1 and "run judge first" in capsys.readouterr().out


# --- runs ---


def test_baselines_of_a_run_read_texts_once(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(k):
        read.add(1)
        return "red fox " * (k % 3) + "blue sky"

    pool = spark.range(20).select(F.concat(F.lit("q"), (F.col("id") % 4).cast("string")).alias("query_id"), F.col("id").alias("ordinal"), F.col("id").cast("string").alias("doc_id"), (F.col("id") % 3 == 0).cast("int").alias("label"), F.lit("red fox").alias("question"), text("id").alias("text"))
    got = {r["route"]: r for r in judge.run_judge(spark, pool, {}, str(tmp_path / "runs"), "d").collect()}
    assert {r: x["pairs"] for r, x in got.items()} == {"length": 20, "term_overlap": 20, "bm25": 20}
    assert read.value == 20


def test_a_failed_route_is_reported_and_run_again(spark, tmp_path):
    pool = spark.createDataFrame([(f"q{q}", i, f"q{q}-{i}", int(i == 1), "x", "text") for q in range(3) for i in range(3)], "query_id string, ordinal long, doc_id string, label int, question string, text string")
    calls, done = [], []

    def good(rows):
        calls.append("good")
        return rows.withColumn("score", F.col("label") * 1.0)

    def bad(rows):
        calls.append("bad")
        raise RuntimeError("no service\nmore")

    def listed(rows):  # an order that the scores don't give
        return rows.withColumn("score", F.lit(0.5)).withColumn("rank", F.when(F.col("label") == 1, 1).otherwise(F.col("ordinal") + 2).cast("int"))

    path = str(tmp_path / "pairs")
    found = {"pointwise": good, "crossencode": bad, "hosted_rerank": listed}
    for _ in range(2):
        summary, errors = judge.evaluate(spark, pool, found, path, "d", 3, done.append)
    assert calls == ["good", "bad", "bad"] and errors == {"crossencode": "no service"} and done == list(found) * 2
    assert {r["route"]: r["mean_mrr"] for r in summary.collect()} == {"pointwise": 1.0, "hosted_rerank": 1.0}


def test_dilution_is_saved_by_setting(spark, tmp_path):
    rows = [(f"q{q}.", i, f"q{q}.{i}", int(i == 0), f"question {q}", f"text {i}") for q in range(12) for i in range(4)]
    pool = spark.createDataFrame(rows, "query_id string, ordinal long, doc_id string, label int, question string, text string")
    asked = []

    def route(batch):
        def scored(rows):
            asked.append(batch)
            return rows.withColumn("score", F.when(F.col("label") == 1, 0.9).when(F.col("own"), 0.2).otherwise(0.7))

        return scored

    settings, path = ((4, 1), (10, 10)), str(tmp_path / "dilution")
    for _ in range(2):
        got = {r["pool"]: r for r in judge.run_dilution(judge.dilution_pools(pool, settings), route, path).collect()}
    assert asked == [1, 10]
    assert got[4]["count"] == 0 and got[4]["share_at_half"] is None and got[4]["requests"] == 48
    assert got[10]["count"] == 72 and got[10]["share_at_half"] == 1.0 and got[10]["requests"] == 12 and got[10]["pr_auc"] == got[10]["query_pr_auc"] == 1.0
    rows, compare = cli._diluted(spark, path, 10, 0)
    assert len(rows) == 2 and compare is None and "| 10 | 10 | 1.00 | 1.00 | 100% | 12 |" in sections.dilution(rows)
    settings = ((10, 1), (10, 10))
    judge.run_dilution(judge.dilution_pools(pool, settings), route, path).collect()
    text = sections.dilution(*cli._diluted(spark, path, 10, 0))
    assert "All in one request less one by one: by query +0.000 (+0.000 to +0.000), of all" in text


def test_a_killed_run_goes_on_from_its_manifest(spark, tmp_path):
    pool = spark.createDataFrame([(f"q{q}", i, f"q{q}-{i}", int(i == 1), "x", "text") for q in range(3) for i in range(3)], "query_id string, ordinal long, doc_id string, label int, question string, text string")
    path, calls = str(tmp_path / "pairs"), []

    def route(rows):
        calls.append(1)
        return rows.filter("query_id <> 'q2' and not (query_id = 'q1' and ordinal = 0)").withColumn("score", F.col("label") * 1.0)

    # pairs that were written, but not committed: the run was killed in between
    runs.save_pairs(pool.select(F.lit("d").alias("dataset"), F.lit("r").alias("route"), "query_id", "ordinal", "doc_id", "label", F.lit(9.0).alias("score"), F.lit(1).alias("rank")), path)
    assert runs.measured(spark, path, "d") == set()
    for _ in range(2):
        rows, errors = judge.evaluate(spark, pool, {"r": route}, path, "d")
        assert not errors and len(calls) == 1 and runs.measured(spark, path, "d") == {"r"}
    row = rows.first()
    assert (row["failed"], row["dropped"]) == (1, 1) and row["seconds"] > 0
    assert [tuple(r) for r in runs.failed_queries(spark, path).collect()] == [("d", "r", "q2")]
    assert runs.load_pairs(spark, path).count() == 5
    assert "| seconds | failed | dropped |" in report.comparison_table([row.asDict()], "r", judge.RANK_METRICS)


# --- commands ---


def test_judge_and_evaluate_commands(spark, dataset, capsys):
    out = str(dataset / "out")
    args = ["judge", "--data", str(dataset / "data"), "--dataset", "flat", "--out", out, *offline(dataset)]
    assert cli.main(args) == 0
    text = capsys.readouterr().out
    assert all(r in text for r in ("embedding", "hosted_rerank", "pointwise_plain", "crossencode", "bm25"))
    assert cli.main(["report-judge", out, "flat", "--samples", "20"]) == 0 and "With criteria" in capsys.readouterr().out
    ranks = str(dataset / "ranks")
    assert cli.main(["evaluate", "--data", str(dataset / "data/flat"), "--out", ranks, "--candidates", "4", *offline(dataset)]) == 0
    text = capsys.readouterr().out
    assert "| hybrid |" in text and "| pairwise |" in text and text.count("done") == len(registry.STANDARD)
    assert cli.main(["report", "--results", ranks, "--data", str(dataset / "data/flat"), "--movers", "pointwise"]) == 0
    text = capsys.readouterr().out
    assert "| gain |" in text and "question" in text
    assert cli.main(["report", "--results", str(dataset / "nothing")]) == 1
    assert cli.main(["sweep", "--data", str(dataset / "data/flat"), "--out", str(dataset / "sweep"), "--batches", "1,2", *offline(dataset)]) == 0
    assert "pointwise@2" in capsys.readouterr().out


def test_answer_context_and_dilution_commands(spark, dataset, capsys):
    data = str(dataset / "data/flat")
    assert cli.main(["answer", "--data", data, "--out", str(dataset / "said"), *offline(dataset)]) == 0
    text = capsys.readouterr().out
    assert "| embedding | 1.000" in text and "| 3 | 5 |" in text and "| pointwise | 1.000" in text  # three failed calls, five answers
    assert cli.main(["answer", "--data", data, "--out", str(dataset / "said"), "--select", "--routes", "pointwise", *offline(dataset)]) == 0
    text = capsys.readouterr().out
    assert "| pointwise+select | 1.000" in text and "failed" not in text
    assert cli.main(["context", "--data", data, *offline(dataset)]) == 0 and "kept_relevant" in capsys.readouterr().out
    assert cli.main(["dilution", "--data", data, "--out", str(dataset / "dil"), "--settings", "4:1,6:3", *offline(dataset)]) == 0
    assert "| 6 | 3 |" in capsys.readouterr().out


def test_commands_stop_before_work_where_a_service_is_missing(spark, dataset, capsys):
    out = dataset / "never"
    args = ["judge", "--data", str(dataset / "data"), "--dataset", "flat", "--out", str(out), "--scripted", str(dataset / "scripted")]
    assert cli.main(args) == 1 and not out.exists() and "vectors: not configured" in capsys.readouterr().err
    assert cli.main(["check"]) == 0 and "offline" in capsys.readouterr().out
    assert cli.main(["check", "--url", "http://127.0.0.1:9", "--key-env", "NO_SUCH_KEY"]) == 1


def test_prepare_judge_reads_the_public_layout(spark, tmp_path, capsys):
    import gzip

    root = tmp_path / "raw"
    (root / "judged/corpus").mkdir(parents=True)
    (root / "lines.jsonl").write_text(json.dumps({"question": "a", "answer": "x", "positive": ["p"], "negative": ["n"]}) + "\n")
    (root / "judged/qrels.tsv").write_text("1\t0\td1\t1\n1\t0\td2\t0\n")
    (root / "judged/topics.tsv").write_text("1\twhich?\n")
    with gzip.open(root / "judged/corpus/docs-0.jsonl.gz", "wt") as f:
        f.write("\n".join(json.dumps({"docid": d, "title": "T", "text": d}) for d in ("d1", "d2", "d3")))
    assert cli.main(["prepare-judge", "--raw", str(root), "--out", str(tmp_path / "data")]) == 0
    text = capsys.readouterr().out
    assert "lines: 1 queries, 2 pairs, 1 relevant" in text and "judged: 1 queries, 2 pairs, 1 relevant" in text
    assert {r["text"] for r in spark.read.parquet(str(tmp_path / "data/judged/pool")).collect()} == {"T d1", "T d2"}
    assert set(loaders.public_bundle(spark, str(root))) == {"lines", "judged"}


def synthetic(tmp_path, leak=False):
    docs = [{"doc_id": f"a-001-d{i}", "role": "positive" if i == 1 else "negative", "contains_facts": ["f1"] if i == 1 else [], "text": f"alpha {i}"} for i in (1, 2)]
    for name, body in (("gen", {"id": "a-001", "question": "alpha", "required_facts": [], "documents": docs}), ("ver", {"id": "a-001", "verdicts": [{"doc_id": d["doc_id"], "facts_stated": d["contains_facts"], "leak_phrase": leak} for d in docs], "question_checks": {"non_factoid": True}})):
        (tmp_path / name).mkdir(exist_ok=True)
        (tmp_path / name / "a-001.json").write_text(json.dumps(body))
    return str(tmp_path / "gen"), str(tmp_path / "ver")


def test_synthetic_gate(spark, tmp_path, capsys):
    built, verified = synthetic(tmp_path)
    assert cli.main(["synthetic-check", "--built", built, "--verified", verified]) == 0
    synthetic(tmp_path, leak=True)
    assert cli.main(["synthetic-check", "--built", built, "--verified", verified]) == 1 and "leak_phrase" in capsys.readouterr().out
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty/b.json").write_text(json.dumps({"id": "other", "verdicts": [], "question_checks": {}}))
    assert cli.main(["synthetic-check", "--built", built, "--verified", str(tmp_path / "empty")]) == 1 and "unverified" in capsys.readouterr().out
