"""Folds, schedules, lexical scores, quality checks, sources and rendering."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from pairloom import schema
from pairloom.functions import text as T
from pairloom.functions import vectors
from pairloom.functions.vectors import cosine
from pairloom.operators import budget, lexical, pairwise, pools, quality, routes
from pairloom.plans import judge
from pairloom.sources import loaders, records, runs


def test_pair_schedule_properties(spark):
    sizes = [1, 2, 3, 11, 12, 13, 30, 66, 70]
    rows = [(f"q{n}", i, f"{i}") for n in sizes for i in range(n)]
    got = {n: [] for n in sizes}
    for r in pairwise.pair_schedule(spark.createDataFrame(rows, "query_id string, ordinal long, doc_id string")).orderBy("query_id", "ordinal").collect():
        got[int(r["query_id"][1:])].append((int(r["left_id"]), int(r["right_id"])))
    for n, pairs in got.items():
        possible = n * (n - 1) // 2
        assert len({frozenset(p) for p in pairs}) == len(pairs) <= pairwise.LIMIT  # none twice, cut at the limit
        assert all(a != b and max(a, b) < n for a, b in pairs)
        if possible <= pairwise.LIMIT:
            assert pairs == list(itertools.combinations(range(n), 2))
        else:
            apart = [(b - a) % n for a, b in pairs]
            assert apart == sorted(apart) and set(apart) <= {1, 2, 3}  # the nearest on the ring first
            assert len(pairs) == min(pairwise.LIMIT, 3 * n)
            assert all([a for a, b in pairs if (b - a) % n == d] == list(range(apart.count(d))) for d in set(apart))


def test_greedy_context_skips_and_falls_back(spark):
    rows = [("a", 0, "x", 600, 3.0, 0.0), ("a", 1, "y", 600, 2.0, 0.0), ("a", 2, "z", 300, 1.0, 0.0), ("a", 3, "w", 10, 1.0, 0.9), ("b", 0, "u", 50, 0.1, 0.0), ("b", 1, "v", 70, 0.5, 0.0)]
    got = budget.greedy_context(spark.createDataFrame(rows, "query_id string, ordinal long, doc_id string, chars long, usefulness double, redundancy double"), 1000).collect()
    assert {r["doc_id"]: r["decision"] for r in got} == {"x": "selected", "y": "over_budget", "z": "selected", "w": "redundant", "u": "not_useful", "v": "selected"}
    assert {r["query_id"]: r["used_chars"] for r in got} == {"a": 900, "b": 70}


def test_next_fit_equals_loop(spark):
    rng = random.Random(4)
    costs = [rng.randrange(1, 300) for _ in range(60)]
    room, out, used, n, batch = int(2000 * 0.9) - 1000, [], 0, 0, 0
    for c in costs:
        if n and (n >= 5 or used + c > room):
            used, n, batch = 0, 0, batch + 1
        used, n = used + c, n + 1
        out.append(batch)
    rows = spark.createDataFrame([("q", i, c) for i, c in enumerate(costs)], "query_id string, ordinal long, cost long")
    got = budget.next_fit_batches(rows, 1000, 5, 2000, 5000).orderBy("ordinal").collect()
    assert [r["batch"] for r in got] == out
    with pytest.raises(ValueError):
        budget.next_fit_batches(rows, 1900, None, 2000)


def test_bm25_keeps_documents_without_a_hit(spark):
    rows = [("q", 0, "a", 1, "alpha beta", "alpha alpha gamma"), ("q", 1, "b", 0, "alpha beta", "delta"), ("q", 2, "c", 0, "alpha beta", "")]
    got = {r["doc_id"]: r["score"] for r in lexical.bm25(spark.createDataFrame(rows, "query_id string, ordinal long, doc_id string, label int, question string, text string")).collect()}
    import math

    idf, average = math.log((3 - 1 + 0.5) / 1.5 + 1), 4 / 3
    assert got["a"] == pytest.approx(idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / average)))
    assert got["b"] == got["c"] == 0.0


def test_baselines_equal_brute_force(spark):
    import math
    import re
    import unicodedata

    rng = random.Random(4)
    words = ["red", "fox", "Ｒｅｄ", "東京", "東京都", "カタカナ", "ｶﾀ", "x", "7a", "naïve"]
    said = lambda n: "".join(rng.choice(words) + rng.choice([" ", "-", ""]) for _ in range(n))
    asked = {q: said(6) for q in ("q1", "q2")} | {"q3": "- x", "q4": None}
    rows = [(q, k, f"{q}{k}", k % 2, a, [None, "", "x"][k] if k < 3 else said(rng.randrange(30))) for q, a in asked.items() for k in range(12)]
    bag = lambda t: re.findall(r"[一-鿿]{2,}|[゠-ヿ]{2,}|[A-Za-z0-9]{2,}", unicodedata.normalize("NFKC", t or ""))
    want = {}
    for q, a in asked.items():
        own = [(d, t, bag(t)) for x, _, d, _, _, t in rows if x == q]
        terms, mean = list(dict.fromkeys(bag(a))), sum(len(b) for *_, b in own) / len(own)
        for d, t, b in own:
            df = {w: sum(w in x for *_, x in own) for w in terms}
            want["bm25", d] = sum(math.log((len(own) - df[w] + 0.5) / (df[w] + 0.5) + 1) * b.count(w) * 2.5 / (b.count(w) + 1.5 * (0.25 + 0.75 * len(b) / mean)) for w in terms if w in b)
            want["term_overlap", d] = 0.0 if not terms else None if t is None else sum(w in b for w in terms) / len(terms)
            want["length", d] = None if t is None else float(len(t))
    pool = spark.createDataFrame(rows, "query_id string, ordinal long, doc_id string, label int, question string, text string")
    got = {(r["route"], r["doc_id"]): r["score"] for r in lexical.baseline_scores(pool).collect()}
    none = {k for k, v in want.items() if v is None}
    assert none and {k for k, v in got.items() if v is None} == none
    assert {k: v for k, v in got.items() if k not in none} == pytest.approx({k: v for k, v in want.items() if k not in none}, abs=1e-12)
    assert {r["doc_id"]: r["score"] for r in lexical.bm25(pool).collect()} == {d: v for (r, d), v in got.items() if r == "bm25"}


def test_text_functions(spark):
    row = spark.createDataFrame([("ＡＢ ｶﾀｶﾅ 漢字文 x 12", "「Ａ・Ｂ」　c-D", "no tag", " 東京 ")], "a string, b string, c string, d string")
    got = row.select(T.terms(F.col("a")).alias("t"), T.normalise_answer(F.col("b")).alias("n"), T.extract_answer(F.col("c")).alias("e"), T.estimate_tokens(F.lit("東京abcde")).alias("k"), T.strip(F.col("d")).alias("s")).first()
    assert got["t"] == ["AB", "カタカナ", "漢字文", "12"] and got["n"] == "abcd" and got["e"] is None
    assert got["k"] == int((2 + 2) * 1.25) and got["s"] == "東京"


def test_exact_answers_win_over_containment(spark):
    row = spark.createDataFrame([("<answer>加藤シゲアキ</answer>", ["加藤", "加藤シゲアキ", " "])], "g string, golds array<string>")
    s = row.select(T.score_answer(F.col("g"), F.col("golds")).alias("s")).first()["s"]
    assert (s["exact"], s["matched"]) == (True, "加藤シゲアキ")


def test_cosine(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in rows.select(cosine(F.col("a"), F.col("b"))).collect()] == [pytest.approx(2**-0.5), 0.0]


def test_merge_never_loses_a_success(spark):
    rows = spark.createDataFrame([("a", 1, None, 1.0), ("a", 2, "failed", None), ("b", 1, "failed", None), ("b", 2, "again", None)], "route string, part int, error string, value double")
    got = {r["route"]: (r["part"], r["error"]) for r in quality.merge_results(rows).collect()}
    assert got == {"a": (1, None), "b": (2, "again")}


def test_one_candidate_keeps_its_score(spark):
    rows = spark.createDataFrame([("a", 0, "x", 1, 0.7), ("b", 0, "y", 1, 0.6), ("b", 1, "z", 0, 0.9)], "query_id string, ordinal long, doc_id string, label int, score double")
    verdicts = spark.createDataFrame([("b", "y", "z", 0.2, 0.8)], "query_id string, left_id string, right_id string, p_left double, p_right double")
    assert {r["doc_id"]: r["score"] for r in pairwise.win_rates(rows, verdicts).collect()} == {"x": 0.7, "y": 0.2, "z": 0.8}


def test_nearest_equals_brute_force(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(vectors, "QUERY_TILE", 4)
    monkeypatch.setattr(vectors, "ROW_TILE", 16)
    x = np.random.default_rng(3).integers(-2, 3, (90, 3)).astype(float)  # with ties and zero vectors
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(None, [1.0, 0.0, 0.0]), (500, None)], "id long, vector array<double>")
    got = {}
    for r in vectors.nearest(table, table.filter("id % 9 = 0"), 5).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["id"]
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    for q in range(0, 90, 9):
        share = np.round(unit @ unit[q], 12)
        want = sorted(range(90), key=lambda i: (-share[i], i))[:5]
        assert [got[q][r] for r in range(1, 6)] == want
    assert vectors.nearest(table.limit(0), table, 5).count() == 0


def test_long_folds_equal_a_loop(spark):
    rng = random.Random(2)
    costs = [rng.randrange(1, 60) for _ in range(1500)]
    items = spark.createDataFrame([("q", i, c) for i, c in enumerate(costs)] + [("p", 0, 5)], "query_id string, ordinal long, cost long")
    got = {(r["query_id"], r["ordinal"]): r["batch"] for r in budget.next_fit_batches(items, 10, 7, total_budget=200, pair_budget=100).collect()}
    batch = used = n = 0
    for i, c in enumerate(costs):
        if n and (n >= 7 or used + c > 170):
            batch, used, n = batch + 1, 0, 0
        used, n = used + c, n + 1
        assert got["q", i] == batch
    assert got["p", 0] == 0 and len(got) == 1501


@pytest.mark.parametrize("sizes", [[300, 1, 1, 2, 5], [3], [2, 2], [1] * 40])
def test_distractors_equal_a_walk_round_the_ring(spark, sizes):
    import hashlib

    place = lambda *x: int(hashlib.md5(":".join(x).encode()).hexdigest()[:8], 16)
    rows = [(f"q{q}", f"d{i}", "t", 1) for q, n in enumerate(sizes) for i in range(n)]
    table = spark.createDataFrame(rows, "query_id string, doc_id string, text string, label int")
    got = sorted((r["query_id"], r["doc_id"], r["own"]) for r in pools.distractor_padding(table, 9, 4).collect())
    want = [(q, d, True) for q, d, *_ in rows]
    for q, n in ((f"q{k}", n) for k, n in enumerate(sizes)):
        start = place("4", "query", q)
        ring = sorted(((place("4", "doc", o, d) - start) % (1 << 32), d, o) for o, d, *_ in rows)
        want += [(q, d, False) for _, d, o in [x for x in ring if x[2] != q][: max(0, 9 - n)]]
    assert got == sorted(want)


def test_distractors_are_foreign_and_fill_up(spark):
    rows = [(f"q{q}", f"q{q}-{i}", "t", 1) for q in range(12) for i in range(5)]
    got = pools.distractor_padding(spark.createDataFrame(rows, "query_id string, doc_id string, text string, label int"), 20).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r)
    assert {q: len(x) for q, x in by.items()} == {f"q{q}": 20 for q in range(12)}
    assert all(r["label"] == 0 and not r["doc_id"].startswith(r["query_id"] + "-") for r in got if not r["own"])
    assert all(len({r["doc_id"] for r in x}) == 20 for x in by.values())


def test_offline_choice_shares_the_rest(spark):
    asked = spark.createDataFrame([("x",), ("y",)], "question_id string")
    got = routes.offline_choice(asked, spark.createDataFrame([("y", "b")], "question_id string, winner string"), ("a", "b", "c")).orderBy("question_id").collect()
    assert got[0]["choice"] == "a" and got[1]["probabilities"] == {"a": pytest.approx(0.05), "b": 0.9, "c": pytest.approx(0.05)}


def test_route_names():
    assert routes.batch_of("pointwise@all") is None and routes.batch_of("pointwise@5") == 5 and routes.batch_of("pointwise") == 10
    with pytest.raises(ValueError):
        routes.known_route("nothing")
    

def synthetic(tmp_path, role="positive"):
    docs = [{"doc_id": "a-001-d1", "role": role, "contains_facts": ["f1"], "text": "one"}, {"doc_id": "a-001-d2", "role": "negative", "contains_facts": [], "near_miss": "x", "text": "two"}]
    (tmp_path / "gen").mkdir(exist_ok=True)
    (tmp_path / "gen/a-001.json").write_text(json.dumps({"id": "a-001", "domain": "d", "question_type": "reason", "question": "why", "required_facts": [{"id": "f1", "fact": "f"}], "documents": docs, "reference_answer": "r"}))
    return str(tmp_path / "gen")


def test_synthetic_records(spark, tmp_path):
    queries, candidates, built = loaders.read_synthetic(spark, synthetic(tmp_path))
    assert queries.first()["category"] == "reason"
    assert {r["doc_id"]: r["label"] for r in candidates.collect()} == {"a-001-d1": 1, "a-001-d2": 0}
    (tmp_path / "ver").mkdir()
    (tmp_path / "ver/a-001.json").write_text(json.dumps({"id": "a-001", "verdicts": [{"doc_id": "a-001-d1", "facts_stated": ["f2"], "leak_phrase": True, "note": "n"}], "question_checks": {"needs_multiple_docs": False, "note": "m"}}))
    verdicts, checks = loaders.read_verdicts(spark, str(tmp_path / "ver"))
    assert sorted(r["kind"] for r in quality.verification_findings(built, verdicts, checks).collect()) == ["fact_mismatch", "leak_phrase", "missing_verdict", "needs_multiple_docs"]
    loaders.write_views(spark, synthetic(tmp_path), str(tmp_path / "views"))
    loaders.write_views(spark, synthetic(tmp_path), str(tmp_path / "views"))
    [view] = spark.read.parquet(str(tmp_path / "views")).collect()
    assert set(view["documents"][0].asDict()) == {"doc_id", "text"}


def test_contradicting_or_broken_records_raise(spark, tmp_path):
    with pytest.raises(Exception, match="disagree"):
        loaders.read_synthetic(spark, synthetic(tmp_path, "negative"))[1].collect()
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/x.json").write_text("{")
    with pytest.raises(Exception, match="x.json"):
        loaders.read_synthetic(spark, str(tmp_path / "bad"))[0].select("query_id").collect()


def test_jsonl_ids_count_dropped_lines(spark, tmp_path):
    lines = [{"question": "a", "answer": "x", "positive": ["p"], "negative": ["n", "m"]}, {"question": "b", "answer": "y", "positive": [], "negative": ["n"]}, {"question": "c", "answer": "", "positive": ["q"], "negative": []}]
    (tmp_path / "x.jsonl").write_text("\n\n".join(map(json.dumps, lines)) + "\n")
    queries, candidates = loaders.read_jsonl(spark, str(tmp_path / "x.jsonl"))
    assert {r["query_id"]: list(r["answers"]) for r in queries.collect()} == {"jr-000": ["x"], "jr-002": []}
    assert {(r["doc_id"], r["label"]) for r in candidates.collect()} == {("jr-000-c00", 1), ("jr-000-c01", 0), ("jr-000-c02", 0), ("jr-002-c00", 1)}


def test_judged_sources(spark, tmp_path):
    (tmp_path / "q.tsv").write_text('1\t0\td1\t1\n1\t0\td2\t0\n')
    (tmp_path / "t.tsv").write_text('1\t"a ""quoted"" question"\n')
    (tmp_path / "c.jsonl").write_text(json.dumps({"docid": "d1", "title": "t", "text": "x"}) + "\n" + json.dumps({"docid": "d9", "title": "t", "text": "x"}) + "\n")
    from pairloom import schema

    qrels, topics = loaders.read_tsv(spark, str(tmp_path / "q.tsv"), schema.QRELS), loaders.read_tsv(spark, str(tmp_path / "t.tsv"), schema.TOPICS)
    passages = loaders.read_corpus(spark, str(tmp_path / "c.jsonl"), loaders.judged_ids(qrels))
    assert [r["docid"] for r in passages.collect()] == ["d1"]
    assert loaders.judged_pairs(qrels, passages, topics).first()["question"] == 'a "quoted" question'
    with pytest.raises(ValueError, match="d2"):
        loaders.load_judged(qrels, passages, topics)


def test_corpus_keeps_the_last_of_repeated_passages(spark, tmp_path):
    import gzip

    (tmp_path / "c").mkdir()
    for n, texts in (("docs-0", ["old", "other"]), ("docs-1", ["new", "newest"])):
        lines = [{"docid": "d1", "title": "t", "text": t} for t in texts] + [{"docid": n, "title": "", "text": n}]
        with gzip.open(tmp_path / f"c/{n}.jsonl.gz", "wt") as f:
            f.write("\n".join(map(json.dumps, lines)))
    wanted = spark.createDataFrame([("d1",), ("docs-0",)], "docid string")
    got = {r["docid"]: r["text"] for r in loaders.read_corpus(spark, str(tmp_path / "c"), wanted).collect()}
    assert got == {"d1": "newest", "docs-0": "docs-0"}
    at = str(tmp_path / "cache")
    assert {r["docid"]: r["text"] for r in loaders.cached_passages(spark, at, str(tmp_path / "c"), wanted).collect()} == got
    assert loaders.cached_passages(spark, at, "/nowhere", wanted.limit(1)).count() == 1  # read from the cache


def test_lines_are_numbered_over_splits_and_files(spark, tmp_path):
    (tmp_path / "t").mkdir()
    want = []
    for name in ("a", "b"):
        lines = [f"{name}{i} " + "x" * (i % 50) for i in range(400)]
        (tmp_path / f"t/{name}.txt").write_text("\n\n".join(lines) + "\n \n")
        want += lines
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = loaders.numbered_lines(spark, str(tmp_path / "t")).orderBy("at").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["line"] for r in got] == want and [r["at"] for r in got] == list(range(800))


def test_request_payload_and_answers(spark):
    asked = spark.createDataFrame([("q", 0, 1, "b", "why"), ("q", 0, 0, "a \"x\"", "why"), ("q", 1, 0, "c", "why")], "query_id string, batch int, position int, text string, question string")
    got = {r["batch"]: json.loads(r["state"]) for r in routes.request_payload(asked).collect()}
    assert got[0] == {"query": "why", "candidates": [{"text": 'a "x"'}, {"text": "b"}]} and got[1]["candidates"] == [{"text": "c"}]
    rows = spark.createDataFrame([('{"type": "%s", "value": 0.5}' % schema.PROBABILITY,), ('{"type": "choice", "choice": "a", "probabilities": {"a": 1}}',)], "answer string")
    assert [(r["probability"], r["choice"]) for r in routes.parse_answers(rows).collect()] == [(0.5, None), (None, "a")]
    with pytest.raises(Exception, match="unknown answer type"):
        routes.parse_answers(spark.createDataFrame([('{"type": "other"}',)], "answer string")).collect()


def test_flat_rows_last_question_wins(spark):
    rows = [("q", "old", ["a"], "10", "", "t", 0, 0), ("q", "new", ["b"], "9", "", "t", 1, 1), ("r", "x", [], "1", "", "t", 0, 2)]
    queries, candidates = loaders.flat_queries(spark.createDataFrame(rows, "q_id string, question string, answers array<string>, passage_row_id string, title string, text string, label int, ordinal long"), 1)
    assert [r["question"] for r in queries.collect()] == ["new"] and [r["doc_id"] for r in candidates.collect()] == ["9"]


def test_env_file():
    assert loaders.parse_env("# c\nA='x'\nB=2\n", {"B": "1"}) == {"A": "x", "B": "1"}
    with pytest.raises(ValueError, match="line 1"):
        loaders.parse_env("nothing", {})


def test_runs_resume_by_route(spark, tmp_path):
    pool = spark.createDataFrame([(f"q{q}", i, f"q{q}-{i}", int(i == 0), "alpha", "alpha beta" if i == 0 else "gamma") for q in range(3) for i in range(4)], "query_id string, ordinal long, doc_id string, label int, question string, text string")
    calls = []

    def good(rows):
        calls.append(1)
        return rows.withColumn("score", F.col("label") * 0.9)

    def bad(rows):
        raise RuntimeError("no service")

    path = str(tmp_path / "pairs")
    found = {"pointwise": good, "crossencode": bad}
    judge.run_judge(spark, pool, found, path, "d")
    got = {r["route"]: r for r in judge.run_judge(spark, pool, found, path, "d").collect()}
    assert len(calls) == 1 and got["pointwise"]["pr_auc"] == 1.0 and got["pointwise"]["brier"] is not None and got["bm25"]["brier"] is None
    assert "no service" in got["crossencode"]["error"]
    assert runs.datasets(spark, path, ["x", "d"]) == ["d"]


# --- quoted records ---


@pytest.mark.parametrize("split", [40, 100_000])
def test_quoted_records_are_read_over_splits(spark, tmp_path, split):
    import csv

    rng = random.Random(split)
    piece = lambda: rng.choice(["plain", "two\nlines", "a\ttab", 'say "so"', "", "\n\n", 'end"', '"', "x" * 90, "\r\nodd", "é\n"])
    rows = [(f"q{k}", piece() + piece()) for k in range(120)]
    for part in range(3):
        with open(tmp_path / f"{part}.tsv", "w", encoding="utf-8", newline="") as f:
            csv.writer(f, delimiter="\t", lineterminator="\r\n" if part == 1 else "\n").writerows(rows[40 * part : 40 * part + 40])
    with open(tmp_path / "9.tsv", "w", encoding="utf-8") as f:
        f.write('size\t5" disk\n\nopen\tplain\n')  # a quote within a field that isn't quoted; a blank line
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = loaders.read_tsv(spark, str(tmp_path), "q string, text string").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = rows + [("size", '5" disk'), ("open", "plain")]
    assert sorted((r["q"], r["text"] or "") for r in got) == sorted(want)


@pytest.mark.parametrize("line, outside, inside", [("a\tb", False, True), ('a\t"b', True, False), ('"a""', True, False), ('"a"\t"b', True, True), ('x"', False, False), ('5" disk\tb', False, False), ("", False, True), ('""\t"', True, True)])
def test_lines_end_inside_quotes(line, outside, inside):
    assert records.ends_inside(line, False) is outside
    if line not in ('"a"\t"b', '""\t"'):
        assert records.ends_inside(line, True) is inside


def test_only_records_near_the_wanted_ones_are_parsed(spark, tmp_path):
    rows = [{"docid": f"d{k}", "title": "t", "text": f'says "docid": "d{k + 1}"'} for k in range(200)] + [{"text": "x", "docid": 'o"dd', "title": ""}, {"docid": "d7", "title": "last", "text": "y"}]
    (tmp_path / "shard.jsonl").write_text("\n".join(json.dumps(r) for r in rows) + "\nbroken\n")
    wanted = spark.createDataFrame([("d7",), ('o"dd',), ("none",)], "docid string")
    assert loaders.asked_lines(spark, str(tmp_path), wanted).count() == 4  # d7 twice, the escaped id, and the broken line
    got = {r["docid"]: (r["title"], r["text"]) for r in loaders.read_corpus(spark, str(tmp_path), wanted).collect()}
    assert got == {"d7": ("last", "y"), 'o"dd': ("", "x")}


def test_all_cosines_shuffle_tiles_and_equal_the_joined_pairs(spark, monkeypatch, capsys):
    from pairloom.functions import vectors

    monkeypatch.setattr(vectors, "QUERY_TILE", 3)
    monkeypatch.setattr(vectors, "ROW_TILE", 5)
    rows = [(f"v{k}", None if k == 7 else [1.0, None] if k == 9 else [0.0, 0.0] if k == 4 else [float(k % 5 - 2), float(k)], None if k == 3 else k % 2) for k in range(20)]
    e = spark.createDataFrame(rows, "id string, vector array<double>, label int")
    asked = e.filter("id in ('v0', 'v3', 'v4', 'v7', 'v9', 'v12', 'v16')")
    found = routes.embedding_of_all(e, asked)
    found.explain()
    assert "HashJoin" not in (plan := capsys.readouterr().out) and "MergeJoin" not in plan
    pairs = e.select(F.col("id").alias("doc_id"), F.col("label").alias("dl")).crossJoin(asked.select(F.col("id").alias("query_id"), F.col("label").alias("ql")))
    pairs = pairs.select("query_id", "doc_id", F.lit(0).alias("ordinal"), (F.col("ql") == F.col("dl")).cast("int").alias("label"))
    want = routes.embedding(pairs.filter("query_id <> 'v7' and doc_id <> 'v7'"), e.select(F.col("id").alias("doc_id"), "vector"), asked.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector")))
    told = lambda x: {(r["query_id"], r["doc_id"]): (r["label"], None if r["score"] is None else round(r["score"], 12)) for r in x.collect()}
    got = told(found)
    assert len(got) == 140 and all(got[x][1] is None for x in got if "v7" in x)
    assert {x: v for x, v in got.items() if "v7" not in x} == told(want)


def test_all_cosines_deal_a_tile_a_task_and_files_hold_little_beside_scores(spark, tmp_path):
    import pyarrow.parquet as pq

    rng = random.Random(5)
    e = spark.createDataFrame([(f"{k}", [rng.gauss(0, 1) for _ in range(8)], k % 10) for k in range(3001)], "id string, vector array<double>, label int")
    tasks = vectors._tiles(e, 400).select(F.spark_partition_id().alias("task")).collect()
    assert len(tasks) == 8 == len({r["task"] for r in tasks})  # hashes of eight numbers share tasks
    asked = e.filter("id % 20 = 0")
    found = routes.embedding_of_all(e, asked, digits=9)
    found.write.parquet(out := str(tmp_path / "pairs"))
    groups = [m.row_group(k) for f in (tmp_path / "pairs").glob("*.parquet") for m in [pq.ParquetFile(f).metadata] for k in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 151 * 3001
    assert sum(g.column(k).total_compressed_size for g in groups for k in (0, 1)) < 0.5 * 151 * 3001  # both ids; query after query they take 1.5 bytes a pair
    got, want = spark.read.parquet(out), routes.embedding_of_all(e, asked).withColumn("score", F.round("score", 9))
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_scores_are_rounded_as_sql_rounds():
    import duckdb
    import numpy as np

    x = np.array([0.5, -0.5, 1.5, 2.5, -2.5, 0.0, -0.0, -1e-12, 0.25, 1.0000000000000002, -0.1234567895, 0.1234567895, 0.49999999999999994, float("nan")])
    for digits in (0, 1, 9):
        want = [v for (v,) in duckdb.execute("SELECT round(unnest(?::DOUBLE[]), ?::INTEGER)", [x.tolist(), digits]).fetchall()]
        got = vectors._rounded(x, digits)
        assert np.array_equal(got, np.array(want), equal_nan=True)
        assert not np.signbit(got[got == 0]).any()
