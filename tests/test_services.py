"""Services: retries, failures as rows, concurrency, typed requests, answers and the checks before a run."""

import json
from functools import partial

import pytest
from pyspark.sql import functions as F

from pairloom.operators import answers, registry, routes
import played
from pairloom.services import client, preflight, prompts, scorers

POOL = "query_id string, ordinal long, doc_id string, label int, question string, text string"


def pool(spark, sizes=(3, 12, 1)):
    rows = [(f"q{q}", i, f"d{q}-{i}", int(i == 0), f"the \"question\" {q}?", f"text {i} of \\ {q}" * (i + 1)) for q, n in enumerate(sizes) for i in range(n)]
    return spark.createDataFrame(rows, POOL)


# --- one request ---


def transport(*responses):
    left = list(responses)

    def send(body):
        x = left.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    send.left = left
    return send


def test_passing_faults_are_tried_again_with_doubled_waits():
    waits = []
    send = transport((503, "busy"), OSError("line"), (200, {"answers": {}}))
    assert client.ask(send, {}, client.Retry(3, 0.5), waits.append) == {"answers": {}} and waits == [0.5, 1.0] and not send.left


def test_tries_end_without_a_last_wait():
    waits = []
    with pytest.raises(client.ServiceError, match="status 429"):
        client.ask(transport(*[(429, "")] * 5), {}, client.Retry(4, 1), waits.append)
    assert waits == [1, 2, 4]


@pytest.mark.parametrize("status", [400, 401, 403, 404, 422])
def test_refusals_raise_at_once_and_say_why(status):
    send = transport((status, {"detail": "no such field"}), (200, {}))
    with pytest.raises(client.ServiceError, match="no such field"):
        client.ask(send, {}, sleep=lambda s: pytest.fail("waited"))
    assert len(send.left) == 1


def test_statuses_worth_a_try():
    assert [s for s in (200, 400, 401, 408, 409, 422, 425, 429, 500, 503) if client.should_retry(s)] == [408, 409, 425, 429, 500, 503]
    with pytest.raises(ValueError, match="key"):
        client.http("http://x", "")


def test_http_transport(tmp_path):
    import http.server
    import threading

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self.send_response(body["status"])
            self.end_headers()
            self.wfile.write(json.dumps({"key": self.headers["Authorization"]}).encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    send = client.http(f"http://127.0.0.1:{server.server_port}/", "k")
    assert send({"status": 200}) == (200, {"key": "Bearer k"}) and send({"status": 422})[0] == 422
    server.shutdown()


# --- many requests, in tasks ---


def test_failures_are_rows_and_the_rest_is_answered(spark):
    rows = spark.createDataFrame([(f"r{i}", json.dumps({"n": i})) for i in range(20)], "request_id string, body string")

    def connect():
        return lambda body: (400, "bad") if body["n"] % 7 == 0 else (200, {"n": body["n"]})

    got = {r["request_id"]: r for r in client.served(rows, connect).collect()}
    assert len(got) == 20
    for i in range(20):
        r = got[f"r{i}"]
        assert (r["error"] is not None and r["response"] is None) if i % 7 == 0 else json.loads(r["response"]) == {"n": i}


def test_requests_run_side_by_side(spark):
    def connect():
        import threading
        import time

        inside, most, lock = [0], [0], threading.Lock()

        def send(body):
            with lock:
                inside[0] += 1
                most[0] = max(most[0], inside[0])
            time.sleep(0.05)
            with lock:
                inside[0] -= 1
            return 200, {"most": most[0]}

        return send

    rows = spark.createDataFrame([(str(i), "{}") for i in range(12)], "request_id string, body string").coalesce(1)
    assert max(json.loads(r["response"])["most"] for r in client.served(rows, connect, workers=4).collect()) in (3, 4)


# --- typed requests ---


def test_requests_hold_every_question_once_and_the_whole_state(spark):
    from pairloom.operators import budget

    asked = budget.request_batches(pool(spark), 5).withColumn("question_id", F.concat_ws("/", "query_id", "doc_id"))
    sent = scorers.requests(asked, prompts.RELEVANT, "m", max_questions=2).collect()
    bodies = [json.loads(r["body"]) for r in sent]
    assert sorted(k for b in bodies for k in b["questions"]) == sorted(r["question_id"] for r in asked.collect())
    assert all(set(r["question_ids"]) == set(b["questions"]) and len(b["questions"]) <= 2 for r, b in zip(sent, bodies, strict=True))
    texts = {r["question_id"]: r["text"] for r in asked.collect()}
    for b in bodies:
        for k, q in b["questions"].items():
            at = int(q["instructions"].partition("candidates[")[2].partition("]")[0])
            assert b["state"]["candidates"][at]["text"] == texts[k] and b["state"]["query"].startswith('the "question"')
        assert b["model"] == "m" and 1 <= len(b["state"]["candidates"]) <= 5


def test_pointwise_over_a_service_drops_failed_queries(spark):
    scorer = scorers.probability_scorer(partial(played.ByNumber, refused="q2", broken=1), prompts.RELEVANT, retry=client.Retry(wait=0))
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in routes.pointwise(pool(spark), scorer).collect()}
    assert len(got) == 15 and {q for q, _ in got} == {"q0", "q1"}
    assert all(s == int(d.partition("-")[2]) / 100 for (_, d), s in got.items())


def test_grades_and_choices_over_a_service(spark):
    connect = partial(played.ByNumber)
    rows = pool(spark, (4,))
    graded = routes.crossencode(rows, lambda asked: asked.select("question_id", F.lit(0.5).alias("value")), scorers.grade_scorer(connect, prompts.GRADE)).orderBy("rank").collect()
    assert [r["doc_id"] for r in graded] == ["d0-3", "d0-2", "d0-1", "d0-0"]
    chosen = routes.compared(rows, scorers.choice_scorer(rows, lambda: lambda b: (200, {"answers": {"pair": {"probabilities": {"a": 1.0 if len(b["state"]["candidates"][0]["text"]) > len(b["state"]["candidates"][1]["text"]) else 0.0, "b": 0.5}}}}), prompts.BETTER))
    assert {r["doc_id"]: r["matches"] for r in chosen.collect()} == {f"d0-{i}": 3 for i in range(4)}
    best = min(chosen.collect(), key=lambda r: r["rank"])
    assert best["doc_id"] == "d0-3"


def test_a_services_order_is_trusted(spark):
    def service(lists):
        results = F.array(F.struct(F.lit(2).alias("index"), F.lit(0.1).alias("score")), F.struct(F.lit(0).alias("index"), F.lit(0.9).alias("score")), F.struct(F.lit(99).alias("index"), F.lit(0.9).alias("score")))
        return lists.select("query_id", results.alias("results"), F.when(F.col("query_id") == "q1", "throttled").alias("error"))

    got = routes.hosted_rerank(pool(spark, (3, 3)), service).orderBy("rank").collect()
    assert [(r["doc_id"], r["score"], r["rank"], r["rank_delta"]) for r in got] == [("d0-2", 0.1, 1, 2), ("d0-0", 0.9, 2, -1)]


def test_reranker_and_generator_over_a_transport(spark):
    def lists():
        return lambda b: (200, {"results": [{"index": len(b["documents"]) - 1, "score": 0.5}]})

    got = routes.hosted_rerank(pool(spark, (3, 2)), scorers.reranker(lists)).collect()
    assert {r["doc_id"] for r in got} == {"d0-2", "d1-1"}

    def writer():
        return lambda b: (400, "no") if "question\" 1" in b["prompt"] else (200, {"text": f"<answer>{b['max_tokens']}</answer>"})

    asked = spark.createDataFrame([("q0", "p", "the question"), ("q1", "p", 'the "question" 1?')], "query_id string, question string, prompt string")
    said = {r["query_id"]: r for r in scorers.generator(writer, prompts.ANSWER, max_tokens=9)(asked).collect()}
    assert said["q0"]["generated"] == "<answer>9</answer>" and said["q1"]["generated"] is None and "no" in said["q1"]["error"]


# --- answers ---


def test_answer_run_tells_failures_from_wrong_answers(spark):
    ranked = spark.createDataFrame([("a", 1, "x", 0), ("a", 2, "y", 1), ("a", 3, "z", 1), ("b", 1, "x", 1)], "query_id string, rank int, text string, label int")
    asked = spark.createDataFrame([("a", "A?", ["Tokyo"]), ("b", "B?", ["Rome"]), ("c", "C?", ["x"]), ("d", "D?", []), ("e", "E?", None), ("f", "F?", ["Bern"])], "query_id string, question string, answers array<string>")
    said = spark.createDataFrame([("a", "<answer>tokyo</answer>", None), ("b", None, "throttled"), ("f", "Bern", None)], "query_id string, generated string, error string")
    got = {r["query_id"]: r for r in answers.answer_queries(ranked, asked, answers.scripted(said), 1).collect()}
    assert set(got) == {"a", "b", "c", "f"}  # queries without a gold answer aren't asked
    assert got["a"]["correct"] and not got["a"]["evidence_in_prompt"] and got["b"]["evidence_in_prompt"]
    assert got["b"]["error"] == "throttled" and not got["b"]["correct"] and not got["b"]["parsed"]
    assert got["c"]["error"] == "no answer came back" and got["f"]["error"] is None and not got["f"]["parsed"]
    two = {r["query_id"]: r for r in answers.prompts(ranked, asked, 2).collect()}
    assert two["a"]["prompt"] == "# Passages\n- x\n\n- y\n\n# Question\nA?" and two["a"]["evidence_in_prompt"]
    assert two["c"]["prompt"] == "# Passages\n\n\n# Question\nC?"


# --- registry and checks ---


def test_registry_opens_only_what_is_needed_and_once(spark):
    opened = []

    def scorer():
        opened.append("scorer")
        return lambda asked: asked.select("question_id", F.lit(0.5).alias("value"))

    made = registry.Registry(scorer=scorer, reranker=lambda: opened.append("reranker"))
    found = made.build(["pointwise@2", "pointwise", "bm25"])
    assert list(found) == ["pointwise@2", "pointwise", "bm25"] and opened == ["scorer"]
    assert found["pointwise@2"](pool(spark)).agg(F.max("position")).first()[0] == 1
    assert found["bm25"](pool(spark)).count() == 16
    with pytest.raises(ValueError, match="unknown route"):
        made.build(["pointwise", "nothing"])
    with pytest.raises(ValueError, match="vectors"):
        made.build(["embedding"])


def test_hybrid_route(spark):
    rows = pool(spark, (3,))
    vectors = spark.createDataFrame([(f"d0-{i}", [1.0, float(i)]) for i in range(3)], "doc_id string, vector array<double>")
    asked = spark.createDataFrame([("q0", [1.0, 0.0])], "query_id string, query_vector array<double>")
    scripted = spark.createDataFrame([(f"q0/d0-{i}", i / 2, None, None) for i in range(3)], "question_id string, value double, grade double, winner string")
    got = registry.offline(scripted, (vectors, asked)).build(["hybrid"])["hybrid"](rows)
    scores = {r["doc_id"]: r["score"] for r in got.collect()}
    assert scores["d0-2"] == pytest.approx(0.7) and scores["d0-0"] == pytest.approx(0.3)


def test_preflight_names_all_that_is_missing():
    assert preflight.needed(["hybrid", "bm25"]) == {"vectors", "scorer"} and preflight.needed([], generate=True) == {"generator"}
    assert preflight.preflight({"scorer": lambda: "ok"}, {"scorer"}) == {"scorer": "ok"}

    def broken():
        raise OSError("expired")

    with pytest.raises(preflight.NotReady, match="reranker: not configured; scorer: expired"):
        preflight.preflight({"scorer": broken}, {"scorer", "reranker"})


def test_wording_ids_follow_the_wording():
    assert prompts.wording_id(prompts.ANSWER) == prompts.wording_id(str(prompts.ANSWER)) != prompts.wording_id(prompts.ANSWER + " ")
    assert "<answer>" in prompts.ANSWER
