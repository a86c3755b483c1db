"""Metrics by hand-computed tables and by brute force on small random ones."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pairloom.operators import bootstrap, classify, curves, draws, pools, ranking, scan, streams, weighted

SCHEMA = "dataset string, route string, query_id string, doc_id string, ordinal long, label int, score double"


def frame(spark, rows):
    return spark.createDataFrame([("d", "r", q, f"{q}-{i}", i, y, float(s)) for i, (q, y, s) in enumerate(rows)], SCHEMA)


def random_rows(seed, n=60, queries=6, levels=12):
    rng = random.Random(seed)
    return [(f"q{rng.randrange(queries)}", int(rng.random() < 0.3), rng.randrange(levels) / levels) for _ in range(n)]


def brute_ap(rows):
    p = sum(y for _, y, _ in rows)
    total = before = 0
    for s in sorted({s for *_, s in rows}, reverse=True):
        kept = [y for _, y, x in rows if x >= s]
        total += (sum(kept) - before) / p * sum(kept) / len(kept)
        before = sum(kept)
    return total


def brute_auc(rows):
    pos, neg = [s for _, y, s in rows if y], [s for _, y, s in rows if not y]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("ranges", [1, 5, 64])
def test_curve_metrics_match_brute_force(spark, monkeypatch, seed, ranges):
    rows = random_rows(seed)
    monkeypatch.setattr(scan, "RANGE_ROWS", max(1, len(rows) // ranges))
    points = curves.curve(frame(spark, rows), ["route"], small=ranges == 1)
    assert curves.average_precision(points, ["route"]).first()["pr_auc"] == pytest.approx(brute_ap(rows))
    assert curves.roc_auc(points, ["route"]).first()["roc_auc"] == pytest.approx(brute_auc(rows))
    best = max(((2 * k / (len(kept) + p), -s) for s in {s for *_, s in rows} for kept in [[y for _, y, x in rows if x >= s]] for k, p in [(sum(kept), sum(y for _, y, _ in rows))]))
    got = curves.best_f1(points, ["route"]).first()
    assert (got["best_f1"], got["best_f1_threshold"]) == (pytest.approx(best[0]), pytest.approx(-best[1]))


def test_constant_score_gives_base_rate(spark):
    rows = [("q", 1, 0.5)] * 3 + [("q", 0, 0.5)] * 7
    points = curves.curve(frame(spark, rows), ["route"])
    assert curves.average_precision(points, ["route"]).first()[1] == pytest.approx(0.3)
    assert curves.roc_auc(points, ["route"]).first()[1] == pytest.approx(0.5)


def test_one_class_is_undefined(spark):
    got = classify.judge_metrics(frame(spark, [("q", 1, 0.1), ("q", 1, 0.2)]), True).first()
    assert got["pr_auc"] is None and got["error"] == "only one class"


def test_precision_at_recall_keeps_ties(spark):
    rows = [("q", 1, 0.9), ("q", 1, 0.5), ("q", 0, 0.5), ("q", 0, 0.1)]
    got = curves.precision_at_recall(curves.curve(frame(spark, rows), ["route"]), ["route"]).first()
    assert (got["precision"], got["threshold"]) == (pytest.approx(2 / 3), 0.5)


@pytest.mark.parametrize("n", [3, 10, 23])
def test_calibration_bins_are_equal_counts(spark, n):
    rows = [("q", i % 2, (i * 7 % n) / n) for i in range(n)]
    got = classify.calibration_bins(frame(spark, rows)).orderBy("bin").collect()
    sizes = [n // 10 + (k < n % 10) for k in range(10)]
    assert [r["count"] for r in got] == [s for s in sizes if s]
    ordered = sorted((s, i) for i, (_, _, s) in enumerate(rows))
    assert got[0]["mean_score"] == pytest.approx(sum(s for s, _ in ordered[: sizes[0]]) / sizes[0])


def test_ndcg_mrr_recall(spark):
    labels = [0, 1, 1, 0]
    rows = [("q", y, 1 - i / 10) for i, y in enumerate(labels)] + [("none", 0, 0.5)]
    got = {r["query_id"]: r for r in ranking.rank_metrics(frame(spark, rows), 3).collect()}
    dcg, ideal = 1 / math.log2(3) + 1 / math.log2(4), 1 + 1 / math.log2(3)
    assert got["q"]["ndcg"] == pytest.approx(dcg / ideal)
    assert (got["q"]["mrr"], got["q"]["recall"], got["q"]["first_relevant"]) == (0.5, 1.0, 2)
    assert (got["none"]["ndcg"], got["none"]["recall"], got["none"]["first_relevant"]) == (0.0, 0.0, None)


def test_random_top_k_is_hypergeometric(spark):
    rows = [("q", int(i < 2), i) for i in range(7)]
    assert ranking.random_top_k(frame(spark, rows), 3).first()["hit_rate"] == pytest.approx(1 - math.comb(5, 3) / math.comb(7, 3))


def test_top_k_breaks_ties_by_input_order(spark):
    rows = [("q", 0, 0.5), ("q", 1, 0.5)]
    assert ranking.top_k_hit(frame(spark, rows), 1).first()["hit_rate"] == 0.0


def test_exact_bootstrap_equals_copied_rows(spark):
    import numpy as np

    a, b = random_rows(5), random_rows(5)
    b = [(q, y, 1 - s) for q, y, s in b]
    ids = sorted({q for q, *_ in a})
    drawn = streams.exact_draws(frame(spark, a), 8, 3)
    got = bootstrap.paired_bootstrap(frame(spark, a), frame(spark, b), drawn, "pr_auc").first()
    rng, diffs = np.random.default_rng(3), []
    for _ in range(8):
        copied = [ids[i] for i in rng.integers(0, len(ids), len(ids))]
        diffs.append(brute_ap([r for q in copied for r in a if r[0] == q]) - brute_ap([r for q in copied for r in b if r[0] == q]))
    assert got["difference"] == pytest.approx(brute_ap(a) - brute_ap(b))
    assert [got["low"], got["high"]] == pytest.approx(np.percentile(diffs, [2.5, 97.5]).tolist())


@pytest.mark.parametrize("ranges", [1, 2, 7])
@pytest.mark.parametrize("metric", ["pr_auc", "precision"])
@pytest.mark.parametrize("hot", [False, True])
def test_sampled_metrics_equal_copied_rows(spark, monkeypatch, ranges, metric, hot):
    import numpy as np

    rows = random_rows(9)
    monkeypatch.setattr(weighted, "RANGE_ROWS", max(1, len(rows) // ranges))
    monkeypatch.setattr(weighted, "MATRIX_ROWS", 3)
    if hot:  # a score that fills several ranges
        rows = [(q, y, 0.5 if k % 3 else s) for k, (q, y, s) in enumerate(rows)]
    drawn = draws.tree_draws(frame(spark, rows), 25, 1)
    table = {}
    for r in drawn.rows().collect():
        table.setdefault(r["sample"], {})[r["query_id"]] = r["weight"]
    assert all(sum(x.values()) == len({q for q, *_ in rows}) for x in table.values()) and len(table) == 25
    got = weighted.sampled_metric(frame(spark, rows), drawn, metric)
    assert got.tolist() == pytest.approx(weighted.sampled_metric(frame(spark, rows), draws.TableDraws(drawn.rows(), 25), metric).tolist(), nan_ok=True)
    for sample, w in table.items():
        copied = [r for r in rows for _ in range(w.get(r[0], 0))]
        if metric == "pr_auc":
            want = brute_ap(copied)
        else:
            total = sum(y for _, y, _ in copied)
            points = [(s, [y for _, y, x in copied if x >= s]) for s in sorted({s for *_, s in copied}, reverse=True)]
            want = next((sum(y) / len(y) for _, y in points if sum(y) >= 0.9 * total), None) if total else None
        assert (np.isnan(got[sample]) if want is None else got[sample] == pytest.approx(want)), sample


def test_tree_draws_are_multinomial():
    import numpy as np

    size, samples = 37, 4000
    w = draws.tree_weights(np.arange(size), size, samples, 5).astype(int)
    assert (w.sum(axis=0) == size).all()
    assert abs(w.mean(axis=1) - 1).max() < 0.07 and abs(w.var(axis=1) - (1 - 1 / size)).max() < 0.12
    assert abs(np.corrcoef(w)[~np.eye(size, dtype=bool)] + 1 / (size - 1)).max() < 0.08
    # a task that holds some queries only finds the same numbers, whatever else it holds
    some = np.array([0, 3, 4, 20, 36])
    assert (draws.tree_weights(some, size, samples, 5) == w[some]).all()
    assert (draws.tree_weights(some, size, 50, 5) == w[some, :50]).all()
    large = draws.tree_weights(np.array([5, 999_999]), 1_000_000, 2000, 0)
    assert abs(large.mean(axis=1) - 1).max() < 0.1 and abs(large.var(axis=1) - 1).max() < 0.15


def test_tree_draws_split_large_ranges_exactly():
    import numpy as np

    # the binomial of a million draws: mean, variance and a tail as they should be
    keys = np.array([draws._key(f"1:sample:{s}") for s in range(5000)], np.uint32)
    n = np.full((1, 5000), 1_000_001)
    got = draws._binomials(n, np.array([0]), np.array([3]), keys, 1)[0]
    z = (got - 1_000_001 * 2 / 3) / np.sqrt(1_000_001 * 2 / 9)
    assert abs(z.mean()) < 0.06 and abs(z.std() - 1) < 0.04 and 0.035 < (abs(z) > 1.96).mean() < 0.065


def test_sampled_mean_equals_table(spark):
    import numpy as np

    values = spark.createDataFrame([(f"q{k}", float(k * k)) for k in range(23)], "query_id string, value double").repartition(3)
    drawn = draws.tree_draws(values, 40, 2)
    table = {}
    for r in drawn.rows().collect():
        table.setdefault(r["sample"], {})[int(r["query_id"][1:])] = r["weight"]
    for distinct in (False, True):
        got = weighted.sampled_mean(values, drawn, distinct)
        want = [np.average([q * q for q in table[s]], weights=[1 if distinct else w for w in table[s].values()]) for s in range(40)]
        assert got.tolist() == pytest.approx(want)


def test_a_metric_of_ones_own(spark):
    good = frame(spark, [r for q in range(20) for r in ((f"q{q}", 1, 0.9), (f"q{q}", 0, 0.1))])
    poor = frame(spark, [r for q in range(20) for r in ((f"q{q}", 1, 0.1), (f"q{q}", 0, 0.9))])
    got = bootstrap.bootstrap_by_metric(good, poor, draws.tree_draws(good, 30), lambda rows, keys: classify.mean_per_query(rows, "pr_auc", keys)).first()
    assert tuple(got) == (0.5, 0.5, 0.5, 30, 20)
    pooled = lambda rows, keys: curves.average_precision(curves.curve(rows, keys, F.col("weight"), small=True), keys, "value")
    a, b = frame(spark, random_rows(5)), frame(spark, [(q, y, 1 - s) for q, y, s in random_rows(5)])
    drawn = draws.tree_draws(a, 12)
    own = bootstrap.bootstrap_by_metric(a, b, drawn, pooled).first()
    built_in = bootstrap.paired_bootstrap(a, b, drawn).first()
    assert [own[c] for c in ("difference", "low", "high", "samples")] == pytest.approx([built_in[c] for c in ("difference", "low", "high", "samples")])


def test_min_max_of_flat_list_is_one(spark):
    rows = frame(spark, [("q", 0, 2), ("q", 1, 2), ("p", 0, 1), ("p", 0, 3)])
    got = [r[0] for r in rows.select(ranking.min_max(F.col("score"), ["query_id"])).collect()]
    assert sorted(got) == [0.0, 1.0, 1.0, 1.0]


def test_paired_difference_of_one_row(spark):
    rows = spark.createDataFrame([("q", True, None)], "query_id string, correct boolean, error string")
    assert tuple(bootstrap.paired_difference(rows, rows).first()) == (0.0, 0.0, 1)


def test_empty_pairs(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert curves.average_precision(curves.curve(none, ["route"]), ["route"]).count() == 0
    assert classify.judge_metrics(none, True).count() == 0


# --- scans and exact streams ---


@pytest.mark.parametrize("rows_a_range", [7, 1000])
def test_running_totals_numbers_and_quantiles(spark, rows_a_range):
    import numpy as np

    rng = random.Random(3)
    rows = [(g, k, rng.choice([rng.random(), 0.5, None])) for g in ("a", "b") for k in range(150)]
    table = spark.createDataFrame(rows, "g string, k long, v double").repartition(4)
    got = scan.running_total(table.drop("v").withColumn("one", F.col("k") * 2), ["g"], "k", "one", "before", rows_a_range).collect()
    assert len(got) == 300 and all(r["before"] == r["k"] * (r["k"] - 1) for r in got)
    for p in (0.0, 0.3, 0.5, 1.0):
        found = {r["g"]: r["q"] for r in scan.quantile(table, ["g"], "v", p, "q", rows_a_range).collect()}
        assert found == {g: pytest.approx(np.percentile([v for h, _, v in rows if h == g and v is not None], 100 * p)) for g in ("a", "b")}
    ids = spark.createDataFrame([(x,) for x in ["b", "a", "é", "\U0001f600", "B", "a"] + [f"q{k}" for k in range(90)]], "query_id string")
    numbers = {r["query_id"]: r["at"] for r in scan.numbered_in_order(ids, rows_a_range=rows_a_range).collect()}
    assert sorted(numbers, key=numbers.get) == sorted(numbers) and sorted(numbers.values()) == list(range(95))


def test_curve_plan_has_no_cartesian_product(spark, capsys):
    rows = frame(spark, random_rows(1)).withColumn("dataset", F.lit("d")).withColumn("route", F.lit("r"))
    curves.curve(rows, ["dataset", "route"]).explain()
    assert "Cartesian" not in capsys.readouterr().out


def test_exact_random_scores_equal_the_plain_loop(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(scan, "RANGE_ROWS", 5)
    monkeypatch.setattr(streams, "HELD", 40)
    rng = random.Random(8)
    rows = [(f"q{q}", 10 * q + k, int(rng.random() < 0.4)) for q in rng.sample(range(40), 40) for k in range(rng.randint(1, 9))]
    gen, values = np.random.default_rng(11), []
    for q in sorted({int(q[1:]) for q, *_ in rows}):
        labels = [y for p, _, y in sorted(rows, key=lambda r: r[1]) if p == f"q{q}"]
        if 0 < sum(labels) < len(labels):
            values.append(np.mean([brute_ap([(q, y, s) for y, s in zip(labels, gen.random(len(labels)), strict=True)]) for _ in range(20)]))
    got = streams.exact_random_query_pr_auc(spark.createDataFrame(rows, "query_id string, ordinal long, label int").repartition(5), 20, 11).first()
    assert got["queries"] == len(values) and abs(got["value"] - np.mean(values)) < 1e-12


@pytest.mark.parametrize("n, samples, stretch", [(1, 4, 64), (2, 9, 64), (3, 50, 64), (1000, 12, 1024), (10_000, 3, 4096)])
def test_exact_draws_equal_the_plain_loop(spark, monkeypatch, n, samples, stretch):
    import numpy as np

    monkeypatch.setattr(streams, "STRETCH", stretch)
    ids = sorted(f"id {k}" for k in range(n))
    drawn = streams.exact_draws(spark.createDataFrame([(x,) for x in ids], "query_id string"), samples, 6)
    got = {(r["sample"], r["query_id"]): r["weight"] for r in drawn.rows().collect()}
    gen, want = np.random.default_rng(6), {}
    for s in range(samples):
        for i in gen.integers(0, n, n):
            want[s, ids[i]] = want.get((s, ids[i]), 0) + 1
    assert got == want


def test_words_are_passed_over_as_numpy_does():
    import numpy as np

    n = 3_000_000_000  # three words in ten are passed over
    want = np.random.default_rng(2).integers(0, n, 5000)
    assert (streams._accepted(2, 0, n)[:5000] == want).all()


def test_exact_orders_equal_pythons(spark):
    rows = [(f"q{q}", f"d{k * 7 % 11}", k, int(k % 3 == 0)) for q in range(6) for k in range(q + 2)]
    table = spark.createDataFrame(rows, "query_id string, doc_id string, ordinal long, label int").repartition(3)
    got = {q: [r["doc_id"] for r in sorted(streams.exact_shuffled(table, [F.asc("ordinal")], False).filter(F.col("query_id") == q).collect(), key=lambda r: r["position"])] for q in ("q0", "q5")}
    for q, found in got.items():
        want = [d for p, d, *_ in rows if p == q]
        random.Random(q).shuffle(want)
        assert found == want
    capped = pools.capped_candidates(table, 4, exact=True).collect()
    for q in range(6):
        own = [r for r in rows if r[0] == f"q{q}"]
        own = sorted(([r for r in own if r[3]] + [r for r in own if not r[3]])[:4], key=lambda r: r[1])
        random.Random(f"q{q}:{len(own)}").shuffle(own)
        assert [r["doc_id"] for r in sorted((r for r in capped if r["query_id"] == f"q{q}"), key=lambda r: r["position"])] == [r[1] for r in own]
    for count in (3, 6, 9):
        got = sorted(streams.exact_sample(table.withColumn("first", F.substring("query_id", 2, 9).cast("int")), "first", count, 4).collect(), key=lambda r: r["position"])
        ids = [f"q{k}" for k in range(6)]
        assert [r["query_id"] for r in got] == (ids if count >= 6 else random.Random(4).sample(ids, count))


def test_weights_of_some_samples_are_columns_of_all():
    import numpy as np

    at = np.flatnonzero(np.random.default_rng(4).random(9000) < 0.6)
    tree = draws.Tree(at, 9000, 3)
    assert (tree.weights(np.array([7, 2, 40])) == draws.tree_weights(at, 9000, 41, 3)[:, [7, 2, 40]]).all()


def test_queries_weights_are_made_in_few_ranges():
    held = draws.TreeDraws.held
    assert weighted._range_count(6_000_000, held) <= 24 and weighted._range_count(36_000_000, held) == 72
    assert weighted._range_count(100_000, held) == 12 and weighted._range_count(10, held) == 1


def test_stream_draws_never_broadcast(spark, capsys):
    values = spark.createDataFrame([(f"q{k}", float(k)) for k in range(50)], "query_id string, value double")
    drawn = streams.exact_draws(values, 20)
    drawn.joined(values).explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and not any("MapInArrow" in x for x in plan.split("BroadcastExchange")[1:])


@pytest.mark.parametrize("long", [3, 50_000])
def test_random_lists_are_not_shuffled_and_equal_rows(spark, monkeypatch, capsys, long):
    import hashlib

    import numpy as np

    monkeypatch.setattr(bootstrap, "LONG", long)
    rng = random.Random(9)
    rows = [(q, k, int(rng.random() < 0.4)) for q in (f"q{x}" for x in range(30)) for k in range(rng.randint(1, 8))]
    got = bootstrap.random_query_pr_auc(spark.createDataFrame(rows, "query_id string, ordinal long, label int").repartition(3), 6, 2)
    want = []
    for q in sorted({r[0] for r in rows}):
        own = [(k, y) for p, k, y in rows if p == q]
        if 0 < sum(y for _, y in own) < len(own):
            want.append(np.mean([brute_ap([(q, y, int(hashlib.md5(f"2:{d}:{q}:{k}".encode()).hexdigest()[:8], 16)) for k, y in own]) for d in range(6)]))
    assert tuple(got.first()) == (pytest.approx(np.mean(want), abs=1e-12), len(want))
    got.explain()
    assert ("explode" in capsys.readouterr().out) == (long == 3)


def test_long_tables_are_dealt_by_query_over_more_tasks(spark, monkeypatch, capsys):
    rows = frame(spark, random_rows(1)).withColumn("dataset", F.lit("d")).withColumn("route", F.lit("r"))
    want = {r["query_id"]: r["value"] for r in classify.per_query(rows, "pr_auc").collect()}
    monkeypatch.setattr(classify, "TASK_ROWS", 3)
    found = classify.per_query(rows, "pr_auc")
    found.explain()
    plan = capsys.readouterr().out
    assert {r["query_id"]: r["value"] for r in found.collect()} == pytest.approx(want)
    assert "REPARTITION_BY_NUM" in plan and plan.count("Exchange hashpartitioning") == 1


def test_sanity_report_reads_texts_once(spark, capsys):
    from pairloom.operators import lexical

    pool = spark.createDataFrame([("q", k, f"d{k}", k % 2, "red fox", t) for k, t in enumerate(["a red fox", "fox fox", "", None, "red", "blue sky"])], "query_id string, ordinal long, doc_id string, label int, question string, text string")
    found = lexical.sanity_report(pool)
    got = {(r["measure"], r["label"]): (r["count"], r["mean"], r["median"]) for r in found.collect()}
    assert got[("length", 0)] == (3, 4.0, 3.0) and got[("length", 1)][0] == 3 and got[("length", 1)][2] == 7.5
    found.explain()
    assert "InMemoryTableScan" in capsys.readouterr().out
