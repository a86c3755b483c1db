"""Dedup, components, URL filters, sampling and language ID against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from pairloom.llm import exact_dedup, language_id, minhash, sampling, url_filter
from pairloom.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, rep string, id string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "clash", "clash") for i, t, lang in rows], DOCS)


def roots(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


# --- exact dedup ---


def brute_groups(rows):
    import re

    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    by = {}
    for i, t, _ in rows:
        by.setdefault(norm(t), []).append(i)
    return sorted(((i, min((x for x in by[norm(t)] if x is not None), default=None), len(by[norm(t)])) for i, t, _ in rows), key=str)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(spark, weak):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a b", "a  b", "a\tb", " a b", "x", "", None, "long " * 5000]), "en") for i in range(80)] + [(3, "x", "en"), (3, "x", "en"), (None, "only", "en"), (None, "x", "en")]
    # a digest of one bit: texts clash, and the whole texts keep them apart
    digest = (lambda t: F.pmod(F.length(t), F.lit(2))) if weak else exact_dedup.sha256
    got = exact_dedup.exact_groups(docs(spark, rows), digest=digest).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in got), key=str) == brute_groups(rows)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    assert sum(r["kept"] for r in got) == len({r["text_sha256"] for r in got})  # one row of each text


def test_exact_dedup_of_empty_table_and_filter(spark):
    assert exact_dedup.exact_groups(docs(spark, [])).count() == 0
    got = exact_dedup.drop_exact_copies(docs(spark, [(2, "a", "x"), (1, "a ", "y"), (1, "b", "z"), (4, "a", "w")]))
    assert got.columns == ["doc_id", "text", "lang", "rep", "id"]
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == [(1, "a "), (1, "b"), (2, "a")]


def test_exact_dedup_keeps_one_row_of_repeated_ids(spark):
    rows = [(1, "b", "en"), (2, "b", "en"), (2, "a", "en"), (5, "z", "en"), (5, "z", "fr"), (7, "z", "en"), (None, "n", "en"), (None, "n", "en"), (None, "z", "en"), (8, None, "en"), (9, "", "en")]
    table = docs(spark, rows).withColumn("sha", F.lit(1)).withColumn("ID_GONE", F.lit(2))
    kept = exact_dedup.drop_exact_copies(table)
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(1, "b"), (2, "a"), (5, "z"), (None, "n"), (8, None)], key=str)
    assert kept.columns == table.columns
    marked = exact_dedup.exact_groups(table).filter("kept").select("doc_id").collect()
    assert sorted((r["doc_id"] for r in marked), key=str) == sorted([1, 2, 5, None, 8], key=str)
    assert exact_dedup.drop_exact_copies(docs(spark, [])).count() == 0


# --- components and near-duplicates ---


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_match_union_find(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(20)] + [(200, 200 + i) for i in range(15)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame([*pairs, (None, 1)], "u long, v long")).collect()}
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == {n: r for n, r in roots(pairs, {x for p in pairs for x in p}).items() if n in nodes}


def near_rows(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    shared = [word() for _ in range(40)]
    rows, n = [], 0
    for size in (1, 2, 3, 12, 25):
        for _ in range(4):
            base = [word() for _ in range(rng.randrange(60, 140))]
            for k in range(size):
                copy = list(base)
                for _ in range(0 if k == 0 else rng.randrange(4)):
                    copy[rng.randrange(len(copy))] = word()
                rows.append((n, " ".join(copy), "en"))
                n += 1
    for _ in range(30):  # a passage that many share is no duplicate
        rows.append((n, " ".join([*shared, *(word() for _ in range(60))]), "en"))
        n += 1
    rng.shuffle(rows)
    return [(i, t, x) for i, (_, t, x) in enumerate(rows)]


def brute_jaccard(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()) for w in (a.split(), b.split())]
    return len(sets[0] & sets[1]) / max(1, len(sets[0] | sets[1]))


@pytest.mark.parametrize("seed", [3, 4])
def test_near_duplicates_match_brute_force(spark, seed):
    rows = near_rows(seed)
    pairs = [(a[0], b[0]) for k, a in enumerate(rows) for b in rows[k + 1 :] if a[1] == b[1] or brute_jaccard(a[1], b[1]) >= 0.8]
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicate_classes(docs(spark, rows)).collect()}
    assert got == roots(pairs, {r[0] for r in rows})


@pytest.mark.parametrize("block", [3, 2048])
@pytest.mark.parametrize("anchors", [0, 64])
def test_all_pairs_of_a_bucket_are_compared(spark, monkeypatch, block, anchors):
    import pyarrow as pa

    # one band of one component: a pair has one bucket and no other chance
    monkeypatch.setattr(minhash, "BLOCK_ROWS", block)
    monkeypatch.setattr(minhash, "ANCHORS", anchors)
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    texts = []
    for _ in range(12):  # a pair of copies among texts that are too far from it and from each other
        base = [word() for _ in range(100)]
        texts += [[*base[:80], *(word() for _ in range(20))] for _ in range(6)] + [base, [*base[:97], word(), word(), word()]]
    rows = near_rows(5)
    rows += [(len(rows) + k, " ".join(t), "en") for k, t in enumerate(texts)]
    [signed] = minhash._signed([pa.record_batch({"id": pa.array([r[0] for r in rows]), "text": pa.array([r[1] for r in rows])})], 1, 1, 5)
    key = dict(zip(signed["node"].to_pylist(), signed["keys"].to_pylist(), strict=True))
    pairs = [(a[0], b[0]) for k, a in enumerate(rows) for b in rows[k + 1 :] if a[1] == b[1] or key[a[0]] == key[b[0]] and brute_jaccard(a[1], b[1]) >= 0.8]
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicate_classes(docs(spark, rows), bands=1, rows=1).collect()}
    assert got == roots(pairs, {r[0] for r in rows})


@pytest.mark.parametrize("seed", range(40))
def test_links_join_what_all_pairs_join(seed):
    import numpy as np

    rng = random.Random(seed)
    n, core = rng.randrange(2, 40), rng.sample(range(500), 60)
    sets = [np.array(sorted(set(core[: rng.randrange(40, 61)]) | {rng.randrange(500) for _ in range(rng.randrange(12))}), np.uint64) for _ in range(n)]
    group = np.array([rng.randrange(n) if rng.random() < 0.2 else k for k in range(n)])
    links = minhash.joining_links(sets, group, 0.8)
    like = lambda a, b: len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b])) - 1e-9
    same = [(a, b) for a in range(n) for b in range(a) if group[a] == group[b]]
    assert all(like(a, b) and group[a] != group[b] for a, b in links)
    assert roots(same + links, range(n)) == roots(same + [(a, b) for a in range(n) for b in range(a) if like(a, b)], range(n))


def brute_weighted(a, b):
    weights = []
    for w in (a.split(), b.split()):
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])
        weights.append({g: grams.count(g) for g in set(grams)})
    x, y = weights
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys())


def repeating_rows(seed):
    """Texts whose sets are alike, whose counts are alike, both, and neither."""
    rng, rows = random.Random(seed), []
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    for _ in range(8):
        head, passage = [word() for _ in range(rng.randrange(20, 60))], [word() for _ in range(rng.randrange(6, 12))]
        for times in (1, 2, 12, 30, 31):
            rows.append([*head, *passage * times])
        rows += [passage * 30, [*(word() for _ in range(5)), *passage * 40], [word() for _ in range(40)]]
    return [(k, " ".join(t), "en") for k, t in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_weighted_classes_match_brute_force(spark, seed):
    rows = [*repeating_rows(seed), (900, None, "x"), (901, "", "x"), (902, "a b", "x"), (903, "a b", "x"), (None, "a a a a a a a", "x")]
    pairs = [(a, b) for k, a in enumerate(rows) for b in rows[k + 1 :] if (a[1] or "") == (b[1] or "") or (a[1] and b[1] and max(brute_jaccard(a[1], b[1]), brute_weighted(a[1], b[1])) >= 0.8)]
    by_sets = [(a, b) for a, b in pairs if (a[1] or "") == (b[1] or "") or brute_jaccard(a[1], b[1]) >= 0.8]
    assert len(by_sets) < len(pairs)
    for measure, linked in ((minhash.EITHER, pairs), (minhash.SETS, by_sets)):
        got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicate_classes(docs(spark, rows), measure=measure).collect()}
        assert got == roots([(a[0], b[0]) for a, b in linked], {r[0] for r in rows})


@pytest.mark.parametrize("seed", range(5))
def test_probability_jaccard_matches_its_definition(seed):
    rows = repeating_rows(seed)[:12]
    for a in rows:
        for b in rows:
            assert minhash.probability_jaccard(a[1], b[1]) == pytest.approx(brute_weighted(a[1], b[1]), abs=1e-12)
    assert minhash.probability_jaccard("", "") == minhash.probability_jaccard("a", "") == 0


@pytest.mark.parametrize("seed", range(20))
def test_weighted_links_join_what_all_pairs_join(seed):
    import numpy as np

    rng = random.Random(seed)
    n, core = rng.randrange(2, 30), rng.sample(range(500), 20)
    sets = [np.array(sorted(set(core[: rng.randrange(10, 21)]) | {rng.randrange(500) for _ in range(rng.randrange(15))}), np.uint64) for _ in range(n)]
    counts = [np.array([rng.randrange(20, 30) if int(x) in core[:10] else 1 for x in s], np.uint32) if rng.random() < 0.7 else np.zeros(0, np.uint32) for s in sets]
    ones = [c if len(c) else np.ones(len(s)) for s, c in zip(sets, counts, strict=True)]
    links = minhash.joining_links(sets, np.arange(n), 0.8, counts)
    like = lambda a, b: len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b])) - 1e-9 or minhash.weighted_jaccard(sets[a], ones[a], sets[b], ones[b]) >= 0.8 - 1e-9
    assert all(like(a, b) for a, b in links)
    assert roots(links, range(n)) == roots([(a, b) for a in range(n) for b in range(a) if like(a, b)], range(n))


def test_hot_group_emits_few_links():
    import numpy as np

    rng = random.Random(3)
    base = rng.sample(range(1 << 30), 300)
    sets = [np.array(sorted({*base, *rng.sample(range(1 << 30), rng.randrange(30))} - set(rng.sample(base, rng.randrange(20)))), np.uint64) for _ in range(1500)]
    links = minhash.joining_links(sets, np.arange(1500), 0.8)
    assert 1400 < len(links) < 1500  # at most a spanning forest


def test_near_duplicates_of_edge_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n", "x"), (4, "one two", "x"), (5, "one  two", "x"), (6, "one two", "x"), (6, "one two", "x"), (None, "one two", "x"), (7, "w " * 40_000, "x"), (8, "w " * 39_999, "x"), (9, "other text", "x"), (9, "text other", "x"), (None, "lonely one", "x")]
    got = sorted(((r["doc_id"], r["class_id"], r["class_size"]) for r in minhash.near_duplicate_classes(docs(spark, rows)).collect()), key=str)
    assert got == sorted([(1, 1, 2), (2, 1, 2), (3, 3, 1), (4, 4, 5), (5, 4, 5), (6, 4, 5), (6, 4, 5), (None, 4, 5), (7, 7, 2), (8, 7, 2), (9, 9, 1), (9, 9, 1), (None, None, 1)], key=str)
    assert minhash.near_duplicate_classes(docs(spark, [])).count() == 0
    table = docs(spark, [*rows, (4, "one two", "y")]).withColumn("__gone", F.lit(1)).withColumn("node", F.lit("clash")).withColumn("salt", F.lit(0)).withColumn("other", F.lit(0))
    kept = minhash.drop_near_duplicates(table)
    assert sorted(((r["doc_id"], r["text"][:9] if r["text"] else r["text"]) for r in kept.collect()), key=str) == sorted([(1, None), (3, " \n"), (4, "one two"), (7, "w w w w w"), (9, "other tex"), (9, "text othe"), (None, "lonely on")], key=str)
    assert kept.columns == table.columns
    assert minhash.drop_near_duplicates(docs(spark, [])).count() == 0


def test_hot_copies_leave_one_row(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(k, text, "x") for k in range(5, 305)] + [(3, f"{text} more", "x"), (3, f"{text} more", "x"), (400, f"{text} less", "x"), (2, "another text of its own", "x")]
    assert sorted((r["doc_id"], r["text"][-4:]) for r in minhash.drop_near_duplicates(docs(spark, rows)).collect()) == [(2, " own"), (3, "more")]


@pytest.mark.parametrize("times", [1, 10, 40, 100])
def test_repeated_lines_lose_no_link(spark, times):
    line, rest = "the same line is said here time and again", " ".join(f"w{k}" for k in range(200))
    rows = [(1, f"{rest} {line}", "x"), (2, f"{rest} " + " ".join([line] * times), "x"), (3, " ".join([line] * times), "x")]
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicate_classes(docs(spark, rows)).collect()}
    assert got[1] == got[2] == 1 and got[3] == 3


def test_signatures_estimate_probability_jaccard():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(5)
    a = [f"w{rng.randrange(400)}" for _ in range(900)]
    b = a[:600] + [f"v{rng.randrange(400)}" for _ in range(300)]
    weights = []
    for w in (a, b):
        weights.append({g: w.count(g) for g in w})
    keys = set(weights[0]) | set(weights[1])
    total = [sum(w.values()) for w in weights]
    share = [{k: w.get(k, 0) / t for k in keys} for w, t in zip(weights, total, strict=True)]
    exact = sum(1 / sum(max(share[0][y] / share[0][x], share[1][y] / share[1][x]) for y in keys) for x in keys if share[0][x] and share[1][x])
    [(_, data, offsets)] = minhash.blocks(pa.array([" ".join(a), " ".join(b)]))
    _, _, doc, h = minhash.words(data, offsets)
    sig = minhash.signatures(*minhash.counted(doc, h), 2, 4096)
    assert abs(float((sig[0] == sig[1]).mean()) - exact) < 4 * (exact * (1 - exact) / 4096) ** 0.5
    assert np.unique(sig).size > 100


def test_candidates_follow_the_verified_measure():
    import pyarrow as pa

    head, passage = [f"w{k}" for k in range(100)], [f"p{k}" for k in range(30)]
    for times in (5, 10, 60):  # a repeated passage changes counts, and hardly the set
        a, b = " ".join(head + passage), " ".join(head + passage * times)
        [signed] = minhash._signed([pa.record_batch({"id": pa.array([1, 2]), "text": pa.array([a, b])})], minhash.BANDS, minhash.ROWS, minhash.SHINGLE)
        keys = signed["keys"].to_pylist()
        assert minhash.jaccard(a, b) == pytest.approx(brute_jaccard(a, b)) and brute_jaccard(a, b) > 0.95
        assert len(set(keys[0]) & set(keys[1])) > 16


# --- URLs ---


def test_hosts_paths_and_rules(spark):
    urls = ["HTTP://A.Example.ORG/es/x?y#z", "https://example.org", "x://www.Foo.com/de/1", "no url", None, "a://b.c?d=/e", "s://example.org/en/12", "s://x.example.org/en/2", "s://notorg/", "s://ÄB.com/fr/", "http://u://v.org/"]
    got = {r["page_id"]: r for r in url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), html_col=None).collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) for i in range(len(urls))] == [
        ("a.example.org", "/es/x", "example.org/es/", "block"), ("example.org", "", None, "allow"), ("www.foo.com", "/de/1", "com/de/", "block"), ("", "", None, "allow"), ("", "", None, "allow"), ("b.c", "", None, "allow"),
        ("example.org", "/en/12", "example.org/en/1", "block"), ("x.example.org", "/en/2", "org/", "allow"), ("notorg", "/", None, "allow"), ("Äb.com", "/fr/", "com/fr/", "allow"), ("u:", "//v.org/", None, "allow"),
    ]


def test_blocks_follow_redirects_and_allows_win(spark):
    link = lambda u: f"<link rel='canonical' href='{u}'>"
    pages = [(1, "http://a.net/x", link("https://bad.com/de/1")), (2, "https://a.net/x?utm_source=q#f", ""), (3, "http://b.net/", "<META http-equiv=Refresh content='0; url=http://a.net/x/'>"), (4, "http://c.net/", link("http://bad.com/de/2")), (5, "http://ok.com/fr/", link("http://c.net/")), (6, "http://bad.com/de/1", None), (7, "http://bad.com/de/2", None), (8, None, None), (9, "http://d.net/y", ""), (6, "http://bad.com/de/1", None)]
    got = sorted((r["page_id"], r["verdict"]) for r in url_filter.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect())
    # 5 is allowed by its own rule; 4 has none, and its link from 5 doesn't clear it
    assert got == [(1, "block"), (2, "block"), (3, "block"), (4, "block"), (5, "allow"), (6, "block"), (6, "block"), (7, "block"), (8, "allow"), (9, "allow")]
    more = spark.createDataFrame([("http://d.net/y", "http://bad.com/de/9"), (None, "x")], "src string, dst string")
    pages.append((10, "http://bad.com/de/9", None))
    again = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), redirects=more).collect()}
    assert again[9] == "block"
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_relative_targets_are_edges(spark):
    link = lambda u: f"<link rel='canonical' href='{u}'>"
    meta = lambda u: f"<meta http-equiv='refresh' content='0; url={u}'>"
    page = "http://a.net/d/e/f?q=1"
    targets = [link("/x"), link("//b.net/y"), meta("/z"), link("g"), link("../h"), link("./../../../i"), link("?r=2"), link("mailto:x"), link("/j?u=http://k.net/"), link("http://l.net/m")]
    rows = spark.createDataFrame([(page, t) for t in targets] + [("no url", link("/x"))], "url string, html string")
    got = sorted(r["v"] for r in url_filter.page_links(rows).collect())
    assert got == sorted(["//a.net/x", "//b.net/y", "//a.net/z", "//a.net/d/e/g", "//a.net/d/h", "//a.net/i", "//a.net/d/e/f?r=2", "//a.net/j?u=http://k.net/", "//l.net/m"])


def test_components_decide_where_links_join_urls(spark):
    rng = random.Random(8)
    hosts = ["good.com/fr/", "bad.com/de/", "a.net/", "b.net/", "c.net/", "d.org/"]
    urls = [f"http://{rng.choice(hosts)}{k}" for k in range(120)]
    links = [(rng.choice(urls), rng.choice(urls)) for _ in range(70)]
    pages = [(k, u, "".join(f"<link rel=canonical href='{v}'>" for a, v in links if a == u)) for k, u in enumerate(urls)]
    root = roots(links, urls)  # all canonical links of a page count
    rule = lambda u: "allow" if ".com/fr/" in u or ".org/" in u else "block" if ".com/de/" in u else None
    bad = {root[u] for u in urls if rule(u) == "block"}
    want = [rule(u) or ("block" if root[u] in bad else "allow") for u in urls]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    for c in ("alias", "root", "k", "bad", "node", "blocked_by", "id"):
        table = table.withColumn(c, F.lit(1))
    got = url_filter.judge_urls(table).orderBy("page_id").collect()
    assert [r["verdict"] for r in got] == want and sum(r["blocked_by"] is not None for r in got) > 5
    long = [(1, "http://a.net/" + "x" * 100_000, "<p>" * 100_000 + "<link rel=canonical href='http://bad.com/de/1'>"), (2, "http://bad.com/de/1", None)]
    assert [r["verdict"] for r in url_filter.judge_urls(spark.createDataFrame(long, "page_id long, url string, html string")).collect()] == ["block", "block"]


# --- sampling ---


def test_gumbel_top_k_is_exact(spark):
    rng = random.Random(7)
    keys = [(i, rng.choice([rng.random(), 0.5, -3.0])) for i in range(300)]
    table = spark.createDataFrame(keys, "id long, sample_key double")
    for k in (0, 1, 37, 150, 299, 300, 400):
        got = {r["id"] for r in sampling.gumbel_top_k(table, k).filter("selected").collect()}
        assert got == {i for i, _ in sorted(keys, key=lambda x: (-x[1], x[0]))[:k]}


def test_gumbel_keys_sample_in_proportion(spark):
    rows = [(i, "", "x") for i in range(20_000)]
    keys = [r["sample_key"] for r in sampling.importance_keys(docs(spark, rows), __import__("numpy").zeros(1 << 10)).collect()]
    assert abs(sum(keys) / len(keys) - 0.5772) < 0.05 and abs(sum(x < 0 for x in keys) / len(keys) - 0.3679) < 0.02


def language_rows(seed, n=160):
    rng = random.Random(seed)
    syllables = {"en": ["th", "ing", "er", "and", "wh"], "fr": ["é", "eau", "que", "oi", "re"], "de": ["sch", "ü", "keit", "ung", "ß"]}
    text = lambda lang: " ".join("".join(rng.choices(syllables[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(5, 80)))
    return [(i, text(lang), lang) for i in range(n) for lang in [rng.choice(list(syllables))]]


def test_resampling_keeps_good_text(spark):
    good = language_rows(11)
    rows = good + [(1000 + i, " ".join(f"{w}&&&" for w in t.split()), x) for i, t, x in good[:50]] + [(2000, None, "en"), (2001, "", "en")]
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, *_ in rows[: len(good) + 50] if i % 2] + [(None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["selected"] for r in sampling.resample_quality(docs(spark, rows), labels).collect()}
    assert len(got) == len(rows) and sum(got[i] for i, *_ in good) >= 0.98 * len(good) and not any(got[1000 + i] for i in range(50) if 1000 + i in got)
    assert sampling.resample_quality(docs(spark, rows), labels.limit(0)).filter("selected").count() == len(rows)
    assert sampling.resample_quality(docs(spark, rows), labels, k=7).filter("selected").count() == 7
    assert sampling.resample_quality(docs(spark, []), labels).count() == 0
    kept = sampling.keep_resampled(docs(spark, rows), labels)
    assert kept.columns == ["doc_id", "text", "lang", "rep", "id"] and {r["doc_id"] for r in kept.collect()} == {i for i, x in got.items() if x}


# --- languages ---


@pytest.mark.parametrize("k", [2, 3, 4, 6, 9, 30])
def test_codewords_are_apart(k):
    code = language_id.codewords(k)
    apart = [int((code[a] != code[b]).sum()) for a in range(k) for b in range(a)]
    assert min(apart) >= (1 if k == 2 else 2) and all(0 < c.sum() < k for c in code.T)


def test_languages_are_told_apart(spark):
    train, held = language_rows(21), language_rows(22, 80)
    noisy = [*train, (900, None, "en"), (901, "some text", None), (None, "thing and", "en")]
    model = language_id.fit_languages(docs(spark, noisy))
    assert model.languages == ["de", "en", "fr"]
    got = {r["doc_id"]: r for r in language_id.identify_languages(docs(spark, [*held, (500, None, "en"), (501, "123 !?", "en"), (502, "", "en")]), model).collect()}
    assert sum(got[i]["lang_pred"] == x for i, _, x in held) >= 0.97 * len(held)
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (500, 501, 502)] == [("und", 0.0)] * 3
    assert all(0 <= r["score"] <= 1 for r in got.values())
    odd = [(1, "½ ²", "en"), (2, "\u0661 \u2163", "en"), (3, "1 é", "en"), (4, "thing " * 100_000, "en")]
    odd = {r["doc_id"]: r["lang_pred"] for r in language_id.identify_languages(docs(spark, odd), model).collect()}
    assert odd[1] == odd[2] == "und" and odd[3] != "und" and odd[4] == "en"
    one = language_id.fit_languages(docs(spark, [(1, "thing", "en")]))
    assert language_id.identify_languages(docs(spark, [(1, "x", "fr")]), one).first()["lang_pred"] == "en"
    none = language_id.fit_languages(docs(spark, []))
    assert language_id.identify_languages(docs(spark, [(1, "x", "fr")]), none).first()["lang_pred"] == "und"
    assert language_id.identify_languages(docs(spark, []), model).count() == 0


def test_bits_are_weighed_on_texts_held_back(spark):
    import math

    import numpy as np
    import pyarrow as pa

    rows = [*language_rows(41, 60), (700, "thing and", None), (701, None, "en"), (702, "", "zz"), (703, "x", "zz")]
    model = language_id.fit_languages(docs(spark, rows).repartition(5))
    back = {r["doc_id"] for r in docs(spark, rows).filter(F.pmod(F.xxhash64("text", F.lit(23)), F.lit(language_id.HELD_BACK)) == 0).collect()}
    used = [r for r in rows if r[1] is not None and r[2] in model.languages]
    assert model.languages == ["de", "en", "fr"] and 2 <= len([r for r in used if r[0] in back]) < len(used) / 3
    grams = {r[0]: language_id.gram_counts(*next(x[1:] for x in language_id._blocks(pa.array([r[1]]))), language_id.BUCKETS)[0] for r in used}
    p = np.array([sum((grams[r[0]] for r in used if r[2] == x and r[0] not in back), np.full(language_id.BUCKETS, 0.5)) for x in model.languages])
    p /= p.sum(axis=1, keepdims=True)
    trust = []
    for bit in range(model.code.shape[1]):
        ones, right, seen = model.code[:, bit] == 1, 0, 0
        odds = np.log(p[ones].mean(axis=0) / p[~ones].mean(axis=0))
        for i, _, x in used:
            if i in back:
                seen += 1
                right += bool(grams[i] @ odds > 0) == bool(model.code[model.languages.index(x), bit])
        trust.append(min(8, max(0.05, math.log((right + 1) / (seen - right + 1)))))
    assert model.trust == pytest.approx(np.array(trust) / np.mean(trust))


def test_mixed_languages_are_ambiguous(spark):
    model = language_id.fit_languages(docs(spark, language_rows(21)))
    by = {}
    for _, t, x in language_rows(22, 80):
        by.setdefault(x, []).extend(t.split())
    mixed, plain = [], []
    for k in range(12):
        a, b = (("de", "en"), ("en", "fr"), ("de", "fr"))[k % 3]
        parts = by[a][k * 20 : k * 20 + 20], by[b][k * 20 : k * 20 + 20]
        mixed.append((k, " ".join(w for pair in zip(*parts, strict=True) for w in pair), None))
        plain.append((100 + k, " ".join(parts[0]), None))
    got = {r["doc_id"]: r["ambiguous"] for r in language_id.identify_languages(docs(spark, mixed + plain), model).collect()}
    assert any(got[i] for i, _, _ in mixed) and not any(got[i] for i, _, _ in plain)


def test_held_out_is_a_quarter(spark):
    import zlib

    got = spark.range(400).select(F.col("id"), language_id.held_out("id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in got)


def test_language_margins_match_brute_force(spark):
    import math
    import zlib

    import numpy as np

    def grams(text):
        low = bytes(c + 32 if 65 <= c <= 90 else 32 if c in b"\t\n\v\f\r" else c for c in text.encode())
        for k in (1, 2, 3):
            for i in range(len(low) - k):
                rolled = np.array([int.from_bytes(low[i : i + k + 1])], np.uint64)
                yield int((language_id.mix(rolled, k) & np.uint64(language_id.BUCKETS - 1))[0])

    rows = language_rows(31, 24)
    model = language_id.fit_languages(docs(spark, rows))
    counts = {x: np.full(language_id.BUCKETS, 0.5) for x in model.languages}
    for _, t, x in rows:
        for g in grams(t):
            counts[x][g] += 1
    p = np.array([counts[x] / counts[x].sum() for x in model.languages])
    for i, t, _ in language_rows(32, 6):
        found = list(grams(t))
        loss = []
        for word in model.code:
            total = 0.0
            for bit, trust in enumerate(model.trust):
                ones = model.code[:, bit] == 1
                odds = sum(math.log(p[ones, g].mean() / p[~ones, g].mean()) for g in found) * language_id.EVIDENCE / len(found)
                total += trust * math.log1p(math.exp(-odds if word[bit] else odds))
            loss.append(total)
        got = language_id.identify_languages(docs(spark, [(i, t, None)]), model).first()
        assert got["lang_pred"] == model.languages[int(np.argmin(loss))]
        assert got["score"] == pytest.approx(1 / sum(math.exp(min(loss) - x) for x in loss), rel=1e-3)
    assert language_id.held_out is not None and zlib.crc32(b"1") % 4 in range(4)


def test_log_weights_match_brute_force(spark):
    import numpy as np
    import pyarrow as pa

    rng = random.Random(17)
    ratios = np.random.default_rng(1).normal(size=1 << 12)
    texts = [None, "", "one", *(" ".join(rng.choices(["a", "Bb", "c9", "d!", "é"], k=rng.randrange(1, 40))) for _ in range(30)), "word " * 50_000]
    got = {r["id"]: r for r in sampling.importance_keys(docs(spark, [(k, t, "x") for k, t in enumerate(texts)]), ratios).collect()}
    for k, t in enumerate(texts[:-1]):
        total = n = 0
        if t:  # a text by itself has the n-grams that it has among others
            [(_, data, offsets)] = sampling.blocks(pa.array([t]))
            for b in sampling._grams(data, offsets, len(ratios))[1].tolist():
                total, n = total + ratios[b], n + 1
            assert n == 4 * len(t.split()) - 2  # words, their shapes, and pairs of both
        assert got[k]["n_grams"] == n and got[k]["log_weight"] == pytest.approx(total)
    assert got[len(texts) - 1]["n_grams"] == 4 * 50_000 - 2


@pytest.fixture
def small_corpus(spark, tmp_path):
    rng = random.Random(12)
    rows = near_rows(7)
    rows = [(i, t, "en", "web", None if i % 11 else len(t), "clash", 1) for i, t, _ in rows]
    n = len(rows)
    rows += [(n + k, rows[k][1] + "  ", "en", "web", 0, None, None) for k in range(0, 20, 3)]  # exact copies but for white space
    rows += [(n + 100, None, None, None, None, None, None), (n + 101, "", "en", "web", 0, "x", 2), (n + 102, "word " * 30_000, "en", "web", 0, "x", 2)]
    rows += [(n + 110 + k, f"mail bob{k}@example.com or call +1 (415) 555-{2000 + k} " + " ".join(f"v{rng.randrange(10**6)}" for _ in range(60)), "en", "web", 0, "x", 2) for k in range(4)]
    docs_table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node string, sha int")
    docs_table.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(n)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path), [(r[0], r[1]) for r in rows]


def test_pipeline_matches_brute_force(spark, small_corpus):
    import re
    import struct
    import zlib

    import corpus_pipeline
    from pairloom.llm import packing, pii
    from pairloom.llm.queries import PII_KEY

    sf, rows = small_corpus  # all labels are good: the classifier lets all stay
    first = {}
    for i, t in sorted(rows):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), (i, t))
    left = sorted(first.values())
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()) for i, t in left for w in [(t or "").split()]}
    like = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0
    ids = [i for i, _ in left]
    root = roots([(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if like(a, b)], ids)
    make, encoder = pii.Pseudonyms(PII_KEY.encode()), packing.TextIds(packing.tokenizer_path())
    want = {}
    for i, t in left:
        if root[i] == i:
            got = [*encoder.tokenizer.encode(pii.pseudonymise(t or "", make)[0], add_special_tokens=False).ids, 2]
            want[i] = (len(got), zlib.crc32(struct.pack(f"<{len(got)}I", *got)))
    packed = corpus_pipeline.run(spark, sf).collect()
    by_doc = {}
    for r in packed:
        by_doc.setdefault(r["doc_id"], []).extend((r["start"] + k, x) for k, x in enumerate(r["ids"]))
    got = {i: (len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *(v for _, v in sorted(x))))) for i, x in by_doc.items()}
    assert got == want
    assert all(a != b for a, b in ((dict(rows)[i], pii.pseudonymise(dict(rows)[i], make)[0]) for i in want if "bob" in (dict(rows)[i] or "")))


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    d, sizes = table, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, sf).cache()
        assert d.columns == table.columns, name
        sizes.append(d.count())
    packed = corpus_pipeline.STAGES[-1][1](spark, d, sf)
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * table.count()
    assert packed.select("doc_id").distinct().count() == sizes[-1]


def test_staged_tables_are_released(spark):
    import os

    from pairloom.llm import _stage

    before = set(_stage._written)
    got = minhash.near_duplicate_classes(docs(spark, near_rows(9))).count()
    left = {p.rsplit("/", 1)[1] for p in set(_stage._written) - before}
    assert got > 0 and left <= {"texts", "edges", "links"}  # what the result still reads, and the last links
    _stage.drop_tables()
    assert not any(os.path.exists(p) for p in before)


def test_a_cluster_without_a_shared_folder_is_refused(monkeypatch):
    from types import SimpleNamespace

    from pairloom.llm import _stage

    session = lambda master, at=None: SimpleNamespace(
        sparkContext=SimpleNamespace(master=master, getConf=lambda: {"spark.checkpoint.dir": at} if at else {}, getCheckpointDir=lambda: "x"), conf=SimpleNamespace(get=lambda k, d: d)
    )
    assert _stage.shared_dir(session("local[4]")) == _stage.DEFAULT_DIR and _stage.shared_dir(session("yarn", "hdfs://x/y/")) == "hdfs://x/y"
    for master in ("yarn", "spark://h:7077", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
            _stage.shared_dir(session(master))


# --- links and rules of url filters ---


def test_url_links_of_all_kinds(spark):
    bad = "http://bad.example/x?x=1&y=2"
    rules = (url_filter.UrlRule("bad.example", "/", False),)
    pages = [
        (1, "http://a.org/1", f'<link rel="canonical" href="http://a.org/ok"><link href="{bad.replace("&", "&amp;")}" rel=canonical>', "block"),  # the second one
        (2, "http://a.org/2", f"<link rel='nofollow Canonical' href='{bad}'>", "block"),
        (3, "http://a.org/3", '<link rel="canonical" href="http://bad.example/x?x=1&amp;y=2">', "block"),
        (4, "http://a.org/4", '<link rel="canonical" href="http://bad.example/x?x=1&#38;y=2">', "block"),
        (5, "http://a.org/5", '<link rel="canonical" href="http://bad&#x2E;example/x?x=1&#x26;y=2">', "block"),
        (6, "http://a.org/6", f'<!-- <link rel="canonical" href="{bad}"> -->', "allow"),
        (7, "http://a.org/7", f'<link rel="canonicals" href="{bad}"><link data-rel="canonical" href="{bad}">', "allow"),
        (8, "http://a.org/8", f'<meta http-equiv="refresh" content="0; url=http://a.org/ok"><META content="1;URL=\'{bad}\'" HTTP-EQUIV=Refresh>', "block"),
        (9, "http://a.org/9", '<link rel="stylesheet" href="/s.css"><link rel="canonical">', "allow"),
        (10, bad, None, "block"),
        (11, None, f'<link rel="canonical" href="{bad}">', "allow"),
        (12, "http://a.org/12", "<link " * 5000 + "<!--" * 5000, "allow"),
    ]
    table = spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(table, rules).collect()}
    # page 1 and 8 join the component that holds a.org/ok as well
    assert got == {p[0]: p[3] for p in pages}


def test_ten_thousand_rules_equal_the_case_expression(spark):
    rng = random.Random(5)
    hosts = ["org", "b.org", "a.b.org", "com", "x.com"]
    few = tuple({(h, p): url_filter.UrlRule(h, p, rng.random() < 0.5) for h in hosts for p in ["/", "/a", "/a/b", "/ab", "/a/b/c?"[: rng.randint(1, 6)]]}.values())
    urls = [f"http://{rng.choice(['', 'www.', 'a.', 'b.', 'q.a.b.'])}{rng.choice([*hosts, 'net', ''])}{rng.choice(['', '/', '/a', '/a/b/c', '/abc', '/z'])}" for _ in range(150)] + [None, "no url"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    many = few + tuple(url_filter.UrlRule(f"h{k}.net", f"/{'x' * (k % 50)}", False) for k in range(10_000))
    short = sorted(map(tuple, url_filter.judge_urls(pages, few, html_col=None).collect()))
    assert sorted(map(tuple, url_filter.judge_urls(pages, many, html_col=None).collect())) == short
    table = spark.createDataFrame([(r.host, r.path, r.allow) for r in few] + [(None, "/", True)], url_filter.RULE_TABLE)
    assert sorted(map(tuple, url_filter.judge_urls(pages, table, html_col=None).collect())) == short
    assert len({r[3] for r in short}) > 8
    assert all(r[4] == "block" for r in url_filter.judge_urls(spark.createDataFrame([(1, "http://www.h77.net/" + "x" * 60)], "page_id int, url string"), many, html_col=None).collect())


def test_rows_without_an_id_are_dealt_over_salts(spark):
    from pairloom.llm.salted import SALTS, salt_of

    text = "one two three four five six seven"
    table = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") % 50 == 0, F.concat(F.lit("other "), F.col("id"))).otherwise(text).alias("text")).repartition(5)
    sizes = [r["count"] for r in table.groupBy(salt_of("doc_id").alias("s")).count().collect()]
    assert len(sizes) == SALTS and max(sizes) < 2 * sorted(sizes)[SALTS // 2]
    groups = exact_dedup.exact_groups(table)
    assert {tuple(r) for r in groups.groupBy("group_size", "kept").count().collect()} == {(1, True, 400), (19_600, True, 1), (19_600, False, 19_599)}
    assert exact_dedup.drop_exact_copies(table).count() == 401
    classes = minhash.near_duplicate_classes(table)
    assert {tuple(r) for r in classes.groupBy("class_size").count().collect()} == {(1, 400), (19_600, 19_600)}
    assert minhash.drop_near_duplicates(table).count() == 401


def test_bitmap_of_nodes_lets_every_node_through(spark):
    import pyarrow as pa

    from pairloom.llm import minhash

    nodes = spark.range(300).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("node"), "id")
    bits, place = minhash._bitmap_of_nodes(nodes.filter("id < 40"))
    table = nodes.select("node", F.lit("").alias("text"), place.alias("place"), "id").toArrow()
    kept = [r for b in table.to_batches() for x in minhash._in_bitmap([b], bits) for r in x.column(3).to_pylist()]
    assert set(range(40)) <= set(kept) and len(kept) < 150
