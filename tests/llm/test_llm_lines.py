"""Line dedup, vector codes and collocations against brute force."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.llm import collocations, line_dedup, vector_codes

# --- line dedup ---

BLANK = " \t\n\x0b\x0c\r"


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_lines(rows, min_docs=2, min_chars=10):
    split = [(i, (t or "").split("\n")) for i, t in rows]
    held = defaultdict(list)
    for i, lines in split:
        for key in {ascii_lower(x.strip(BLANK)) for x in lines}:
            held[key].append(i)
    out = []
    for i, lines in split:
        kept = []
        for x in lines:
            key = ascii_lower(x.strip(BLANK))
            ids = held[key]
            low = min((y for y in ids if y is not None), default=None)
            if len(key) < min_chars or len(ids) < min_docs or i == low:
                kept.append(x)
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def line_rows(spark, rows):
    return spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, mark string, N_LINES int")


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("min_docs", [2, 3])
def test_line_dedup_equals_brute_force(spark, seed, min_docs):
    rng = random.Random(seed)
    pool = ["a shared line of text", "  A Shared LINE of text\t", "ninechars", "exactly 10", "ÉTUDE ÉTUDE", "étude étude", "", " ", "own", "tabs\there and there\r", "\U0001f600" * 10, "\U0001f600" * 9]
    rows = [(rng.choice([None, *range(30)]), "\n".join(rng.choice([*pool, f"line of its own {rng.random()}"]) for _ in range(rng.randint(0, 9)))) for _ in range(60)]
    rows += [(4, None), (None, None), (5, ""), (6, "\n\n"), (7, "a shared line of text"), (7, "a shared line of text"), (2, "twice in one text\ntwice in one text")]
    got = line_dedup.dedup_lines(line_rows(spark, rows), min_docs=min_docs)
    assert got.columns == ["doc_id", "text", "mark", "N_LINES", "n_lines_", "n_dropped"]
    assert sorted(((r["doc_id"], r["text"], r["n_lines_"], r["n_dropped"]) for r in got.collect()), key=str) == brute_lines(rows, min_docs)


def test_line_dedup_of_long_texts_and_empty_table(spark):
    many = "\n".join(f"numbered line {k % 7000}" for k in range(20_000))
    rows = [(1, many), (2, many), (3, "x" * 2_000_000 + "\nnumbered line 5"), (4, "x" * 2_000_000)]
    assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.dedup_lines(line_rows(spark, rows).drop("N_LINES")).collect()), key=str) == brute_lines(rows)
    assert line_dedup.dedup_lines(line_rows(spark, [])).count() == 0


# --- vector codes ---


def floor_books(rows, parts, entries, rounds):
    """Lloyd's rounds by plain loops over Python's integers."""
    kept = [(i, lab, [math.floor(256 * float(x)) for x in v]) for i, lab, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    w = len(kept[0][2]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, _, v in kept[:entries]] for p in range(parts)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            hits = defaultdict(list)
            for _, _, v in kept:
                hits[near(cut(v, p), books[p])[1]].append(cut(v, p))
            for e, own in hits.items():
                books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    coded = []
    for i, lab, v in kept:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        coded.append((i, lab, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    return coded, books


VECTORS = "vec_id long, embedding array<float>, label int, id string, code string"


def vector_rows(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", "y") for i, lab, v in rows], VECTORS).repartition(3)


@pytest.mark.parametrize("n, parts, width, entries, spread", [(900, 4, 3, 16, 1), (300, 2, 1, 8, 0.02), (40, 16, 2, 64, 1), (5, 4, 2, 64, 1), (700, 2, 2, 5, 0.01)])
def test_vector_codes_equal_plain_rounds(spark, n, parts, width, entries, spread):
    rng = random.Random(n)
    f32 = lambda x: float(np.float32(x))
    rows = [(rng.choice([k, k, 3, None]) if k > 4 else k, rng.choice([None, 1, 1, 2]), [f32(rng.gauss(0, spread)) for _ in range(parts * width)]) for k in range(n)]
    rows += [(n + 1, 1, None), (n + 2, None, [None] * (parts * width)), (n + 3, 1, [math.nan] * (parts * width)), (n + 4, 1, [math.inf] + [0.0] * (parts * width - 1)), (-1, 1, [])]
    rows += [(k, 9, rows[0][2]) for k in range(50)]  # many copies of one vector
    coded, books = floor_books(rows, parts, entries, 2)
    got, model = vector_codes.compress_vectors(vector_rows(spark, rows), parts=parts, entries=entries)
    assert model.books.tolist() == books
    assert model.sha256 == hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(coded, key=str)
    total = Counter()
    for _, lab, _, err in coded:
        total[lab] += err
    assert all(r["label_error"] == total[r["label"]] for r in vector_codes.with_label_error(got).collect())


def test_vector_codes_hold_large_numbers(spark):
    rng = random.Random(4)
    rows = [(k, 0, [float(np.float32(rng.choice([1.0, 1e3, 1e7]) * rng.gauss(0, 1))) for _ in range(4)]) for k in range(200)]
    coded, books = floor_books(rows, 2, 8, 2)
    got, model = vector_codes.compress_vectors(vector_rows(spark, rows), parts=2, entries=8)
    assert model.books.tolist() == books
    want = sorted((i, lab, code, err if err < 1 << 63 else None) for i, lab, code, err in coded)
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compress_vectors(vector_rows(spark, rows), parts=3)


def test_vector_codes_of_empty_table(spark):
    got, model = vector_codes.compress_vectors(vector_rows(spark, [(1, 2, None)]))
    assert got.count() == 0 and model.sha256 == hashlib.sha256(b"").hexdigest()
    assert vector_codes.with_label_error(got).count() == 0


def test_trees_assign_whole_subtrees():
    rng = np.random.default_rng(1)
    points = np.floor(np.concatenate([rng.normal(c, 3, (400, 2)) for c in (0, 100, 200)]))
    book = np.array([[0.0, 0.0], [100.0, 100.0], [200.0, 200.0], [0.0, 0.0]])
    tree = vector_codes.Tree.built(points)
    whole, single, _ = vector_codes.filtered(tree, book)
    assert len(single) < 60 and sum(len(nodes) for _, nodes, _ in whole) < 20
    sums, counts = vector_codes.tree_sums(tree, book)
    assert counts.tolist() == [400, 400, 400, 0] and sums[1].tolist() == points[400:800].sum(0).tolist()


# --- collocations ---


def brute_phrases(rows, min_count=30, top=2000):
    import re

    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", ascii_lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 5):
                for k in range(len(words) - m + 1):
                    f[lang, tuple(words[k : k + m])] += 1
    out = defaultdict(list)
    for (lang, p), a in f.items():
        if len(p) < 2 or a < min_count:
            continue
        score, _, left, right = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        if any(g == lang and len(q) > len(p) and b >= min_count and 100 * b >= 80 * a and any(q[s : s + len(p)] == p for s in range(len(q) - len(p) + 1)) for (g, q), b in f.items()):
            continue
        out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, k + 1, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for k, (s, a, p, left, right) in enumerate(sorted(found)[:top]))


def phrase_rows(spark, rows):
    return spark.createDataFrame([(t, lang, "x", 1) for t, lang in rows], "text string, lang string, phrase string, f int").repartition(3)


@pytest.mark.parametrize("seed, min_count, top", [(1, 3, 2000), (2, 5, 4), (3, 2, 2000)])
def test_collocations_equal_brute_force(spark, seed, min_count, top):
    rng = random.Random(seed)
    bag = ["New York", "new york city", "the", "of", "École", "école", "a b", "hot  dog", "hot\tdog", "x"]
    rows = [("".join(rng.choice(bag) + rng.choice([" ", " ", "\t", ", ", "\n", ". "]) for _ in range(rng.randint(0, 25))), rng.choice(["en", "fr", None, "und"])) for _ in range(70)]
    rows += [(None, "en"), ("", None), (" ,. ", "de"), ("one two three four five " * 40, "x y"), ("solo", "z")]
    got = collocations.mine_collocations(phrase_rows(spark, rows), min_count=min_count, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute_phrases(rows, min_count, top)


def test_collocations_of_long_texts_few_bits_and_empty_table(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(" ".join(rng.choice("abcdefgh") for _ in range(30_000)), "en"), ("a b c d " * 100, "en"), ("a b c d", "fr")]
    want = brute_phrases(rows, 40)
    assert sorted(tuple(r) for r in collocations.mine_collocations(phrase_rows(spark, rows), min_count=40).collect()) == want
    # a bitmap that is full strikes nothing out, and the result is the same
    monkeypatch.setattr(collocations, "_bitmap", lambda grams, level: np.full(128, 2**64 - 1, np.uint64))
    assert sorted(tuple(r) for r in collocations.mine_collocations(phrase_rows(spark, rows), min_count=40).collect()) == want
    assert collocations.mine_collocations(phrase_rows(spark, [])).count() == 0
    assert collocations.mine_collocations(phrase_rows(spark, [("a b", "en")])).count() == 0


def test_collocation_scores_pass_64_bits(spark):
    a = 5 * 10**12
    got = spark.range(1).select(F.lit(a).alias("a"), F.lit(a).alias("l"), F.lit(a).alias("r")).selectExpr("(cast(a as decimal(19, 0)) * cast(2000000 as decimal(10, 0))) div cast(l + r as decimal(19, 0)) as s").collect()
    assert got[0]["s"] == 2_000_000 * a // (2 * a)
