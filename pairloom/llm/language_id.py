"""Language ID with error-correcting output codes.

Each language has a codeword of bits. A binary n-gram classifier predicts each bit: the log
odds of hashed byte n-grams between the languages whose bit is set and the others. The
n-gram counts by language come from all training texts. A text goes to the codeword with
the least loss, each bit's logistic loss weighted by how well its classifier does on training
texts that it wasn't counted from: one of eight is held back for that, judged by the counts of
the others, and counted in the final model. A small lead over the second codeword marks ambiguity.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._words import U, blocks, mix

BUCKETS, UNKNOWN = 1 << 14, "und"
#: One of this many training texts tells the weights of the bits.
HELD_BACK = 8
#: Up to this many languages the code is exhaustive; beyond, random words of this many bits a doubling.
EXHAUSTIVE, BITS_A_DOUBLING = 6, 12
#: A score under this is flagged as ambiguous.
AMBIGUOUS = 0.75
#: Log odds a text's n-grams count as, whatever its length: n-grams of one text are not independent.
EVIDENCE = 24.0
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_LOW[[9, 10, 11, 12, 13]] = 32


def has_letter(text: str | None) -> bool:
    """Whether a character is alphabetic; numbers such as one half or a superscript two are not."""
    return any(map(str.isalpha, text or ""))


def codewords(k: int, seed: int = 17) -> np.ndarray:
    """Codewords (languages x bits) of 0 and 1: exhaustive, or the best of random ones."""
    if k < 2:
        return np.zeros((k, 0), np.int8)
    if k <= EXHAUSTIVE:
        columns = [(1, *c) for c in itertools.product((1, 0), repeat=k - 1) if 0 in c]
        return np.array(columns, np.int8).T
    bits, rng, best = int(BITS_A_DOUBLING * np.ceil(np.log2(k))), np.random.default_rng(seed), None
    for _ in range(50):
        code = rng.integers(0, 2, (k, bits), dtype=np.int8)
        code = code[:, (code.min(axis=0) == 0) & (code.max(axis=0) == 1)]
        ones = code.astype(np.int32)
        apart = ones @ (1 - ones).T + (1 - ones) @ ones.T
        np.fill_diagonal(apart, bits)
        if best is None or apart.min() > best[0]:
            best = (apart.min(), code)
    return best[1]


def gram_counts(data: np.ndarray, offsets: np.ndarray, buckets: int) -> np.ndarray:
    """Counts (texts x buckets) of the byte n-grams of 2 to 4 bytes, A-Z lower-cased."""
    n, low = len(offsets) - 1, _LOW[data].astype(U)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    out, rolled = np.zeros(n * buckets, np.float32), low
    for k in range(1, 4):
        if len(low) <= k:
            break
        rolled = rolled[:-1] * U(256) + low[k:]
        whole = doc[:-k] == doc[k:]
        spot = doc[:-k] * buckets + (mix(rolled, k) & U(buckets - 1)).astype(np.int64)
        out += np.bincount(spot[whole], minlength=n * buckets)
    return out.reshape(n, buckets)


def _blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks of at most 64 texts, since their count table is dense."""
    for first, data, offsets in blocks(column, 1 << 18):
        for k in range(0, len(offsets) - 1, 64):
            part = offsets[k : k + 65]
            yield first + k, data[part[0] : part[-1]], part - part[0]


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def margins(self, counts: np.ndarray) -> np.ndarray:
        return EVIDENCE * (counts @ self.weights) / np.maximum(counts.sum(axis=1, keepdims=True), 1)

    def decode(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest codeword and a score from 0 to 1."""
        if len(self.languages) == 1:
            return np.zeros(len(counts), int), np.ones(len(counts))
        m = self.margins(counts)
        loss = (np.logaddexp(0, -m) * self.trust) @ self.code.T + (np.logaddexp(0, m) * self.trust) @ (1 - self.code.T)
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        return loss.argmin(axis=1), 1 / p.sum(axis=1)


def _by_language(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """(text, lang, back) to each language's counts, those of texts held back apart."""
    totals: dict[tuple[str, bool], np.ndarray] = {}
    for batch in batches:
        keys = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
        for first, data, offsets in _blocks(batch.column(0)):
            counts, mine = gram_counts(data, offsets, buckets), keys[first : first + len(offsets) - 1]
            for x in set(mine):
                totals[x] = totals.get(x, np.zeros(buckets)) + counts[[k == x for k in mine]].sum(axis=0)
    for (x, back), counts in totals.items():
        some = np.flatnonzero(counts)
        yield pa.record_batch({"lang": pa.array([x] * len(some), pa.string()), "back": pa.array([back] * len(some), pa.bool_()), "bucket": pa.array(some, pa.int32()), "n": pa.array(counts[some])})


def _model(languages: list[str], code: np.ndarray, counts: np.ndarray) -> LanguageModel:
    """The bits' log odds by counts (languages x buckets), half a count added; all bits trusted alike."""
    table, ones = counts + 0.5, code.astype(float)
    p = table / table.sum(axis=1, keepdims=True)
    sides = [(s.T @ p) / np.maximum(s.sum(axis=0), 1)[:, None] for s in (ones, 1 - ones)]
    return LanguageModel(languages, code, (np.log(sides[0]) - np.log(sides[1])).T, np.ones(code.shape[1]))


def _right_bits(batches: Iterator[pa.RecordBatch], model: LanguageModel) -> Iterator[pa.RecordBatch]:
    """(text, lang) to how many texts each bit's classifier is right on: a row a bit, and one for the texts."""
    at, right, seen = {x: k for k, x in enumerate(model.languages)}, np.zeros(model.code.shape[1], np.int64), 0
    for batch in batches:
        lang = batch.column(1).to_pylist()
        for first, data, offsets in _blocks(batch.column(0)):
            m, mine = model.margins(gram_counts(data, offsets, len(model.weights))), lang[first : first + len(offsets) - 1]
            known = [k for k, x in enumerate(mine) if x in at]  # a language may have no text with an n-gram
            truth = model.code[[at[mine[k]] for k in known]]
            right, seen = right + ((m[known] > 0) == truth).sum(axis=0), seen + len(known)
    yield pa.record_batch({"bit": pa.array(range(len(right) + 1), pa.int32()), "n": pa.array([*right, seen], pa.int64())})


def bit_weights(right: np.ndarray, seen: int) -> np.ndarray:
    """The log odds that a bit is right, within bounds, with a mean of 1."""
    accuracy = (right + 1) / (seen + 2)
    trust = np.log(accuracy / (1 - accuracy)).clip(0.05, 8)
    return trust / trust.mean()


def fit_languages(train: DataFrame, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Count every training text with a language; rows with a null text or language are not used.

    The driver gets counts (languages x buckets) and a number a bit, and no text. Repeated rows
    are held back together, so none is judged by its copy's counts.
    """
    back = F.pmod(F.xxhash64("text", F.lit(23)), F.lit(HELD_BACK)) == 0
    rows = train.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text is not null and lang is not null").withColumn("back", back)
    counted = rows.mapInArrow(lambda b: _by_language(b, buckets), "lang string, back boolean, bucket int, n double")
    counts = counted.groupBy("lang", "back", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = counts.column("lang").to_numpy()
    languages, spot = np.unique(names.astype(str), return_inverse=True)
    apart = np.zeros((2, len(languages), buckets))
    apart[counts.column("back").to_numpy().astype(int), spot, counts.column("bucket").to_numpy()] = counts.column("n").to_numpy()
    languages, code = languages.tolist(), codewords(len(languages))
    model = _model(languages, code, apart.sum(axis=0))
    if len(languages) > 1:
        judged = _model(languages, code, apart[0])
        right = rows.filter("back").select("text", "lang").mapInArrow(lambda b: _right_bits(b, judged), "bit int, n long")
        found = dict(right.groupBy("bit").agg(F.sum("n")).collect())  # a row a bit
        model.trust = bit_weights(np.array([found.get(k, 0) for k in range(code.shape[1])]), found.get(code.shape[1], 0))
    return model


def identify_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, lang_pred, score, ambiguous.

    ``und`` (score 0) for null texts, texts without a letter, and where no language was
    learned. Null ids and repeated rows get rows like others; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind, buckets = rows.schema["id"].dataType.simpleString(), len(model.weights)
    names = np.array([*model.languages, UNKNOWN], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = np.array([has_letter(x) for x in batch.column(1).to_pylist()], bool)
            for first, data, offsets in _blocks(batch.column(1)):
                n = len(offsets) - 1
                best, score = model.decode(gram_counts(data, offsets, buckets)) if model.languages else (np.zeros(n, int), np.zeros(n))
                good = letters[first : first + n] & bool(model.languages)
                score = np.where(good, score, 0.0)
                yield pa.record_batch({"id": batch.column(0).slice(first, n), "lang_pred": pa.array(names[np.where(good, best, len(names) - 1)], pa.string()), "score": score, "ambiguous": good & (score < AMBIGUOUS)})

    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double, ambiguous boolean").withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id") -> Column:
    """True for a quarter of the ids, by crc32; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
