"""Phrase collocations by Apriori level-wise passes.

Pass k counts the k-grams whose two overlapping (k-1)-grams are both frequent. A pass reads the
texts by blocks; a block's words and grams are small numbers (dictionaries, no hashes), so it
sends each distinct phrase once, with its exact count, and Spark adds these up by language and
phrase. Which (k-1)-grams are frequent is broadcast as a bitmap of their hashes: at most
``MAX_BITS`` bits whatever the corpus holds. Two grams on one bit can only let a rare k-gram be
counted in vain, which its count then drops: a k-gram of enough occurrences always has frequent
parts, so results are exact.

The level tables hold all frequent grams, and so the parts of every cut of every candidate. Cuts
and containment are joins of these tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _words
from ._stage import stage_table

#: What parts words, and what parts pieces (fixed values).
GAPS, CUTS = b" \t", b".,;:!?\n\x0b\x0c\r"
#: Bytes of text whose phrases are added up before they are sent; a longer text is a block of its own.
BLOCK = 1 << 23
#: Bits for each frequent gram, and at most for all: 32 MB.
BITS_A_GRAM, MAX_BITS = 16, 1 << 28
GRAM_SEED = 0x632BE59BD9B4E019

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CUT = np.zeros(256, bool)
_CUT[list(CUTS)] = True
_WORD = ~_CUT
_WORD[list(GAPS)] = False


def _numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each value among the distinct ones, and these."""
    coded = pa.array(x).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_numpy()


def _strings(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))


def _hashes(strings: pa.Array) -> np.ndarray:
    """64-bit hashes of strings without white space, one each."""
    out = [_words.words(data, offsets)[3] for _, data, offsets in _words.blocks(strings)]
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _of_lang(langs: pa.Array) -> np.ndarray:
    """A hash of each language's name, which may be any string."""
    named = [int.from_bytes(hashlib.blake2b(str(x).encode(), digest_size=8).digest(), "little") for x in langs.to_pylist()]
    return np.array(named, np.uint64)


def _longer(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _words.mix(prefix * np.uint64(GRAM_SEED) + word)


def _asked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(64 - int(len(bits) * 64).bit_length() + 1)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def block_grams(data: np.ndarray, offsets: np.ndarray, langs: pa.Array, level: int, bits: list[np.ndarray]) -> tuple[pa.Array, pa.Array, np.ndarray] | None:
    """(language, phrase, count) of the distinct ``level``-grams of a block of texts, or None.

    ``bits`` holds the bitmaps of levels 1 to ``level`` - 1.
    """
    n = len(data)
    data = _LOWER[data]
    full, cut = _WORD[data], _CUT[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    cut |= edge[:n]
    starts = np.flatnonzero(full & (~np.concatenate([[False], full[:-1]]) | edge[:n])) if n else np.zeros(0, np.int64)
    if not len(starts):
        return None
    ends = np.flatnonzero(full & (~np.concatenate([full[1:], [False]]) | edge[1:])) + 1
    piece = np.cumsum(cut)[starts]
    doc = np.searchsorted(offsets, starts, "right") - 1
    coded = _strings(data[full], ends - starts).dictionary_encode()
    spoken = langs.cast(pa.string()).dictionary_encode()
    n_words = len(coded.dictionary)
    both, pairs = _numbered(spoken.indices.to_numpy()[doc].astype(np.int64) * n_words + coded.indices.to_numpy())
    of_word, of_lang = pairs % n_words, pairs // n_words
    texts = coded.dictionary.take(pa.array(of_word))
    phrases, grams, last = texts, both, np.arange(len(pairs))
    if level > 1:
        word_hash = _hashes(coded.dictionary)[of_word]
        hashes = _longer(_of_lang(spoken.dictionary)[of_lang], word_hash)
    for k in range(2, level + 1):
        known = _asked(bits[k - 2], hashes)[grams] & (grams >= 0)  # of -1 any answer, then the sign
        m = max(0, len(both) - k + 1)
        use = known[:m] & known[1 : m + 1] & (piece[:m] == piece[k - 1 :])
        at = np.flatnonzero(use)
        if not len(at):
            return None
        number, pairs = _numbered(grams[at].astype(np.int64) * len(texts) + both[at + k - 1])
        before, last = pairs // len(texts), pairs % len(texts)
        grams = np.full(m, -1, np.int64)
        grams[at] = number
        phrases = pc.binary_join_element_wise(phrases.take(pa.array(before)), texts.take(pa.array(last)), pa.scalar(" ", pa.large_string()))
        hashes = _longer(hashes[before], word_hash[last])
    return spoken.dictionary.take(pa.array(of_lang[last])), phrases, np.bincount(grams[grams >= 0], minlength=len(phrases))


def _counter(level: int, sent: list) -> Callable:
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [x.value for x in sent]
        for part in parts:
            langs = part.column("lang")
            for row, data, offsets in _words.blocks(part.column("text"), BLOCK):
                found = block_grams(data, offsets, langs.slice(row, len(offsets) - 1), level, bits)
                if found is None:
                    continue
                lang, phrase, counts = found
                if level == 1:  # a null phrase carries the number of all words
                    spoken = lang.dictionary_encode()
                    lang = pa.concat_arrays([lang, spoken.dictionary])
                    phrase = pa.concat_arrays([phrase.cast(pa.string()), pa.nulls(len(spoken.dictionary), pa.string())])
                    counts = np.concatenate([counts, np.bincount(spoken.indices.to_numpy(), weights=counts)]).astype(np.int64)
                for k in range(0, len(counts), 100_000):
                    yield pa.record_batch([lang[k : k + 100_000].cast(pa.string()), phrase[k : k + 100_000].cast(pa.string()), pa.array(counts[k : k + 100_000], pa.int64())], schema)

    return batches


def _bitmap(grams: DataFrame, level: int) -> np.ndarray:
    """The bitmap of a level's frequent grams, put together on the executors by words of 64 bits."""
    count = grams.count()
    size = min(MAX_BITS, max(1 << 13, 1 << (BITS_A_GRAM * count - 1).bit_length()))
    shift = 64 - size.bit_length() + 1

    def places(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            spoken = part.column("lang").dictionary_encode()
            lang = _of_lang(spoken.dictionary)[spoken.indices.to_numpy()]
            found = [_words.words(data, offsets)[3] for _, data, offsets in _words.blocks(part.column("phrase"))]
            words = np.concatenate(found).reshape(-1, level) if found else np.zeros((0, level), np.uint64)
            hashes = lang[: len(words)]
            for k in range(level):
                hashes = _longer(hashes, words[:, k])
            at = hashes >> np.uint64(shift)
            yield pa.record_batch([pa.array((at >> np.uint64(6)).astype(np.int32)), pa.array(np.left_shift(np.uint64(1), at & np.uint64(63)).astype(np.uint64).view(np.int64))], ["slot", "bit"])

    slots = grams.select("lang", "phrase").mapInArrow(places, "slot int, bit long").groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[slots.column("slot").to_numpy()] = slots.column("bits").to_numpy().view(np.uint64)
    return out


def frequent_grams(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = 30, max_words: int = 4) -> tuple[DataFrame, DataFrame]:
    """The level tables in one (n_words, lang, phrase, f), and (lang, n) with each language's number of words."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"))
    levels, sent, totals = [], [], None
    for k in range(1, max_words + 1):
        counted = rows.mapInArrow(_counter(k, list(sent)), "lang string, phrase string, f long")
        level = stage_table(counted.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).filter((F.col("f") >= min_count) | F.col("phrase").isNull()), f"grams{k}")
        if k == 1:
            totals = level.filter("phrase is null").select("lang", F.col("f").alias("n"))
            level = level.filter("phrase is not null")
        levels.append(level.select(F.lit(k).alias("n_words"), "lang", "phrase", "f"))
        if k < max_words:
            sent.append(spark.sparkContext.broadcast(_bitmap(level, k)))
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    for x in sent:  # all levels are written
        x.destroy()
    return every, totals


def _part(words: Column, start: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def mine_collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = 30, max_words: int = 4, scale: int = 2_000_000, absorbed_percent: int = 80, top: int = 2000) -> DataFrame:
    """Each language's best phrases of 2 to ``max_words`` words: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z) and parted into pieces at ``CUTS``, these into words at ``GAPS``.
    a, l and r are the occurrences of the phrase and of the two parts of its lowest-scoring cut,
    score is floor(scale * a / (l + r)), n the language's number of words. Ties of cuts: the
    shortest first part. A phrase inside a longer one that has ``absorbed_percent`` of its
    occurrences is left out. Ties of phrases: a descending, then the phrase's bytes.

    A null text has no words; a null language is ``und``. Rows are occurrences: repeated rows
    count again. Other columns are not read. An empty table, or one without frequent phrases, gives
    an empty result. Products are decimals, so they may pass 64 bits.
    """
    every, totals = frequent_grams(docs, text_col, lang_col, min_count, max_words)
    phrases = every.filter("n_words > 1").withColumn("words", F.split("phrase", " "))
    cuts = phrases.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.col("words"), 1, F.col("k")).alias("first"), _part(F.col("words"), F.col("k") + 1, F.size("words") - F.col("k")).alias("rest"))
    of = lambda part, f: every.select("lang", F.col("phrase").alias(part), F.col("f").alias(f))
    cuts = cuts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"])
    score = F.expr(f"(cast(a as decimal(19, 0)) * cast({scale} as decimal(10, 0))) div cast(l + r as decimal(19, 0))")
    scored = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("n_words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("n_words") - m + 1), lambda s: _part(F.col("words"), s, m))))
    inside = phrases.filter("n_words > 2").select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    own = scored.join(inside, ["lang", "phrase"], "left").filter(f"longer is null or cast(longer as decimal(19, 0)) * 100 < cast(a as decimal(19, 0)) * {absorbed_percent}")
    best = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = own.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
