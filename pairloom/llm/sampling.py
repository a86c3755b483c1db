"""Quality classifier by importance resampling.

Two hashed n-gram generative models are counted, one from labelled good text (target) and
one from all text (raw). A document's log weight is the sum, over its n-grams, of the log
ratio of the two models. Gumbel noise is added to the log weights and the k largest keys
stay, which samples without replacement in proportion to the weights. Unless k is given it
is the number of keys over the limit that parts labelled good from bad keys best.

n-grams: words, pairs of words, and pairs of word shapes (kinds of the outer characters,
length, and whether the word repeats the one before).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._stage import fresh_name, stage_table
from ._words import U, blocks, mix, words

BUCKETS = 1 << 16
#: Labelled good documents that the target model is counted from at most.
FIT_ROWS = 20_000
#: Pseudo-counts that draw a bucket's ratio to 1, and the largest log ratio of a bucket.
SMOOTHING, CLIP = 8.0, 4.0
#: Share of labelled good documents that the limit may lose at most.
LOSS = 0.003
_KIND = np.full(256, 5, np.uint64)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 0, 1, 2, 3
_KIND[[33, 44, 46, 58, 59, 63]] = 4


def _grams(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, bucket) of every n-gram of a block."""
    starts, ends, doc, h = words(data, offsets)
    if not len(doc):
        return doc, doc
    after = np.zeros(len(doc), bool)
    after[1:] = doc[1:] == doc[:-1]
    again = after.copy()
    again[1:] &= h[1:] == h[:-1]
    size = np.minimum(np.log2(ends - starts).astype(U), U(5))
    shape = size
    for at in (starts, np.minimum(starts + 1, ends - 1), np.maximum(ends - 2, starts), ends - 1):
        shape = shape * U(6) + _KIND[data[at]]
    shape = mix(shape * U(2) + again, 5)
    mask = U(buckets - 1)
    pair, shapes = mix(h[:-1] * U(3) + h[1:], 2)[after[1:]], mix(shape[:-1] * U(3) + shape[1:], 4)[after[1:]]
    return np.concatenate([doc, doc, doc[after], doc[after]]), (np.concatenate([h, shape, pair, shapes]) & mask).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch], good: pa.Array, buckets: int) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, buckets), np.int64)
    for batch in batches:
        of = pc.is_in(batch.column(0), value_set=good).to_numpy(zero_copy_only=False)
        for first, data, offsets in blocks(batch.column(1)):
            doc, bucket = _grams(data, offsets, buckets)
            counts[0] += np.bincount(bucket, minlength=buckets)
            counts[1] += np.bincount(bucket[of[first : first + len(offsets) - 1][doc]], minlength=buckets)
    some = np.flatnonzero(counts[0])
    yield pa.record_batch({"bucket": pa.array(some, pa.int32()), "raw": pa.array(counts[0][some]), "target": pa.array(counts[1][some])})


def log_ratios(raw: np.ndarray, target: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """Log ratio of the target model to the raw one by bucket; 0 where nothing is known."""
    expected = raw * (target.sum() / max(1, raw.sum()))
    return np.clip(np.log((target + smoothing) / (expected + smoothing)), -CLIP, CLIP)


def fit_log_ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Count both models in one pass over all texts; the ids of the target are a bounded list.

    Labels: id, quality (1 good) and, if there, toxic (1 is no target). Ids of the
    ``calibration`` part are no targets. Without a good label all ratios are 0.
    """
    good = F.col("quality") == 1
    if "toxic" in labels.columns:
        good = good & (F.coalesce("toxic", F.lit(0)) != 1)
    ids = labels.filter(good & F.col(id_col).isNotNull() & ~calibration(id_col)).select(F.col(id_col).alias("id")).distinct().orderBy(F.xxhash64("id", F.lit(3)), "id").limit(fit_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    chosen = pa.array([r["id"] for r in ids.collect()], rows.schema["id"].dataType.typeName() == "string" and pa.string() or pa.int64())
    parts = rows.mapInArrow(lambda b: _counted(b, chosen.cast(chosen.type), buckets), "bucket int, raw long, target long")
    counts = np.zeros((2, buckets))
    for r in parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():  # at most ``buckets`` rows
        counts[:, r["bucket"]] = r["raw"], r["target"]
    return log_ratios(*counts) if len(chosen) else np.zeros(buckets)


def importance_keys(docs: DataFrame, ratios: np.ndarray, seed: int = 11, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_grams, log_weight, sample_key (log weight and Gumbel noise)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    buckets, kind = len(ratios), rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in blocks(batch.column(1)):
                n = len(offsets) - 1
                doc, bucket = _grams(data, offsets, buckets)
                yield pa.record_batch({"id": batch.column(0).slice(first, n), "n_grams": np.bincount(doc, minlength=n).astype(np.int64), "log_weight": np.bincount(doc, ratios[bucket], n).astype(float)})

    weighed = rows.mapInArrow(run, f"id {kind}, n_grams long, log_weight double")
    even = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return weighed.withColumn("sample_key", F.col("log_weight") - F.log(-F.log(even)))


def _bin(key) -> Column:
    return F.floor(F.asinh(key) * 256).cast("int")


def calibration(id_col: str = "doc_id") -> Column:
    """True for a third of the ids, whose labels set the limit and not the target model."""
    return F.pmod(F.xxhash64(F.col(id_col), F.lit(29)), F.lit(3)) == 0


def calibrated_k(keys: DataFrame, labels: DataFrame, id_col: str = "doc_id", loss: float = LOSS) -> int:
    """Number of keys over the limit that best parts good from bad labelled rows.

    The limit maximises the share of good rows kept less that of bad rows kept, among limits
    that lose at most ``loss`` of the good ones. Only labels that the target model was not
    counted from are read (:func:`calibration`). Without labels of both kinds, all stay.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col("quality").isNotNull() & calibration(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.min("quality").alias("q"))
    rows = keys.join(known, "id").groupBy(_bin(F.col("sample_key")).alias("bin")).agg(F.sum(F.when(F.col("q") == 1, 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("q") == 1, 0).otherwise(1)).alias("bad")).orderBy("bin").collect()  # bounded by the bins
    good, bad = sum(r["good"] for r in rows), sum(r["bad"] for r in rows)
    if not good or not bad:
        return keys.count()
    best, limit, g, b = 0.0, None, 0, 0
    for r, after in zip(rows, [*rows[1:], rows[-1]], strict=True):
        g, b = g + r["good"], b + r["bad"]
        if g <= loss * good and b / bad - g / good > best:
            best, limit = b / bad - g / good, (r["bin"] + after["bin"]) // 2  # halfway to the next key
    return keys.count() if limit is None else keys.filter(_bin(F.col("sample_key")) > limit).count()


def gumbel_top_k(keys: DataFrame, k: int) -> DataFrame:
    """``keys`` with ``selected``: true for the k largest sample keys, ties by id.

    The k-th key is found by counts over ever finer bins, at most 4096 rows a step, and rows
    of equal keys at the limit are numbered; nothing is sorted as a whole.
    """
    total = keys.count()
    if k >= total or k <= 0:
        return keys.withColumn("selected", F.lit(k > 0))
    low, high = keys.agg(F.min("sample_key"), F.max("sample_key")).first()
    left = k
    while high > low:
        width = (high - low) / 4096
        at = F.least(F.floor((F.col("sample_key") - low) / width), F.lit(4095)).cast("int") if width > 0 else F.lit(0)
        rows = keys.filter((F.col("sample_key") >= low) & (F.col("sample_key") <= high)).groupBy(at.alias("at")).agg(F.count(F.lit(1)).alias("n"), F.min("sample_key").alias("low"), F.max("sample_key").alias("high")).orderBy(F.desc("at")).collect()
        for r in rows:
            if r["n"] >= left:
                break
            left -= r["n"]
        low, high = r["low"], r["high"]
        if len(rows) == 1 and r["n"] <= 4096:
            break
    inside = keys.filter((F.col("sample_key") >= low) & (F.col("sample_key") <= high))
    if high > low or inside.count() > left:
        edge = inside.orderBy(F.desc("sample_key"), "id").limit(left).agg(F.min("sample_key").alias("key"), F.max(F.struct(-F.col("sample_key"), "id"))["id"].alias("id")).first()
        rule = (F.col("sample_key") > edge["key"]) | ((F.col("sample_key") == edge["key"]) & (F.col("id") <= F.lit(edge["id"])))
    else:
        rule = F.col("sample_key") >= low
    return keys.withColumn("selected", F.coalesce(rule, F.lit(False)))


def resample_quality(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 11, buckets: int = BUCKETS, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_grams, log_weight, sample_key, selected.

    Null and empty texts have no n-grams and log weight 0. Noise depends on the id and seed
    only, so repeated rows of one id and text share a key; rows with a null id share one
    draw. Other columns are not read. An empty table gives an empty result.
    """
    ratios = fit_log_ratios(docs, labels, buckets, fit_rows, id_col, text_col)
    keys = stage_table(importance_keys(docs, ratios, seed, id_col, text_col), "keys")
    k = calibrated_k(keys, labels, id_col) if k is None else k
    return gumbel_top_k(keys, k).withColumnRenamed("id", id_col)


def keep_resampled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that the sample leaves out; all columns kept.

    Only ids that are left out are joined, so rows with a null id stay.
    """
    name = fresh_name(docs.columns, "gone")
    out = resample_quality(docs, labels, id_col=id_col, text_col=text_col).filter(~F.col("selected"))
    gone = out.select(F.col(id_col).alias(name)).distinct()
    return docs.join(gone, F.col(f"`{id_col}`") == F.col(name), "left_anti")
