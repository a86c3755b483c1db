"""Pooled metrics of all bootstrap samples at once.

Only (query, score) sums with the query's number are shuffled. First they are dealt by query: a task makes the
weights of its queries once, and adds up what each score range holds in all samples. Then they are dealt
over score ranges: what the ranges above hold is known, so a range's task walks down its scores, a block of samples at
a time, and makes the weights of its own queries for that block. Ranges grow with the table, up to ``held`` rows,
so that a query's weights are made in few of them. A score that fills several ranges is a range by itself, of which the sums
are all that is needed; precision needs only the samples that cross their recall in a range. The driver gets
vectors of samples only: two or three for each range.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scan
from .draws import Draws

#: Score ranges at most, rows of a range that are wished for, and ranges until which they don't grow.
RANGES, RANGE_ROWS, FEW_RANGES = 4096, 8_000, 24
#: Rows and samples of a matrix, and rows that are gathered for the sums by query.
MATRIX_ROWS, SAMPLE_BLOCK, GATHERED = 512, 250, 100_000

#: From a range's scores (falling), tp, n, queries' places and what makes weights: its vector of samples.
Walk = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Callable], np.ndarray]


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches in tables of about so many rows."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(table: pa.Table, name: str) -> pa.Array:
    return table.column(name).combine_chunks()


def _blocks(samples: np.ndarray) -> Iterator[slice]:
    return (slice(k, min(k + SAMPLE_BLOCK, len(samples))) for k in range(0, len(samples), SAMPLE_BLOCK))


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each range, which stand together."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        at = batch.column("range").to_numpy()
        cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
        for first, end in zip(cuts[:-1], cuts[1:], strict=True):
            if first == end:
                continue
            if held and at[first] != now:
                yield now, pa.Table.from_batches(held).combine_chunks()
                held = []
            now = int(at[first])
            held.append(batch.slice(first, end - first))
    if held:
        yield now, pa.Table.from_batches(held).combine_chunks()


def _range_sums(rows: DataFrame, draws: Draws, ranges: int) -> dict[int, np.ndarray]:
    """By range: positives and pairs in all samples; ``rows``: range, tp, n and drawn, by query and range."""
    weights, samples = draws.lookup(), np.arange(draws.samples)

    def packed(out: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for k, found in out.items():
            yield pa.record_batch({"range": pa.array([k], pa.int32()), "found": pa.array([found.tobytes()], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for table in _gathered(batches, min(GATHERED, draws_held)):
            make, row = weights(_column(table, "drawn"))
            held, at = np.unique(_column(table, "range").to_numpy(), return_inverse=True)
            queries = int(row.max()) + 1
            step = max(1, (1 << 22) // len(held))  # numbers of a matrix of counts
            found = np.zeros((2, len(held), len(samples)))
            for block in _blocks(samples):
                w = make(samples[block])
                for q in range(0, queries, step):
                    own = np.flatnonzero((row >= q) & (row < q + step))
                    wide = min(step, queries - q)
                    part = w[q : q + wide].astype(float)
                    for j, name in enumerate(("tp", "n")):
                        counts = np.bincount(at[own] * wide + row[own] - q, _column(table, name).to_numpy()[own], len(held) * wide)
                        found[j][:, block] += counts.reshape(len(held), wide) @ part
            for j, k in enumerate(held.tolist()):
                out[k] = out[k] + found[:, j] if k in out else found[:, j].copy()
        yield from packed(out)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, found in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = np.frombuffer(found.as_buffer(), float).reshape(2, -1)
                out[k] = out[k] + found if k in out else found
        yield from packed(out)

    draws_held, kind = draws.held, "range int, found binary"
    parts = draws.dealt(rows, ranges).mapInArrow(run, kind).repartition(ranges, "range").mapInArrow(add, kind)
    return {r["range"]: np.frombuffer(r["found"], float).reshape(2, -1) for r in parts.collect()}  # two vectors a range


def _walked(rows: DataFrame, draws: Draws, ranges: int, walk: Callable[[int], Walk]) -> Iterator[np.ndarray]:
    """The vector that ``walk(range)`` makes of each range's rows."""
    weights = draws.lookup()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, table in _by_range(batches):
            make, row = weights(_column(table, "drawn"))
            score, tp, n = (_column(table, c).to_numpy() for c in ("score", "tp", "n"))
            yield pa.record_batch({"found": pa.array([walk(k)(score, tp, n, row, make).tobytes()], pa.binary())})

    dealt = rows.repartitionById(ranges, F.col("range")).sortWithinPartitions("range", F.desc("score"))
    for r in dealt.mapInArrow(run, "found binary").collect():  # a vector a range
        yield np.frombuffer(r["found"], float)


def _running(score: np.ndarray, tp: np.ndarray, n: np.ndarray, row: np.ndarray, w: np.ndarray, above: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """ctp and cn (running counts by distinct score and sample) of runs of scores, from those above on."""
    base = above.astype(np.int64)
    last = np.r_[score[1:] != score[:-1], True]
    for first in range(0, len(row), MATRIX_ROWS):
        own = slice(first, min(first + MATRIX_ROWS, len(row)))
        part, hits, ends = w[row[own]], np.flatnonzero(tp[own]), np.flatnonzero(last[own])
        sums = []
        for at, times in ((hits, tp[own][hits]), (slice(None), n[own])):
            x = part[at]
            if (times != 1).any():
                x = x * times[:, None]
            out = np.zeros((len(x) + 1, x.shape[1]), np.int64 if x.dtype == np.int64 else np.int32)
            np.cumsum(x, axis=0, out=out[1:])
            sums.append(out)
        if len(ends):
            yield base[0] + sums[0][np.searchsorted(hits, ends, "right")], base[1] + sums[1][ends + 1]
        base = base + [sums[0][-1], sums[1][-1]]


def _range_count(size: int, held: int) -> int:
    return max(1, min(RANGES, max(min(size // RANGE_ROWS, FEW_RANGES), size // held)))


def _ranges(bounds: list[float]) -> tuple[Column, set[int]]:
    """A score's range, ascending with it, and the ranges of one score.

    ``bounds`` are percentiles: one that comes twice or more is a score that fills whole ranges.
    """
    times = Counter(bounds)
    cuts = sorted(times)
    if not cuts:
        return F.lit(0), set()
    below = scan.range_of(F.array(*map(F.lit, cuts)), F.col("score"))
    hot = {k for k, b in enumerate(cuts) if times[b] > 1}
    full = F.coalesce(F.col("score").isin([cuts[k] for k in hot]), F.lit(False)) if hot else F.lit(False)
    return 2 * below + full.cast("int"), {2 * k + 1 for k in hot}


def sampled_metric(pairs: DataFrame, draws: Draws, metric: str, keep: float = 0.9) -> np.ndarray:
    """The metric of each sample, NaN where it is undefined.

    ``pr_auc``: both classes are needed. ``precision``: at the highest score from which on
    ``keep`` of the positives survive; a positive is needed.
    """
    size = pairs.count()
    if not size:
        return np.full(draws.samples, np.nan)
    ranges = _range_count(size, draws.held)
    percentiles = pairs.agg(F.percentile_approx("score", [k / ranges for k in range(1, ranges)], 10_000)).first()[0] if ranges > 1 else []
    at, single = _ranges(percentiles or [])
    small = pairs.groupBy("query_id", "score").agg(F.sum("label").cast("long").alias("tp"), F.count(F.lit(1)).alias("n"))
    rows = draws.joined(small.select("query_id", at.cast("int").alias("range"), "score", "tp", "n")).select("range", "score", "tp", "n", "drawn")

    rows = rows.persist()
    try:
        return _metric(rows, draws, 2 * ranges, single, metric, keep)
    finally:
        rows.unpersist()


def _metric(rows: DataFrame, draws: Draws, ranges: int, single: set[int], metric: str, keep: float) -> np.ndarray:
    samples = draws.samples
    by_range = _range_sums(rows.groupBy("drawn", "range").agg(F.sum("tp").alias("tp"), F.sum("n").alias("n")), draws, ranges)
    if not by_range:
        return np.full(samples, np.nan)
    p, total = sum(by_range.values())
    above, run = {}, np.zeros((2, samples))
    for k in sorted(by_range, reverse=True):
        above[k], run = run, run + by_range[k]
    every = np.arange(samples)
    crossed = {k: np.flatnonzero((above[k][0] < keep * p) & (above[k][0] + by_range[k][0] >= keep * p)) for k in by_range}

    def area(k: int) -> Walk:
        def walk(score: np.ndarray, tp: np.ndarray, n: np.ndarray, row: np.ndarray, make: Callable) -> np.ndarray:
            out = np.zeros(samples)
            for block in _blocks(every):
                before = above[k][:1, block]  # positives down to the score before
                for ctp, cn in _running(score, tp, n, row, make(every[block]), above[k][:, block]):
                    gained = np.diff(ctp, axis=0, prepend=before)
                    out[block] += (gained * (ctp / np.maximum(cn, 1))).sum(axis=0)
                    before = ctp[-1:]
            return out / np.maximum(p, 1)

        return walk

    def crossing(k: int) -> Walk:
        def walk(score: np.ndarray, tp: np.ndarray, n: np.ndarray, row: np.ndarray, make: Callable) -> np.ndarray:
            out, asked = np.full(samples, np.nan), crossed[k]
            for block in _blocks(asked):
                own = asked[block]
                for ctp, cn in _running(score, tp, n, row, make(own), above[k][:, own]):
                    ok = ctp >= keep * p[own]  # first met where positives are gained, so at a score that is drawn
                    first = ok.argmax(axis=0)
                    cols = np.flatnonzero(ok.any(axis=0) & np.isnan(out[own]))
                    out[own[cols]] = ctp[first[cols], cols] / cn[first[cols], cols]
                    if not np.isnan(out[own]).any():
                        break
            return out

        return walk

    if metric == "pr_auc":
        tp, n = {k: by_range[k][0] for k in by_range}, {k: by_range[k][1] for k in by_range}
        found = sum((tp[k] / np.maximum(p, 1) * ((above[k][0] + tp[k]) / np.maximum(above[k][1] + n[k], 1)) for k in by_range if k in single), np.zeros(samples))  # one point each
        rest = [k for k in by_range if k not in single]
        if rest:
            for x in _walked(rows.filter(~F.col("range").isin(list(single))) if single else rows, draws, ranges, area):
                found = found + x
        return np.where((p > 0) & (p < total), found, np.nan)
    value = np.full(samples, np.nan)
    for k in single & set(by_range):
        own = crossed[k]
        value[own] = ((above[k][0] + by_range[k][0]) / (above[k][1] + by_range[k][1]))[own]
    rest = [k for k in by_range if k not in single and len(crossed[k])]
    if rest:
        for x in _walked(rows.filter(F.col("range").isin(rest)), draws, ranges, crossing):
            value = np.where(np.isnan(value), x, value)
    return np.where(p > 0, value, np.nan)


def sampled_mean(values: DataFrame, draws: Draws, distinct: bool = False) -> np.ndarray:
    """The mean of ``value`` by query over the queries drawn in each sample, NaN where none is.

    A query drawn twice counts twice, or once if ``distinct``. Each task sends two vectors.
    """
    weights, samples = draws.lookup(), np.arange(draws.samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, len(samples)))
        for batch in batches:
            make, row = weights(batch.column(1))
            value = np.bincount(row, batch.column(0).to_numpy(zero_copy_only=False))
            times = np.bincount(row).astype(float)
            for block in _blocks(samples):
                w = make(samples[block])
                w = (w > 0).astype(float) if distinct else w.astype(float)
                sums[:, block] += [value @ w, times @ w]
        yield pa.record_batch({"found": pa.array([sums.tobytes()], pa.binary())})

    total = np.zeros((2, len(samples)))
    for r in draws.joined(values.select("query_id", F.col("value").cast("double").alias("value"))).select("value", "drawn").mapInArrow(run, "found binary").collect():
        total += np.frombuffer(r["found"], float).reshape(2, -1)
    return np.where(total[1] > 0, total[0] / np.where(total[1] > 0, total[1], 1), np.nan)
