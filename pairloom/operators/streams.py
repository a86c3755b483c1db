"""The published numbers: draws of one seeded generator's stream, made by many tasks.

NumPy's generator can jump ahead, so a task that knows its place in the stream begins there. Random
scores take one word a pair, and places are a running total of pool sizes. Bounded integers pass
words over now and then; whether a word is passed over depends on the word alone, so tasks first count
the words of their stretch of the stream that count, and a running total gives each stretch its first draw.

Orders of Python's ``random`` are seeded by a text for each group. They depend on the text and on the
group's size only, so a task makes positions, and no group is gathered.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan
from .classify import mixed_queries
from .draws import MOST, TableDraws, _BytesDraws

#: 64-bit words of a stretch, random scores held at a time, and positions sent at a time.
STRETCH, HELD, SENT = 1 << 20, 1 << 20, 1 << 16
#: Queries of a block at most, and weights of its matrix.
BLOCK, BLOCK_WEIGHTS = 4096, 1 << 23


def _generator(seed: int, place: int) -> np.random.PCG64:
    """``numpy.random.default_rng(seed)``'s bits from the 64-bit word ``place`` on."""
    bits = np.random.PCG64(seed)
    bits.advance(place)
    return bits


def random_precision(labels: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """PR-AUC of each row of scores; tied scores are one threshold."""
    order = np.argsort(-scores, axis=1)
    hits, ranked = labels[order], np.take_along_axis(scores, order, axis=1)
    last = np.ones(scores.shape, bool)  # of the pairs that share a score
    last[:, :-1] = ranked[:, 1:] != ranked[:, :-1]
    if last.all():
        return (hits * (np.cumsum(hits, axis=1) / np.arange(1, len(labels) + 1))).sum(axis=1) / labels.sum()
    out = np.empty(len(scores))
    for k in range(len(scores)):
        at = np.flatnonzero(last[k])
        found = np.cumsum(hits[k])[at]
        out[k] = (np.diff(found, prepend=0) * (found / (at + 1))).sum() / labels.sum()
    return out


def exact_random_query_pr_auc(pairs: DataFrame, draws: int = 100, seed: int = 0) -> DataFrame:
    """Mean over mixed queries of the mean PR-AUC of ``draws`` lists of ``default_rng(seed)``'s numbers: value, queries.

    Queries use the stream in order of their first ``ordinal``, which is a number, and give scores to their
    pairs in its order. A query's labels are one row.
    """
    rows = pairs.join(mixed_queries(pairs, []).select("query_id"), "query_id", "left_semi")
    asked = rows.groupBy("query_id").agg(F.min("ordinal").alias("first"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("ordinal", F.col("label").cast("int").alias("label")))).alias("pairs"))
    places = scan.running_total(asked.select("first", (F.col("n") * draws).alias("words")), [], "first", "words", "place").select("first", "place")
    placed = asked.select("first", F.transform("pairs", lambda p: p["label"]).alias("labels")).join(places, "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = []
            for k in range(batch.num_rows):
                labels, place = batch.column(1)[k].values.to_numpy(), batch.column(2)[k].as_py()
                rng, step = np.random.Generator(_generator(seed, place)), max(1, HELD // len(labels))
                found = [random_precision(labels, rng.random((min(step, draws - at), len(labels)))) for at in range(0, draws, step)]
                values.append(np.concatenate(found).mean())
            yield pa.record_batch({"value": pa.array(values, pa.float64())})

    return placed.select("first", "labels", "place").mapInArrow(run, "value double").agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("queries"))


def _accepted(seed: int, stretch: int, n: int) -> np.ndarray:
    """The numbers below ``n`` that a stretch of the stream gives, by multiplying 32-bit words (low half first)."""
    words = _generator(seed, stretch * STRETCH).random_raw(STRETCH).view(np.uint32).astype(np.uint64)
    product = words * np.uint64(n)
    return (product >> np.uint64(32))[(product & np.uint64(0xFFFFFFFF)) >= np.uint64((1 << 32) % n)].astype(np.int64)


def exact_draws(queries: DataFrame, samples: int, seed: int = 0) -> TableDraws | StreamDraws:
    """Draws of ``default_rng(seed).integers(0, n, n)`` for each sample in turn, over the sorted ids.

    Works for up to 2^32 - 1 queries; one query is drawn without using the stream.
    """
    spark = queries.sparkSession
    ids = scan.numbered_in_order(queries)
    n = queries.select("query_id").distinct().count()
    if n < 2:
        every = ids.select(F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample"), "query_id", F.lit(1).cast("long").alias("weight"))
        return TableDraws(every, samples)
    wanted, share = n * samples, 1 - ((1 << 32) % n) / (1 << 32)
    stretches = int(wanted / (2 * STRETCH * share)) + 2  # a stretch gives 2 * STRETCH words

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy()
            yield pa.record_batch({"stretch": pa.array(at), "n": pa.array([len(_accepted(seed, int(k), n)) for k in at], pa.int64())})

    while True:
        each = spark.range(0, stretches, 1, stretches).mapInArrow(count, "stretch long, n long")
        first = each.select("stretch", F.coalesce(F.sum("n").over(Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"), "n").persist()  # a row a stretch
        if first.agg(F.sum("n")).first()[0] >= wanted:
            break
        first.unpersist()
        stretches += 1 + stretches // 16

    block = max(1, min(BLOCK, BLOCK_WEIGHTS // samples))

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, begin in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = _accepted(seed, k, n)[: max(0, wanted - begin)]
                sample = ((begin + np.arange(len(found))) // n).astype("<u4")
                order = np.argsort(found // block, kind="stable")
                found, sample = found[order], sample[order]
                cuts = np.searchsorted(found // block, np.arange(-(-n // block) + 1))
                for b in np.flatnonzero(np.diff(cuts)).tolist():
                    own = slice(cuts[b], cuts[b + 1])
                    yield pa.record_batch({"block": pa.array([b], pa.int32()), "sample": pa.array([sample[own].tobytes()], pa.binary()), "place": pa.array([(found[own] - b * block).astype("<u2").tobytes()], pa.binary())})

    parts = first.select("stretch", "first").repartition(stretches, "stretch").mapInArrow(drawn, "block int, sample binary, place binary")
    return StreamDraws(ids, parts, samples, n, block)


@dataclass(frozen=True)
class StreamDraws(_BytesDraws):
    """Draws of a stream: ``parts`` (block, sample, place) are packed numbers, one row for a stretch and a block of queries.

    A task has one block's draws and makes its matrix of weights. Joins are merges: Spark takes tables that tasks
    make out of a range for tiny, and would send them whole through the driver.
    """

    ids: DataFrame
    parts: DataFrame
    samples: int
    size: int
    block: int

    def weights(self) -> DataFrame:
        """(at, drawn) of every query that is drawn."""
        samples, block = self.samples, self.block

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list[np.ndarray]] = {}
            for batch in batches:
                for b, sample, place in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                    sample, place = np.frombuffer(sample.as_buffer(), "<u4"), np.frombuffer(place.as_buffer(), "<u2")
                    held.setdefault(b, []).append(place.astype(np.int64) * samples + sample)
            for b in list(held):
                matrix = np.bincount(np.concatenate(held.pop(b)), minlength=block * samples).reshape(-1, samples)
                if matrix.max() > MOST:
                    raise OverflowError(f"a query is drawn over {MOST} times in a sample")
                matrix = matrix.astype("<u2")
                some = np.flatnonzero(matrix.any(axis=1))
                for k in range(0, len(some), 512):
                    yield pa.record_batch({"at": pa.array(b * block + some[k : k + 512]), "drawn": pa.array([matrix[x].tobytes() for x in some[k : k + 512]], pa.binary())})

        return self.parts.repartitionById(-(-self.size // block), F.col("block")).mapInArrow(run, "at long, drawn binary")

    def joined(self, rows: DataFrame) -> DataFrame:
        at = rows.join(self.ids, "query_id").hint("merge")
        return at.join(self.weights().hint("merge"), "at").drop("at")

    def rows(self) -> DataFrame:
        samples = self.samples
        kind = self.ids.schema["query_id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(0, batch.num_rows, 512):
                    part = batch.slice(k, 512)
                    w = np.frombuffer(b"".join(part.column("drawn").to_pylist()), "<u2").reshape(-1, samples)
                    row, sample = np.nonzero(w)
                    yield pa.record_batch({"sample": pa.array(sample.astype(np.int32)), "query_id": part.column("query_id").take(pa.array(row)), "weight": pa.array(w[row, sample].astype(np.int64))})

        return self.joined(self.ids.select("query_id")).select("query_id", "drawn").mapInArrow(run, f"sample int, query_id {kind}, weight long")


def exact_positions(groups: DataFrame, key: str, seed_text: Column, size: str) -> DataFrame:
    """(key, place, position): where ``random.Random(seed_text).shuffle`` puts the items of each group.

    ``place`` numbers a group's items from 0 in the order before; ``size`` names their number.
    """
    kind = groups.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places, positions = [], [], []
            for k in range(batch.num_rows):
                order = list(range(batch.column(2)[k].as_py()))
                random.Random(batch.column(1)[k].as_py()).shuffle(order)
                rows += [k] * len(order)
                places += order
                positions += range(len(order))
                if len(rows) >= SENT or k == batch.num_rows - 1:
                    yield pa.record_batch({key: batch.column(0).take(pa.array(rows, pa.int64())), "place": pa.array(places, pa.int64()), "position": pa.array(positions, pa.int64())})
                    rows, places, positions = [], [], []

    return groups.select(key, seed_text.alias("__seed"), F.col(size).cast("long").alias("__n")).mapInArrow(run, f"{key} {kind}, place long, position long")


def exact_shuffled(rows: DataFrame, order: list[Column], with_size: bool, key: str = "query_id") -> DataFrame:
    """``rows`` with ``position``, their place after Python's seeded shuffle of each group, which begins in ``order``.

    The seed is the group's key, or ``key:size`` where ``with_size``.
    """
    placed = rows.withColumn("place", (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("long"))
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    seed = F.concat_ws(":", F.col(key), F.col("__n").cast("string")) if with_size else F.col(key).cast("string")
    return placed.join(exact_positions(sizes, key, seed, "__n"), [key, "place"]).drop("place")


def exact_sample(queries: DataFrame, order: str, count: int, seed: int = 0) -> DataFrame:
    """(query_id, position): ``random.Random(seed).sample`` of the distinct queries, which begin in order of ``order``.

    All of them, in that order, where ``count`` isn't below their number. The generator's ``count`` numbers are made
    by one task; the queries are never gathered.
    """
    firsts = queries.groupBy("query_id").agg(F.min(order).alias("__first"))
    placed = scan.running_total(firsts.withColumn("__one", F.lit(1)), [], "__first", "__one", "at").select("query_id", F.col("at").cast("long").alias("at"))
    n = firsts.count()
    if count >= n:
        return placed.select("query_id", F.col("at").alias("position"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            chosen = np.array(random.Random(seed).sample(range(n), count), np.int64)
            for k in range(0, len(chosen), SENT):
                part = chosen[k : k + SENT]
                yield pa.record_batch({"at": pa.array(part), "position": pa.array(np.arange(k, k + len(part)))})

    chosen = queries.sparkSession.range(0, 1, 1, 1).mapInArrow(run, "at long, position long")
    return placed.join(chosen, "at").select("query_id", "position")
