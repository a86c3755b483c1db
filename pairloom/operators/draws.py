"""Bootstrap draws that any task can make for its own queries, out of a seed.

A sample draws as many queries, with replacement, as there are. Queries are numbered from 0, and
how many draws fall to the lower half of a range of numbers is a binomial of the range's draws. So
the draws of one query are found by going down a tree of ranges from the whole one: the numbers are
those of a multinomial, exactly, each node's seeded by itself, and nothing has to be shuffled or
known of other queries.

A binomial of n is the sum of independent ones of the powers of two in n; each is read off its
distribution function at a uniform number, which is mixed from the md5 of the node, of the sample and
of the power. SQL can tell the same numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries whose draws are found together.
CHUNK = 2048
#: Queries are drawn up to so often in a sample.
MOST = np.iinfo(np.uint16).max


def _key(text: str) -> tuple[int, int]:
    digits = hashlib.md5(text.encode(), usedforsecurity=False).digest()
    return int.from_bytes(digits[:4]), int.from_bytes(digits[4:8])


_kept_key = lru_cache(1 << 14)(_key)


def _mixed(x: np.ndarray) -> np.ndarray:
    """murmur3's finaliser of 32-bit numbers (its constants are fixed values), in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


@lru_cache(4096)
def _distribution(power: int, lower: int, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """First count and distribution function of a binomial of 2^power and lower / width, without the ends that no double
    reaches; and the function's first 32 bits."""
    n, p = 1 << power, lower / width
    mode = min(n, int((n + 1) * p))
    reach = int(12 * np.sqrt(n * p * (1 - p))) + 12
    first, last = max(0, mode - reach), min(n, mode + reach)
    up = np.arange(mode + 1, last + 1, dtype=float)
    down = np.arange(mode, first, -1, dtype=float)
    odds = p / (1 - p)
    above = np.cumprod((n - up + 1) / up * odds)
    below = np.cumprod(down / (n - down + 1) / odds)
    mass = np.concatenate([below[::-1], [1.0], above])
    cdf = np.cumsum(mass / mass.sum())
    return first, cdf, np.minimum(np.floor(cdf * 2.0**32), 2.0**32 - 1).astype(np.uint32)


Width = tuple[int, int, int]


def _nodes(lows: np.ndarray, highs: np.ndarray, seed: int) -> tuple[np.ndarray, list[Width]]:
    """Keys of nodes in order of width, and (width, first, end) of equal ones."""
    keys = np.array([_key(f"{seed}:{a}:{b}") for a, b in zip(lows.tolist(), highs.tolist(), strict=True)], np.uint32).reshape(-1, 2)
    found, first = np.unique(highs - lows, return_index=True)
    return keys, list(zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(lows)], strict=True))


@dataclass(frozen=True)
class _Level:
    """Nodes of one depth, in order of width: their keys, (width, first, end) of equal ones, and what becomes of their
    halves, of which the lower ones come first: ``leaves`` are draws of the queries ``rows``, ``inner`` are the next nodes."""

    keys: np.ndarray
    widths: list[Width]
    leaves: np.ndarray
    rows: np.ndarray
    inner: np.ndarray


def _levels(own: np.ndarray, size: int, seed: int) -> list[_Level]:
    out, lows, highs = [], np.zeros(1, np.int64), np.full(1, size, np.int64)
    while len(lows):
        keys, widths = _nodes(lows, highs, seed)
        mid = lows + (highs - lows + 1) // 2
        lows, highs = np.concatenate([lows, mid]), np.concatenate([mid, highs])
        held, width = np.searchsorted(own, highs) > np.searchsorted(own, lows), highs - lows
        leaves, inner = np.flatnonzero(held & (width == 1)), np.flatnonzero(held & (width > 1))
        inner = inner[np.argsort(width[inner], kind="stable")]
        out.append(_Level(keys, widths, leaves, np.searchsorted(own, lows[leaves]), inner))
        lows, highs = lows[inner], highs[inner]
    return out


def _binomials(n: np.ndarray, lows: np.ndarray, highs: np.ndarray, samples: np.ndarray, seed: int) -> np.ndarray:
    """The like of :func:`_lower` for nodes in any order."""
    order = np.argsort(highs - lows, kind="stable")
    out = np.empty_like(n)
    out[order] = _lower(n[order], *_nodes(lows[order], highs[order], seed), samples, seed)
    return out


def _lower(n: np.ndarray, node_keys: np.ndarray, widths: list[Width], samples: np.ndarray, seed: int) -> np.ndarray:
    """Draws that fall to the lower halves of nodes (rows, in order of width) in each sample (columns), of ``n`` draws.

    A uniform number has 32 high bits and 20 low ones; the low ones are only made where the high ones are those of
    a step of the distribution function.
    """
    out = np.zeros(n.shape, n.dtype)
    for width, first_row, end in widths:
        count, got = n[first_row:end].reshape(-1), out[first_row:end].reshape(-1)
        keys = node_keys[first_row:end]
        lane = _mixed(keys[:, None, 0] ^ samples[None, :, 0]).reshape(-1)
        for power in range(int(count.max(initial=0)).bit_length()):
            at = np.flatnonzero(count & n.dtype.type(1 << power))
            if not len(at):
                continue
            bit = _kept_key(f"{seed}:bit:{power}")
            high = _mixed(lane[at] ^ np.uint32(bit[0]))
            first, cdf, steps = _distribution(power, (width + 1) // 2, width)
            if power < 3:
                lower, tie = np.zeros(len(at), n.dtype), np.zeros(len(at), bool)
                for step in steps[:-1]:
                    lower += high > step
                    tie |= high == step
            else:
                place = np.searchsorted(steps, high)
                tie = steps[np.minimum(place, len(steps) - 1)] == high
                lower = np.minimum(first + place, 1 << power).astype(n.dtype)
            if tie.any():
                t = np.flatnonzero(tie)
                low = _mixed(_mixed(keys[at[t] // len(samples), 1] ^ samples[at[t] % len(samples), 1]) ^ np.uint32(bit[1]))
                u = ((high[t].astype(np.int64) << 20) + (low >> np.uint32(12)).astype(np.int64) + 0.5) / 2.0**52
                lower[t] = np.minimum(first + np.searchsorted(cdf[: -1 if power < 3 else None], u), 1 << power)
            got[at] += lower
    return out


class Tree:
    """The part of the tree that leads to the ascending numbers ``at`` of queries, of ``size``; nodes are hashed once."""

    def __init__(self, at: np.ndarray, size: int, seed: int) -> None:
        self.queries, self.size, self.seed = len(at), size, seed
        self.chunks = [_levels(at[k : k + CHUNK], size, seed) for k in range(0, len(at), CHUNK)] if size > 1 else []

    def weights(self, samples: np.ndarray) -> np.ndarray:
        """How often each of the samples of these numbers (columns) draws the queries (rows)."""
        keys = np.array([_kept_key(f"{self.seed}:sample:{s}") for s in samples.tolist()], np.uint32).reshape(-1, 2)
        out = np.ones((self.queries, len(samples)), np.uint16)
        for k, levels in enumerate(self.chunks):
            n = np.full((1, len(samples)), self.size, np.int32 if self.size < 1 << 30 else np.int64)
            for level in levels:
                left = _lower(n, level.keys, level.widths, keys, self.seed)
                both = np.concatenate([left, n - left])
                if len(level.leaves):
                    drawn = both[level.leaves]
                    if drawn.max(initial=0) > MOST:
                        raise OverflowError(f"a query is drawn over {MOST} times in a sample")
                    out[k * CHUNK + level.rows] = drawn
                n = both[level.inner]
        return out


def tree_weights(at: np.ndarray, size: int, samples: int, seed: int) -> np.ndarray:
    """How often each sample (column) draws the queries of the ascending numbers ``at`` (rows), of ``size``."""
    return Tree(at, size, seed).weights(np.arange(samples))


def numbered(queries: DataFrame) -> DataFrame:
    """(query_id, at): the distinct ids numbered from 0, by order of md5 bucket and id.

    Ids are numbered within 4,096 buckets, and raised by the sizes of the buckets before; only
    the buckets themselves are ever sorted as a whole.
    """
    ids = queries.select("query_id").distinct().withColumn("bucket", F.substring(F.md5("query_id"), 1, 3))
    below = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = ids.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).select("bucket", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("bucket").orderBy("query_id")) - 1
    return ids.withColumn("within", within).join(base, "bucket").select("query_id", (F.col("base") + F.col("within")).alias("at"))


#: From an array of samples' numbers to a matrix of weights by them.
Weights = Callable[[np.ndarray], np.ndarray]
Lookup = Callable[[pa.Array], tuple[Weights, np.ndarray]]


@dataclass(frozen=True)
class TreeDraws:
    """Draws of the numbered queries ``ids`` (query_id, at), of which there are ``size``."""

    ids: DataFrame
    size: int
    samples: int
    seed: int = 0

    #: Rows of which a task may hold the draws' numbers.
    held = 500_000

    def joined(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``drawn``, from which :meth:`lookup` makes weights; rows of other queries leave."""
        return rows.join(self.ids.withColumnRenamed("at", "drawn"), "query_id")

    def dealt(self, rows: DataFrame, tasks: int) -> DataFrame:
        """Joined rows by query: neighbours in the tree share a task, and stand together there."""
        return rows.repartition(tasks, F.floor(F.col("drawn") / max(1, -(-self.size // tasks)))).sortWithinPartitions("drawn")

    def lookup(self) -> Lookup:
        """From a column ``drawn``, within a task: what makes weights (rows) by samples, and each row's place among them."""
        size, seed = self.size, self.seed

        def weights(drawn: pa.Array) -> tuple[Weights, np.ndarray]:
            at, row = np.unique(drawn.to_numpy(zero_copy_only=False), return_inverse=True)
            return Tree(at, size, seed).weights, row

        return weights

    def rows(self) -> DataFrame:
        """(sample, query_id, weight) of every query drawn in a sample."""
        weights, samples = self.lookup(), np.arange(self.samples)

        def run(batches):
            for batch in batches:
                for k in range(0, batch.num_rows, 512):
                    part = batch.slice(k, 512)
                    make, place = weights(part.column(1))
                    w = make(samples)[place]
                    row, sample = np.nonzero(w)
                    yield pa.record_batch({"sample": pa.array(sample.astype(np.int32)), "query_id": part.column(0).take(pa.array(row)), "weight": pa.array(w[row, sample].astype(np.int64))})

        return self.ids.mapInArrow(run, f"sample int, query_id {self.ids.schema['query_id'].dataType.simpleString()}, weight long")


def tree_draws(queries: DataFrame, samples: int, seed: int = 0) -> TreeDraws:
    """Draws of the distinct queries of ``queries``, as many in each sample as there are."""
    return TreeDraws(numbered(queries), queries.select("query_id").distinct().count(), samples, seed)


class _BytesDraws:
    """Draws whose ``drawn`` holds a query's weights in all samples, as 16-bit numbers."""

    samples: int
    held = 8_000

    def dealt(self, rows: DataFrame, tasks: int) -> DataFrame:
        return rows.repartition(tasks, F.xxhash64("drawn"))

    def lookup(self) -> Lookup:
        samples = self.samples

        def weights(drawn: pa.Array) -> tuple[Weights, np.ndarray]:
            every = np.frombuffer(b"".join(drawn.to_pylist()), "<u2").reshape(-1, samples)
            return lambda some: every[:, some], np.arange(len(drawn))

        return weights


@dataclass(frozen=True)
class TableDraws(_BytesDraws):
    """Draws that a table of (sample, query_id, weight) tells, samples from 0 on."""

    table: DataFrame
    samples: int

    def joined(self, rows: DataFrame) -> DataFrame:
        samples = self.samples

        def run(batches):
            for batch in batches:
                out = []
                for k in range(batch.num_rows):
                    flat = batch.column(1)[k].values
                    row = np.zeros(samples, np.int64)
                    row[flat.field(0).to_numpy()] = flat.field(1).to_numpy()
                    if row.max(initial=0) > MOST:
                        raise OverflowError(f"a query is drawn over {MOST} times in a sample")
                    out.append(row.astype("<u2").tobytes())
                yield pa.record_batch({"query_id": batch.column(0), "drawn": pa.array(out, pa.binary())})

        lists = self.table.groupBy("query_id").agg(F.collect_list(F.struct(F.col("sample").cast("int").alias("sample"), F.col("weight").cast("int").alias("weight"))).alias("drawn"))
        kind = self.table.schema["query_id"].dataType.simpleString()
        return rows.join(lists.mapInArrow(run, f"query_id {kind}, drawn binary"), "query_id")

    def rows(self) -> DataFrame:
        return self.table


Draws = TreeDraws | _BytesDraws
