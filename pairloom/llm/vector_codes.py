"""Vector code compression: a codebook for each part position, by the filtering form of Lloyd's rounds.

Every task cuts its vectors into blocks and builds a kd-tree over each part position of a block: a
node keeps its bounding box, the sum and the count of the parts below it. The trees are written
once. A round walks them level by level, all open nodes at once: of the entries that may still be
nearest in a node, those which lose to another one over the whole box are struck out; a
node that one entry is left for gives its cached sum and count to it and isn't opened. Only
parts in leaves with several entries left are measured one by one. A task sends one sum for each
part position and entry, and the driver holds the codebooks alone.

All numbers are integers, held exactly: in floats while every square stays below 2^53, else as
Python's integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._stage import release, stage_table
from .salted import SALTS, back_to_rows

#: Components of a block, rows of a block, and parts of a leaf at the least.
BLOCK, ROWS, LEAF = 1 << 20, 1 << 13, 12
#: Components up to this size are exact in floats.
SMALL = 1 << 18
#: Larger components than this are refused: sums of them are decimals of 38 digits.
LARGEST = 10**27


@dataclass(frozen=True)
class CodeModel:
    """``books``: (part position, entry, component), integers."""

    books: np.ndarray
    width: int

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.reshape(-1).tolist())).encode()).hexdigest()


def scaled(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), as floats where all are small, else as Python's integers."""
    x = np.floor(vectors.astype(np.float64) * scale)
    if not x.size or np.abs(x).max() <= SMALL:
        return x
    if np.abs(x).max() > LARGEST:
        raise ValueError(f"a vector has a component beyond {LARGEST // scale}")
    return np.array([int(y) for y in x.reshape(-1)], object).reshape(x.shape)


def _bounds(n: int, level: int) -> np.ndarray:
    """Where the nodes of a level begin, and the end; a node's halves are nodes of the next level."""
    return (np.arange((1 << level) + 1) * n) >> level


@dataclass
class Tree:
    """A balanced kd-tree: points in its order, their places, and by level boxes and sums of the nodes."""

    points: np.ndarray
    order: np.ndarray
    boxes: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    @staticmethod
    def depth(n: int) -> int:
        return max(0, (n // LEAF).bit_length() - 1)

    @classmethod
    def built(cls, points: np.ndarray) -> Tree:
        order, n = np.arange(len(points)), len(points)
        for level in range(cls.depth(n)):
            at = _bounds(n, level)
            spread = np.maximum.reduceat(points, at[:-1]) - np.minimum.reduceat(points, at[:-1])
            node = np.repeat(np.arange(1 << level), np.diff(at))
            by = np.lexsort((points[np.arange(n), spread.argmax(1)[node]], node))
            points, order = points[by], order[by]
        return cls(points, order, []).boxed()

    def boxed(self) -> Tree:
        depth = self.depth(len(self.points))
        at = _bounds(len(self.points), depth)[:-1]
        made = [(np.minimum.reduceat(self.points, at), np.maximum.reduceat(self.points, at), np.add.reduceat(self.points, at))]
        for _ in range(depth):
            lo, hi, total = made[0]
            made.insert(0, (np.minimum(lo[::2], lo[1::2]), np.maximum(hi[::2], hi[1::2]), total[::2] + total[1::2]))
        self.boxes = made
        return self


def _squares(a: np.ndarray, book: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] + (book * book).sum(1)[None, :] - 2 * (a @ book.T)


def _beaten(book: np.ndarray, near: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Entries that lose to the entry ``near`` at every point of the box, ties to the lower index."""
    k = np.arange(len(book))
    out = np.empty((len(near), len(book)), bool)
    step = max(1, (1 << 20) // max(1, book.size))
    norm = (book * book).sum(1)
    for s in range(0, len(near), step):
        z = near[s : s + step]
        to = book[None, :, :] - book[z][:, None, :]
        up = np.maximum(to, 0)
        # the entry's gain at the corner that lies farthest its way
        gain = norm[None, :] - norm[z][:, None] - 2 * (up * hi[s : s + step, None, :] + (to - up) * lo[s : s + step, None, :]).sum(2)
        out[s : s + step] = (gain > 0) | ((gain == 0) & (k > z[:, None]))
    return out


def filtered(tree: Tree, book: np.ndarray) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """(level, nodes, entries) that were assigned whole; then single points and their entries."""
    n = len(tree.points)
    depth = tree.depth(n)
    whole, nodes, left = [], np.zeros(1, np.int64), np.ones((1, len(book)), bool)
    far = np.inf
    for level in range(depth + 1):
        lo, hi, _ = (x[nodes] for x in tree.boxes[level])
        near = np.where(left, _squares(lo + hi, 2 * book), far).argmin(1)
        left &= ~_beaten(book, near, lo, hi)
        one = left.sum(1) == 1
        whole.append((level, nodes[one], near[one]))
        nodes, left = nodes[~one], left[~one]
        if level < depth:
            nodes, left = np.stack([2 * nodes, 2 * nodes + 1], 1).reshape(-1), np.repeat(left, 2, axis=0)
    at = _bounds(n, depth)
    size = np.diff(at)[nodes]
    single = np.repeat(at[nodes] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(nodes) else np.zeros(0, np.int64)
    entry = np.where(np.repeat(left, size, axis=0), _squares(tree.points[single], book), far).argmin(1) if len(single) else single
    return whole, single, entry


def tree_sums(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By entry: the sums and the number of the parts that are nearest to it."""
    sums, counts = np.zeros(book.shape, tree.points.dtype), np.zeros(len(book), np.int64)
    whole, single, entry = filtered(tree, book)
    for level, nodes, entries in whole:
        np.add.at(sums, entries, tree.boxes[level][2][nodes])
        np.add.at(counts, entries, np.diff(_bounds(len(tree.points), level))[nodes])
    np.add.at(sums, entry, tree.points[single])
    np.add.at(counts, entry, 1)
    return sums, counts


def tree_codes(tree: Tree, book: np.ndarray) -> np.ndarray:
    """The nearest entry of every part, in the block's order."""
    found = np.zeros(len(tree.points), np.int64)
    whole, single, entry = filtered(tree, book)
    for level, nodes, entries in whole:
        at = _bounds(len(tree.points), level)
        size = (at[nodes + 1] - at[nodes]) if len(nodes) else np.zeros(0, np.int64)
        found[np.repeat(at[nodes] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(nodes) else single[:0]] = np.repeat(entries, size)
    found[single] = entry
    out = np.empty_like(found)
    out[tree.order] = found
    return out


def _packed(x: np.ndarray) -> bytes:
    return ",".join(map(str, x.reshape(-1).tolist())).encode() if x.dtype == object else x.astype(np.int32).tobytes()


def _unpacked(x: bytes, big: bool, width: int) -> np.ndarray:
    flat = np.array([int(y) for y in x.split(b",")], object) if big else np.frombuffer(x, np.int32).astype(np.float64)
    return flat.reshape(-1, width)


def _exact(a: np.ndarray, big: bool) -> np.ndarray:
    """A codebook in the numbers that a tree needs."""
    if big or np.abs(a).max(initial=0) > SMALL:
        return a.astype(object)
    return a.astype(np.float64)


def _trees(vectors: DataFrame, parts: int, width: int, scale: int) -> DataFrame:
    """Blocks with their trees: ids, labels, and for each part position points in tree order with their places."""
    rows = max(64, min(ROWS, BLOCK // (parts * width)))
    names = ["big", "ids", "labels", "points", "orders"]

    def made(table: pa.Table) -> pa.RecordBatch:
        n = table.num_rows
        flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        x = scaled(flat, scale).reshape(n, parts, width)
        trees = [Tree.built(np.ascontiguousarray(x[:, k, :])) for k in range(parts)]
        held = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), table.column(c).combine_chunks()) for c in ("id", "label")]
        return pa.record_batch([pa.array([x.dtype == object]), *held, pa.array([[_packed(t.points) for t in trees]], pa.list_(pa.binary())), pa.array([[t.order.astype(np.uint16).tobytes() for t in trees]], pa.list_(pa.binary()))], names)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                take = batch.slice(0, rows - n)
                held, n, batch = [*held, take], n + take.num_rows, batch.slice(take.num_rows)
                if n == rows:
                    yield made(pa.Table.from_batches(held))
                    held, n = [], 0
        if n:
            yield made(pa.Table.from_batches(held))

    of = lambda c: T.ArrayType(vectors.schema[c].dataType)
    return vectors.mapInArrow(blocks, T.StructType([T.StructField("big", T.BooleanType()), T.StructField("ids", of("id")), T.StructField("labels", of("label")), T.StructField("points", T.ArrayType(T.BinaryType())), T.StructField("orders", T.ArrayType(T.BinaryType()))]))


def _forest(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, bool, list[Tree]]]:
    for k in range(batch.num_rows):
        big = batch.column("big")[k].as_py()
        points, orders = batch.column("points")[k].as_py(), batch.column("orders")[k].as_py()
        yield k, big, [Tree(_unpacked(p, big, width), np.frombuffer(o, np.uint16).astype(np.int64), []).boxed() for p, o in zip(points, orders, strict=True)]


def _moved(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: each entry becomes the floor of its parts' mean; unused entries stay."""
    parts, entries, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(books.shape, object), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for _, big, forest in _forest(batch, width):
                for p, tree in enumerate(forest):
                    book = _exact(books[p], big)
                    if book.dtype == object and not big:
                        tree = Tree(np.vectorize(int, otypes=[object])(tree.points), tree.order, []).boxed()
                    s, c = tree_sums(tree, book)
                    total[p] += s if s.dtype == object else s.astype(np.int64).astype(object)
                    count[p] += c
        p, e = np.nonzero(count)
        if len(p):
            yield pa.record_batch([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), pa.array([[str(int(y)) for y in x] for x in total[p, e]], pa.list_(pa.string()))], ["part", "entry", "n", "sums"])

    made = trees.mapInArrow(sums, "part int, entry int, n long, sums array<string>")
    added = [F.sum(F.col("sums")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(width)]
    out = books.copy()
    for r in made.groupBy("part", "entry").agg(F.sum("n").alias("n"), *added).collect():
        out[r["part"], r["entry"]] = [int(r[f"s{k}"]) // r["n"] for k in range(width)]
    return out


def _valid(vector: Column) -> Column:
    return F.coalesce(F.size(vector) > 0, F.lit(False)) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def compress_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> tuple[DataFrame, CodeModel]:
    """(id, label, code, error) of the vectors that can be coded, as a written table, and the codebooks.

    Vectors that are null, empty or hold a null, NaN or infinite component are left out. Component x
    is the integer floor(scale * x). The codebooks start as the parts of the ``entries`` (at most
    256) vectors of the smallest ids, fewer if there are fewer; null ids come last, rows of one id by their
    components. ``rounds`` times each part goes to its nearest entry, the lower index of equally near
    ones, and each entry to the floor of its parts' mean; entries without parts stay. Then
    each part is coded once more: ``code`` has two hex digits a part, ``error`` is the sum of squared distances (null
    beyond 64 bits). Repeated rows are coded each. A vector of another length than the smallest id's
    is left out as well, since it has no such parts; a length that ``parts`` doesn't divide raises. An empty table gives an
    empty result and empty codebooks. Other columns are not read.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code of two hex digits has 1 to 256 entries")
    spark = vectors.sparkSession
    used = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    used = used.filter(_valid(F.col("vector")))
    first = used.select("id", "vector").orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    out = T.StructType([used.schema["id"], used.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if not first:
        return spark.createDataFrame([], out), CodeModel(np.zeros((parts, 0, 0), object), 0)
    size = len(first[0]["vector"])
    if size % parts:
        raise ValueError(f"vectors of {size} components can't be cut into {parts} equal parts")
    width = size // parts
    start = np.array([scaled(np.array(r["vector"]), scale) for r in first if len(r["vector"]) == size], object).reshape(-1, parts, width)
    books = np.array([int(x) for x in start.reshape(-1)], object).reshape(start.shape).transpose(1, 0, 2)
    trees = stage_table(_trees(used.filter(F.size("vector") == size), parts, width, scale), "trees")
    for _ in range(rounds):
        books = _moved(trees, books)
    coded = stage_table(trees.mapInArrow(_coder(books), out), "codes")
    release(trees)
    return coded, CodeModel(books, width)


def _coder(books: np.ndarray) -> Callable:
    parts, _, width = books.shape

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, big, forest in _forest(batch, width):
                n = len(forest[0].points)
                code, error = np.empty((n, parts), np.uint8), np.zeros(n, object)
                for p, tree in enumerate(forest):
                    book = _exact(books[p], big)
                    if book.dtype == object and not big:
                        tree = Tree(np.vectorize(int, otypes=[object])(tree.points), tree.order, []).boxed()
                    code[:, p] = found = tree_codes(tree, book)
                    there = np.empty_like(tree.points)
                    there[tree.order] = tree.points
                    off = ((there - book[found]) ** 2).sum(1)
                    error += off if off.dtype == object else off.astype(np.int64)
                text = code.tobytes().hex()
                words = [text[2 * parts * i : 2 * parts * (i + 1)] for i in range(n)]
                fits = [int(x) if x < 1 << 63 else None for x in error]
                yield pa.record_batch([batch.column("ids")[k].values, batch.column("labels")[k].values, pa.array(words), pa.array(fits, pa.int64())], ["id", "label", "code", "error"])

    return codes


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with label_error: the errors of all rows of a label added up, of null labels together.

    A label's rows are dealt over salts on the way to its sum and back. A sum is null if an error is, or if it passes 64 bits.
    """
    salted = stage_table(coded.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")), "salted")
    of = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias("total")
    local = salted.groupBy("label", "salt").agg(of("error"), F.count(F.when(F.col("error").isNull(), 1)).alias("lost"))
    whole = local.groupBy("label").agg(of("total"), F.sum("lost").alias("lost"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts"))
    sums = back_to_rows(whole).select(F.col("label").alias("of"), F.col("salt").alias("dealt"), F.when(F.col("lost") == 0, F.expr("try_cast(total as bigint)")).alias("label_error"))
    met = salted.join(sums, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("dealt")))
    return met.select(*coded.columns, "label_error")
