"""Near-duplicates by ProbMinHash: signatures, banding and verification on whole shingle sets.

Each distinct five-word shingle of a text runs a Poisson process whose rate is its weight; every
arrival goes to a hashed signature component, which keeps the earliest. The process of a shingle
ends as soon as its arrival is later than every component's, so the work for a text is near its
number of shingles. Two texts share a component as often as their probability Jaccard says. Bands
of components make the buckets in which texts are compared.

Two measures are at hand. ``EITHER`` weighs a shingle by its count: texts are linked where the
probability Jaccard of the weighted shingles or the Jaccard of the sets reaches the threshold.
``SETS`` weighs each by 1, for which both are the Jaccard of the sets. A text that repeats no
shingle has one signature for both; one that does gets the bands of both that differ.

Inside a bucket every pair of texts is compared exactly on whole sets and counts, or is in one
class already; no estimate leaves a pair out, and no pair is ever a row: a task holds one block
of a bucket, compares one text at a time with all others through an inverted index of the block,
and emits only the links that join two classes. A text that joins most others (an original among
its copies) comes first, so a group of copies costs one comparison each.

A bucket too large for one block is dealt over blocks that share some anchor texts, which makes
its classes large; then the parts of its different classes meet in pairs of parts, so that any
two of its texts in different classes are compared. Buckets of the same texts are one bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._stage import fresh_name, release, stage_table
from ._words import U, blocks, counted, mix, shingles, words
from .components import connected_components
from .salted import back_to_rows, salt_bit, salt_of, with_group

SHINGLE, THRESHOLD = 5, 0.8
#: Measures: the Jaccard of the sets of shingles, or that and the probability Jaccard of their counts.
SETS, EITHER = "sets", "either"
#: 32 bands of 5 components: a pair at 0.8 shares no band once in 300,000 times.
BANDS, ROWS = 32, 5
#: Texts, and shingles of all its texts, that a block of a bucket holds about.
BLOCK_ROWS, BLOCK_SHINGLES = 2048, 1 << 21
#: Bits of a bitmap for each node, and at most for all: 32 MB.
BITS_A_NODE, MAX_BITS = 16, 1 << 28
#: Texts of a large bucket that all of its blocks share.
ANCHORS = 64
#: Bytes of a text's SHA-256 that name it; two texts share them never in practice (128 bits).
NODE_BYTES = 16
_NEVER = U(0)


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, texts: int, m: int) -> np.ndarray:
    """ProbMinHash signatures (texts x m, uint64); rows of texts without shingles are 0."""
    times = np.full(texts * m, np.inf)
    out = np.full(texts * m, _NEVER)
    at, sh, rate, arrival, k = doc, shingle, weight.astype(float), np.zeros(len(doc)), 0
    while len(at):
        k += 1
        draw = mix(sh, k)
        arrival = arrival - np.log1p(-((draw >> U(11)).astype(float) * 2.0**-53)) / rate
        spot = at * m + (mix(draw, 1) % U(m)).astype(np.int64)
        early = arrival < times[spot]
        where, when, who = spot[early], arrival[early], sh[early]
        np.minimum.at(times, where, when)
        won = times[where] == when
        out[where[won]] = who[won]
        latest = times.reshape(texts, m).max(axis=1)
        going = arrival < latest[at]
        at, sh, rate, arrival = at[going], sh[going], rate[going], arrival[going]
    return out.reshape(texts, m)


def _shingled(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, texts, text index, shingle, count) of blocks of texts, each text's shingles once."""
    for first, data, offsets in blocks(column):
        _, _, doc, hashes = words(data, offsets)
        yield first, len(offsets) - 1, *counted(*shingles(doc, hashes, size))


def _keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The keys of a signature's bands (texts x bands)."""
    parts = mix(sig).reshape(len(sig), bands, rows)
    keys = np.zeros((len(sig), bands), U)
    for k in range(rows):
        keys = mix(keys + parts[:, :, k], k + 9)
    return mix(keys + np.arange(bands, dtype=U))  # the band is part of the key


def _signed(batches: Iterator[pa.RecordBatch], bands: int, rows: int, size: int, measure: str = SETS) -> Iterator[pa.RecordBatch]:
    """(node, text) to (node, n_shingles, keys): a key for each band, and for each other band of the
    weighted signature; texts without a shingle have no row."""
    for batch in batches:
        for first, n, doc, found, times in _shingled(batch.column(1), size):
            counts = np.bincount(doc, minlength=n)
            some = np.flatnonzero(counts)
            keys = _keys(signatures(doc, found, np.ones(len(doc)), n, bands * rows)[some], bands, rows)
            owner, flat = np.repeat(np.arange(len(some)), bands), keys.ravel()
            repeats = np.unique(doc[times > 1]) if measure == EITHER else some[:0]
            if len(repeats):
                mine = np.isin(doc, repeats)
                sig = signatures(np.searchsorted(repeats, doc[mine]), found[mine], times[mine], len(repeats), bands * rows)
                spot, more = np.searchsorted(some, repeats), _keys(sig, bands, rows)
                other = more != keys[spot]
                owner, flat = np.concatenate([owner, np.repeat(spot, bands)[other.ravel()]]), np.concatenate([flat, more[other]])
                order = np.argsort(owner, kind="stable")
                owner, flat = owner[order], flat[order]
            ends = pa.array(np.searchsorted(owner, np.arange(len(some) + 1)).astype(np.int32))
            yield pa.record_batch({
                "node": batch.column(0).slice(first, n).take(pa.array(some)),
                "n_shingles": pa.array(counts[some].astype(np.int64)),
                "keys": pa.ListArray.from_arrays(ends, pa.array(flat.view(np.int64))),
            })


def _as_sets(batches: Iterator[pa.RecordBatch], size: int, measure: str = SETS) -> Iterator[pa.RecordBatch]:
    """(node, text) to (node, shingles, counts): the distinct 64-bit shingles in rising order, and
    their 32-bit counts, which are left out where they are all 1 or not asked for."""
    for batch in batches:
        for first, n, doc, found, times in _shingled(batch.column(1), size):
            cuts = np.searchsorted(doc, np.arange(n + 1)).tolist()
            times = times.astype(np.uint32)
            spans = list(zip(cuts, cuts[1:], strict=False))
            counts = [times[a:b].tobytes() if measure == EITHER and b > a and times[a:b].max() > 1 else b"" for a, b in spans]
            sets = [found[a:b].tobytes() for a, b in spans]
            yield pa.record_batch({"node": batch.column(0).slice(first, n), "shingles": pa.array(sets, pa.binary()), "counts": pa.array(counts, pa.binary())})


def similar(both, a, b, threshold: float):
    """Whether sets of ``a`` and ``b`` elements with ``both`` in common reach the threshold."""
    return (both > 0) & (both >= threshold * (a + b - both) - 1e-9)


def jaccard(a: str, b: str, size: int = SHINGLE) -> float:
    """Exact similarity of two texts' shingle sets (0 if both have none)."""
    [(_, _, doc, found, _)] = _shingled(pa.array([a, b]), size)
    x, y = found[doc == 0], found[doc == 1]
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def weighted_jaccard(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray) -> float:
    """Exact probability Jaccard of shingles ``x`` and ``y`` (rising) that occur ``n`` and ``m`` times.

    It is the sum over common shingles i of 1 / sum over j of max(n_j / n_i, m_j / m_i). The
    greater side at j is told by whether n_j / m_j is over n_i / m_i, so with shingles in the
    order of that ratio the inner sums are running totals.
    """
    every, spot = np.unique(np.concatenate([x, y]), return_inverse=True)
    a, b = (np.bincount(s, w, len(every)) for s, w in ((spot[: len(x)], n), (spot[len(x) :], m)))
    with np.errstate(divide="ignore"):
        ratio = a / b
    order = np.argsort(ratio, kind="stable")
    a, b, ratio = a[order], b[order], ratio[order]
    common = (a > 0) & (b > 0)
    above, below = a.sum() - np.cumsum(a) + a, np.cumsum(b) - b
    return float(np.sum(1 / (above[common] / a[common] + below[common] / b[common])))


def probability_jaccard(a: str, b: str, size: int = SHINGLE) -> float:
    """Exact similarity of two texts' shingles weighted by their counts (0 if both have none)."""
    [(_, _, doc, found, times)] = _shingled(pa.array([a, b]), size)
    return weighted_jaccard(found[doc == 0], times[doc == 0], found[doc == 1], times[doc == 1])


def joining_links(sets: list[np.ndarray], group: np.ndarray, threshold: float, counts: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Links that join all groups (small ints) that some pair of similar sets joins.

    With ``counts`` (empty: all 1) sets are similar by their probability Jaccard as well. It is
    at most the sum over common shingles of the smaller share that one has of its text, so the
    exact value is asked only of pairs that this bound leaves open.

    A pivot is compared with all sets at once. It ends when all sets that were no pivot are in
    one group: each pair of different groups had a pivot in it then, and was compared.
    """
    size = np.array([len(x) for x in sets])
    counts = counts or [np.zeros(0)] * len(sets)
    uneven = np.array([len(x) > 0 for x in counts])
    times = [n if len(n) else np.ones(len(x)) for x, n in zip(sets, counts, strict=True)] if uneven.any() else []
    weigh = lambda a, b: weighted_jaccard(sets[a], times[a], sets[b], times[b]) >= threshold - 1e-9
    if len(sets) == 2:
        both = np.intersect1d(*sets, assume_unique=True).size if group[0] != group[1] else 0
        return [(0, 1)] if similar(both, *size, threshold) or both and uneven.any() and weigh(0, 1) else []
    owner = np.repeat(np.arange(len(sets)), size)
    _, spot = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(spot, kind="stable")
    holder, share = owner[order], None
    if uneven.any():
        share = np.concatenate([n / max(1, n.sum()) for n in times])
        held = share[order]
    spread = np.bincount(spot)  # sets that hold each shingle
    begin, ends = np.cumsum(spread) - spread, np.cumsum(size)
    likeness = np.bincount(owner, spread[spot], len(sets)) / np.maximum(size, 1)
    group, waits, out = group.copy(), np.ones(len(sets), bool), []
    pivot = int(likeness.argmax())
    while True:
        waits[pivot] = False
        own = spot[ends[pivot] - size[pivot] : ends[pivot]]
        n = spread[own]
        at = np.repeat(begin[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(holder[at], minlength=len(sets))
        alike, apart = similar(both, size[pivot], size, threshold), group != group[pivot]
        if share is not None:
            least = np.minimum(np.repeat(share[ends[pivot] - size[pivot] : ends[pivot]], n), held[at])
            bound = np.bincount(holder[at], least, len(sets)) >= threshold - 1e-8
            joins = np.unique(group[alike & apart])  # groups that come in without a second measure
            for other in np.flatnonzero(bound & ~alike & apart & (uneven | uneven[pivot])):
                if group[other] not in joins and weigh(pivot, other):
                    alike[other], joins = True, np.append(joins, group[other])
        joined = np.flatnonzero(alike & apart)
        for other, first in zip(*np.unique(group[joined], return_index=True), strict=True):
            out.append((pivot, int(joined[first])))
            group[group == other] = group[pivot]
        sizes = np.bincount(group[waits], minlength=1)
        outside = np.flatnonzero(waits & (group != sizes.argmax()))
        if not len(outside):
            return out
        pivot = int(outside[likeness[outside].argmax()])


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (key, block), the first two columns, which the rows come sorted by."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        first, last = ((b.column(0)[k].as_py(), b.column(1)[k].as_py()) for b, k in ((kept[0], 0), (batch, -1)))
        if first == last:
            continue  # one block so far
        table = pa.Table.from_batches(kept)
        key, block = table.column(0).to_numpy(), table.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1).tolist()]
        yield from (table.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False))
        kept = table.slice(cuts[-1]).to_batches()
    if kept:
        yield pa.Table.from_batches(kept)


def _linked(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """(key, block, node, class, shingles, counts) to links (a, b) of nodes."""
    a, b = [], []
    for table in _whole_blocks(batches):
        if table.num_rows > 1:
            sets = [np.frombuffer(x.as_buffer(), U) for x in table.column(4)]
            group = table.column(3).combine_chunks().dictionary_encode().indices.to_numpy()
            if group.any():
                node = table.column(2)
                counts = [np.frombuffer(x.as_buffer(), np.uint32) for x in table.column(5)]
                for i, j in joining_links(sets, group, threshold, counts):
                    a.append(node[i].as_py())
                    b.append(node[j].as_py())
    yield pa.record_batch({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def node_of(text: Column) -> Column:
    """The name of a text (null: empty): the first bytes of its SHA-256."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, NODE_BYTES)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("node", node_of(F.col("text")))


def _buckets(texts: DataFrame, bands: int, rows: int, size: int, measure: str) -> DataFrame:
    """(key, node, n_shingles, n, parts) of every bucket of two texts or more, sets of buckets alike only once."""
    sign = lambda b: _signed(b, bands, rows, size, measure)
    signed = stage_table(texts.select("node", "text").mapInArrow(sign, "node binary, n_shingles long, keys array<long>"), "signed")
    keyed = signed.select("node", "n_shingles", F.explode("keys").alias("key"))
    shared = (
        keyed.groupBy("key")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("n_shingles").alias("total"),
            F.bit_xor(F.xxhash64("node")).alias("x1"),
            F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x2"),
        )
        .filter("n > 1")
    )
    one = shared.groupBy("n", "total", "x1", "x2").agg(F.min("key").alias("key"))
    parts = F.ceil(F.greatest(F.col("n") / BLOCK_ROWS, F.col("total") / BLOCK_SHINGLES))
    bucket = stage_table(keyed.join(one.select("key", "n", parts.alias("parts")), "key"), "bucket")
    release(signed)
    return bucket


def _dealt(bucket: DataFrame) -> DataFrame:
    """Blocks of the buckets: one, or some that share the bucket's anchors."""
    own = F.array(F.pmod(F.xxhash64("node", "key"), "parts"))
    anchor = (F.col("parts") > 1) & (F.pmod(F.xxhash64("node", "key", F.lit(2)), "n") < ANCHORS)
    block = F.when(anchor, F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(own)
    return bucket.select("key", F.explode(block).alias("block"), "node", F.col("node").alias("class"))


def _in_pairs_of_parts(large: DataFrame, roots: DataFrame) -> DataFrame:
    """Blocks in which any two texts of different classes of a large bucket meet.

    Each large class of a bucket has parts of its own and its other classes share parts; a block
    is a pair of parts of different classes, or one or two of the shared parts.
    """
    half_rows, half_shingles = max(1, BLOCK_ROWS // 2), max(1, BLOCK_SHINGLES // 2)
    here = large.join(roots, "node", "left").select("key", "node", "n_shingles", F.coalesce("root", "node").alias("class"))
    classes = here.groupBy("key", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("total"))
    owns = (F.col("n") > half_rows // 2) | (F.col("total") > half_shingles // 2)
    classes = classes.withColumn("owner", F.when(owns, F.col("class")))
    deal = F.ceil(F.greatest(F.sum("n") / half_rows, F.sum("total") / half_shingles))
    parts = classes.groupBy("key", "owner").agg(deal.alias("deal"))
    part = lambda owner, k: F.concat(F.coalesce(F.hex(owner), F.lit("rest")), F.lit(":"), k.cast("string"))
    owned = classes.join(parts.withColumnRenamed("owner", "o"), ["key"]).filter(F.col("owner").eqNullSafe(F.col("o")))
    mine = here.join(owned.select("key", "class", "owner", "deal"), ["key", "class"])
    mine = mine.withColumn("mine", part(F.col("owner"), F.pmod(F.xxhash64("node", "key"), "deal"))).drop("deal")
    theirs = parts.select("key", F.col("owner").alias("other"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("deal") - 1)).alias("k"))
    met = mine.join(theirs, "key").filter(F.col("owner").isNull() | ~F.col("owner").eqNullSafe(F.col("other")))
    met = met.withColumn("theirs", part(F.col("other"), F.col("k")))
    return met.select("key", F.xxhash64(F.least("mine", "theirs"), F.greatest("mine", "theirs")).alias("block"), "node", "class")


def _bitmap_of_nodes(bucket: DataFrame) -> tuple[np.ndarray, Column]:
    """A bitmap of the nodes in buckets, put together on the executors by words of 64 bits, and a node's place in it.

    Texts of other nodes that fall on a set bit only make a set that is not asked for.
    """
    count = bucket.agg(F.approx_count_distinct("node")).first()[0]
    size = min(MAX_BITS, max(1 << 13, 1 << (BITS_A_NODE * count).bit_length()))
    place = F.shiftrightunsigned(F.xxhash64("node"), 64 - size.bit_length() + 1)
    spots = bucket.select(place.alias("place")).selectExpr("place div 64 as slot", "shiftleft(1L, cast(place % 64 as int)) as bit")
    slots = spots.groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(size // 64, U)
    out[slots.column("slot").to_numpy()] = slots.column("bits").to_numpy().view(U)
    return out, place


def _in_bitmap(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows (node, text, place) whose place is set."""
    for batch in batches:
        place = batch.column(2).to_numpy().view(U)
        kept = batch.filter(pa.array((bits[place >> U(6)] >> (place & U(63))) & U(1) == 1))
        if kept.num_rows:
            yield kept


def _roots(texts: DataFrame, threshold: float, bands: int, rows: int, size: int, measure: str) -> DataFrame:
    """(node, root) of the texts with a link, root naming the class."""
    bucket = _buckets(texts, bands, rows, size, measure)
    bits, place = _bitmap_of_nodes(bucket)
    sent = texts.sparkSession.sparkContext.broadcast(bits)
    sets = stage_table(texts.select("node", "text", place.alias("place")).mapInArrow(lambda b: _as_sets(_in_bitmap(b, sent.value), size, measure), "node binary, shingles binary, counts binary"), "sets")
    sent.destroy()

    def linked(dealt: DataFrame) -> DataFrame:
        whole = dealt.join(sets, "node").select("key", "block", "node", "class", "shingles", "counts")
        ordered = whole.repartition("key", "block").sortWithinPartitions("key", "block")
        return stage_table(ordered.mapInArrow(lambda b: _linked(b, threshold), "a binary, b binary"), "links")

    links = linked(_dealt(bucket))
    roots = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    large = bucket.filter("parts > 1")
    if not large.isEmpty():
        links = links.unionByName(linked(_in_pairs_of_parts(large, roots)))
        roots = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    release(bucket, sets)
    return roots


def _text_classes(rows: DataFrame, threshold: float, bands: int, shape: int, size: int, measure: str) -> DataFrame:
    """One row per distinct text: node, salts, id, n, class_id, class_size, stays."""
    texts = rows.groupBy("node", "text").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.bit_or(salt_bit("id")).alias("salts"))
    texts = stage_table(texts, "texts")
    slim = texts.select("node", "id", "n", "salts")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("first")
    linked = with_group(_roots(texts, threshold, bands, shape, size, measure).join(slim, "node"), "root", "node", first, F.sum("n").alias("class_size"), F.min("first").alias("first"), F.sum("class_size").alias("class_size"))
    linked = linked.select("node", "first", "class_size")
    return slim.join(linked, "node", "left").select(
        "node",
        "salts",
        "id",
        "n",
        F.when(F.col("first").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("class_id"),
        F.coalesce("class_size", "n").alias("class_size"),
        F.coalesce(F.col("first.node") == F.col("node"), F.lit(True)).alias("stays"),
    )


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE, measure: str = SETS) -> DataFrame:
    """One row per input row: id, class_id, class_size, by the ``measure`` ``SETS`` or ``EITHER``.

    class_id is the least id of the class; null ids get rows too, and class_id is null only
    where all ids of the class are. Null texts count as empty. Texts with no word have no
    shingles: their classes are their exact copies; so is a text of fewer than five words,
    which has one shingle of all its words. Repeated rows and exact copies share a class, and
    texts that share an id are texts of their own. Other columns are not read; an empty table
    gives an empty result.
    """
    base = _rows(docs, id_col, text_col)
    found = _text_classes(base, threshold, bands, rows, size, measure).filter("class_size > 1")
    spread = back_to_rows(found.select("node", "salts", "class_id", "class_size"))
    out = base.select("id", "node", salt_of("id").alias("salt")).join(spread, ["node", "salt"], "left")
    alone = F.col("class_size").isNull()
    return out.select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, measure: str = SETS) -> DataFrame:
    """``docs`` with one row of each class, all columns kept: the least id's.

    ``SETS`` is the default, as a text may repeat one passage so often that its counts drown what
    only it says; a class is then no reason to drop it.
    Null ids lose to any id; of texts with the least id the one of the least digest stays, and
    of rows that repeat id and text any one. Columns of ``docs`` may have any names.
    """
    node, salt, other = (fresh_name(docs.columns, x) for x in ("node", "salt", "other"))
    found = _text_classes(_rows(docs, id_col, text_col), threshold, BANDS, ROWS, SHINGLE, measure).filter("not stays or n > 1")
    found = stage_table(back_to_rows(found.select("node", "salts", "id", "stays")), "found")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    key = [F.col("node").alias(node), F.col("salt").alias(salt)]
    out = docs.withColumn(node, node_of(text)).withColumn(salt, salt_of(f"`{id_col}`"))
    out = out.join(found.filter("not stays").select(key), [node, salt], "left_anti")
    copied = found.filter("stays").select(*key, F.struct("id").alias(other))
    columns = [f"`{c}`" for c in docs.columns]
    if copied.isEmpty():
        return out.select(columns)
    out = out.join(copied, [node, salt], "left").filter(F.col(other).isNull() | F.col(f"`{id_col}`").eqNullSafe(F.col(other)["id"]))
    single = out.filter(F.col(other).isNull()).select(columns)
    return single.unionByName(out.filter(F.col(other).isNotNull()).dropDuplicates([node]).select(columns))
