"""Best-fit packing with Martello-Toth dominance reduction.

Texts are cut into pieces of at most ``capacity`` tokens. Which pieces share a sequence
depends on their lengths only, so the instance that is solved is a histogram of at most
``capacity`` lengths with counts, whatever the number of documents:

1. reduction: for the longest length, a set of at most three lengths that provably
   dominates every other set that holds it is fixed, as often as its counts allow;
2. what no dominance settles is packed best-fit, longest first.

The result is a short list of patterns with multiplicities. Each piece is numbered within
its length (a count per task, then a running sum over tasks), and its number finds its
pattern, sequence and offset; no documents are gathered anywhere.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._stage import stage_table

CAPACITY, END_ID = 1024, 2
TOKENIZER = "byte_bpe_50k.json"
Pattern = tuple[tuple[int, ...], int]


#: Texts of these characters only (Latin, Cyrillic, kana, CJK, Hangul and common marks) are
#: parted alike by both engines; any other text goes to ``tokenizers`` itself.
PLAIN = re.compile("[\t\n\r\x20-\x7e\u00a1-\u024f\u0400-\u052f\u2010-\u2027\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]*").fullmatch
#: The pre-tokeniser's pattern of ``byte_bpe_50k.json`` (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class TextIds:
    """Ids of whole texts by ``tokenizers`` with a byte-level BPE file, at its default flags.

    So a special token's text in a document is that token's id. ``tokenizers`` encodes about
    1 MB a second, so texts of PLAIN characters without a special token are encoded by
    tiktoken's engine with the vocabulary of the same file; the ids are equal (tested).
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        letters = {c: b for b, c in _byte_letters().items()}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)").search
        ranks = {bytes(letters[c] for c in x): i for x, i in vocabulary.items() if x not in special}
        self.engine = tiktoken.Encoding("texts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if PLAIN(text) and not self.special(text):
            return self.engine.encode_ordinary(text)
        return self.tokenizer.encode(text, add_special_tokens=False).ids


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


_text_ids: dict[str, TextIds] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _cut(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    if path not in _text_ids:
        _text_ids[path] = TextIds(path)
    encoder, slots, part = _text_ids[path], {}, TaskContext.get().partitionId()
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            row, piece, start, length, crc, slot, ids = [], [], [], [], [], [], []
            for i, text in enumerate(batch.column(1).slice(at, 512).to_pylist()):
                data = np.array([*encoder.ids(text or ""), end_id], "<u4").tobytes()
                n, done, k = len(data) // 4, 0, 0
                size = n % capacity or capacity
                while done < n:
                    part_ids = data[4 * done : 4 * (done + size)]
                    slots[size] = mine = slots.get(size, -1) + 1
                    for out, x in ((row, at + i), (piece, k), (start, done), (length, size), (crc, zlib.crc32(part_ids)), (slot, mine)):
                        out.append(x)
                    if keep_ids:
                        ids.append(part_ids)
                    done, k, size = done + size, k + 1, capacity
            out = {"id": batch.column(0).take(pa.array(row, pa.int32())), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()), "part": pa.array([part] * len(row), pa.int32()), "slot": pa.array(slot, pa.int64())}
            if keep_ids:
                out["ids"] = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(x) // 4 for x in ids)]), pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))
            yield pa.record_batch(out)


def _smallest(have: list[int], left: dict[int, int], k: int) -> list[int]:
    out: list[int] = []
    for x in have:
        out += [x] * min(left[x], k - len(out))
        if len(out) == k:
            break
    return out


def _dominating(top: int, have: list[int], left: dict[int, int], room: int) -> tuple[int, ...] | None:
    """Companions of the longest length that provably dominate all others; None if unproven.

    ``have``: lengths left, rising, and ``left``: their counts, without one of ``top``.
    """
    low = _smallest(have, left, 3)
    if not low or low[0] > room:
        return ()
    best = have[bisect.bisect_right(have, room) - 1]
    if best == room or len(low) < 2 or low[0] + low[1] > room:
        return (best,)
    if len(low) == 3 and sum(low) <= room:
        return None  # three may fit: not settled by sets of this size
    pair, i, j = (0, 0, 0), 0, len(have) - 1
    while i <= j:
        a, b = have[j], have[i]
        if a + b > room or i == j and left[a] < 2:
            j -= 1
            continue
        pair = max(pair, (a + b, a, b))
        i += 1
    total, a, b = pair
    if best >= total:
        return (best,)
    between = _smallest([x for x in have if b < x <= best], left | {best: left[best] - 1}, 2)
    if a == best and (len(between) < 2 or sum(between) > room):
        return (a, b)
    return None


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Patterns fixed by dominance, and the counts that are left.

    A length that is not settled is asked again after others are fixed, until none is.
    """
    left, fixed, asked, before = {k: n for k, n in counts.items() if n}, [], set(), -1
    while True:
        if not (open_ := left.keys() - asked):
            if len(fixed) == before:
                return fixed, left
            asked, before = set(), len(fixed)
            continue
        top = max(open_)
        others = left | {top: left[top] - 1}
        chosen = _dominating(top, sorted(k for k, n in others.items() if n), others, capacity - top)
        if chosen is None:
            asked.add(top)  # it stays among the others' companions
            continue
        pattern = (top, *chosen)
        times = min(left[x] // pattern.count(x) for x in set(pattern))
        for x in pattern:
            left[x] -= times
        left = {k: n for k, n in left.items() if n}
        fixed.append((pattern, times))


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over counts: groups of like bins are filled and split at once."""
    rooms: dict[int, list[list]] = {}
    order: list[int] = []

    def put(pattern: tuple[int, ...], times: int) -> None:
        room = capacity - sum(pattern)
        if room not in rooms:
            rooms[room] = []
            bisect.insort(order, room)
        rooms[room].append([pattern, times])

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            k = bisect.bisect_left(order, size)
            if k == len(order):
                each = capacity // size
                if n // each:
                    put((size,) * each, n // each)
                if n % each:
                    put((size,) * (n % each), 1)
                break
            room = order[k]
            pattern, times = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                order.pop(k)
            fits = room // size
            if n >= fits * times:
                put(pattern + (size,) * fits, times)
                n -= fits * times
            else:
                full, more = divmod(n, fits)
                if full:
                    put(pattern + (size,) * fits, full)
                if more:
                    put(pattern + (size,) * more, 1)
                if times - full - bool(more):
                    put(pattern, times - full - bool(more))
                n = 0
    return [(tuple(p), t) for room in order for p, t in rooms[room]]


def pack_counts(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns (lengths in a sequence) with multiplicities that hold every piece once."""
    if any(not 0 < k <= capacity for k, n in counts.items() if n):
        raise ValueError(f"lengths are from 1 to {capacity}")
    fixed, rest = reduce_instance(counts, capacity)
    return fixed + best_fit(rest, capacity)


def _segments(patterns: list[Pattern]) -> dict[int, np.ndarray]:
    """By length: first number, first sequence and offset of each run of pieces."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for size in pattern:
            out.setdefault(size, []).append((used.get(size, 0), sequence, offset))
            used[size] = used.get(size, 0) + times
            offset += size
        sequence += times
    return {k: np.array(v, np.int64) for k, v in out.items()}


def cut_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of each text: id, piece, start, length, ids_crc32, part, slot and, if kept, ids."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, part int, slot long" + ", ids array<int>" * keep_ids
    return rows.mapInArrow(lambda b: _cut(b, path, capacity, end_id, keep_ids), schema)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    Each text's ids end with ``end_id``; only texts longer than ``capacity`` are cut, the
    first piece being the shorter one. Null texts are empty (one piece of the end id). Null
    ids and repeated rows are packed like any other; an empty table gives an empty result.
    The digest is taken from the ids as they are cut, so they need not be kept for it.
    """
    path = path or tokenizer_path()
    pieces = stage_table(cut_documents(docs, path, capacity, end_id, keep_ids, id_col, text_col), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    plan = _segments(pack_counts(totals, capacity))
    base = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    numbered = pieces.join(counts.select("part", "length", F.coalesce(base, F.lit(0)).alias("base")), ["part", "length"])
    columns = ["id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for size in np.unique(length):
                of, runs = length == size, plan[int(size)]
                run = runs[np.searchsorted(runs[:, 0], number[of], "right") - 1]
                sequence[of], offset[of] = run[:, 1] + number[of] - run[:, 0], run[:, 2]
            yield pa.record_batch([*(batch.column(c) for c in columns), pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    ready = numbered.select(*columns, (F.col("base") + F.col("slot")).alias("number"))
    schema = ", ".join(f"{c} {ready.schema[c].dataType.simpleString()}" for c in columns)
    return ready.mapInArrow(placed, f"{schema}, sequence_id long, offset long").withColumnRenamed("id", id_col)
