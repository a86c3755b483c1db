"""SentencePiece encoding and decoding with the n best segmentations.

A text is a lattice of pieces. Forward Viterbi gives the best score from the start to every
position; these are exact heuristics for an A* search that walks back from the end, so it
leaves no path of the n best out and expands few others. Of equally good paths the one nearest
to the start is walked on first, so ties don't multiply the paths that are open.

Pieces never cross from a word to the space after it, so the lattice falls apart at spaces.
For words under ``LONG`` characters the best segmentation and the cost of the second best come
from forward and backward Viterbi scores of many words at once, as arrays. Costs add up, so the
n best of a text differ from its best in the n - 1 words of the least such costs only: A* gives
the n best of those words (and of long ones), and a best-first search combines them.

``piece_bpe_32k.model`` is a BPE model: its scores are merge ranks (0, -1, -2 and so on), which
are used here as if they were log probabilities; any model with piece scores may be given.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._words import U

SPACE, MODEL, BEST = "▁", "piece_bpe_32k.model", 4
#: An unknown character scores this much below the least piece, as in SentencePiece.
UNKNOWN_PENALTY = 10.0
#: Words whose segmentations a Python worker keeps.
CACHE_WORDS = 400_000
#: Words of this many characters are searched one by one.
LONG = 28
#: A run of spaces and what follows, or what stands before the first space.
_CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Lattice:
    """Pieces and scores of a SentencePiece model, with byte fallback for other characters."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        self.pieces: dict[str, tuple[int, float]] = {}
        self.bytes: dict[int, int] = {}
        self.text: list[bytes] = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
                self.text.append(bytes([int(piece[1:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.text.append(b"")
            else:
                self.text.append(piece.replace(SPACE, " ").encode())
                self.pieces[piece] = i, float(sp.get_score(i))
        self.longest = max(map(len, self.pieces), default=1)
        self.heads = {p[:k] for p in self.pieces for k in range(1, len(p))}
        self.tails = {p[k:] for p in self.pieces for k in range(1, len(p))}
        self.unknown = sp.unk_id()
        self.unknown_score = min((s for _, s in self.pieces.values()), default=0.0) - UNKNOWN_PENALTY

    def _other(self, char: str) -> tuple[int, ...]:
        return tuple(self.bytes[b] for b in char.encode()) if self.bytes else (self.unknown,)

    def forward(self, chunk: str) -> list[float]:
        """Best score from the start to each position."""
        n, get, heads, longest = len(chunk), self.pieces.get, self.heads, self.longest
        best = [0.0] + [-np.inf] * n
        for i in range(n):
            base = best[i]
            for j in range(i + 1, min(n, i + longest) + 1):
                piece = chunk[i:j]
                found = get(piece)
                if found or j == i + 1:
                    score = base + (found[1] if found else self.unknown_score)
                    if score > best[j]:
                        best[j] = score
                if piece not in heads:
                    break  # no piece goes on like this
        return best

    def search(self, chunk: str, n: int) -> list[tuple[float, tuple[str, ...]]]:
        """The n best segmentations by backward A*; of equally good paths the nearest to the start goes on."""
        best, get, tails, longest = self.forward(chunk), self.pieces.get, self.tails, self.longest
        heap, count, out = [(-best[-1], len(chunk), 0, 0.0, None)], 0, []
        while heap and len(out) < n:
            cost, at, _, done, path = heapq.heappop(heap)
            if not at:
                pieces = []
                while path:
                    pieces.append(path[0])
                    path = path[1]
                out.append((-cost, tuple(pieces)))
                continue
            for start in range(at - 1, max(0, at - longest) - 1, -1):
                piece = chunk[start:at]
                found = get(piece)
                if found or start == at - 1:
                    score = done + (found[1] if found else self.unknown_score)
                    count += 1
                    heapq.heappush(heap, (-(best[start] + score), start, count, score, (piece, path)))
                if piece not in tails:
                    break  # no piece ends like this
        return out

    def ids(self, pieces: tuple[str, ...]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            found = self.pieces.get(p)
            out += [found[0]] if found else self._other(p)
        return out

    @cached_property
    def _table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(x) for x in self.text], np.int64)
        return np.frombuffer(b"".join(self.text), np.uint8), np.cumsum(sizes) - sizes, sizes

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces and fallback bytes, without the space put in front."""
        data, starts, sizes = self._table
        n = sizes[ids]
        ends = np.cumsum(n)
        out = data[np.repeat(starts[ids] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        return out.removeprefix(b" ").decode("utf-8", "replace")


class PieceTable:
    """Piece ids and scores by hash of their characters, looked up for whole arrays."""

    SLOTS = 1 << 19

    def __init__(self, lattice: Lattice) -> None:
        self.at = np.full(self.SLOTS + 64, -1, np.int32)
        self.score = np.array([s for _, s in lattice.pieces.values()])
        self.id = np.array([i for i, _ in lattice.pieces.values()], np.int64)
        self.keys = np.zeros(len(self.id) + 1, U)
        for k, piece in enumerate(lattice.pieces):
            h = np.zeros(1, U)
            for c in piece:
                h = self.longer(h, np.array([ord(c)], U))
            spot = int(h[0] >> U(45))
            while self.at[spot] >= 0:
                spot += 1
            self.keys[k], self.at[spot] = h[0], k

    @staticmethod
    def longer(h: np.ndarray, char: np.ndarray) -> np.ndarray:
        h = (h + char + U(1)) * U(0x9E3779B97F4A7C15)
        return h ^ (h >> U(29))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of the piece with each hash, or -1."""
        spot = (h >> U(45)).astype(np.int64)
        out = self.at[spot]
        wrong = np.flatnonzero((self.keys[out] != h) & (out >= 0))
        while len(wrong):  # look on where another piece sits
            spot[wrong] += 1
            out[wrong] = self.at[spot[wrong]]
            wrong = wrong[(self.keys[out[wrong]] != h[wrong]) & (out[wrong] >= 0)]
        return out


class Segmenter(dict):
    """By word without the space before it: ids of its best segmentation, its score and what the second best costs more."""

    def __init__(self, path: str, n: int, limit: int = CACHE_WORDS) -> None:
        super().__init__()
        self.lattice, self.n, self.limit, self.new = Lattice(path), n, limit, set()
        self.table = PieceTable(self.lattice)

    def __missing__(self, word: str) -> None:
        self.new.add(word)

    def one(self, word: str) -> tuple[bytes, float, float]:
        found = self.lattice.search(SPACE + word, 2)
        ids = np.array(self.lattice.ids(found[0][1]), "<u4").tobytes()
        return ids, found[0][0], found[0][0] - found[1][0] if len(found) > 1 else np.inf

    def learn(self) -> dict[str, tuple[bytes, float, float]]:
        """The new words' values; words of one length are solved together."""
        by_length: dict[int, list[str]] = {}
        for word in self.new:
            by_length.setdefault(len(word), []).append(word)
        out: dict[str, tuple[bytes, float, float]] = {}
        for n, group in by_length.items():
            if n >= LONG:
                out |= {w: self.one(w) for w in group}
            else:
                for k in range(0, len(group), 4096):
                    self._together(group[k : k + 4096], n + 1, out)
        self.new.clear()
        for word, value in out.items():
            if len(self) >= self.limit:
                break
            if len(word) < LONG:
                self[word] = value
        return out

    def _together(self, group: list[str], n: int, out: dict) -> None:
        """Forward and backward Viterbi for words of n characters (with the space), as arrays.

        The second best costs the least over pieces off the best path of (best through it).
        """
        chars = np.frombuffer("".join(SPACE + w for w in group).encode("utf-32-le"), "<u4").reshape(len(group), n).astype(U)
        edges: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        known = np.ones(len(group), bool)
        for i in range(n):
            h = np.zeros(len(group), U)
            for j in range(i + 1, min(n, i + self.lattice.longest) + 1):
                h = self.table.longer(h, chars[:, j - 1])
                k = self.table.find(h)
                if j > i + 1 and (k < 0).all():
                    continue
                score = np.where(k >= 0, self.table.score[k], self.lattice.unknown_score if j == i + 1 else -np.inf)
                ids = self.table.id[k]
                if j == i + 1 and (k < 0).any():
                    low = (k < 0) & (chars[:, i] < 128)
                    known &= (k >= 0) | low & bool(self.lattice.bytes)
                    ids = np.where(low, self.ascii[np.minimum(chars[:, i], U(127)).astype(np.int64)], ids)
                edges.append((i, j, score, ids))
        best, back = np.full((n + 1, len(group)), -np.inf), np.zeros((n + 1, len(group)), np.int64)
        best[0] = 0
        for i, j, score, _ in edges:
            better = best[i] + score > best[j]
            best[j][better], back[j][better] = (best[i] + score)[better], i
        after = np.full((n + 1, len(group)), -np.inf)
        after[n] = 0
        for i, j, score, _ in reversed(edges):
            np.maximum(after[i], score + after[j], out=after[i])
        on = np.zeros((n + 1, len(group)), bool)
        on[n] = True
        every = np.arange(len(group))
        for j in range(n, 0, -1):
            on[back[j][on[j]], every[on[j]]] = True
        second, ids = np.full(len(group), -np.inf), np.full((len(group), n), -1, np.int64)
        for i, j, score, piece in edges:
            used = on[j] & (back[j] == i)
            np.maximum(second, np.where(used, -np.inf, best[i] + score + after[j]), out=second)
            ids[used, j - 1] = piece[used]
        flat, ends = ids[ids >= 0].astype("<u4").tobytes(), np.cumsum((ids >= 0).sum(axis=1)).tolist()
        first = 0
        for word, ok, end, top, cost in zip(group, known.tolist(), ends, best[n].tolist(), (best[n] - second).tolist(), strict=True):
            out[word] = (flat[4 * first : 4 * end], top, cost) if ok else self.one(word)
            first = end

    @cached_property
    def ascii(self) -> np.ndarray:
        return np.array([self.lattice.bytes.get(b, self.lattice.unknown) for b in range(128)], np.int64)

    def segment(self, texts: list[str]) -> list[list[tuple[float, bytes]]]:
        """The n best (score, little-endian ids) of each text; an empty text has one, without ids."""
        parts = [_words_of(x) if x else [] for x in texts]
        found = [list(map(self.__getitem__, p)) for p in parts]
        new = self.learn() if self.new else {}
        return [self._joined(p, [new[w] if v is None else v for v, w in zip(f, p, strict=True)] if None in f else f) for p, f in zip(parts, found, strict=True)]

    def _joined(self, parts: list[str], found: list) -> list[tuple[float, bytes]]:
        if not parts:
            return [(0.0, b"")]
        ids, scores, costs = (list(x) for x in zip(*found, strict=True))
        top, n, costs = sum(scores), self.n, np.array(costs)
        if n < 2:
            return [(top, b"".join(ids))]
        limit = np.partition(costs, n - 2)[n - 2] if len(costs) >= n else costs.max()
        near = np.flatnonzero((costs <= limit) & (costs < np.inf))
        near = near[np.argsort(costs[near], kind="stable")[: n - 1]].tolist()
        choices = [(k, self.lattice.search(SPACE + parts[k], n)) for k in near]
        for k, options in choices:  # of equally good ones, the same that the search takes first
            ids[k] = self._ids(options[0][1])
        out, start = [(top, b"".join(ids))], (0,) * len(choices)
        heap, seen = [(0.0, start)], {start}
        while heap and len(out) < n:
            cost, picked = heapq.heappop(heap)
            if picked != start:
                other = ids.copy()
                for (k, options), r in zip(choices, picked, strict=True):
                    if r:
                        other[k] = self._ids(options[r][1])
                out.append((top - cost, b"".join(other)))
            for i, (_, options) in enumerate(choices):
                r = picked[i] + 1
                step = (*picked[:i], r, *picked[i + 1 :])
                if r < len(options) and step not in seen:
                    seen.add(step)
                    heapq.heappush(heap, (cost + options[r - 1][0] - options[r][0], step))
        return out

    def _ids(self, pieces: tuple[str, ...]) -> bytes:
        return np.array(self.lattice.ids(pieces), "<u4").tobytes()


def _words_of(text: str) -> list[str]:
    """What follows each space that follows no space; more spaces stay with the word."""
    if "  " not in text and SPACE not in text and not text.startswith(" ") and not text.endswith(" "):
        return text.split(" ")
    return [c[1:] for c in _CHUNK(SPACE + text.replace(" ", SPACE))]


_segmenters: dict[tuple[str, int], Segmenter] = {}


def _segmenter(path: str, n: int) -> Segmenter:
    if (path, n) not in _segmenters:
        _segmenters[path, n] = Segmenter(path, n)
    return _segmenters[path, n]


def encode_nbest(docs: DataFrame, path: str | None = None, n: int = BEST, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, segmentations (array of rank, score, n_ids, ids_crc32 and, if kept, ids), decoded_equal.

    Scores are sums of piece scores, best first; a text with fewer segmentations has fewer.
    decoded_equal: decoding the best ids gives the whole text back. Null and empty texts
    have one segmentation without ids. Null ids and repeated rows get rows like others.
    """
    path = path or model_path()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    fields = [("rank", pa.int32()), ("score", pa.float64()), ("n_ids", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.list_(pa.int32()))] if keep_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = _segmenter(path, n)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part, sizes, equal, flat = batch.slice(at, 1024), [], [], []
                texts = [x or "" for x in part.column(1).to_pylist()]
                for text, found in zip(texts, seg.segment(texts), strict=True):
                    sizes.append(len(found))
                    equal.append(seg.lattice.decode(np.frombuffer(found[0][1], "<u4")) == text)
                    flat += [(r, s, len(x) // 4, zlib.crc32(x), x) for r, (s, x) in enumerate(found)]
                columns = [pa.array([x[k] for x in flat], kind) for k, (_, kind) in enumerate(fields[:4])]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(x[2] for x in flat)]), pa.int32()), pa.array(np.frombuffer(b"".join(x[4] for x in flat), "<i4"))))
                structs = pa.StructArray.from_arrays(columns, [f for f, _ in fields])
                yield pa.record_batch({"id": part.column(0), "segmentations": pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), structs), "decoded_equal": pa.array(equal, pa.bool_())})

    inner = "rank:int,score:double,n_ids:bigint,ids_crc32:bigint" + ",ids:array<int>" * keep_ids
    return rows.mapInArrow(run, f"id {kind}, segmentations array<struct<{inner}>>, decoded_equal boolean").withColumnRenamed("id", id_col)


def decode_ids(rows: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and text of arrays of ids; null arrays give null texts."""
    path = path or model_path()
    picked = rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    kind = picked.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _segmenter(path, 1).lattice
        for batch in batches:
            yield pa.record_batch({"id": batch.column(0), "text": pa.array([None if x is None else lattice.decode(np.array(x, np.int64)) for x in batch.column(1).to_pylist()], pa.string())})

    return picked.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
