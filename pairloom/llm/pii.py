"""PII: format-preserving Feistel pseudonyms for validated values.

A value is found by pattern, validated (Luhn, mod 97, octet ranges, calendar), permuted by a
keyed Feistel network within the domain of its format, and written back in the same layout. It
is a permutation: equal values stay equal and different ones different across all documents,
lengths and separators stay, and check digits hold. Who has the key can undo it.

Strings of symbols (cards, phones, secrets) are halved, and each round adds to every symbol of
one half a keyed stream made from the whole other half, so the work is linear in the length and
any change reaches all of the value. Small numbers (octets, days) are permuted within their
range by cycle walking. A date has one pseudonym in all its layouts; see :meth:`Pseudonyms.date`.
"""

from __future__ import annotations

import datetime
import ipaddress
import re
from collections.abc import Iterator
from hashlib import blake2b, shake_256
from math import isqrt, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROUNDS = 10
#: Dates are permuted among the days from FIRST_DAY to LAST_DAY.
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)


class Feistel:
    """Keyed permutations: of range(n) for any n, and of strings of symbols."""

    def __init__(self, key: bytes, kind: str) -> None:
        self.key = blake2b(key, digest_size=32).digest() + kind.encode()[:16].ljust(16, b"\0")

    def _stream(self, step: int, shape: bytes, half: bytes, size: int) -> bytes:
        """``size`` bytes that depend on the key, the round, the domain and all of ``half``."""
        head = b"%d,%d,%d:" % (step, len(shape), len(half))
        return shake_256(self.key + head + shape + half).digest(size)

    def _f(self, step: int, n: int, x: int, size: int) -> int:
        data = self._stream(step, b"%d" % n, x.to_bytes((x.bit_length() + 7) // 8), size.bit_length() // 8 + 17)
        return int.from_bytes(data) % size

    def _walk(self, x: int, n: int, back: bool) -> int:
        a = isqrt(n - 1) + 1
        b = -(-n // a)
        while True:
            left, right = divmod(x, b)
            for step in reversed(range(ROUNDS)) if back else range(ROUNDS):
                if step % 2:
                    right = (right + (-1 if back else 1) * self._f(step, n, left, b)) % b
                else:
                    left = (left + (-1 if back else 1) * self._f(step, n, right, a)) % a
            x = left * b + right
            if x < n:
                return x

    def apply(self, x: int, n: int, back: bool = False) -> int:
        """The image of ``x`` in range(n); ``n`` is a small number (its digits are written out)."""
        return x if n < 2 else self._walk(x, n, back)

    def apply_symbols(self, values: list[int], sizes: list[int], back: bool = False) -> list[int]:
        """The image of a string of symbols, each ``values[i]`` in range(``sizes[i]``)."""
        if len(values) < 2:
            return [self.apply(x, n, back) for x, n in zip(values, sizes, strict=True)]
        middle = len(values) // 2
        shape = np.array(sizes, np.uint8)
        halves = [np.array(values[:middle], np.int64), np.array(values[middle:], np.int64)]
        limits = [shape[:middle].astype(np.int64), shape[middle:].astype(np.int64)]
        for step in reversed(range(ROUNDS)) if back else range(ROUNDS):
            this = step % 2
            other = halves[1 - this].astype(np.uint8).tobytes()
            more = np.frombuffer(self._stream(step, shape.tobytes(), other, 4 * len(halves[this])), "<u4")
            halves[this] = (halves[this] + (-1 if back else 1) * more.astype(np.int64)) % limits[this]
        return halves[0].tolist() + halves[1].tolist()


def _mixed(values: list[int], sizes: list[int]) -> int:
    x = 0
    for v, n in zip(values, sizes, strict=True):
        x = x * n + v
    return x


def _unmixed(x: int, sizes: list[int]) -> list[int]:
    out = []
    for n in reversed(sizes):
        x, v = divmod(x, n)
        out.append(v)
    return out[::-1]


def luhn(digits: str) -> bool:
    total = sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(digits)))
    return total % 10 == 0


def _luhn_end(body: str) -> str:
    return next(d for d in "0123456789" if luhn(body + d))


def _iban_number(bban: str, country: str, check: str) -> int:
    return int("".join(str(int(c, 36)) for c in bban + country + check))


def _relaid(layout: str, symbols: str) -> str:
    """``layout`` with its letters and digits replaced, one after the other."""
    it = iter(symbols)
    return "".join(next(it) if c.isalnum() else c for c in layout)


#: Alphabets that characters are permuted within (fixed values).
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HEX = "0123456789abcdef"
#: Small letters beyond ASCII that have one capital each (fixed values).
ACCENTED = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ"


def _written(value: str) -> str:
    """How a secret is written: decimal digits alone, hexadecimal ones, or others."""
    return "digits" if re.fullmatch("[0-9]+", value) else "hex" if re.fullmatch("[0-9a-f]+", value) else "secret"


def _number(day: datetime.date) -> int:
    """The number of a day among the days after the 12th of their month, or among the others."""
    months = 12 * (day.year - FIRST_DAY.year) + day.month - 1
    if day.day <= 12:
        return 12 * months + day.day - 1
    return (day.replace(day=1) - FIRST_DAY).days - 12 * months + day.day - 13


def _day(number: int, late: bool) -> datetime.date:
    """The day of a number of :func:`_number`."""
    if not late:
        months, rest = divmod(number, 12)
        return datetime.date(FIRST_DAY.year + months // 12, months % 12 + 1, rest + 1)
    months = number // 19  # 16 to 19 days a month: too early by a few years at most
    while True:
        first = datetime.date(FIRST_DAY.year + months // 12, months % 12 + 1, 13)
        rest = number - _number(first)
        if rest < 16 or rest < 19 and (first + datetime.timedelta(rest)).month == first.month:
            return first + datetime.timedelta(rest)
        months += max(1, rest // 19)


class Pseudonyms:
    """Pseudonyms of each kind under one key; ``back`` undoes them."""

    def __init__(self, key: bytes, back: bool = False) -> None:
        self.key, self.back = key, back
        self.networks: dict[str, Feistel] = {}

    def _permute(self, kind: str, values: list[int], sizes: list[int]) -> list[int]:
        network = self.networks.setdefault(kind, Feistel(self.key, kind))
        return _unmixed(network.apply(_mixed(values, sizes), prod(sizes), self.back), sizes)

    def _symbols(self, kind: str, text: str, alphabets: list[str]) -> str:
        network = self.networks.setdefault(kind, Feistel(self.key, kind))
        got = network.apply_symbols([a.index(c) for a, c in zip(alphabets, text, strict=True)], list(map(len, alphabets)), self.back)
        return "".join(a[v] for a, v in zip(alphabets, got, strict=True))

    def email(self, x: str) -> str | None:
        low = x.lower()
        head, dot, top = low.rpartition(".")
        if len(low) != len(x):
            return None
        alphabets = {c: next((a for a in (DIGITS, LOWER, ACCENTED) if c in a), None) for c in set(head)}
        plain = [c for c in head if alphabets[c]]
        got = iter(self._symbols("email", "".join(plain), [alphabets[c] for c in plain]))
        new = "".join(next(got) if alphabets[c] else c for c in head) + dot + top
        return "".join(n.upper() if c.isupper() else n for n, c in zip(new, x, strict=True))

    def card(self, x: str) -> str | None:
        digits = re.sub(r"[^0-9]", "", x)
        if not 13 <= len(digits) <= 19 or not luhn(digits) or len(set(digits)) == 1:
            return None
        body = self._symbols("card", digits[:-1], [DIGITS] * (len(digits) - 1))
        return _relaid(x, body + _luhn_end(body))

    def iban(self, x: str) -> str | None:
        flat = re.sub(r"\W", "", x).upper()
        if not 15 <= len(flat) <= 34 or _iban_number(flat[4:], flat[:2], flat[2:4]) % 97 != 1:
            return None
        bban = self._symbols("iban", flat[4:], [DIGITS if c in DIGITS else UPPER for c in flat[4:]])
        return _relaid(x, f"{flat[:2]}{98 - _iban_number(bban, flat[:2], '00') % 97:02d}{bban}")

    def ipv4(self, x: str) -> str | None:
        octets = x.split(".")
        if any(int(o) > 255 or o != str(int(o)) for o in octets):
            return None
        low, size = {1: 0, 2: 10, 3: 100}, {1: 10, 2: 90, 3: 156}
        got = self._permute("ipv4", [int(o) - low[len(o)] for o in octets], [size[len(o)] for o in octets])
        return ".".join(str(v + low[len(o)]) for v, o in zip(got, octets, strict=True))

    def ipv6(self, x: str) -> str | None:
        """The hexadecimal digits of an address as it is spelled: each group keeps its length."""
        try:
            ipaddress.IPv6Address(x)
        except ValueError:
            return None
        groups = [g for g in x.split(":") if g]
        if len(groups) < 3:  # ::1 is nobody's, and a::b may be code
            return None
        got = iter(self._symbols("ipv6", "".join(groups).lower(), [HEX] * sum(map(len, groups))))
        new = "".join(c if c == ":" else next(got) for c in x)
        return new.upper() if x.upper() == x else new

    def phone(self, x: str) -> str | None:
        digits = re.sub(r"[^0-9]", "", x)
        if not 8 <= len(digits) <= 15:
            return None
        keep = 1 if digits[0] == "1" and len(digits) == 11 else 2 if x.startswith("+") else 0
        body = digits[keep:]
        north = keep == 1 or keep == 0 and len(body) == 10
        if north and (body[0] in "01" or body[3] in "01"):
            return None
        alphabets = [DIGITS[2:] if north and k in (0, 3) else DIGITS for k in range(len(body))]
        return _relaid(x, digits[:keep] + self._symbols("phone", body, alphabets))

    def ssn(self, x: str) -> str | None:
        area, group, serial = map(int, x.split("-"))
        if not 0 < area < 900 or area == 666 or not group or not serial:
            return None
        got = self._permute("ssn", [area - 1 - (area > 666), group - 1, serial - 1], [898, 99, 9999])
        return f"{got[0] + 1 + (got[0] >= 665):03d}-{got[1] + 1:02d}-{got[2] + 1:04d}"

    def date(self, x: str) -> str | None:
        """Year first; else day first, or month first where only that is a date.

        Days after the 12th of a month are permuted among themselves, and the others too. So a
        date's pseudonym is the same day in every layout, and a month-first pseudonym is read as
        month first again. 03/04/1987 may mean two days; it is always read day first. A day or month written
        without a leading zero gets none, so undoing may bring back 03 for 3.
        """
        a, mark, b, _, c = re.fullmatch(r"([0-9]+)([-/.])([0-9]+)([-/.])([0-9]+)", x).groups()
        order, text = ((0, 1, 2) if len(a) == 4 else (2, 1, 0) if int(b) <= 12 else (2, 0, 1)), (a, b, c)
        try:
            day = datetime.date(*(int(text[k]) for k in order))
        except ValueError:
            return None
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        [at] = self._permute("late" if day.day > 12 else "early", [_number(day)], [_number(LAST_DAY if day.day > 12 else LAST_DAY.replace(day=12)) + 1])
        new = _day(at, day.day > 12)
        out = ["", "", ""]
        for k, v in zip(order, (new.year, new.month, new.day), strict=True):
            out[k] = f"{v:0{len(text[k])}d}"
        return mark.join(out)

    def access(self, x: str) -> str | None:
        return x[:4] + self._symbols("access", x[4:], [DIGITS if c in DIGITS else UPPER for c in x[4:]])

    def secret(self, x: str) -> str | None:
        name = re.match(r"\w+\s*[=:]\s*[\"']?", x)[0]
        value = x[len(name) :]
        kind = _written(value)
        alphabets = [{"digits": DIGITS, "hex": HEX}.get(kind) or next((a for a in (DIGITS, LOWER, UPPER) if c in a), c) for c in value]
        while _written(value := self._symbols(kind, value, alphabets)) != kind:
            pass  # walk on to a value that is written in the same way
        return name + value


#: Kinds and their patterns; earlier kinds win.
KINDS = (
    ("email", r"(?<![\w.%+-])[\w.%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])"),
    ("secret", r"(?<!\w)(?i:token|password|passwd|secret|api_key|apikey)\s*[=:]\s*[\"']?(?:[A-Za-z0-9+/_\-]{8,}|(?=[A-Za-z+/_\-]*[0-9])[A-Za-z0-9+/_\-]{4,7})"),
    ("access", r"(?<!\w)(?:AKIA|ASIA)[A-Z0-9]{16}(?!\w)"),
    ("iban", r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    ("date", r"(?<![\d./-])(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}-[0-9]{1,2}-[0-9]{4})(?![\d/-]|\.\d)"),
    ("ssn", r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    ("ipv4", r"(?<![\d.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?\d)"),
    ("ipv6", r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,8}[0-9A-Fa-f]{0,4}(?![\w:])"),
    ("card", r"(?<![\w-])[0-9](?:[ -]?[0-9]){12,18}(?!\w|-\w)"),
    ("phone", r"(?<!\w)(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?!\w)"),
)
_FOUND = re.compile("|".join(f"(?P<{k}>{p})" for k, p in KINDS))
#: Every kind holds a digit or an @, but a spelled-out secret; texts without any are passed.
_MAYBE = re.compile(r"[0-9@]|::|(?i:password|passwd|secret|token|api_?key)").search


def pseudonymise(text: str, make: Pseudonyms) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with its values replaced, and (kind, start, length) of each in the new text."""
    if not text or not _MAYBE(text):
        return text, []
    out, spans, at, size = [], [], 0, 0
    pos = 0
    while m := _FOUND.search(text, pos):
        new = getattr(make, m.lastgroup)(m[0])
        pos = m.end()
        if new is None:
            new = _retried(m, make)
            if new is None:
                pos = _next(text, m)
                continue
        out += [text[at : m.start()], new]
        size += m.start() - at
        spans.append((m.lastgroup, size, len(new)))
        size += len(new)
        at = m.end()
    return "".join(out) + text[at:], spans


def _retried(m: re.Match, make: Pseudonyms) -> str | None:
    """A run of digits that is no card may still be a phone number, and the like."""
    for kind, pattern in KINDS:
        if kind != m.lastgroup and re.fullmatch(pattern, m[0]) and (new := getattr(make, kind)(m[0])) is not None:
            return new
    return None


def _next(text: str, m: re.Match) -> int:
    """Where to look on after a match that isn't valid: behind its first run of letters or digits."""
    k = m.start()
    while k < m.end() and text[k].isalnum():
        k += 1
    return max(k, m.start() + 1)


def pseudonymise_documents(docs: DataFrame, key: str, text_col: str = "text", spans_col: str | None = "pii_spans") -> DataFrame:
    """``docs`` with the text pseudonymised, all columns kept, and an array of spans added.

    Spans: (kind, start, length) in code points of the new text. A null text stays null with
    no spans; empty texts, repeated rows and rows with null ids are treated like others. The
    spans column must not be there yet.
    """
    if spans_col in docs.columns:
        raise ValueError(f"{spans_col} is a column already")
    secret, at = key.encode(), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Pseudonyms(secret)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32())]))
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                done = [pseudonymise(x, make) for x in part.column(at).to_pylist()]
                columns = part.columns
                columns[at] = pa.array([x for x, _ in done], pa.string())
                if spans_col:
                    columns.append(pa.array([[{"kind": k, "start": s, "length": n} for k, s, n in y] for _, y in done], kind))
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, *([spans_col] if spans_col else [])])

    fields = docs.select(*(F.col(f"`{c}`") for c in docs.columns)).schema
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType())])
    schema = fields.add(spans_col, T.ArrayType(span)) if spans_col else fields
    return docs.mapInArrow(run, schema)
