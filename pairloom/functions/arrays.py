"""Array folds whose work is near linear in the array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that are folded into one list before the lists are put together.
CHUNK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once: a transform over a one-element array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(items: Column, state: str, out: str, start: Column, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """A struct of the last ``state`` and, for each item, what ``step(state, item)`` said of it.

    ``state`` and ``out`` are the SQL types of both. Appending copies a list, so what is said is
    gathered by ``CHUNK`` items, and the chunks' lists are put together at the end.
    """
    chunks = F.sequence(F.lit(0), F.greatest(F.floor((F.size(items) - 1) / CHUNK).cast("int"), F.lit(0)))
    chunks = F.transform(chunks, lambda c: F.slice(items, c * CHUNK + 1, CHUNK))
    nothing, no_chunk = F.array().cast(f"array<{out}>"), F.array().cast(f"array<array<{out}>>")

    def within(acc: Column, x: Column) -> Column:
        after, said = step(acc["state"], x)
        return F.struct(after.cast(state).alias("state"), F.concat(acc["said"], F.array(said.cast(out))).alias("said"))

    def over(acc: Column, chunk: Column) -> Column:
        whole = F.aggregate(chunk, F.struct(acc["state"].alias("state"), nothing.alias("said")), within)
        return let(whole, lambda w: F.struct(w["state"].alias("state"), F.concat(acc["said"], F.array(w["said"])).alias("said")))

    begun = F.struct(start.cast(state).alias("state"), no_chunk.alias("said"))
    return F.aggregate(chunks, begun, over, lambda acc: F.struct(acc["state"].alias("state"), F.flatten(acc["said"]).alias("said")))
