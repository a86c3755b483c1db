"""Line dedup: lines that stand in several documents stay only in the first of them.

1. Explode: each text is split at ``\\n``; a line's key is the line without ASCII white space at
   both ends, A-Z lower-cased. Keys of at least ``min_chars`` code points become 128-bit digests.
2. Count: one row a document and distinct digest, added up by digest before and after the shuffle.
3. Drop: the lines meet the digests over threshold by digest and salt, so a line that a third of
   all documents hold is dealt over many tasks on its way in and back.
4. Reassemble: a document's dropped positions cut its array of lines into runs that stay, and the
   runs are joined in order. Only digests and positions are shuffled before this last join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._stage import fresh_name
from .salted import SALTS, back_to_rows

#: Stripped at both ends of a line (fixed values: space, and \t to \r).
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    """The lines of a text, parted at each ``\\n``; an empty text is one empty line."""
    return F.split(text, "\n", -1)


def line_keys(text: Column) -> Column:
    """The keys of a text's lines, in order."""
    return F.transform(lines_of(F.translate(text, UPPER, LOWER)), lambda x: F.btrim(x, F.lit(BLANK)))


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text")).withColumn("whole", F.unhex(F.md5("text")))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 2, min_chars: int = 10) -> DataFrame:
    """(id, whole, dropped): the positions, from 0 and ascending, of the lines that each document loses.

    ``whole`` is the digest of the document's text; rows that repeat id and text are one row here.
    """
    salt = F.pmod(F.xxhash64("id", "whole"), F.lit(SALTS)).cast("int")
    marks = F.transform(line_keys(F.col("text")), lambda k: F.when(F.length(k) >= min_chars, F.md5(k)))
    rows = _named(docs, id_col, text_col).select("id", "whole", salt.alias("salt"), marks.alias("marks"))
    once = rows.select("id", "salt", F.explode(F.array_distinct(F.filter("marks", lambda m: m.isNotNull()))).alias("mark")).withColumn("mark", F.unhex("mark"))
    found = once.groupBy("mark").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts"))
    hits = back_to_rows(found.filter(F.col("n") >= min_docs).select("mark", "low", "salts"))
    lines = rows.select("id", "whole", "salt", F.posexplode("marks").alias("at", "mark")).filter("mark is not null").withColumn("mark", F.unhex("mark"))
    lost = lines.join(hits, ["mark", "salt"]).filter(~F.col("id").eqNullSafe(F.col("low")))
    return lost.groupBy("id", "whole").agg(F.sort_array(F.collect_set("at")).alias("dropped"))


def _without(lines: Column, dropped: Column) -> Column:
    """``lines`` joined without those at the ascending positions ``dropped``: the runs between two of them."""
    ends = F.concat(F.array(F.lit(-1)), dropped, F.array(F.size(lines)))
    # a one-element array binds both to a lambda variable, so that they are made once a row
    runs = F.transform(F.array(F.struct(lines.alias("l"), ends.alias("e"))), lambda s: F.flatten(F.transform(F.sequence(F.lit(0), F.size(s["e"]) - 2), lambda k: F.slice(s["l"], F.get(s["e"], k) + 2, F.get(s["e"], k + 1) - F.get(s["e"], k) - 1))))
    return F.array_join(F.get(runs, F.lit(0)), "\n")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 2, min_chars: int = 10, n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """``docs`` with the lines of their texts that repeat dropped, and two counts added.

    A key of at least ``min_chars`` code points that stands in ``min_docs`` or more documents loses all
    its lines, except those of the document with the smallest id that holds it: these stay, as often
    as they stand there. Shorter keys stay everywhere. The lines that stay are joined by ``\\n``.

    A null text is an empty one: one empty line, an empty result. A null id is larger than any
    other, so keys that only rows without an id hold stay in all of them. A document is a row: rows that repeat an
    id count as documents of their own, and keep or lose a key together. Text columns of other
    types are read as strings. All columns stay; a count's name that is taken gets a ``_`` more.
    An empty table gives an empty result.
    """
    n_lines = fresh_name(docs.columns, n_lines)
    n_dropped = fresh_name([*docs.columns, n_lines], n_dropped)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("i"), text.alias("text")).withColumn("w", F.unhex(F.md5("text")))
    lost = repeated_lines(docs, id_col, text_col, min_docs, min_chars)
    met = rows.join(lost, F.col("i").eqNullSafe(F.col("id")) & (F.col("w") == F.col("whole")), "left")
    lines = lines_of(F.col("text"))
    kept = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(_without(lines, F.col("dropped")))
    out = [kept.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]
    return met.select(*out, F.size(lines).cast("long").alias(n_lines), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias(n_dropped))
