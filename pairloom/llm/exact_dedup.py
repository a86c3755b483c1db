"""Exact dedup by skew-safe combining (native: DataFrame functions only).

Texts are equal when they are identical after each run of ASCII white space is replaced
by one space. Grouping keys hold the digest *and* the whole normalised text, at every
stage, so a digest collision never merges different texts:

1. local: Spark's map-side partial aggregate keeps one row per (digest, salt, text);
2. salted: groups of one digest are spread over ``SALTS`` reducers by a hash of the id, rows without
   an id by their place in the scan;
3. global: at most ``SALTS`` winners per text meet and give keep_id and group_size.

Only (digest, salt, keep_id, group_size) is then joined to the documents, by the salts of the
way in. Digests that hold two different texts are looked for first; they join by digest and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._stage import fresh_name, release, stage_table
from .salted import ALL_SALTS, back_to_rows, salt_of


def normalised(text: Column) -> Column:
    """Null counts as empty; each run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _found(docs: DataFrame, id_col: str, text_col: str, digest) -> DataFrame:
    """One narrow row per input row, written: id, sha, keep_id, group_size, tie (a row number)."""
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm")).withColumn("digest", digest(F.col("norm"))).withColumn("salt", salt_of("id"))
    local = rows.groupBy("digest", "salt", "norm").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n"), F.bool_or(F.col("id").isNull()).alias("nameless"))
    salts = F.bit_or(F.when(F.col("nameless"), F.lit(ALL_SALTS)).otherwise(F.expr("shiftleft(1L, salt)"))).alias("salts")
    groups = local.groupBy("digest", "norm").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"), salts)
    table = stage_table(groups.select("digest", "keep_id", "group_size", "salts"), "groups")
    clashes = table.groupBy("digest").count().filter("count > 1").select("digest")
    narrow = rows.select("id", "digest", "salt", sha256(F.col("norm")).alias("sha"), F.monotonically_increasing_id().alias("tie"))
    columns = ["id", "sha", "keep_id", "group_size", "tie"]
    if clashes.isEmpty():
        found = stage_table(narrow.join(back_to_rows(table), ["digest", "salt"]).select(columns), "found")
        release(table)
        return found
    plain = narrow.join(back_to_rows(table.join(clashes, "digest", "left_anti")), ["digest", "salt"]).select(columns)
    mixed = rows.join(clashes, "digest", "left_semi").withColumn("sha", sha256(F.col("norm"))).withColumn("tie", F.monotonically_increasing_id())
    exact = mixed.groupBy("digest", "norm").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return stage_table(plain.unionByName(mixed.join(exact, ["digest", "norm"]).select(columns)), "found")


def _repeated(found: DataFrame) -> DataFrame:
    """(sha, id, first) of the ids that stay and stand in several rows of their text."""
    stays = found.filter(F.col("id").eqNullSafe(F.col("keep_id")))
    return stays.groupBy("sha", "id").agg(F.min("tie").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("sha", "id", "first")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Nulls: a null text is an empty one; null ids are counted, and lose to any id, so
    keep_id is null only where all ids of a group are. Ties: of rows that repeat the smallest
    id one is marked as kept. An id may stand with several texts; each is a group of its own.
    Other columns of ``docs`` are not read. An empty table gives an empty result. ``digest``
    maps the normalised text to a grouping digest.
    """
    found = _found(docs, id_col, text_col, digest)
    kept = F.col("id").eqNullSafe(F.col("keep_id"))
    again = _repeated(found)
    if not again.isEmpty():
        again = again.select(F.col("sha").alias("s"), F.col("id").alias("i"), "first")
        found = found.join(again, (F.col("sha") == F.col("s")) & F.col("id").eqNullSafe(F.col("i")), "left")
        kept = kept & (F.col("first").isNull() | (F.col("tie") == F.col("first")))
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept: the smallest id's.

    Rows with a null id stay only where no copy has an id, and of rows that repeat id and text
    any one stays. Columns of ``docs`` may have any names.
    """
    found = _found(docs, id_col, text_col, sha256)
    sha, s, i = (fresh_name(docs.columns, x) for x in ("sha", "sha_gone", "id_gone"))
    same = (F.col(sha) == F.col(s)) & F.col(f"`{id_col}`").eqNullSafe(F.col(i))
    named = lambda pairs: pairs.select(F.col("sha").alias(s), F.col("id").alias(i))
    gone = found.filter(~F.col("id").eqNullSafe(F.col("keep_id"))).select("sha", "id").distinct()
    out = docs.withColumn(sha, sha256(normalised(F.col(f"`{text_col}`")))).join(named(gone), same, "left_anti")
    again = stage_table(_repeated(found), "again")
    if not again.isEmpty():
        one = out.join(named(again), same, "left_semi").dropDuplicates([sha, id_col])
        out = out.join(named(again), same, "left_anti").unionByName(one)
    return out.select([f"`{c}`" for c in docs.columns])
