"""Delimited records whose quoted fields may hold line breaks, read by all splits of a file at once.

Whether a line begins inside a quoted field depends on the lines before it, in splits that other tasks
read. Each task tells both cases of its split: what its lines are if it begins outside a quoted field, and if
it begins inside. A running composition of the splits (a row each) then says which case holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CASES = ("outside", "inside")


def ends_inside(line: str, inside: bool, sep: str = "\t", quote: str = '"') -> bool:
    """Whether a quoted field is open at the end of ``line``, which begins in one if ``inside``.

    A quote opens a field only at its start; two in a row within stand for one.
    """
    at = 0
    while True:
        if not inside and line.startswith(quote, at):
            at, inside = at + 1, True
        while inside:
            at = line.find(quote, at)
            if at < 0:
                return True
            inside = line.startswith(quote, at + 1)
            at += 2 if inside else 1
        at = line.find(sep, at) + 1
        if not at:
            return False


def _cases(sep: str):
    """Of each line, in both cases of its split: inside before it, inside behind it, records begun so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, at, state, begun = None, 0, [False, True], [0, 0]
        for batch in batches:
            out: list[tuple] = []
            for file, block, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, block) != split:
                    split, at, state, begun = (file, block), 0, [False, True], [0, 0]
                before = list(state)
                if '"' in line:
                    state = [ends_inside(line, s, sep) for s in state]
                begun = [n + (not s) for n, s in zip(begun, before, strict=True)]
                out.append((file, block, at, line, *before, *state, *begun))
                at += 1
            names = ["file", "block", "at", "line", *(f"{n}_{c}" for n in ("before", "behind", "begun") for c in CASES)]
            if out:
                yield pa.record_batch([pa.array(c) for c in zip(*out, strict=True)], names)

    return run


def _composed(splits: DataFrame) -> DataFrame:
    """(file, block, first, before): which case holds of each split, and the records begun in the file before it."""
    seen = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    gathered = splits.withColumn("__ahead", F.collect_list(F.struct(*(F.col(f"{n}_{c}").alias(f"{n}_{c}") for n in ("behind", "begun") for c in CASES))).over(seen))
    step = lambda got, s: F.struct(F.when(got["inside"], s["behind_inside"]).otherwise(s["behind_outside"]).alias("inside"), (got["n"] + F.when(got["inside"], s["begun_inside"]).otherwise(s["begun_outside"])).alias("n"))
    return gathered.select("file", "block", F.aggregate("__ahead", F.struct(F.lit(False).alias("inside"), F.lit(0).cast("long").alias("n")), step).alias("case"))


def records(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """(record): the texts of all records of the files at ``path``, line breaks within quoted fields kept.

    Records end at ``\\n`` or ``\\r\\n``; blank ones are passed over. Only lines of records with line breaks are
    shuffled, and a record is one row. A quote that is never closed makes the rest of its file one record.
    """
    lines = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    flags = ", ".join(f"{n}_{c} {kind}" for n, kind in (("before", "boolean"), ("behind", "boolean"), ("begun", "long")) for c in CASES)
    told = lines.mapInArrow(_cases(sep), f"file string, block long, at long, line string, {flags}")
    last = [F.max_by(f"{n}_{c}", "at").alias(f"{n}_{c}") for n in ("behind", "begun") for c in CASES]
    case = _composed(told.groupBy("file", "block").agg(*last))
    told = told.join(F.broadcast(case), ["file", "block"])  # a row a split

    def of(name: str) -> Column:
        return F.when(F.col("case.inside"), F.col(f"{name}_inside")).otherwise(F.col(f"{name}_outside"))

    told = told.select("file", "block", "at", "line", of("before").alias("goes_on"), of("behind").alias("open"), (F.col("case.n") + of("begun")).alias("number"))
    single = told.filter(~F.col("goes_on") & ~F.col("open")).select(F.col("line").alias("record"))
    parts = F.array_sort(F.collect_list(F.struct("block", "at", "line")))
    several = told.filter("goes_on or open").groupBy("file", "number").agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("record"))
    every = single.unionByName(several.select("record"))
    return every.select(F.regexp_replace("record", "\r$", "").alias("record")).filter(F.trim("record") != "")
