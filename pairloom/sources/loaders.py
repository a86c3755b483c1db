"""Sources: flat Parquet, JSON lines, TSV judgements, corpus shards and synthetic records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom import schema
from pairloom.functions.text import passage_text
from pairloom.operators import streams
from pairloom.operators.pools import capped_candidates, shuffle_key

from .records import records


def in_file_order() -> Column:
    """A sort key of rows read from files: file, split, and place in the split.

    A split's rows are read by one task, one after the other, so the running id orders them.
    """
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))


def read_flat(spark: SparkSession, path: str, cap: int | None = None, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """Queries and candidates of flat Parquet rows, in file order; the last question and answers of a query win."""
    rows = spark.read.schema(schema.FLAT).parquet(path)
    return flat_queries(rows.select("*", in_file_order().alias("ordinal")), cap, exact)


def flat_queries(rows: DataFrame, cap: int | None = None, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """``rows``: FLAT and ordinal. Queries without a relevant passage are dropped."""
    queries = rows.groupBy(F.col("q_id").alias("query_id")).agg(F.max_by("question", "ordinal").alias("question"), F.max_by("answers", "ordinal").alias("answers"), F.min("ordinal").alias("first"), F.sum("label").alias("relevant")).filter("relevant > 0").drop("relevant")
    candidates = rows.select(F.col("q_id").alias("query_id"), F.col("passage_row_id").alias("doc_id"), "ordinal", "title", "text", "label")
    return queries, capped_candidates(candidates, cap, exact)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(at, line): the non-blank lines of text files, numbered from 0 in file order.

    Lines are numbered within the splits that tasks read, and raised by the splits before; no
    file is read as one row.
    """
    lines = spark.read.text(path).select(F.col("value").alias("line"), in_file_order().alias("k")).filter(F.trim("line") != "")
    split = Window.partitionBy("k.file", "k.block").orderBy("k.at")
    sizes = lines.groupBy(F.col("k.file").alias("file"), F.col("k.block").alias("block")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1))  # a row a split
    base = sizes.select("file", "block", F.coalesce(before, F.lit(0)).alias("base"))
    rows = lines.select("line", F.col("k.file").alias("file"), F.col("k.block").alias("block"), (F.row_number().over(split) - 1).alias("n"))
    return rows.join(F.broadcast(base), ["file", "block"]).select((F.col("base") + F.col("n")).cast("int").alias("at"), "line")


def read_jsonl(spark: SparkSession, path: str, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """JSON lines: question, answer, positive and negative texts.

    Ids count the non-blank lines, those dropped for want of a positive included. ``exact``: candidates in
    the order of Python's ``random``, seeded by the query's id; else in hash order.
    """
    lines = numbered_lines(spark, path)
    rows = lines.select("at", F.from_json("line", schema.JSONL).alias("r")).select("at", "r.*")
    numbered = rows.withColumn("query_id", F.format_string("jr-%03d", "at")).filter(F.size("positive") > 0)
    queries = numbered.select("query_id", "question", F.when(F.length("answer") > 0, F.array("answer")).otherwise(F.expr("cast(array() as array<string>)")).alias("answers"))
    texts = F.concat(F.transform("positive", lambda t: F.struct(t.alias("text"), F.lit(1).alias("label"))), F.transform(F.coalesce("negative", F.expr("cast(array() as array<string>)")), lambda t: F.struct(t.alias("text"), F.lit(0).alias("label"))))
    flat = numbered.select("query_id", F.posexplode(texts).alias("i", "c"))
    candidates = flat.select("query_id", F.concat("query_id", F.format_string("-c%02d", "i")).alias("doc_id"), F.col("i").cast("long").alias("ordinal"), F.col("c.text").alias("text"), F.col("c.label").alias("label"))
    return queries, streams.exact_shuffled(candidates, [F.asc("ordinal")], with_size=False) if exact else hash_shuffled(candidates)


def hash_shuffled(candidates: DataFrame, seed: Column | None = None) -> DataFrame:
    """``position`` in the hash order of each query."""
    key = shuffle_key(*([seed] if seed is not None else []), F.col("query_id"), F.col("doc_id"))
    return candidates.withColumn("position", (F.row_number().over(Window.partitionBy("query_id").orderBy(key, "doc_id")) - 1).cast("long"))


def read_tsv(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """Tab-separated rows without a header; quotes are doubled inside quoted fields, which may hold tabs and line breaks."""
    parsed = F.from_csv("record", columns, {"sep": "\t", "quote": '"', "escape": '"'})
    return records(spark, path).select(parsed.alias("r")).select("r.*")


def judged_ids(qrels: DataFrame) -> DataFrame:
    return qrels.select("docid").distinct()


#: A record's id as it stands in its line; ids with escapes, which it doesn't match, are parsed to be known.
_PLAIN_ID = r'"docid"\s*:\s*"([^"\\]*)"'


def asked_lines(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(value, __at): the lines of JSON-line shards that may be wanted by the id they show, and those that show none."""
    lines = spark.read.text(path).select("value", in_file_order().alias("__at"), F.regexp_extract("value", _PLAIN_ID, 1).alias("__id"))
    shown = lines.filter("__id <> ''").join(wanted.select(F.col("docid").alias("__id")), "__id", "left_semi")
    return shown.unionByName(lines.filter("__id = ''")).drop("__id")


def read_corpus(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Passages of (gzipped) JSON-line shards that are wanted; of repeated ids the last one wins.

    Lines are asked for their id before they are parsed, so only records near the wanted ones are.
    """
    rows = asked_lines(spark, path, wanted).select(F.from_json("value", schema.CORPUS).alias("r"), "__at").select("r.*", "__at")
    last = rows.join(wanted, "docid", "left_semi").groupBy("docid").agg(F.max_by(F.struct("title", "text"), "__at").alias("p"))
    return last.select("docid", "p.title", "p.text")


def cached_passages(spark: SparkSession, path: str, shards: str, wanted: DataFrame) -> DataFrame:
    """The wanted passages, from the Parquet table at ``path``, or from the shards and saved there.

    A saved table that lacks wanted ids is as good as none: it is made anew.
    """
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        have = spark.read.schema(schema.CORPUS).parquet(path)
        if wanted.join(have, "docid", "left_anti").isEmpty():
            return have.join(wanted, "docid", "left_semi")
    read_corpus(spark, shards, wanted).write.mode("overwrite").parquet(path)
    return spark.read.schema(schema.CORPUS).parquet(path)


def public_bundle(spark: SparkSession, root: str) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Queries and candidates of each public set under ``root``: lines.jsonl, and judged/ (qrels.tsv,
    topics.tsv, corpus/*.jsonl.gz, with the passages kept in judged/passages)."""
    qrels = read_tsv(spark, f"{root}/judged/qrels.tsv", schema.QRELS)
    topics = read_tsv(spark, f"{root}/judged/topics.tsv", schema.TOPICS)
    passages = cached_passages(spark, f"{root}/judged/passages", f"{root}/judged/corpus", judged_ids(qrels))
    pairs = load_judged(qrels, passages, topics)
    queries = pairs.select("query_id", "question", F.expr("cast(array() as array<string>)").alias("answers")).distinct()
    text = passage_text(F.col("title"), F.col("text"))
    candidates = hash_shuffled(pairs.select("query_id", "question", "doc_id", text.alias("text"), "label"))
    lines = read_jsonl(spark, f"{root}/lines.jsonl")
    return {"lines": lines, "judged": (queries, candidates.withColumn("ordinal", F.col("position")))}


def missing_passages(qrels: DataFrame, passages: DataFrame) -> DataFrame:
    return judged_ids(qrels).join(passages, "docid", "left_anti")


def judged_pairs(qrels: DataFrame, passages: DataFrame, topics: DataFrame) -> DataFrame:
    """qrels with their passages and topics; label = rel > 0."""
    rows = qrels.join(passages, "docid").join(topics.withColumnRenamed("text", "question"), "q")
    return rows.select(F.col("q").alias("query_id"), "question", F.col("docid").alias("doc_id"), "title", "text", (F.col("rel") > 0).cast("int").alias("label"))


def load_judged(qrels: DataFrame, passages: DataFrame, topics: DataFrame) -> DataFrame:
    """The same, raising with the first ids where passages are missing."""
    missing = [r["docid"] for r in missing_passages(qrels, passages).orderBy("docid").limit(10).collect()]
    if missing:
        raise ValueError(f"passages are missing: {', '.join(missing)}")
    return judged_pairs(qrels, passages, topics)


def _records(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """One JSON object a file; a file that can't be read raises with its name."""
    rows = spark.read.schema(columns).json(path, multiLine=True, mode="PERMISSIVE").select("*", F.col("_metadata.file_name").alias("file"))
    bad = F.raise_error(F.concat(F.lit("not JSON: "), F.col("file")))
    return rows.withColumn("id", F.when(F.col("_corrupt_record").isNull(), F.col("id")).otherwise(bad)).drop("_corrupt_record")


def read_synthetic(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Queries, candidates and built facts of one or more generators' folders.

    Label: role positive; a document whose role and facts disagree raises.
    """
    rows = None
    for path in paths:
        part = _records(spark, path, schema.SYNTHETIC)
        rows = part if rows is None else rows.unionByName(part)
    queries = rows.select(F.col("id").alias("query_id"), "question", F.expr("cast(array() as array<string>)").alias("answers"), F.coalesce("question_type", F.lit("")).alias("category"))
    docs = rows.select(F.col("id").alias("query_id"), "question", F.explode("documents").alias("d")).select("query_id", "question", "d.*")
    positive, facts = F.col("role") == "positive", F.size(F.coalesce("contains_facts", F.expr("cast(array() as array<string>)"))) > 0
    label = F.when(positive == facts, positive.cast("int")).otherwise(F.raise_error(F.concat("doc_id", F.lit(": role and contains_facts disagree"))).cast("int"))
    candidates = docs.select("query_id", "question", "doc_id", "text", label.alias("label"))
    candidates = hash_shuffled(candidates).withColumn("ordinal", F.col("position"))
    built = docs.select(F.col("query_id").alias("id"), "doc_id", F.col("contains_facts").alias("facts"))
    return queries, candidates, built


def read_verdicts(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """Verdicts by document and checks by question of verifiers' folders."""
    rows = None
    for path in paths:
        part = _records(spark, path, schema.VERDICTS)
        rows = part if rows is None else rows.unionByName(part)
    verdicts = rows.select("id", F.posexplode("verdicts").alias("ordinal", "v")).select("id", "ordinal", "v.*")
    return verdicts, rows.select("id", "question_checks.*")


def write_views(spark: SparkSession, source: str, target: str, seed: int = 0) -> DataFrame:
    """Views for verifiers: construction fields taken out, documents in hash order.

    Only questions that ``target`` (a Parquet folder) doesn't hold are added, never changed.
    Returns what was added.
    """
    rows = _records(spark, source, schema.SYNTHETIC)
    keyed = F.array_sort(F.transform("documents", lambda d: F.struct(shuffle_key(F.lit(seed), F.col("id"), d["doc_id"]).alias("k"), d["doc_id"].alias("doc_id"), d["text"].alias("text"))))
    views = rows.select("id", "question", "required_facts", F.transform(keyed, lambda d: F.struct(d["doc_id"].alias("doc_id"), d["text"].alias("text"))).alias("documents"))
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        views = views.join(spark.read.schema(schema.VIEWS).parquet(target).select("id"), "id", "left_anti")
    views.write.mode("append").parquet(target)
    return views


def parse_env(text: str, env: dict[str, str]) -> dict[str, str]:
    """KEY=VALUE lines, quotes stripped; names that ``env`` holds stay as they are."""
    out = dict(env)
    for n, line in enumerate(text.splitlines(), 1):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        name, eq, value = line.partition("=")
        if not eq or not name.strip():
            raise ValueError(f"line {n}: not KEY=VALUE")
        value = value.strip()
        if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1]
        out.setdefault(name.strip(), value)
    return out
