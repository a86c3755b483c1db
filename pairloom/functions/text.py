"""Text functions: normal forms, content terms, token estimates and tagged answers."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: Runs that count as content terms; characters that a token estimate takes one by one;
#: marks taken out of an answer (fixed values).
TERM = r"[一-鿿]{2,}|[゠-ヿ]{2,}|[A-Za-z0-9]{2,}"
CJK = r"[\u3000-\u30ff\u3400-\u9fff\uff00-\uffef]"
ANSWER_MARKS = "・=-"
QUOTED = r"[「『](.*?)[」』]"
TAGGED = r"(?s)<answer>(.*?)</answer>"
#: An estimate is raised by this factor, and counts so many other characters as one token.
TOKEN_MARGIN, CHARS_A_TOKEN = 1.25, 4


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(ArrayType(StringType()))
def _nfkc_all(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else [None if y is None else unicodedata.normalize("NFKC", y) for y in x])


def nfkc(text: Column) -> Column:
    """NFKC form; texts of ASCII only, which it leaves alone, don't go to Python."""
    other = F.when(text.rlike(r"[^\x00-\x7F]"), text)
    return F.coalesce(_nfkc(other), text)


def term_bag(text: Column, normalise: bool = True) -> Column:
    """All content terms of a text, in order."""
    return F.regexp_extract_all(nfkc(text) if normalise else text, F.lit(TERM), F.lit(0))


def terms(text: Column, normalise: bool = True) -> Column:
    """The set of content terms."""
    return F.array_distinct(term_bag(text, normalise))


_TERM = re.compile(TERM)


def _bag(text: str) -> list[str]:
    return _TERM.findall(text if text.isascii() else unicodedata.normalize("NFKC", text))


@lru_cache(4096)
def _asked(question: str | None) -> dict[str, None]:
    return dict.fromkeys(_bag(question or ""))


_FOUND = ArrayType(StructType([StructField("term", StringType()), StructField("times", IntegerType())]))


@F.arrow_udf(StructType([StructField("asked", IntegerType()), StructField("bag", IntegerType()), StructField("found", _FOUND)]))
def term_counts(question: pa.Array, text: pa.Array) -> pa.Array:
    """Number of a question's terms, number of content terms of its text, and the question's terms counted there.

    ``found`` keeps the question's order, and is null for a null text. A text's terms don't leave the task.
    """
    asked, bags, found = [], [], []
    for q, t in zip(question.to_pylist(), text.to_pylist(), strict=True):
        wanted, bag = _asked(q), _bag(t or "")
        times = Counter(filter(wanted.__contains__, bag))
        asked.append(len(wanted))
        bags.append(len(bag))
        found.append(None if t is None else [{"term": w, "times": times[w]} for w in wanted if w in times])
    kind = pa.list_(pa.struct({"term": pa.string(), "times": pa.int32()}))
    return pa.StructArray.from_arrays([pa.array(asked, pa.int32()), pa.array(bags, pa.int32()), pa.array(found, kind)], ["asked", "bag", "found"])


def estimate_tokens(text: Column) -> Column:
    """Tokens of a text: CJK characters one each, others by fours, raised by the margin."""
    cjk = F.regexp_count(text, F.lit(CJK))
    rest = F.floor((F.length(text) - cjk + (CHARS_A_TOKEN - 1)) / F.lit(float(CHARS_A_TOKEN)))
    return F.floor((cjk + rest).cast("double") * TOKEN_MARGIN).cast("long")


def strip(text: Column) -> Column:
    """Without white space of any script at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def passage_text(title: Column, text: Column) -> Column:
    """Title and text with a space between, stripped; the text alone where there is no title."""
    return F.when(F.length(title) > 0, strip(F.concat(title, F.lit(" "), text))).otherwise(text)


def _wide(text: Column) -> Column:
    return F.replace(text, F.lit("～"), F.lit("〜"))


def _bare(composed: Column) -> Column:
    marked = F.translate(F.regexp_replace(F.lower(composed), QUOTED, "$1"), ANSWER_MARKS, "")
    return F.regexp_replace(marked, r"(?U)\s+", "")


def normalise_answer(text: Column) -> Column:
    """Answers that differ in width, case, quotes, separators or white space become equal."""
    return _bare(nfkc(_wide(text)))


def normalise_answers(texts: Column) -> Column:
    """The same for every text of an array."""
    return F.transform(_nfkc_all(F.transform(texts, _wide)), _bare)


def extract_answer(text: Column) -> Column:
    """What stands in the first answer tag, or null."""
    return F.when(text.rlike(TAGGED), F.regexp_extract(text, TAGGED, 1))


def score_answer(generated: Column, golds: Column) -> Column:
    """Struct of parsed, exact, contains, extracted, matched.

    An untagged answer isn't parsed. Equality is looked for among all golds before
    containment; golds that normalise to nothing never match.
    """
    span = extract_answer(generated)
    pred = normalise_answer(span)
    preds = F.array_repeat(pred, F.size(golds))  # lambdas can't hold a Python function's result
    each = F.filter(F.arrays_zip(golds.alias("gold"), normalise_answers(golds).alias("norm"), preds.alias("pred")), lambda g: g["norm"] != "")
    first = lambda keep: F.get(F.filter(each, keep), F.lit(0))["gold"]
    same, part = first(lambda g: g["norm"] == g["pred"]), first(lambda g: g["pred"].contains(g["norm"]))
    return F.struct(
        span.isNotNull().alias("parsed"),
        (span.isNotNull() & same.isNotNull()).alias("exact"),
        (span.isNotNull() & F.coalesce(same, part).isNotNull()).alias("contains"),
        span.alias("extracted"),
        F.when(span.isNotNull(), F.coalesce(same, part)).alias("matched"),
    )
