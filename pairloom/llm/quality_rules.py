"""Quality rules (native): text statistics and a learned decision list.

Statistics are DataFrame expressions over whole texts. The list is learned by sequential
covering: a conjunction of thresholds is grown on two thirds of the labelled rows by
information gain, pruned on the other third, and its covered rows are taken out before
the next one is grown. It comes out as an ordered CASE expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space and symbols of the base rules (fixed values).
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WORD_BREAK = r"[\x20\x09-\x0D]+"
#: Base limits: fewest words; most percent of words in repeated five-word windows.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: Labelled rows that the list is learned from at most, dealt by a hash of the id.
FIT_ROWS = 12_000
FEATURES = ("symbol_ratio", "dup_line_ratio", "repeat_ratio", "mean_word_chars", "upper_ratio", "bang_ratio", "log_words")


def _gone(text: str | Column, chars: str) -> Column:
    """Characters of ``text`` that are in ``chars``."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _repeated_words(words: Column) -> Column:
    """Words inside five-word windows that occur twice or more (64-bit window hashes)."""
    at = F.sequence(F.lit(0), F.size(words) - WINDOW)
    hashes = F.transform(at, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW))))

    def covered(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        same = lambda s, i, j: F.coalesce(F.get(s, j)["h"] == F.get(s, i)["h"], F.lit(False))

        def spots(s: Column) -> Column:
            twice = F.filter(s, lambda x, i: same(s, i, i - 1) | same(s, i, i + 1))
            return F.array_sort(F.transform(twice, lambda x: x["at"]))

        def total(p: Column) -> Column:
            return F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, x: F.struct((a["n"] + x + WINDOW - F.greatest(x, a["end"])).alias("n"), (x + WINDOW).alias("end")), lambda a: a["n"])

        return _let(ordered, lambda s: _let(spots(s), total))

    dup = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(words) > WINDOW, dup).otherwise(F.lit(0))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once: a transform over a one-element array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and FEATURES.

    A null or empty text has no words: all counts are 0, ratios 0. Every row gives a row
    (repeated ones too); other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__t"))
    rows = rows.withColumn("__w", F.filter(F.split("__t", WORD_BREAK), lambda w: w != ""))
    lines = F.filter(F.split("__t", "\n"), lambda x: F.trim(F.translate(x, SPACES, " ")) != "")
    rows = rows.select(
        "__id",
        F.size("__w").cast("long").alias("n_words"),
        (F.length("__t") - _gone("__t", SPACES)).cast("long").alias("word_chars"),
        _gone("__t", SYMBOLS).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.struct(F.size(x).alias("all"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("__lines"),
        _repeated_words(F.col("__w")).cast("long").alias("n_repeat_words"),
        _gone("__t", "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ").alias("__upper"),
        _gone("__t", "!").alias("__bang"),
    )
    over = lambda a, b: F.col(a).cast("double") / F.greatest(F.col(b) if isinstance(b, str) else b, F.lit(1))
    return rows.select(
        F.col("__id").alias(id_col), "n_words", "word_chars", "n_symbols", F.col("__lines.dup").cast("long").alias("n_dup_lines"), "n_repeat_words",
        over("n_symbols", "word_chars").alias("symbol_ratio"), over("__lines.dup", "__lines.all").alias("dup_line_ratio"), over("n_repeat_words", "n_words").alias("repeat_ratio"),
        over("word_chars", "n_words").alias("mean_word_chars"), over("__upper", "word_chars").alias("upper_ratio"), over("__bang", "word_chars").alias("bang_ratio"),
        F.log1p(F.col("n_words").cast("double")).alias("log_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    limit: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] > self.limit if self.above else row[self.feature] <= self.limit

    def column(self) -> Column:
        x = F.col(self.feature)
        return x > self.limit if self.above else x <= self.limit


#: A conjunction of conditions; a row that meets all of one rule is rejected.
Rule = tuple[Condition, ...]


def _covers(rule: Rule, rows: list[dict]) -> list[dict]:
    return [r for r in rows if all(c.holds(r) for c in rule)]


def _counts(rows: list[dict]) -> tuple[int, int]:
    bad = sum(r["bad"] for r in rows)
    return bad, len(rows) - bad


def _best_condition(rows: list[dict], cuts: int) -> tuple[float, Condition | None]:
    """The threshold of the highest gain: bad rows kept times the rise of log precision."""
    bad, good = _counts(rows)
    before, best = math.log2(bad / (bad + good)), (0.0, None)
    for f in FEATURES:
        ordered = sorted((r[f], r["bad"]) for r in rows)
        steps = {ordered[min(len(ordered) - 1, len(ordered) * k // cuts)][0] for k in range(cuts)}
        below = at = 0
        for step in sorted(steps):
            while at < len(ordered) and ordered[at][0] <= step:
                below += ordered[at][1]
                at += 1
            # halfway to the next value, so that a limit of 0 isn't passed by any value above it
            limit = (step + ordered[at][0]) / 2 if at < len(ordered) else step
            for above, p, n in ((False, below, at - below), (True, bad - below, len(ordered) - at - bad + below)):
                if p and p + n < len(rows):
                    gain = p * (math.log2(p / (p + n)) - before)
                    if gain > best[0]:
                        best = (gain, Condition(f, above, limit))
    return best


def learn_decision_list(rows: list[dict], max_rules: int = 12, max_conditions: int = 4, cuts: int = 64, least_precision: float = 0.97) -> list[Rule]:
    """Ordered rules from rows that hold FEATURES, ``bad`` (0 or 1) and ``prune`` (bool).

    Without rows of both kinds the list is empty. Stops when a pruned rule holds less than
    ``least_precision`` on the rows held for pruning, or covers no bad row of them.
    """
    grow, prune, rules = [r for r in rows if not r["prune"]], [r for r in rows if r["prune"]], []
    while len(rules) < max_rules and all(_counts(grow)) and _counts(prune)[0]:
        rule, left = (), grow
        while len(rule) < max_conditions and all(_counts(left)):
            gain, condition = _best_condition(left, cuts)
            if condition is None:
                break
            rule, left = (*rule, condition), _covers((condition,), left)
        worth = lambda r: (lambda p, n: (p - n) / (p + n) if p + n else -1.0)(*_counts(_covers(r, prune)))
        if not rule:
            break
        rule = max((rule[: k + 1] for k in range(len(rule))), key=lambda r: (worth(r), -len(r)))
        bad, good = _counts(_covers(rule, prune))
        if not bad or bad / (bad + good) < least_precision:
            break
        rules.append(rule)
        grow, prune = ([r for r in part if not all(c.holds(r) for c in rule)] for part in (grow, prune))
    return rules


def fit_decision_list(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> list[Rule]:
    """Learn from at most ``fit_rows`` labelled documents, chosen by a hash of the id.

    Labels: id, quality (1 good, 0 bad); rows with a null id or quality are not used, and
    of several labels of one id the lowest counts, as does any one row of a repeated id.
    """
    known = labels.select(F.col(id_col).alias("__l"), F.col("quality").alias("__q")).filter("__l is not null and __q is not null").groupBy("__l").agg(F.min("__q").alias("__q"))
    chosen = known.orderBy(F.xxhash64("__l", F.lit(5)), "__l").limit(fit_rows)
    stats = text_statistics(docs.join(chosen, F.col(id_col) == F.col("__l"), "left_semi"), id_col, text_col)
    rows = stats.dropDuplicates([id_col]).join(chosen, F.col(id_col) == F.col("__l")).select(*FEATURES, (F.col("__q") < 1).cast("int").alias("bad"), (F.pmod(F.xxhash64("__l", F.lit(7)), F.lit(3)) == 0).alias("prune"))
    return learn_decision_list([r.asDict() for r in rows.collect()])  # one row an id: ``fit_rows`` at most


def verdict(rules: list[Rule]) -> Column:
    """The ordered list as a column: index of the first rule that rejects, or null."""
    out = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules))):
        met = F.lit(True)
        for c in rule:
            met = met & c.column()
        out = F.when(met, F.lit(k)).otherwise(out)
    return out


def apply_quality_rules(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics of every document, base_failed, rule (index that rejects, or null) and kept."""
    stats = text_statistics(docs, id_col, text_col)
    return stats.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
