"""The judge report: one long table of measures, and a layout that says which of them stand where.

``measures`` gives (dataset, route, measure, value, low, high) of all saved routes, and of contrasts of
two routes under the name ``first - second``. A layout is data: sections, each with the measures of its
columns and the contrasts beneath. Rows are routes. What isn't in the table isn't shown.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators import bootstrap, classify, curves, ranking, streams

from .report import PERCENT, POINTS, THREE, TWO, Places, grid

LONG = "dataset string, route string, measure string, value double, low double, high double"
#: The name that a random order has among the routes.
CHANCE = "random order"
QUERY_AP, AP, KEPT, CUT, RATE, COUNT, FIRST, THIRD = "query_pr_auc", "pr_auc", "precision", "threshold", "positive_rate", "queries", "hit_1", "hit_3"


def _long(wide: DataFrame, *names: str) -> DataFrame:
    values = [F.struct(F.lit(n).alias("measure"), F.col(n).cast("double").alias("value")) for n in names]
    return wide.select("dataset", "route", F.explode(F.array(*values)).alias("m")).select("dataset", "route", "m.*")


def route_measures(pairs: DataFrame, seed: int = 0) -> DataFrame:
    """(dataset, route, measure, value) of every route; a random order's expected measures come as a route."""
    by = classify.ROUTE
    points = curves.curve(pairs, by)
    hits = ((FIRST, 1), (THIRD, 3))
    chance = lambda df: df.groupBy("dataset", "measure").agg(F.max("value").alias("value")).select("dataset", F.lit(CHANCE).alias("route"), "measure", "value")  # noqa: E731  pools are the same for all routes
    parts = [
        _long(classify.mean_per_query(pairs, "pr_auc").withColumnsRenamed({"value": QUERY_AP}), QUERY_AP, COUNT),
        _long(curves.average_precision(points, by, AP), AP),
        _long(curves.precision_at_recall(points, by), KEPT, CUT),
        *(_long(ranking.top_k_hit(pairs, k).withColumnRenamed("hit_rate", name), name) for name, k in hits),
        *(chance(_long(ranking.random_top_k(pairs, k).withColumnRenamed("hit_rate", name), name)) for name, k in hits),
        chance(_long(pairs.groupBy(*by).agg(F.avg("label").alias(AP)).withColumn(KEPT, F.col(AP)), AP, KEPT)),
    ]
    one = pairs.join(F.broadcast(pairs.groupBy("dataset").agg(F.min("route").alias("route"))), by, "left_semi")
    parts.append(chance(_long(bootstrap.random_query_pr_auc(one, seed=seed, keys=by).withColumnRenamed("value", QUERY_AP), QUERY_AP)))
    return reduce(DataFrame.unionByName, parts)


def contrast_measures(pairs: DataFrame, contrasts: list[tuple[str, str, str, tuple[str, ...]]], samples: int, seed: int) -> list[tuple]:
    """Rows of LONG, intervals included, for (dataset, first, second, measures); a contrast's draws are made once."""
    out = []
    for dataset, first, second, names in contrasts:
        own = pairs.filter(F.col("dataset") == dataset)
        a, b = (own.filter(F.col("route") == r) for r in (first, second))
        drawn = streams.exact_draws(a.select("query_id").join(b.select("query_id").distinct(), "query_id", "left_semi"), samples, seed)
        for name in names:
            if name == QUERY_AP:
                found = bootstrap.bootstrap_mean_diff(*(classify.per_query(x, "pr_auc").select("query_id", "value") for x in (a, b)), drawn)
            else:
                found = bootstrap.paired_bootstrap(a, b, drawn, name)
            r = found.first()
            out.append((dataset, f"{first} - {second}", name, r["difference"], r["low"], r["high"]))
    return out


@dataclass(frozen=True)
class Section:
    """A title, its columns (header, measure, how numbers are written), and the contrasts beneath by measure.

    ``routes`` names the rows; () is every route. A dataset without all of ``needs`` isn't shown.
    """

    title: str
    columns: tuple[tuple[str, str, Places], ...]
    contrasts: tuple[tuple[str, Places], ...] = ()
    pair: tuple[str, str] = ("", "")
    needs: tuple[str, ...] = ()
    routes: tuple[str, ...] = ()

    def shown(self, table: dict[tuple[str, str, str], tuple], datasets: list[str]) -> str:
        """Markdown from (dataset, route, measure) -> (value, low, high), or an empty text."""
        body, beneath = [], []
        for d in datasets:
            there = sorted({r for x, r, _ in table if x == d and " - " not in r})
            if not set(self.needs) <= set(there):
                continue
            for r in [x for x in there if not self.routes or x in self.routes]:
                cells = [table.get((d, r, m), (None,))[0] for _, m, _ in self.columns]
                if any(x is not None for x in cells):
                    body.append([d, r, *(p.value(x) for x, (_, _, p) in zip(cells, self.columns, strict=True))])
            first, second = self.pair
            for m, p in self.contrasts:
                if (d, f"{first} - {second}", m) in table:
                    _, low, high = table[d, f"{first} - {second}", m]
                    a, b = (table.get((d, r, m), (None,))[0] for r in self.pair)
                    beneath.append([d, m, first, second, p.difference(a, b, {"low": low, "high": high})])
        if not body:
            return ""
        text = grid(["dataset", "route", *(h for h, _, _ in self.columns)], body)
        return text + ("\n\n" + grid(["dataset", "measure", "of", "less", "difference (95 %)"], beneath) if beneath else "")


def layout(first: str, second: str, plain: str) -> list[Section]:
    """What the report shows, in order."""
    both = (first, second)
    three = (first, plain, second)
    return [
        Section("Order within each query", (("queries", COUNT, Places(0)), ("mean PR-AUC", QUERY_AP, THREE)), ((QUERY_AP, THREE),), both, both),
        Section("Scores across queries", (("PR-AUC of all pairs", AP, TWO),), ((AP, TWO),), both, both),
        Section("The top of the list", (("relevant at 1", FIRST, PERCENT), ("relevant in 3", THIRD, PERCENT)), needs=both),
        Section("One threshold for all queries", (("precision, nine tenths kept", KEPT, POINTS), ("threshold", CUT, TWO)), ((KEPT, POINTS),), both, both),
        Section("With criteria and without", (("mean PR-AUC", QUERY_AP, THREE), ("PR-AUC of all pairs", AP, TWO), ("precision, nine tenths kept", KEPT, POINTS)), ((KEPT, POINTS),), (first, plain), three, three),
    ]


def judge_sections(pairs: DataFrame, datasets: list[str], first: str, second: str, plain: str, samples: int, seed: int, diluted: tuple[list[dict], dict | None] | None = None) -> dict[str, str]:
    """All sections by title, in order, of the saved ``pairs`` of ``datasets``."""
    table: dict[tuple[str, str, str], tuple] = {}
    for r in route_measures(pairs.filter(F.col("dataset").isin(datasets)), seed).collect():  # a few rows a route
        table[r["dataset"], r["route"], r["measure"]] = (r["value"], None, None)
    sections, wanted = layout(first, second, plain), {}
    for s in sections:
        for d in datasets:
            if s.contrasts and all((d, r, AP) in table for r in s.needs):
                wanted.setdefault((d, *s.pair), []).extend(m for m, _ in s.contrasts)
    for d, r, m, *found in contrast_measures(pairs, [(*k, tuple(dict.fromkeys(v))) for k, v in wanted.items()], samples, seed):
        table[d, r, m] = tuple(found)
    return {s.title: s.shown(table, datasets) for s in sections} | {"Candidates in one request": dilution(*diluted) if diluted else ""}


def dilution(rows: list[dict], compare: dict | None = None) -> str:
    """Own pairs by pool and batch; ``compare`` holds the differences of the two small settings."""
    if not rows:
        return ""
    written = {"candidates": ("pool", str), "a request": ("batch", str), "PR-AUC by query": ("query_pr_auc", TWO.value), "PR-AUC of all": ("pr_auc", TWO.value), "foreign ones over 0.5": ("share_at_half", lambda x: "none" if x is None else PERCENT.value(x)), "requests": ("requests", str)}
    text = grid(written, [[write(r[name]) for name, write in written.values()] for r in rows])
    if compare:
        text += "\n\nAll in one request less one by one: " + ", ".join(f"{name} {THREE.difference(c['first'], c['second'], c)}" for name, c in compare.items())
    return text
