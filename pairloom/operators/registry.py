"""Routes by name: built from what they need, and only that is opened, once for all routes."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ranking, routes

Route = Callable[[DataFrame], DataFrame]
#: The routes of a run that names none; ``pointwise_plain`` is for comparing the wording.
STANDARD = ("embedding", "hosted_rerank", "pointwise", "crossencode", "pairwise", "hybrid")


class Registry:
    """Named routes over services.

    Each part is a function without arguments, called when the first route needs it:
    ``vectors`` gives (vectors, query_vectors) tables, ``scorer``, ``plain`` and ``grader`` give
    scorers of single candidates, ``chooser`` one of pairs (from the pool), ``reranker`` one of lists.
    """

    def __init__(self, **parts: Callable[[], object]) -> None:
        self._parts = {name: cache(make) for name, make in parts.items()}

    def part(self, name: str) -> object:
        if name not in self._parts:
            raise ValueError(f"no {name} is configured; there are {', '.join(sorted(self._parts)) or 'none'}")
        return self._parts[name]()

    def build(self, names: Iterable[str]) -> dict[str, Route]:
        """Routes in the order given; an unknown name raises before anything is opened."""
        names = list(names)
        makers = [self._maker(routes.known_route(n), routes.batch_of(n)) for n in names]
        return {n: make() for n, make in zip(names, makers, strict=True)}

    def _maker(self, base: str, batch: int | None) -> Callable[[], Route]:
        return {
            "embedding": lambda: self._embedding(),
            "hosted_rerank": lambda: self._listed(),
            "pointwise": lambda: self._pointwise("scorer", batch),
            "pointwise_plain": lambda: self._pointwise("plain", batch),
            "crossencode": lambda: self._crossencode(),
            "pairwise": lambda: self._pairwise(),
            "hybrid": lambda: self._hybrid(batch),
        }.get(base, lambda: lambda pool: routes.baselines(pool).filter(F.col("route") == base))

    def _embedding(self) -> Route:
        vectors, queries = self.part("vectors")
        return lambda pool: routes.embedding(pool.select(*routes.KEY), vectors, queries)

    def _listed(self) -> Route:
        service = self.part("reranker")
        return lambda pool: routes.hosted_rerank(pool, service)

    def _pointwise(self, part: str, batch: int | None) -> Route:
        scorer = self.part(part)
        return lambda pool: routes.pointwise(pool, scorer, batch)

    def _crossencode(self) -> Route:
        scorer, grader = self.part("scorer"), self.part("grader")
        return lambda pool: routes.crossencode(pool, scorer, grader)

    def _pairwise(self) -> Route:
        chooser = self.part("chooser")
        return lambda pool: routes.compared(pool, chooser(pool))

    def _hybrid(self, batch: int | None) -> Route:
        first, second = self._embedding(), self._pointwise("scorer", batch)
        return lambda pool: ranking.hybrid(first(pool), second(pool), keys=["query_id"]).drop("route")


def in_rank_order(scored: DataFrame) -> DataFrame:
    """``scored`` with ``rank``: the one that it has (a service's order), else by score and input order."""
    if "rank" in scored.columns:
        return scored
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "ordinal")))


def offline(scripted: DataFrame, vectors: tuple[DataFrame, DataFrame] | None = None) -> Registry:
    """Every service played from a table: question_id, and value, grade or winner where there is one."""
    probabilities = scripted.filter("value is not null")

    def listed(lists: DataFrame) -> DataFrame:
        by_size = F.array_sort(F.transform("documents", lambda d, i: F.struct((-F.length(d)).alias("k"), i.alias("i"))))
        results = F.transform(by_size, lambda x: F.struct(x["i"].alias("index"), (-x["k"]).cast("double").alias("score")))
        return lists.select("query_id", results.alias("results"), F.lit(None).cast("string").alias("error"))

    parts = {
        "scorer": lambda: lambda asked: routes.offline_probability(asked, probabilities),
        "plain": lambda: lambda asked: routes.offline_probability(asked, probabilities),
        "grader": lambda: lambda asked: routes.offline_score(asked, scripted.filter("grade is not null").select("question_id", F.col("grade").alias("value"))),
        "chooser": lambda: lambda pool: lambda asked: routes.offline_choice(asked, scripted.filter("winner is not null"), ("a", "b")),
        "reranker": lambda: listed,
    }
    return Registry(**parts, **({"vectors": lambda: vectors} if vectors else {}))
