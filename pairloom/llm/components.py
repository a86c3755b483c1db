"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum joined back to the edges, by node and salt, so no component,
neighbour list or hub is ever held in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._stage import release, stage_table, tasks_for
from .salted import with_group


def _star(edges: DataFrame, large: bool, tasks: int) -> DataFrame:
    """Link each node's larger (or all other) neighbours to the least node around it.

    A hub's neighbours are dealt over salts on the way to the least of them and back.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined = with_group(both, "u", "v", F.min("v").alias("low"), F.min("low").alias("low")).coalesce(tasks)
    joined = joined.select("u", "v", F.least("u", "low").alias("m"))
    out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct().coalesce(tasks)


def connected_components(edges: DataFrame, max_steps: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v), root being the component's least node.

    Null ends and self links are passed over; repeated links count once; no edges give an
    empty result. Raises if it has not settled after ``max_steps`` double steps.
    """
    edges = stage_table(edges.filter("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges")
    size = edges.count()
    tasks = tasks_for(2 * size)
    if not size:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(max_steps):
        before, edges = edges, stage_table(_star(_star(edges, True, tasks), False, tasks), "edges")
        release(before)
        # settled when every node hangs on one root, and no root hangs on another
        roles = edges.select(F.col("u").alias("x"), F.lit(1).alias("leaf")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("leaf")))
        if roles.groupBy("x").agg(F.sum("leaf").alias("up"), F.min("leaf").alias("low")).coalesce(tasks).filter("up > 1 or (up = 1 and low = 0)").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    raise RuntimeError("connected components did not settle")
