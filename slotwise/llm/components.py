"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import few_tasks, stored, tables_folder, workspace


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), a stored table; ``root`` is the smallest node reachable.

    Each round joins every edge with the smallest neighbour of its end: a node with very many edges
    is pre-aggregated; the smallest neighbours are stored, so that the join's inputs are plain scans and a hot node
    can be split at run time.  Rounds are stored: the lineage stays short and
    survives lost executors.  Their tables are written by as many tasks as their rows fill, and deleted at the end.
    Self loops give a node that is its own root; no edges give no rows.
    """
    outside = tables_folder(edges.sparkSession)
    with workspace(edges.sparkSession) as rounds:
        return _components(edges, rounds, outside)


def _components(edges: DataFrame, rounds: str, outside: str) -> DataFrame:
    both = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct())
    before = None
    now = _mark(both)
    while before != now:
        with workspace(edges.sparkSession):
            rows = now[0]
            large = stored(few_tasks(_large_star(both, rows), rows))
            both, before = stored(few_tasks(_small_star(large, rows), rows), rounds), now
        now = _mark(both)
    roots = both.where("a <> b")
    nodes = roots.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("b", "b").distinct()).union(
        both.where("a = b").join(roots.select("a").union(roots.select("b")).distinct(), "a", "left_anti").select("a", "b")
    )
    return stored(few_tasks(nodes, now[0]), outside)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    """Links every larger neighbour of a node to the smallest of the node and its neighbours."""
    around = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = stored(few_tasks(around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), rows))
    return around.join(least, "u").where("v > u OR v = u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them.  Edges point from a to b <= a."""
    least = stored(few_tasks(edges.groupBy("a").agg(F.min("b").alias("m")), rows))
    return edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m")).distinct()
