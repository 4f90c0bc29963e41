"""Connected components of a link table by alternating large-star and small-star rounds, all on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import materialize, spread_join


def _print_of(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def _linked_to_least(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """rows(a, b) with m, the least b of each a, and the table of these; an `a` with any number of rows is spread over tasks."""
    least = materialize(rows.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), name)
    return spread_join(rows, least, ["a"]), least


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    joined, _ = _linked_to_least(both, "least")
    return joined.filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of these; edges come as (larger, smaller)."""
    joined, least = _linked_to_least(edges, "smallest")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links(a, b), except that roots have no row of their own; root is the least node.

    Both columns are bigint without nulls. Each round is written to the shared folder; the neighbours of a node meet
    its least one in a join that spreads nodes of many neighbours over tasks.
    """
    edges = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = _print_of(edges)
    while before[0]:
        edges = materialize(_small_star(materialize(_large_star(edges), "large")), "stars")
        after = _print_of(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
