"""Connected components of a graph of links, by alternating large and small stars.

Each round joins every node to the least node around it; a handful of rounds
are enough, one where the links are stars already. Each is written to the
shared folder, in files by the number of links, so that a lost executor costs
one round. No link or label reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.shared import drop, kept


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over (a, b) with a > b: one shuffle by node. Rows may repeat."""
    least = F.least("a", F.min("b").over(Window.partitionBy("a")))
    if large:
        both = edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        return both.select("a", "b", least.alias("m")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    joined = edges.select("a", "b", least.alias("m"))
    return joined.select(F.inline(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))).filter("a <> b")


def components(links: DataFrame, rounds: int = 40, rows: int | None = None) -> DataFrame:
    """(node, label) of every node of ``links`` (a, b): label is the least node of its component. ``rows``: about how many links there are."""

    def seen(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = kept(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), rows)
    now = seen(edges)
    for _ in range(rounds):
        before, held = now, edges
        edges = kept(_star(_star(held, True), False).distinct(), now[0])
        now = seen(edges)
        drop(held)
        if before == now:
            break
    else:
        raise RuntimeError("components did not settle")
    # every node but the labels points at its label, which points at itself
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select(F.col("b"), F.col("b")).distinct())
