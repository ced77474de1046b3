"""Connected components of a distributed edge list (alternating large-star and small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, spread_join


def _beside(rows: DataFrame, least: DataFrame, total: int, small: int) -> DataFrame:
    """rows with m of their a. So few rows fit into one task, however they are spread."""
    return rows.join(least.drop("n"), "a") if total <= small else spread_join(rows, least, "a", total)


def _large_star(e: DataFrame, total: int, small: int) -> DataFrame:
    both = e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    return _beside(both, least, 2 * total, small).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(e: DataFrame, total: int, small: int) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    joined = _beside(down, least, total, small)
    return joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, small: int = 0) -> DataFrame:
    """edges: a, b (long). Returns a, b: each node that is not the least of its component, and that least node.

    Each round is written to the shared folder, so a lost executor costs at most that round.
    Rounds grow with the logarithm of the longest chain. A node with very many links is not brought
    to one task (see spread_join), unless there are `small` rows or fewer in all: then plain joins make smaller plans. Defined results: no edges give no rows; repeated edges and loops
    change nothing; an edge with a null end is left out.
    """
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    now = materialize(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    seen = mark(now)
    while seen[0]:
        starred = materialize(_large_star(now, seen[0], small).distinct(), "edges")
        after = materialize(_small_star(starred, mark(starred)[0], small).distinct(), "edges")
        discard(now)
        discard(starred)
        now = after
        got = mark(now)
        if got == seen:
            break
        seen = got
    return now
