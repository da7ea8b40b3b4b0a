"""Connected components over an edge table, by stars that shrink to the least member."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolloom.session import materialize

#: Rows of an edge table that one task writes; a table has fewer tasks only if it is small.
EDGES_PER_FILE = 200_000


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its least neighbour (or itself) to its larger neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    larger = both.where(F.col("v") > F.col("u"))
    return larger.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node ties its smaller neighbours and itself to the least of them; edges are (larger, smaller)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = edges.join(least, "u")
    moved = linked.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _is_star(edges: DataFrame) -> bool:
    """Whether every node has one edge at most to a smaller one, and no chain is left."""
    smaller = edges.groupBy("u").agg(F.count("*").alias("n"), F.max("v").alias("v"))
    chained = smaller.join(edges.select(F.col("v").alias("centre")).distinct(), F.col("u") == F.col("centre"), "left")
    return chained.where("n > 1 OR centre IS NOT NULL").isEmpty()


def components(edges: DataFrame, left: str, right: str, label: str = "components") -> DataFrame:
    """``node`` and ``component`` (its least node) for every node that has an edge to another.

    Large-star and small-star steps alternate until only stars are left; rounds grow with the
    logarithm of the longest chain. The edges stay a distributed table of at most one row per edge,
    written after every round, in files of EDGES_PER_FILE or more. The minimum of a hub's neighbours is taken
    inside tasks first, and its join may be split at run time. Edges with a null
    end and loops are ignored; repeated edges do no harm.
    """
    pairs = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a <> b")
    pairs = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    current = materialize(pairs, label)
    files = 1 + current.count() // EDGES_PER_FILE
    while not _is_star(current):
        after = _small_star(_large_star(current))
        current = materialize(after.coalesce(files), label)
    star = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    centres = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return star.union(centres)
