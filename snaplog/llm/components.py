"""Connected components of a graph of links, as DataFrames, without any driver-side structure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

ROUNDS = 200


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """vertex, label of every vertex in ``links`` (columns a, b): label is the smallest vertex reachable.

    ``rows``: about how many links there are, if that is known; they are dealt anew before they are written.

    Each round puts the vertices that are left in an order drawn anew by a hash. Every vertex gets its
    first neighbour (or itself, if that comes first) as parent and then its parent's parent, and links
    are contracted to parents: of a path, however its vertices are numbered, about a third is left, and
    of a hub's links nothing. Every round is a written table. When no link is left, roots are found by
    following the rounds' parents from the last to the first, and each root's smallest vertex is the
    label. The joins have tables on both sides, so that adaptive execution can split the rows of a hub,
    which all have one parent. Links are counted each round, and tables are written in as many files
    as their rows need: a file a shuffle partition, in dozens of tables, costs more than the work.
    """
    ends = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    left = written(ends.where(F.col("a") != F.col("b")).distinct(), "links", rows)
    # a vertex has a link at least, so a round has at most two vertices a link
    most = 2 * (n := left.count())
    rounds: list[DataFrame] = []
    while n or not rounds:
        if len(rounds) == ROUNDS:
            raise RuntimeError("components did not settle")
        place = lambda x: F.xxhash64(x, F.lit(len(rounds)))  # noqa: B023, E731
        both = left.select(F.col("a").alias("vertex"), F.col("b").alias("other")).unionByName(left.select(F.col("b").alias("vertex"), F.col("a").alias("other")))
        best = both.groupBy("vertex").agg(F.min_by("other", place("other")).alias("other"))
        parent = F.when(place("other") < place("vertex"), F.col("other")).otherwise(F.col("vertex"))
        first = written(best.select("vertex", parent.alias("parent")), "nearest", 2 * n)
        above = first.where(F.col("vertex") != F.col("parent")).select(F.col("vertex").alias("parent"), F.col("parent").alias("next"))
        parents = written(first.join(above, "parent", "left").select("vertex", F.coalesce("next", "parent").alias("parent")), "parents", 2 * n)
        rounds.append(parents)
        a, b = (parents.select(F.col("vertex").alias(x), F.col("parent").alias(f"p{x}")) for x in ("a", "b"))
        moved = left.join(a, "a").join(b, "b").where(F.col("pa") != F.col("pb"))
        left = written(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "links", n)
        n = left.count()
    roots = rounds.pop().withColumnRenamed("parent", "root")
    while rounds:
        to = roots.select(F.col("vertex").alias("parent"), "root")
        roots = rounds.pop().join(to, "parent", "left").select("vertex", F.coalesce("root", "parent").alias("root"))
    roots = written(roots, "roots", most)
    least = written(roots.groupBy("root").agg(F.min("vertex").alias("label")), "labels", most)
    return written(roots.join(least, "root").select("vertex", "label"), "labelled", most)
