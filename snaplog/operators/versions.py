"""Reads of a version log: pure functions from DataFrame to DataFrame.

The order of steps is the whole point. ``seq <= S`` is applied below the choice of each key's newest
version, and reaches the scan. ``kind`` is looked at above it: a tombstone must win first and be
dropped then. Predicates on ``key`` may stand above or below, since key is what the choice partitions
by, and Catalyst moves them to the scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import entry_bytes
from ..schema import LATEST, PUT, key_bytes


def visible(log: DataFrame, snapshot: int = LATEST) -> DataFrame:
    """The newest version of each key at the snapshot, tombstones included.

    row_number() = 1 lets Spark keep one row a key in each task before the exchange.
    """
    seen = log if snapshot >= LATEST else log.where(F.col("seq") <= F.lit(snapshot))
    newest = Window.partitionBy("key").orderBy(F.col("seq").desc())
    return seen.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") == 1).drop("_rank")


def live(log: DataFrame, snapshot: int = LATEST) -> DataFrame:
    """(key, value) of the keys that exist at the snapshot."""
    return visible(log, snapshot).where(F.col("kind") == PUT).select("key", "value")


def get(log: DataFrame, key: bytes | str, snapshot: int = LATEST) -> DataFrame:
    """At most one row (key, value). The limit comes before the tombstone test."""
    seen = log.where(F.col("key") == F.lit(key_bytes(key)))
    seen = seen if snapshot >= LATEST else seen.where(F.col("seq") <= F.lit(snapshot))
    return seen.orderBy(F.col("seq").desc()).limit(1).where(F.col("kind") == PUT).select("key", "value")


def multi_get(log: DataFrame, keys: DataFrame, snapshot: int = LATEST) -> DataFrame:
    """(key, value) of those of ``keys`` (column key, repeats ignored) that exist: get for a whole set.

    The keys cut the log before the newest versions are chosen. Which side moves is Spark's choice by size.
    """
    wanted = keys.select(F.col("key").cast("binary").alias("key")).distinct()
    return live(log.join(wanted, "key", "left_semi"), snapshot)


def range_scan(log: DataFrame, low: bytes | str, high: bytes | str, limit: int = 0, snapshot: int = LATEST) -> DataFrame:
    """(key, value) with low <= key <= high, by bytes, ascending; the first ``limit`` of them if it is above 0.

    An inverted range is empty. The limit counts keys that exist, so it stands above everything else.
    """
    if limit < 0:
        raise ValueError("a limit is 0 or more")
    found = live(log.where(F.col("key").between(F.lit(key_bytes(low)), F.lit(key_bytes(high)))), snapshot).orderBy("key")
    return found.limit(limit) if limit else found


def latest_seq(log: DataFrame) -> DataFrame:
    """(key, latest): the newest sequence number of each key; tombstones count."""
    return log.groupBy("key").agg(F.max("seq").alias("latest"))


def retain(log: DataFrame, boundary: int) -> DataFrame:
    """The versions that some snapshot at or above ``boundary`` can need.

    Of each key: all versions above the boundary, and of the others the newest unless it is a tombstone. The
    log must be the whole log: in a part of it a tombstone may still hide older versions elsewhere.
    """
    old = F.col("seq") <= F.lit(boundary)
    rank = F.row_number().over(Window.partitionBy("key", old).orderBy(F.col("seq").desc()))
    return log.withColumn("_rank", rank).where(~old | ((F.col("_rank") == 1) & (F.col("kind") == PUT))).drop("_rank")


def union_runs(*runs: DataFrame) -> DataFrame:
    """One log of several runs. Their order has no meaning: seq alone decides."""
    return reduce(DataFrame.unionByName, runs)


def distinct_versions(log: DataFrame) -> DataFrame:
    """One row for each (key, seq), for logs whose writer may have stored a batch twice."""
    return log.dropDuplicates(["key", "seq"])


def version_order(log: DataFrame) -> DataFrame:
    """All versions, by key ascending, then newest first."""
    return log.orderBy("key", F.col("seq").desc())


def tail_bytes(log: DataFrame) -> DataFrame:
    """One row (bytes): key and value bytes of a log, which tells when to roll it up."""
    return log.agg(F.coalesce(F.sum(entry_bytes(F.col("key"), F.col("value"))), F.lit(0)).cast("long").alias("bytes"))


def run_stats(log: DataFrame, *by: str) -> DataFrame:
    """rows, min_key, max_key, max_seq, bytes of the log, or of each group of it."""
    return log.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.max("seq").alias("max_seq"), F.sum(entry_bytes(F.col("key"), F.col("value"))).cast("long").alias("bytes"))
