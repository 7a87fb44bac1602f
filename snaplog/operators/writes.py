"""Write-sets: what a transaction or batch would do, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import PUT, TOMBSTONE
from .versions import latest_seq, live


def last_writes(writes: DataFrame) -> DataFrame:
    """(key, kind, value): the last write of each key by ``ord``, of a write-set with repeated keys."""
    last = Window.partitionBy("key").orderBy(F.col("ord").desc())
    return writes.withColumn("_rank", F.row_number().over(last)).where(F.col("_rank") == 1).select("key", "kind", "value")


def delete_set(log: DataFrame, keys: DataFrame, snapshot: int) -> DataFrame:
    """(key): those of ``keys`` that exist at the snapshot, each once; their number is a delete's result."""
    wanted = keys.select(F.col("key").cast("binary").alias("key")).distinct()
    return live(log.join(wanted, "key", "left_semi"), snapshot).select("key")


def tombstones(keys: DataFrame) -> DataFrame:
    return keys.select("key", F.lit(TOMBSTONE).cast("byte").alias("kind"), F.lit(None).cast("binary").alias("value"))


def overlay(log: DataFrame, writes: DataFrame, snapshot: int) -> DataFrame:
    """(key, value) as a transaction sees it: its own writes (one a key) over the snapshot it reads."""
    own = writes.select("key", "kind", "value")
    return live(log, snapshot).join(own, "key", "left_anti").unionByName(own.where(F.col("kind") == PUT).select("key", "value"))


def conflicts(log: DataFrame, writes: DataFrame, read_seq: int) -> DataFrame:
    """(key, latest): written keys of which a version newer than ``read_seq`` exists, whatever its kind.

    Only the newer part of the log is read. Keys that were only read are not looked at: this is
    snapshot isolation, and write skew is possible.
    """
    newer = log.where(F.col("seq") > F.lit(read_seq))
    return latest_seq(newer.join(writes.select("key").distinct(), "key", "left_semi"))


def stamp_batch(writes: DataFrame, last_seq: int) -> DataFrame:
    """A batch as log rows: one new sequence number for all of it."""
    return writes.select("key", F.lit(last_seq + 1).cast("long").alias("seq"), F.col("kind").cast("byte").alias("kind"), "value")


def stamp_each(writes: DataFrame, last_seq: int, rows_a_window: int = 100_000) -> DataFrame:
    """Ordered single writes as log rows: each its own sequence number, in order of ``ord`` (which must be unique).

    Numbers are prefix sums over ranges of ord: rows are counted by bucket of ord, one row a bucket is
    summed, and a window runs within each bucket, so no task sees all rows.
    """
    count, low, high = writes.agg(F.count(F.lit(1)), F.min("ord"), F.max("ord")).first()
    width = max(1, ((high or 0) - (low or 0) + 1) * rows_a_window // max(1, count))
    rows = writes.withColumn("_bucket", F.floor((F.col("ord") - F.lit(low or 0)) / F.lit(width)))
    before = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy("ord"))
    return rows.join(starts, "_bucket").select("key", (F.lit(last_seq).cast("long") + F.col("_start") + place).alias("seq"), F.col("kind").cast("byte").alias("kind"), "value")
