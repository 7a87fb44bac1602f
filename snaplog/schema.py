"""The one schema of the engine, and checks of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PUT, TOMBSTONE = 0, 1
#: No bound on the snapshot.
LATEST = 2**63 - 1

LOG = T.StructType([
    T.StructField("key", T.BinaryType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("kind", T.ByteType(), False),
    T.StructField("value", T.BinaryType(), True),
])
WRITES = T.StructType([
    T.StructField("ord", T.LongType(), False),
    T.StructField("key", T.BinaryType(), False),
    T.StructField("kind", T.ByteType(), False),
    T.StructField("value", T.BinaryType(), True),
])


def as_log(df: DataFrame) -> DataFrame:
    """``df`` with the log's columns and types; strings become their UTF-8 bytes. A tombstone has no value."""
    kind = F.col("kind").cast("byte")
    return df.select(F.col("key").cast("binary").alias("key"), F.col("seq").cast("long").alias("seq"), kind.alias("kind"), F.when(kind == PUT, F.col("value").cast("binary")).alias("value"))


def as_writes(df: DataFrame) -> DataFrame:
    kind = F.col("kind").cast("byte")
    return df.select(F.col("ord").cast("long").alias("ord"), F.col("key").cast("binary").alias("key"), kind.alias("kind"), F.when(kind == PUT, F.col("value").cast("binary")).alias("value"))


def violations(log: DataFrame) -> DataFrame:
    """Rows that break the schema's rules: an unknown kind, a null key, a live null value, a sequence number below 1."""
    return log.where(F.col("key").isNull() | F.col("seq").isNull() | (F.col("seq") < 1) | F.col("kind").isNull() | ~F.col("kind").isin(PUT, TOMBSTONE) | ((F.col("kind") == PUT) & F.col("value").isNull()))


def key_bytes(key: bytes | str | None) -> bytes:
    """A null key or value of a command is an empty one."""
    if key is None:
        return b""
    return key.encode() if isinstance(key, str) else bytes(key)
