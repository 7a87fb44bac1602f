"""Ordered commands from a stream, applied to a store: one code path with batches.

Each micro-batch becomes one commit; the manifest holds the last batch number of each stream, so a
batch that Spark delivers again after a failure changes nothing. A source must be ordered by ``ord``
across batches, as a replicated command log is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import command_name
from ..schema import PUT, TOMBSTONE
from ..sources.store import Store


def commands_to_writes(commands: DataFrame) -> DataFrame:
    """(ord, arguments) to (ord, key, kind, value): SET and DEL, which may name several keys; other commands are ignored.

    A DEL's keys get their own places after it: ord grows by 2 ** 20 a command.
    """
    name = command_name(F.col("arguments"))
    count = F.size("arguments")
    put = commands.where((name == "SET") & (count == 3)).select((F.col("ord") * (1 << 20)).alias("ord"), F.get("arguments", F.lit(1)).alias("key"), F.lit(PUT).alias("kind"), F.get("arguments", F.lit(2)).alias("value"))
    gone = commands.where((name == "DEL") & (count > 1)).select("ord", F.posexplode(F.slice("arguments", 2, F.size("arguments") - 1)).alias("place", "key"))
    return put.unionByName(gone.select((F.col("ord") * (1 << 20) + F.col("place")).alias("ord"), "key", F.lit(TOMBSTONE).alias("kind"), F.lit(None).cast("string").alias("value")))


def apply_stream(commands: DataFrame, store: Store, name: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Applies a streaming DataFrame (ord, arguments) to the store; ``trigger`` as for writeStream, availableNow by default."""

    def batch(rows: DataFrame, number: int) -> None:
        store.apply_ordered(commands_to_writes(rows), stream=name, batch=number)

    return commands.writeStream.foreachBatch(batch).queryName(name).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
