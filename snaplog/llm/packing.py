"""Packing: concatenate all documents and cut the stream into windows of fixed length.

Pass one encodes every document once and writes its ids with its offset within the partition.
Partition totals, summed in order of partition, give each partition's offset in the whole stream
(one row a partition). Pass two adds the two and cuts each document at the windows' bounds; a
document that crosses a bound gives one boundary record a window. No row is shuffled, only the
last window of all has padding.

Defined results: a null or empty text is its end id alone; rows that repeat a doc_id are packed
each; an empty table gives no rows; other columns are ignored whatever their names. A very long text
is encoded in parts that give the ids of the whole (see Encoder), and cut like any other. A lost
executor costs its tasks only: pass two reads what pass one committed, so offsets never change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import DEFAULT_VOCABULARY, bounded, encoder, table, texts, written

LENGTH, END = 2048, 1


def encoded(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, engine: str = "tiktoken", end: int = END) -> DataFrame:
    """doc_id, part, start_in_part, n_tokens, ids (binary, unsigned 32-bit little-endian, with the end id)."""

    def encode(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        own, part, start = encoder(vocabulary, engine), TaskContext.get().partitionId(), 0
        for batch in bounded(batches):
            ids = [own(text, end) for text in batch.column(1).to_pylist()]
            sizes = np.array([len(x) for x in ids], dtype=np.int64)
            starts = start + np.cumsum(sizes) - sizes
            start += int(sizes.sum())
            columns = [batch.column(0), *map(pa.array, (np.full(len(ids), part), starts, sizes)), pa.array([x.tobytes() for x in ids], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "start_in_part", "n_tokens", "ids"])

    return texts(docs).mapInArrow(encode, "doc_id long, part long, start_in_part long, n_tokens long, ids binary")


def pack(tokens: DataFrame, length: int = LENGTH) -> DataFrame:
    """Pieces of what ``encoded`` gave: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    ``tokens`` must be a written table: it is read twice and must not change between the passes.
    """
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # as many rows as pass one had partitions, so broadcasting them is safe at any size of input
    starts = totals.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("part_start"))
    placed = tokens.join(F.broadcast(starts), "part").select("doc_id", (F.col("part_start") + F.col("start_in_part")).alias("at"), "n_tokens", "ids")

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        for batch in bounded(batches):
            at, n = (batch.column(k).to_numpy() for k in (1, 2))
            first, last = at // length, (at + n - 1) // length
            pieces = last - first + 1
            row = np.repeat(np.arange(len(n)), pieces)
            window = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            low, high = np.maximum(at[row], window * length), np.minimum((at + n)[row], (window + 1) * length)
            start, size = low - at[row], high - low
            held = [x.as_py() for x in batch.column(3)]
            ids = [held[r][4 * s : 4 * (s + k)] for r, s, k in zip(row.tolist(), start.tolist(), size.tolist())]
            columns = [batch.column(0).take(pa.array(row)), *map(pa.array, (start, size, n[row], window, low - window * length)), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    pieces = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return placed.mapInArrow(cut, pieces)


def pack_documents(docs: DataFrame, length: int = LENGTH, vocabulary: str = DEFAULT_VOCABULARY, engine: str = "tiktoken", end: int = END) -> DataFrame:
    return pack(written(encoded(docs, vocabulary, engine, end), "packing"), length)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op3_packing": op3_packing}
ORACLES: dict[str, str] = {}
