"""Token ids in binary files of fixed-width packed ids.

A file holds shards, one after another (integers of a head are big-endian, the rest little-endian):

    "SLTK", version u8, bits u8, u16 0, partition u32, number in the partition u32,
    tokens of the partition before u64, tokens u64, documents u32, blocks u32, tokens a block u32, bytes of the body u64
    body: doc ids i64[documents], known u8[documents] (0: doc_id is null), starts u64[documents + 1] (tokens),
          block offsets u64[blocks + 1] (bytes, in the packed ids), packed ids, crc32 u32 of the body before it
    one byte 0x0A

An id takes the fewest bits that hold the whole vocabulary, lowest bit first; each block starts at a
byte, so a reader finds token i in block i // tokens-a-block at once and unpacks it with numpy.

Documents are sorted by range of doc_id (nulls first), so partitions and shards are in ascending
order. Writing goes through Spark's text sink, one record a shard: the bytes reach any store that
Spark can write, under its commit protocol, and ``binaryFile`` reads them back. The same pass writes
each partition's number of tokens as a line of its own file, in another folder (kind=totals), so that
files of tokens are read once. A shard holds about SHARD tokens, or one document if that is longer,
and a file FILE shards at most: what a task holds is bounded by these two and its longest document.

Defined results: a null or empty text is its end id alone; rows that repeat a doc_id are written
each; an empty table gives no rows; other columns are ignored. A very long text is encoded in parts
that give the ids of the whole (see Encoder), and has a shard of its own.
"""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import new_path
from .common import DEFAULT_VOCABULARY, bounded, encoder, table, texts, vocabulary_size

MAGIC, VERSION, END = b"SLTK", 1, 0
HEAD = ">4sBBHIIQQIIIQ"
BLOCK, SHARD, FILE = 4096, 1 << 18, 32
#: Bytes of ids in one batch of rows that a reader makes.
BATCH = 1 << 20


def width(size: int) -> int:
    """The fewest bits for ids 0 .. size - 1."""
    return max(1, (size - 1).bit_length())


def pack_bits(ids, bits: int) -> bytes:
    import numpy as np

    flat = np.unpackbits(np.ascontiguousarray(ids, dtype="<u4").view(np.uint8), bitorder="little").reshape(-1, 32)[:, :bits]
    return np.packbits(flat.ravel(), bitorder="little").tobytes()


def unpack_bits(data, bits: int, count: int):
    import numpy as np

    flat = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    whole = np.zeros((count, 32), dtype=np.uint8)
    whole[:, :bits] = flat
    return np.packbits(whole.ravel(), bitorder="little").view("<u4")


def write_shard(doc_ids: list, arrays: list, bits: int, partition: int = 0, number: int = 0, before: int = 0, block: int = BLOCK) -> bytearray:
    """A shard's bytes, filled in place: besides them, one block's ids are unpacked at a time."""
    import numpy as np

    n = len(arrays)
    starts = np.zeros(n + 1, dtype="<u8")
    np.cumsum([len(a) for a in arrays], out=starts[1:])
    tokens = int(starts[-1])
    blocks = -(-tokens // block)
    offsets = np.arange(blocks + 1, dtype="<u8") * (-(-block * bits // 8))
    if blocks:
        offsets[-1] = offsets[-2] + -(-(tokens - (blocks - 1) * block) * bits // 8)
    head = struct.calcsize(HEAD)
    tables = [np.array([x or 0 for x in doc_ids], dtype="<i8"), np.array([x is not None for x in doc_ids], dtype=np.uint8), starts, offsets]
    size = sum(t.nbytes for t in tables) + int(offsets[-1])
    out = bytearray(head + size + 5)
    struct.pack_into(HEAD, out, 0, MAGIC, VERSION, bits, 0, partition, number, before, tokens, n, blocks, block, size + 4)
    at = head
    for t in tables:
        out[at : at + t.nbytes] = t.tobytes()
        at += t.nbytes
    ids = arrays[0] if n == 1 else np.concatenate([np.zeros(0, dtype="<u4"), *arrays])
    if tokens and int(ids.max()) >> bits:
        raise ValueError(f"an id does not fit {bits} bits")
    for k in range(blocks):
        low = at + int(offsets[k])
        out[low : at + int(offsets[k + 1])] = pack_bits(ids[k * block : (k + 1) * block], bits)
    struct.pack_into("<I", out, head + size, zlib.crc32(memoryview(out)[head : head + size]))
    out[-1] = 10
    return out


class Shard:
    """A shard's bytes, read at random: document k, or any range of tokens."""

    def __init__(self, data, check: bool = True):
        import numpy as np

        view = memoryview(data)
        head = struct.unpack_from(HEAD, view)
        self.bits, self.partition, self.number, self.before = head[2], *head[4:7]
        self.tokens, self.documents, blocks, self.block, size = head[7:]
        if head[0] != MAGIC or head[1] != VERSION:
            raise ValueError("not a token file of this version")
        body = view[struct.calcsize(HEAD) : struct.calcsize(HEAD) + size]
        self.nbytes = struct.calcsize(HEAD) + size + 1
        if len(body) != size or check and zlib.crc32(body[:-4]) != struct.unpack("<I", body[-4:])[0]:
            raise ValueError("a token file is damaged")
        at, n = 0, self.documents

        def take(kind: str, count: int):
            nonlocal at
            out = np.frombuffer(body, dtype=kind, count=count, offset=at)
            at += out.nbytes
            return out

        self.doc_ids, self.known = take("<i8", n), take("u1", n)
        self.starts, self.offsets = take("<u8", n + 1).astype(np.int64), take("<u8", blocks + 1).astype(np.int64)
        self.packed = body[at:-4]

    def range(self, low: int, high: int):
        """Ids of tokens low .. high - 1; reads the blocks that hold them only."""
        import numpy as np

        if high <= low:
            return np.zeros(0, dtype="<u4")
        first, last = low // self.block, (high - 1) // self.block
        if self.block * self.bits % 8 == 0:  # then blocks but the last have no bits between them
            count = min((last + 1) * self.block, self.tokens) - first * self.block
            ids = unpack_bits(self.packed[self.offsets[first] : self.offsets[last + 1]], self.bits, count)
        else:
            ids = np.concatenate([unpack_bits(self.packed[self.offsets[k] : self.offsets[k + 1]], self.bits, min(self.block, self.tokens - k * self.block)) for k in range(first, last + 1)])
        return ids[low - first * self.block : high - first * self.block]

    def document(self, k: int):
        return self.range(int(self.starts[k]), int(self.starts[k + 1]))


def shards(data):
    """The shards of a file's bytes, one after another."""
    view, at = memoryview(data), 0
    while at < len(view):
        own = Shard(view[at:])
        yield own
        at += own.nbytes


def write_token_files(
    docs: DataFrame, path: str, vocabulary: str = DEFAULT_VOCABULARY, engine: str = "tiktoken", end: int = END, shard: int = SHARD, in_file: int = FILE
) -> None:
    """Writes shards of all documents, in ascending order of doc_id, and each partition's total, under ``path``."""
    bits = width(vocabulary_size(vocabulary))

    def encode(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        own, partition = encoder(vocabulary, engine), TaskContext.get().partitionId()
        doc_ids, arrays, held, before, number = [], [], 0, 0, 0

        def row(kind: str, record):
            return pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([record], pa.binary())], names=["kind", "record"])

        for batch in bounded(batches):
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                doc_ids.append(doc_id.as_py())
                arrays.append(own(text.as_py(), end))
                held += len(arrays[-1])
                if held >= shard:
                    yield row("shards", bytes(memoryview(write_shard(doc_ids, arrays, bits, partition, number, before))[:-1]))
                    before, number = before + held, number + 1
                    doc_ids, arrays, held = [], [], 0
        if arrays:
            yield row("shards", bytes(memoryview(write_shard(doc_ids, arrays, bits, partition, number, before))[:-1]))
        if before + held:
            yield row("totals", f"{partition} {before + held}".encode())

    ordered = texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    records = ordered.mapInArrow(encode, "kind string, record binary")
    # the sink ends each record with 0x0A, which is a shard's last byte
    lines = records.select("kind", F.col("record").cast("string").alias("value"))
    lines.write.partitionBy("kind").option("maxRecordsPerFile", in_file).text(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (tokens of all documents before it), n_tokens, ids (binary, unsigned 32-bit little-endian)."""
    files = spark.read.format("binaryFile").load(path)
    kinds = "doc_id long, partition long, start long, n_tokens long, ids binary"
    if "kind" not in files.columns:  # nothing was written
        return spark.createDataFrame([], kinds).drop("partition")
    lines = F.explode(F.split(F.col("content").cast("string"), "\n"))
    totals = files.where(F.col("kind") == "totals").select(lines.alias("line")).where(F.col("line") != "")
    part = lambda k: F.split(F.col("line"), " ")[k].cast("long")
    totals = totals.select(part(0).alias("partition"), part(1).alias("tokens"))
    before = Window.partitionBy(F.lit(0)).orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)
    # one row a partition of the writing job, so broadcasting them is safe at any size of input
    starts = totals.select("partition", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("first"))

    def parse(batches):
        import numpy as np
        import pyarrow as pa

        for batch in bounded(batches):
            for own in (s for content in batch.column(0) for s in shards(content.as_buffer())):
                low = 0
                while low < own.documents:
                    high = max(low + 1, int(np.searchsorted(own.starts, own.starts[low] + BATCH // 4, side="right")) - 1)
                    s = own.starts[low : high + 1]
                    data = own.range(int(s[0]), int(s[-1])).tobytes()
                    cuts = ((s - s[0]) * 4).tolist()
                    yield pa.RecordBatch.from_arrays([
                        pa.array(own.doc_ids[low:high], mask=own.known[low:high] == 0), pa.array(np.full(high - low, own.partition)),
                        pa.array(s[:-1] + own.before), pa.array(s[1:] - s[:-1]), pa.array([data[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary()),
                    ], names=["doc_id", "partition", "start", "n_tokens", "ids"])
                    low = high

    rows = files.where(F.col("kind") == "shards").select("content").mapInArrow(parse, kinds)
    return rows.join(F.broadcast(starts), "partition").select("doc_id", (F.col("start") + F.col("first")).alias("start"), "n_tokens", "ids")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op4_token_files": op4_token_files}
ORACLES: dict[str, str] = {}
