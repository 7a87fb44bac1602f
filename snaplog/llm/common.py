"""What several operators share: reading tables, the shared folder, written tables, tokenizing."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import new_path

#: White space is what these classes exclude: blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
DEFAULT_VOCABULARY = "byte_bpe_50k"
#: Narrow rows that one file may hold where the number of rows is known beforehand.
FILE_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, what: str, rows: int | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and survives lost executors.

    ``rows``: how many narrow rows it has at most. A small table then is few files, however many
    partitions a shuffle has; beyond FILE_ROWS a partition, nothing changes.
    """
    spark = df.sparkSession
    path = new_path(spark, what)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id and text (null: empty), and the columns named; anything else in ``docs`` is ignored."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *keep)


def as_rows(docs: DataFrame, *also: str) -> DataFrame:
    """``row`` (all columns of ``docs`` as a struct, out of the way of other names) and the columns named."""
    return docs.select(F.struct(*docs.columns).alias("row"), *also)


def with_ref(docs: DataFrame, *also: str) -> DataFrame:
    """``as_rows`` and ref: a unique long that ascends with doc_id (nulls first), then text.

    It is doc_id itself where that is unique and never null. Otherwise rows are sorted, numbered and
    written, so that numbers stay as they are when a task is run again.
    """
    own = F.col("doc_id").cast("long")
    if docs.where(own.isNull()).isEmpty() and docs.groupBy(own.alias("id")).count().where(F.col("count") > 1).isEmpty():
        return as_rows(docs.withColumn("doc_id", own), *also).withColumn("ref", F.col("row.doc_id"))
    ordered = docs.repartitionByRange(own, "text").sortWithinPartitions(own, "text")
    return written(as_rows(ordered, *also).withColumn("ref", F.monotonically_increasing_id()), "numbered")


def near(small: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``small`` to be broadcast if it has at most ``most`` rows; as it is (both sides shuffled) beyond. It must be written."""
    return F.broadcast(small) if small.count() <= most else small


def words(column: str = "text"):
    """Number of words of a text column, in the JVM."""
    return F.regexp_count(F.coalesce(F.col(column), F.lit("")), F.lit(WORD)).cast("long")


def bounded(batches: Iterator, most: int = 2 << 20) -> Iterator:
    """Arrow batches cut so that none holds much more than ``most`` bytes, one row at least."""
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        step = max(1, int(rows * most / max(1, batch.nbytes)))
        for at in range(0, rows, step):
            yield batch.slice(at, step)


#: A blank between two letters: no token of the vocabulary's pattern goes over it from the left, so texts may be encoded in two parts there.
SEAM = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")
LONG = 1 << 20


class Encoder:
    """Token ids of whole texts under a public byte-level BPE vocabulary, as the tokenizers library gives them.

    ``engine="tokenizers"`` is the library itself. ``engine="tiktoken"`` reads the same vocabulary
    as ranks and gives the same ids in much less time (README has figures, the tests compare both).
    Two kinds of texts go to the library all the same: those that hold the string of a special
    token, which the library reads as that token, and those on which tiktoken's regex gives up (a run
    of more than 1,000,000 white-space characters). A text of more than LONG characters is encoded
    in parts, cut at blanks between letters, where tokens end in any case; what has no such blank
    is encoded whole.
    """

    def __init__(self, vocabulary: str = DEFAULT_VOCABULARY, engine: str = "tiktoken"):
        import json

        import public_tokenizers

        if engine not in ("tokenizers", "tiktoken"):
            raise ValueError(f"unknown engine {engine!r}")
        self.file, self.library, self.ranks = public_tokenizers.path(f"{vocabulary}.json"), None, None
        if engine == "tiktoken":
            with open(self.file, encoding="utf-8") as found:
                self.special = {x["content"]: x["id"] for x in json.load(found)["added_tokens"]}
            self.ranks = _by_ranks(vocabulary, self.special, public_tokenizers)

    def __call__(self, text: str, *more: int):
        """An array (unsigned 32-bit) of the text's ids, then those of ``more``."""
        import numpy as np

        parts, at = [], 0
        while len(text) - at > LONG and (cut := SEAM.search(text, at + LONG)):
            parts.append(self._ids(text[at : cut.start()]))
            at = cut.start()
        parts.append(self._ids(text[at:] if at else text))
        return np.concatenate([*parts, np.array(more, dtype="<u4")])

    def _ids(self, text: str):
        import numpy as np

        if self.ranks is not None and not any(x in text for x in self.special):
            try:
                return self.ranks.encode_to_numpy(text, disallowed_special=())
            except BaseException as error:  # noqa: BLE001  a panic is no Exception, and its class can't be imported
                if type(error).__name__ != "PanicException" and "Regex error" not in str(error):
                    raise
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.file)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")


def _by_ranks(vocabulary: str, special: dict[str, int], public_tokenizers):
    import base64

    import tiktoken

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def encoder(vocabulary: str = DEFAULT_VOCABULARY, engine: str = "tiktoken") -> Encoder:
    """The Encoder of this process: a Python worker makes it once and keeps it for its later tasks."""
    import sys

    # functions come to workers by value, with globals of their own; what is to stay is kept in sys
    held = sys.__dict__.setdefault("_snaplog_encoders", {})
    if (vocabulary, engine) not in held:
        held[vocabulary, engine] = Encoder(vocabulary, engine)
    return held[vocabulary, engine]


def vocabulary_size(vocabulary: str = DEFAULT_VOCABULARY) -> int:
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json")).get_vocab_size(with_added_tokens=True)
