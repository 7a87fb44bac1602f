"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents; each works on all
that its predecessor kept. Near-duplicate detection takes shingles of five words and a similarity of
0.8. Rows are told apart by a reference of their own where doc_id repeats or is null, so a stage's
decision about a row never touches another row. Empty input gives empty output at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snaplog.llm import mixing, ngram_join, packing, secrets, toxicity
from snaplog.llm.common import near, table, with_ref, written
from snaplog.sources.scratch import new_path, scope


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar scores 0.5 or more go; null and empty texts stay."""
    return toxicity.keep_clean(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents joined by similarity, the one of smallest doc_id stays. Texts without words are in no group."""
    rows = with_ref(docs)
    found = ngram_join.join_documents(rows.select(F.col("ref").alias("doc_id"), "row.text"), words=5, num=80, den=100)
    gone = written(found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("ref")), "copies", rows.count())
    return rows.join(near(gone), "ref", "left_anti").select("row.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found is replaced by [SECRET], and n_chars follows. No document goes."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, 0 to 2 times, whole, sorted by range of training position.

    The document in which a source's share ends is taken if more than half of it fits.
    """
    rows = with_ref(docs)
    mixed = mixing.mix(rows.select(F.col("ref").alias("doc_id"), "row.source", "row.text"), whole=True)
    placed = written(mixed.where(F.col("copies") > 0).select(F.col("doc_id").alias("ref"), F.explode("positions").alias("position")), "positions")
    each = rows.join(near(placed), "ref")
    return each.repartitionByRange("position", "ref").sortWithinPartitions("position", "ref").select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens; a copy of a document is packed like any other document."""
    pieces = packing.pack_documents(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("mix_sources", mix_sources),
    ("packing", pack_sequences),
]

#: Tokenizing, learning and components can't be said in SQL; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read again.

    What a stage wrote on its way is removed as soon as its result is there.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        with scope(spark):
            found = stage(spark, docs, sf_dir)
            found.write.parquet(path)
        docs = spark.read.schema(found.schema).parquet(path)
    return docs
