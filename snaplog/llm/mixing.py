"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight, which fixes how many words the mix takes of it, and a schedule, which
fixes when. The schedule's weight is a function of training time 0..1, linear between knots; its
integral up to t, as a share of the whole, is the share of the source's words wanted by then. A
document stands at some offset in its source's stream of words (in an order drawn from a hash of
doc_id), and inverting the integral at that offset gives its training position. Sorting by range
of position then gives the training order.

Offsets are prefix sums in two levels: buckets of a source's hash range, sized by its row count,
are summed first, and a window runs within each bucket only. So a source that holds a third of all
rows is spread over as many tasks as it needs.

Defined results: a null text has size 0; a null source is a source of its own, last in order;
repeated rows count each; an empty table gives no rows; sources of size 0 have target 0; other
columns are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, words, written

#: Fixed by the contract: weights of sources in order of their names, repeating; share of all words; most of one source.
WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
#: Knots (time, weight) of the schedules, taken in the same order: early, late, level.
SCHEDULES = (((0.0, 2.0), (1.0, 0.5)), ((0.0, 0.5), (0.5, 1.0), (1.0, 2.0)), ((0.0, 1.0), (1.0, 1.0)))
ROWS_PER_BUCKET = 1_000


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row a source: source, rank (from 0), source_size, n_docs, target.

    Targets share ``share`` times all words by weight and stop at ``most`` times the source's size,
    the excess going to the others by weight. That fixed point fills all sources to one level (words
    per unit of weight): sort by the level at which each is full, and take the first one whose
    predecessors' full sizes leave a level below its own.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    # one row a source, not a document, is in these unpartitioned windows
    every = Window.partitionBy(F.lit(0))
    ranked = per.withColumn("rank", F.row_number().over(every.orderBy(F.col("source").isNull(), "source")) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("rank") % len(weights) + 1)).withColumn("cap", (F.col("source_size") * most).cast("double"))
    by_full = every.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, after = by_full.rowsBetween(Window.unboundedPreceding, -1), by_full.rowsBetween(0, Window.unboundedFollowing)
    levels = ranked.withColumn("left", F.sum("source_size").over(every) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("level", F.col("left") / F.sum("weight").over(after))
    chosen = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct((F.col("cap") / F.col("weight")).alias("full"), "rank", "level"))).over(every)
    return levels.withColumn("target", F.least("cap", F.coalesce(chosen["level"] * F.col("weight"), F.col("cap")))).select("source", "rank", "source_size", "n_docs", "target")


def position(share: Column, rank: Column, schedules: tuple = SCHEDULES) -> Column:
    """Training time 0..1 by which a source has been asked for this share of its words."""
    chosen = None
    for k, knots in enumerate(schedules):
        whole = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))
        done, pieces = 0.0, []
        for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
            part = (t1 - t0) * (w0 + w1) / 2
            rest, slope = share * F.lit(whole) - F.lit(done), (w1 - w0) / (t1 - t0)
            # w0 x + slope x^2 / 2 = rest, in the form that has no cancellation
            under = F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * rest, F.lit(0.0))
            below = F.lit(w0) + F.sqrt(under)
            pieces.append((done + part, F.lit(t0) + F.when(below > 0, F.lit(2.0) * rest / below).otherwise(F.lit(0.0))))
            done += part
        found = pieces[-1][1]
        for end, value in reversed(pieces[:-1]):
            found = F.when(share * F.lit(whole) <= F.lit(end), value).otherwise(found)
        chosen = F.when(rank % len(schedules) == k, found) if chosen is None else chosen.when(rank % len(schedules) == k, found)
    return F.least(F.greatest(chosen, F.lit(0.0)), F.lit(1.0))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST, schedules: tuple = SCHEDULES, whole: bool = False) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, taken, copies, positions.

    The mix runs through a source's stream of words until the target is met, again from the start
    where the target is above the source's size. Where it ends within a document, that one document
    of the source gives its first words only (``whole``: all or none of them, whichever is nearer).
    ``positions`` has the training position of each of the document's ``copies`` (0 to ``most``).
    """
    sizes = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words().alias("size")), "mix-sizes")
    targets = written(source_targets(sizes, weights, share, most).coalesce(1), "mix-targets")
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n_docs") / ROWS_PER_BUCKET))).cast("int")
    rows = sizes.alias("d").join(targets.alias("t"), F.expr("d.source <=> t.source")).select("doc_id", "d.source", "rank", "size", "source_size", "target", bits.alias("bits"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("drawn"))
    rows = rows.withColumn("bucket", F.expr("shiftright(cast(conv(substr(drawn, 1, 8), 16, 10) as long), 32 - bits)"))
    offsets = rows.groupBy("rank", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select("rank", "bucket", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("bucket_start"))
    within = Window.partitionBy("rank", "bucket").orderBy("drawn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(offsets, ["rank", "bucket"]).withColumn("start", F.col("bucket_start") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    goal = F.round("target").cast("long")
    starts = [F.col("start") + k * F.col("source_size") for k in range(most)]
    if whole:
        parts = [F.when(s + F.col("size") / 2 <= goal, F.col("size")).otherwise(F.lit(0)) for s in starts]
    else:
        parts = [F.greatest(F.least(goal - s, F.col("size")), F.lit(0)) for s in starts]
    taken = sum(parts[1:], parts[0]).cast("long")
    used = F.array_compact(F.array(*[F.when(p > 0, position(s / F.col("target"), F.col("rank"), schedules)) for p, s in zip(parts, starts)]))
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), F.size(used).alias("copies"), used.alias("positions"))


def training_order(mixed: DataFrame) -> DataFrame:
    """Rows of ``mix`` for each copy taken, with ``position`` and ``copy``, sorted by range of position."""
    each = mixed.select("*", F.posexplode("positions").alias("copy", "position"))
    return each.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id", "copy")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    first = mixed.select("doc_id", "size", "source_size", "target", "taken", F.get("positions", F.lit(0)).alias("first_position"))
    return first.repartitionByRange(F.col("first_position").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("first_position").asc_nulls_last(), "doc_id")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS drawn FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM d GROUP BY source
), w AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, CAST(2 * source_size AS DOUBLE) AS cap FROM s
), l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), c AS (
  SELECT level AS chosen FROM l WHERE level <= cap / weight ORDER BY cap / weight, rank LIMIT 1
), t AS (
  SELECT l.source, rank, source_size, least(cap, coalesce((SELECT chosen FROM c) * weight, cap)) AS target FROM l
), o AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.rank,
    CAST(coalesce(sum(d.size) OVER (PARTITION BY t.rank ORDER BY d.drawn, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), p AS (
  SELECT *, greatest(least(CAST(round(target) AS BIGINT) - start, size), 0) AS p0, greatest(least(CAST(round(target) AS BIGINT) - start - source_size, size), 0) AS p1 FROM o
), f AS (
  SELECT *, CASE WHEN p0 > 0 THEN start / target WHEN p1 > 0 THEN (start + source_size) / target END AS f FROM p
)
SELECT doc_id, size, source_size, target, CAST(p0 + p1 AS BIGINT) AS taken,
  CASE WHEN f IS NULL THEN NULL ELSE least(greatest(CASE rank % 3
    WHEN 0 THEN 0.0::DOUBLE + 2.0::DOUBLE * (f * 1.25::DOUBLE - 0.0::DOUBLE) / (2.0::DOUBLE + sqrt(greatest(4.0::DOUBLE + -3.0::DOUBLE * (f * 1.25::DOUBLE - 0.0::DOUBLE), 0.0::DOUBLE)))
    WHEN 1 THEN CASE WHEN f * 1.125::DOUBLE <= 0.375::DOUBLE
      THEN 0.0::DOUBLE + 2.0::DOUBLE * (f * 1.125::DOUBLE - 0.0::DOUBLE) / (0.5::DOUBLE + sqrt(greatest(0.25::DOUBLE + 2.0::DOUBLE * (f * 1.125::DOUBLE - 0.0::DOUBLE), 0.0::DOUBLE)))
      ELSE 0.5::DOUBLE + 2.0::DOUBLE * (f * 1.125::DOUBLE - 0.375::DOUBLE) / (1.0::DOUBLE + sqrt(greatest(1.0::DOUBLE + 4.0::DOUBLE * (f * 1.125::DOUBLE - 0.375::DOUBLE), 0.0::DOUBLE))) END
    ELSE 0.0::DOUBLE + 2.0::DOUBLE * (f * 1.0::DOUBLE - 0.0::DOUBLE) / (1.0::DOUBLE + sqrt(greatest(1.0::DOUBLE + 0.0::DOUBLE * (f * 1.0::DOUBLE - 0.0::DOUBLE), 0.0::DOUBLE))) END, 0.0::DOUBLE), 1.0::DOUBLE) END AS first_position
FROM f
"""

QUERIES = {"op8_mix_sources": op8_mix_sources}
ORACLES = {"op8_mix_sources": SQL}
