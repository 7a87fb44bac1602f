"""Queries over logs derived from the test tables, each with its SQL.

Two logs: of events (few keys, many versions, tombstones at errors) and of orders (many keys, few
versions). Keys and values are binary in the engine and strings in results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import command_name, inline_arguments, padded_key
from ..operators import versions, writes
from ..schema import as_log, as_writes

LOW, HIGH = "u00000010", "u00000050"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", 1).otherwise(0)
    return as_log(_table(spark, sf_dir, "events").select(padded_key("u", F.col("user_id"), 8).alias("key"), (F.col("event_id") + 1).alias("seq"), kind.alias("kind"), F.col("props").alias("value")))


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 5 == 0), 1).otherwise(0)
    return as_log(_table(spark, sf_dir, "orders").select(padded_key("c", F.col("o_custkey"), 9).alias("key"), (F.col("o_orderkey") + 1).alias("seq"), kind.alias("kind"), F.col("o_orderpriority").alias("value")))


def _count(spark: SparkSession, sf_dir: str) -> int:
    return _table(spark, sf_dir, "events").count()


def _share(spark: SparkSession, sf_dir: str, thousandths: int) -> int:
    return _count(spark, sf_dir) * thousandths // 1000


def shown(df: DataFrame) -> DataFrame:
    """Binary columns as strings, and kind as an integer."""
    return df.select(*[F.col(n).cast("string").alias(n) if t == "binary" else F.col(n).cast("int").alias(n) if n == "kind" else F.col(n) for n, t in df.dtypes])


def _keys(spark: SparkSession, *keys: str) -> DataFrame:
    return spark.createDataFrame([(k,) for k in keys], "key string").select(F.col("key").cast("binary").alias("key"))


WANTED = ("u00000003", "u00000010", "u00000010", "u00000012", "u00000014", "u99999999")
DELETED = ("u00000001", "u00000002", "u00000003", "u00000004", "u00000005", "u00000005", "u99999999")
#: ord, key, kind, value: a put on a live key, a delete, a delete of an absent key, a new key, two writes of one key.
WRITES = ((1, "u00000010", 0, "own-10"), (2, "u00000011", 1, None), (3, "u99999999", 1, None), (4, "v-new", 0, "fresh"), (5, "u00000012", 0, "first"), (6, "u00000012", 0, "last"), (7, "u00000013", 0, "gone"), (8, "u00000013", 1, None))


def _writes(spark: SparkSession) -> DataFrame:
    return as_writes(spark.createDataFrame(WRITES, "ord long, key string, kind int, value string"))


def _runs(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    log, a, b = event_log(spark, sf_dir), _share(spark, sf_dir, 300), _share(spark, sf_dir, 700)
    return [log.where(F.col("seq") <= a), log.where((F.col("seq") > a) & (F.col("seq") <= b)), log.where(F.col("seq") > b)]


def live_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(versions.live(event_log(spark, sf_dir)))


def live_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(versions.live(event_log(spark, sf_dir), _share(spark, sf_dir, 800)))


def get_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(versions.get(event_log(spark, sf_dir), LOW))


def get_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of the first ten keys, some of whose newest versions are tombstones, as one set."""
    return shown(versions.multi_get(event_log(spark, sf_dir), _keys(spark, *[f"u{k:08d}" for k in range(10)])))


def multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(versions.multi_get(event_log(spark, sf_dir), _keys(spark, *WANTED)))


def range_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(versions.range_scan(event_log(spark, sf_dir), LOW, HIGH))


def range_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(versions.range_scan(event_log(spark, sf_dir), LOW, HIGH, 5))


def range_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(versions.range_scan(event_log(spark, sf_dir), LOW, HIGH, 7, _share(spark, sf_dir, 500)))


def range_inverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(versions.range_scan(event_log(spark, sf_dir), HIGH, LOW))


def range_multi_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(versions.range_scan(versions.union_runs(*reversed(_runs(spark, sf_dir))), LOW, HIGH))


def latest_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(versions.latest_seq(event_log(spark, sf_dir)))


def newest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(versions.visible(event_log(spark, sf_dir)))


def retain_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(versions.retain(event_log(spark, sf_dir), _count(spark, sf_dir)))


def retain_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(versions.retain(event_log(spark, sf_dir), _share(spark, sf_dir, 500)))


def asof_after_retain(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = versions.retain(event_log(spark, sf_dir), _share(spark, sf_dir, 500))
    return shown(versions.live(kept, _share(spark, sf_dir, 800)))


def delete_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(writes.delete_set(event_log(spark, sf_dir), _keys(spark, *DELETED), _count(spark, sf_dir)))


def delete_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writes.delete_set(event_log(spark, sf_dir), _keys(spark, *DELETED), _count(spark, sf_dir)).agg(F.count(F.lit(1)).alias("deleted"))


def txn_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(writes.overlay(event_log(spark, sf_dir), writes.last_writes(_writes(spark)), _share(spark, sf_dir, 800)))


def txn_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a transaction that wrote every key and an absent one."""
    log = event_log(spark, sf_dir)
    keys = log.select("key").unionByName(_keys(spark, "u99999999"))
    return shown(writes.conflicts(log, keys, _share(spark, sf_dir, 999)))


def commit_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All live pairs after a batch was committed at one sequence number."""
    batch = writes.stamp_batch(writes.last_writes(_writes(spark)), _count(spark, sf_dir))
    return shown(versions.live(versions.union_runs(event_log(spark, sf_dir), batch)))


def delete_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, last = event_log(spark, sf_dir), _count(spark, sf_dir)
    batch = writes.stamp_batch(writes.tombstones(writes.delete_set(log, _keys(spark, *DELETED), last)), last)
    return shown(versions.live(versions.union_runs(log, batch)))


def ordered_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log after ordered single writes, each with its own sequence number: what was appended."""
    return shown(writes.stamp_each(_writes(spark), _count(spark, sf_dir)))


def write_set_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_log(spark, sf_dir).withColumnRenamed("seq", "ord")
    return shown(writes.last_writes(rows))


def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _share(spark, sf_dir, 300), _share(spark, sf_dir, 700)
    run = F.when(F.col("seq") <= a, "run-1").when(F.col("seq") <= b, "run-2").otherwise("tail")
    return shown(versions.run_stats(event_log(spark, sf_dir).withColumn("run", run), "run"))


def recover_last_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.union_runs(*_runs(spark, sf_dir)).agg(F.max("seq").alias("last_seq"))


def tail_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.tail_bytes(_runs(spark, sf_dir)[-1])


def duplicate_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tail that was flushed and kept: its rows stand twice and count once."""
    runs = _runs(spark, sf_dir)
    return shown(versions.distinct_versions(versions.union_runs(*runs, runs[-1])).groupBy("key").agg(F.count(F.lit(1)).alias("versions")))


def version_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(versions.version_order(event_log(spark, sf_dir)))


def parse_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("  set "), padded_key("u", F.col("user_id"), 8), F.lit("   "), F.col("event_type"), F.lit(" "))
    words = _table(spark, sf_dir, "events").select("event_id", inline_arguments(line).alias("words"))
    return words.select("event_id", command_name(F.col("words")).alias("name"), F.size("words").cast("long").alias("n"), F.array_join("words", "|").alias("words"))


def orders_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(versions.live(order_log(spark, sf_dir)))


def orders_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(versions.range_scan(order_log(spark, sf_dir), "c000000100", "c000000200", 50))


def orders_retain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(versions.retain(order_log(spark, sf_dir), 10_000))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        live_now, live_asof, get_point, get_deleted, multi_get, range_all, range_limit, range_asof, range_inverted, range_multi_run, latest_seq, newest_versions,
        retain_all, retain_held, asof_after_retain, delete_set, delete_count, txn_overlay, txn_conflicts, commit_apply, delete_apply, ordered_apply,
        write_set_dedupe, run_stats, recover_last_seq, tail_size, duplicate_versions, version_dump, parse_inline, orders_live, orders_range, orders_retain,
    )
}

_LOG = """e AS (
  SELECT 'u' || lpad(CAST(user_id AS VARCHAR), 8, '0') AS key, event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS kind,
    CASE WHEN event_type = 'error' THEN NULL ELSE props END AS value FROM events
), n AS (SELECT count(*) AS n FROM events)"""
_ORDERS = """o AS (
  SELECT *, CASE WHEN kind = 0 THEN v END AS value FROM (
    SELECT 'c' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS key, o_orderkey + 1 AS seq, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS kind, o_orderpriority AS v FROM orders)
)"""


def _values(rows: tuple) -> str:
    text = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else f"'{x}'"
    return ", ".join(f"({', '.join(map(text, r if isinstance(r, tuple) else (r,)))})" for r in rows)


def _live(source: str = "e", where: str = "true") -> str:
    return f"SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM {source} WHERE {where}) WHERE r = 1 AND kind = 0"


def _at(thousandths: int) -> str:
    return f"(SELECT n * {thousandths} // 1000 FROM n)"


def _retain(source: str, boundary: str) -> str:
    return f"SELECT key, seq, kind, value FROM (SELECT *, row_number() OVER (PARTITION BY key, seq <= {boundary} ORDER BY seq DESC) AS r FROM {source}) WHERE seq > {boundary} OR (r = 1 AND kind = 0)"


_W = f"w0 AS (SELECT * FROM (VALUES {_values(WRITES)}) AS t(ord, key, kind, value)), w AS (SELECT key, kind, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ord DESC) AS r FROM w0) WHERE r = 1)"
_DELETE = f"SELECT key FROM ({_live()}) WHERE key IN (SELECT k FROM (VALUES {_values(DELETED)}) AS t(k))"
_BETWEEN = f"key BETWEEN '{LOW}' AND '{HIGH}'"

ORACLES: dict[str, str] = {
    "live_now": f"WITH {_LOG} {_live()}",
    "live_asof": f"WITH {_LOG} {_live(where=f'seq <= {_at(800)}')}",
    "get_point": f"WITH {_LOG} SELECT * FROM ({_live()}) WHERE key = '{LOW}'",
    "get_deleted": f"WITH {_LOG} SELECT * FROM ({_live()}) WHERE key BETWEEN 'u00000000' AND 'u00000009'",
    "multi_get": f"WITH {_LOG} SELECT * FROM ({_live()}) WHERE key IN (SELECT k FROM (VALUES {_values(WANTED)}) AS t(k))",
    "range_all": f"WITH {_LOG} SELECT * FROM ({_live()}) WHERE {_BETWEEN}",
    "range_limit": f"WITH {_LOG} SELECT * FROM ({_live()}) WHERE {_BETWEEN} ORDER BY key LIMIT 5",
    "range_asof": f"WITH {_LOG} SELECT * FROM ({_live(where=f'seq <= {_at(500)}')}) WHERE {_BETWEEN} ORDER BY key LIMIT 7",
    "range_inverted": f"WITH {_LOG} SELECT * FROM ({_live()}) WHERE key BETWEEN '{HIGH}' AND '{LOW}'",
    "range_multi_run": f"WITH {_LOG} SELECT * FROM ({_live()}) WHERE {_BETWEEN}",
    "latest_seq": f"WITH {_LOG} SELECT key, max(seq) AS latest FROM e GROUP BY key",
    "newest_versions": f"WITH {_LOG} SELECT key, seq, kind, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM e) WHERE r = 1",
    "retain_all": f"WITH {_LOG} {_retain('e', '(SELECT n FROM n)')}",
    "retain_held": f"WITH {_LOG} {_retain('e', _at(500))}",
    "asof_after_retain": f"WITH {_LOG} {_live(where=f'seq <= {_at(800)}')}",
    "delete_set": f"WITH {_LOG} {_DELETE}",
    "delete_count": f"WITH {_LOG} SELECT count(*) AS deleted FROM ({_DELETE})",
    "txn_overlay": f"WITH {_LOG}, {_W} SELECT * FROM ({_live(where=f'seq <= {_at(800)}')}) WHERE key NOT IN (SELECT key FROM w) UNION ALL SELECT key, value FROM w WHERE kind = 0",
    "txn_conflicts": f"WITH {_LOG} SELECT key, max(seq) AS latest FROM e GROUP BY key HAVING max(seq) > {_at(999)}",
    "commit_apply": f"WITH {_LOG}, {_W}, u AS (SELECT * FROM e UNION ALL SELECT key, (SELECT n + 1 FROM n), kind, value FROM w) {_live('u')}",
    "delete_apply": f"WITH {_LOG} SELECT * FROM ({_live()}) WHERE key NOT IN (SELECT k FROM (VALUES {_values(DELETED)}) AS t(k))",
    "ordered_apply": f"WITH {_LOG}, {_W} SELECT key, (SELECT n FROM n) + row_number() OVER (ORDER BY ord) AS seq, kind, value FROM w0",
    "write_set_dedupe": f"WITH {_LOG} SELECT key, kind, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM e) WHERE r = 1",
    "run_stats": f"WITH {_LOG} SELECT CASE WHEN seq <= {_at(300)} THEN 'run-1' WHEN seq <= {_at(700)} THEN 'run-2' ELSE 'tail' END AS run, count(*) AS rows, min(key) AS min_key, max(key) AS max_key, max(seq) AS max_seq, CAST(sum(strlen(key) + coalesce(strlen(value), 0)) AS BIGINT) AS bytes FROM e GROUP BY ALL",
    "recover_last_seq": f"WITH {_LOG} SELECT max(seq) AS last_seq FROM e",
    "tail_size": f"WITH {_LOG} SELECT CAST(coalesce(sum(strlen(key) + coalesce(strlen(value), 0)), 0) AS BIGINT) AS bytes FROM e WHERE seq > {_at(700)}",
    "duplicate_versions": f"WITH {_LOG} SELECT key, count(*) AS versions FROM e GROUP BY key",
    "version_dump": f"WITH {_LOG} SELECT key, seq, kind, value FROM e",
    "parse_inline": "SELECT event_id, upper(w[1]) AS name, CAST(len(w) AS BIGINT) AS n, array_to_string(w, '|') AS words FROM (SELECT event_id, [x FOR x IN string_split('  set u' || lpad(CAST(user_id AS VARCHAR), 8, '0') || '   ' || event_type || ' ', ' ') IF x <> ''] AS w FROM events)",
    "orders_live": f"WITH {_ORDERS} {_live('o')}",
    "orders_range": f"WITH {_ORDERS} SELECT * FROM ({_live('o')}) WHERE key BETWEEN 'c000000100' AND 'c000000200' ORDER BY key LIMIT 50",
    "orders_retain": f"WITH {_ORDERS} {_retain('o', '10000')}",
}
