"""Queries that go through a store, transactions, sessions and the stream applier, each with its SQL.

Every query works on a store of its own in the shared folder: a branch, without copying, of one that
holds the event log as three ordered commits and is made once for each application and folder of tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import wire
from ..sources.scratch import new_path
from ..sources.store import Store, TransactionConflict
from ..streaming.applier import apply_stream, commands_to_writes
from .catalogue import _DELETE, _LOG, _W, DELETED, HIGH, LOW, WANTED, WRITES, _at, _keys, _live, _retain, _share, _table, event_log, padded_key, shown
from .session import CommandError, Session, Transaction

_bases: dict[tuple[str, str], Store] = {}


def _branch(spark: SparkSession, sf_dir: str, **options) -> Store:
    """A fresh store that holds the event log: sequence numbers 1 to N, in three commits."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _bases:
        base = Store(spark, new_path(spark, "store"), flush=1 << 62)
        ordered = event_log(spark, sf_dir).withColumnRenamed("seq", "ord")
        cuts = [0, _share(spark, sf_dir, 300), _share(spark, sf_dir, 700), _share(spark, sf_dir, 1000)]
        for number, (low, high) in enumerate(zip(cuts, cuts[1:])):
            base.apply_ordered(ordered.where((F.col("ord") > low) & (F.col("ord") <= high)), stream="events", batch=number)
        _bases[key] = base
    return _bases[key].branch(new_path(spark, "store"), **options)


def _act(transaction: Transaction, rows: tuple = WRITES) -> None:
    for _, key, kind, value in rows:
        transaction.delete(key) if kind else transaction.set(key, value)


def store_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered commits, read back by a store that was opened anew."""
    return shown(Store(spark, _branch(spark, sf_dir).path).live())


def store_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(_branch(spark, sf_dir).live(_share(spark, sf_dir, 800)))


def store_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a new process finds: last number, files, last batch of the stream; leftovers and broken manifests don't count."""
    store = _branch(spark, sf_dir)
    store._write(store.log(), "commit")
    store.files.create("manifest/00000000000000000099.json", '{"number": 99, "last_se')
    now = Store(spark, store.path).manifest()
    return spark.createDataFrame([(now.last_seq, len(now.files), now.streams["events"])], "last_seq long, files long, batch long")


def store_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What manifests know of each commit, by which reads choose files."""
    rows = [(f["rows"], bytes.fromhex(f["min_key"]).decode(), bytes.fromhex(f["max_key"]).decode(), f["min_seq"], f["max_seq"], f["bytes"]) for f in _branch(spark, sf_dir).manifest().files]
    return spark.createDataFrame(rows, "rows long, min_key string, max_key string, min_seq long, max_seq long, bytes long")


def store_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single reads through the store; keys that don't exist have no value."""
    store = _branch(spark, sf_dir)
    rows = [(k, None if (v := store.get(k)) is None else v.decode()) for k in sorted(set(WANTED))]
    return spark.createDataFrame(rows, "key string, value string")


def store_multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(_branch(spark, sf_dir).multi_get(_keys(spark, *WANTED)))


def store_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(_branch(spark, sf_dir).range(LOW, HIGH, 5))


def store_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single puts: each has a number of its own, and an empty value is a value."""
    store = _branch(spark, sf_dir)
    for key, value in (("u00000010", "one"), ("v-new", ""), ("u00000010", "two")):
        store.set(key, value)
    return shown(store.log().where(F.col("seq") > _share(spark, sf_dir, 1000)))


def store_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An atomic batch: all its rows have one number."""
    store = _branch(spark, sf_dir)
    store.put(_keys(spark, "u00000010", "u00000011", "v-new").withColumn("value", F.concat(F.lit("put-"), F.col("key").cast("string")).cast("binary")))
    return shown(store.live())


def store_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bulk delete: how many keys it found, and how many are left."""
    store = _branch(spark, sf_dir)
    deleted = store.delete(_keys(spark, *DELETED))
    return spark.createDataFrame([(deleted, store.live().count(), store.delete(["v-none"]))], "deleted long, left long, absent long")


def store_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A commit over the flush threshold makes one run of all commits by itself; no version is lost."""
    store = _branch(spark, sf_dir, flush=1)
    store.set("v-new", "x")
    kinds = [f["kind"] for f in store.manifest().files]
    return shown(store.log()).withColumn("runs", F.lit(kinds.count("run"))).withColumn("commits", F.lit(kinds.count("commit")))


def store_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _branch(spark, sf_dir)
    store.compact()
    store.vacuum(0)
    return shown(store.log())


def store_compact_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compaction by another process, as it were, while a snapshot is held: what the snapshot needs stays."""
    store = _branch(spark, sf_dir)
    store.hold(_share(spark, sf_dir, 500))
    Store(spark, store.path).compact()
    return shown(store.log())


def store_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A released snapshot holds nothing any more."""
    store, other = _branch(spark, sf_dir), None
    seq = store.hold(_share(spark, sf_dir, 500))
    store.hold(seq)
    store.release(seq)
    other = Store(spark, store.path)
    held = other.oldest_held()
    store.release(seq)
    other.compact()
    return shown(other.log()).withColumn("held", F.lit(held).cast("long"))


def txn_begin_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a transaction sees, after others wrote, deleted and compacted, with its own writes on top."""
    store = _branch(spark, sf_dir)
    transaction, other = Transaction(store), Store(spark, store.path)
    _act(transaction)
    other.set("u00000010", "theirs")
    other.delete(["u00000014", "u00000015"])
    transaction.store.release(transaction.read_seq)  # even without its hold: it reads the files of its own manifest
    other.compact()
    found = transaction.view()
    gets = {k: transaction.get(k) for k in ("u00000014", "u00000012", "u00000013")}
    assert gets["u00000012"] == b"last" and gets["u00000013"] is None
    return shown(found)


def txn_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _branch(spark, sf_dir)
    with Transaction(store) as transaction:
        _act(transaction)
    return shown(store.live())


def txn_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _branch(spark, sf_dir)
    transaction = Transaction(store)
    _act(transaction)
    transaction.rollback()
    return shown(store.live()).withColumn("held", F.lit(store.oldest_held()).cast("long"))


def txn_delete_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delete within a transaction counts the keys that it sees."""
    transaction = Transaction(_branch(spark, sf_dir))
    transaction.set("u99999999", "own")
    return spark.createDataFrame([(transaction.delete(*DELETED), transaction.delete(*DELETED))], "first long, again long")


def txn_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three transactions from one snapshot: the second writes a key of the first, the third others. And what is left in the end."""
    store = _branch(spark, sf_dir)
    begun = [Transaction(store) for _ in range(3)]
    begun[0].set("u00000010", "t1")
    begun[1].set("u00000010", "t2")
    begun[1].set("u00000011", "t2")
    begun[2].delete("u00000012")
    rows = []
    for number, transaction in enumerate(begun, 1):
        try:
            transaction.commit()
            rows.append((f"t{number}", "committed"))
        except TransactionConflict:
            rows.append((f"t{number}", "conflict"))
    return spark.createDataFrame(rows, "key string, value string").unionByName(shown(store.live()))


SCRIPT = (
    "PING", "ping hello", "ECHO some", "COMMAND", f"GET {LOW}", "SET v-new one", "GET v-new", "get v-none", "DEL v-new v-new v-none", "GET v-new", f"RANGE {LOW} {HIGH} LIMIT +2", f"RANGE {HIGH} {LOW}", "Nope x",
    "GET", "COMPACT", f"GET {LOW}", "COMMIT", "BEGIN", "BEGIN", f"RANGE {LOW} {HIGH}", "COMPACT", "SET v-own 1", "GET v-own", "DEL v-own", "ROLLBACK", "GET v-own", "BEGIN", "SET v-own 2", "COMMIT", "GET v-own", "QUIT",
)


def session_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replies, as bytes of the protocol, to commands that came as bytes: odd ones as lines, even ones as arrays."""
    store, reader = _branch(spark, sf_dir), wire.Reader()
    data = b"".join(f"{line}\r\n".encode() if k % 2 else wire.encode([w.encode() for w in line.split(" ")]) for k, line in enumerate(SCRIPT, 1))
    found, rows = [c for k in range(0, len(data), 7) for c in reader.feed(data[k : k + 7])], []
    with Session(store) as session:
        for number, words in enumerate(found, 1):
            try:
                reply = session.execute(*words)
            except CommandError as error:
                reply = error
            rows.append((number, words[0].decode(), wire.encode(reply).decode()))
    return spark.createDataFrame(rows, "n long, name string, reply string")


def session_disconnect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session that ends within a transaction leaves nothing of it behind, and holds nothing."""
    store = _branch(spark, sf_dir)
    with Session(store) as session:
        session.line("BEGIN")
        session.line(f"SET {LOW} gone")
        session.line(f"DEL {HIGH}")
    return shown(store.live()).withColumn("held", F.lit(store.oldest_held()).cast("long"))


def inline_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Command lines in text files, one for each event."""
    path = new_path(spark, "lines")
    _commands(spark, sf_dir).select(F.concat(F.array_join(F.slice("arguments", 1, 2), "  "), F.lit(" "))).write.text(path)
    return wire.read_inline(spark, path).groupBy("name", F.col("arguments")[1].alias("key")).agg(F.count(F.lit(1)).alias("lines"))


def _commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as ordered commands: DEL at errors, else SET."""
    key = padded_key("u", F.col("user_id"), 8)
    arguments = F.when(F.col("event_type") == "error", F.array(F.lit("del"), key)).otherwise(F.array(F.lit("SET"), key, F.col("props")))
    return _table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("ord"), arguments.alias("arguments"))


def stream_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of commands in three files, stopped after the first two, begun again, and its last batch delivered twice."""
    source, check, store = new_path(spark, "stream"), new_path(spark, "check"), Store(spark, new_path(spark, "store"))
    commands = _commands(spark, sf_dir)
    cuts = [0, _share(spark, sf_dir, 300), _share(spark, sf_dir, 700), _share(spark, sf_dir, 1000)]

    def run(number: int) -> DataFrame:
        part = commands.where((F.col("ord") > cuts[number]) & (F.col("ord") <= cuts[number + 1]))
        part.coalesce(1).write.mode("append").json(source)
        rows = spark.readStream.schema(commands.schema).option("maxFilesPerTrigger", 1).json(source)
        apply_stream(rows, store, "commands", check).awaitTermination()
        return part

    for number in range(3):
        last = run(number)
    store.apply_ordered(commands_to_writes(last), stream="commands", batch=store.manifest().streams["commands"])
    return shown(store.log())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        store_live, store_asof, store_recover, store_files, store_get, store_multi_get, store_range, store_set, store_put, store_delete,
        store_roll_up, store_compact, store_compact_held, store_release, txn_begin_read, txn_commit, txn_rollback, txn_delete_count, txn_first_wins,
        session_replies, session_disconnect, inline_file, stream_apply,
    )
}


def _u(*batches: str) -> str:
    """The event log and further rows of (key, seq after the last, kind, value)."""
    rows = ", ".join(batches)
    return f"u AS (SELECT * FROM e UNION ALL SELECT key, (SELECT n FROM n) + seq, kind, value FROM (VALUES {rows}) AS t(key, seq, kind, value))"


def _script_sql() -> str:
    end = "chr(13) || chr(10)"
    bulk = lambda x: f"('$' || strlen({x}) || {end} || {x} || {end})"
    got = f"coalesce((SELECT {bulk('value')} FROM live WHERE key = '{LOW}'), '$-1' || {end})"
    text = lambda x: f"'{x}' || {end}"
    ranged = f"(SELECT '*' || 2 * count(*) || {end} || coalesce(string_agg({bulk('key')} || {bulk('value')}, '' ORDER BY key), '') FROM (SELECT * FROM live WHERE key BETWEEN '{LOW}' AND '{HIGH}' ORDER BY key LIMIT 2))"
    no = lambda x: text(f"-ERR {x}")
    replies = [
        text("+PONG"), bulk("'hello'"), bulk("'some'"), text("*0"), got, text("+OK"), bulk("'one'"), text("$-1"), text(":1"), text("$-1"), ranged, text("*0"), no("unknown command ''Nope''"),
        no("wrong number of arguments for GET"), text("+OK"), got, no("no transaction in progress"), text("+OK"), no("already in a transaction"), no("not allowed in a transaction"), no("not allowed in a transaction"),
        text("+OK"), bulk("'1'"), text(":1"), text("+OK"), text("$-1"), text("+OK"), text("+OK"), text("+OK"), bulk("'2'"), text("+OK"),
    ]
    rows = " UNION ALL ".join(f"SELECT {k} AS n, '{line.split(' ')[0]}' AS name, {reply} AS reply" for k, (line, reply) in enumerate(zip(SCRIPT, replies), 1))
    return f"WITH {_LOG}, live AS ({_live()}) SELECT CAST(n AS BIGINT) AS n, name, reply FROM ({rows})"


_HELD = "(SELECT n FROM n) AS held"
_VERSIONS = "SELECT key, seq, kind, value FROM"

ORACLES: dict[str, str] = {
    "store_live": f"WITH {_LOG} {_live()}",
    "store_asof": f"WITH {_LOG} {_live(where=f'seq <= {_at(800)}')}",
    "store_recover": f"WITH {_LOG} SELECT max(seq) AS last_seq, CAST(3 AS BIGINT) AS files, CAST(2 AS BIGINT) AS batch FROM e",
    "store_files": f"WITH {_LOG}, f AS (SELECT *, CASE WHEN seq <= {_at(300)} THEN 1 WHEN seq <= {_at(700)} THEN 2 ELSE 3 END AS f FROM e) SELECT count(*) AS rows, min(key) AS min_key, max(key) AS max_key, min(seq) AS min_seq, max(seq) AS max_seq, CAST(sum(strlen(key) + coalesce(strlen(value), 0)) AS BIGINT) AS bytes FROM f GROUP BY f",
    "store_get": f"WITH {_LOG}, k AS (SELECT DISTINCT k AS key FROM (VALUES {', '.join(f'({k!r})' for k in WANTED)}) AS t(k)) SELECT k.key, l.value FROM k LEFT JOIN ({_live()}) l ON l.key = k.key",
    "store_multi_get": f"WITH {_LOG} SELECT * FROM ({_live()}) WHERE key IN ({', '.join(map(repr, WANTED))})",
    "store_range": f"WITH {_LOG} SELECT * FROM ({_live()}) WHERE key BETWEEN '{LOW}' AND '{HIGH}' ORDER BY key LIMIT 5",
    "store_set": f"WITH {_LOG} SELECT key, (SELECT n FROM n) + o AS seq, 0 AS kind, value FROM (VALUES ('u00000010', 1, 'one'), ('v-new', 2, ''), ('u00000010', 3, 'two')) AS t(key, o, value)",
    "store_put": f"WITH {_LOG}, {_u(*(f'({k!r}, 1, 0, {v!r})' for k, v in ((k, 'put-' + k) for k in ('u00000010', 'u00000011', 'v-new'))))} {_live('u')}",
    "store_delete": f"WITH {_LOG}, l AS ({_live()}), d AS ({_DELETE}) SELECT (SELECT count(*) FROM d) AS deleted, (SELECT count(*) FROM l) - (SELECT count(*) FROM d) AS left, CAST(0 AS BIGINT) AS absent",
    "store_roll_up": f"WITH {_LOG}, {_u("('v-new', 1, 0, 'x')")} SELECT key, seq, kind, value, 1 AS runs, 0 AS commits FROM u",
    "store_compact": f"WITH {_LOG} {_retain('e', '(SELECT n FROM n)')}",
    "store_compact_held": f"WITH {_LOG} {_retain('e', _at(500))}",
    "store_release": f"WITH {_LOG} SELECT *, CAST({_at(500)} AS BIGINT) AS held FROM ({_retain('e', '(SELECT n FROM n)')})",
    "txn_begin_read": f"WITH {_LOG}, {_W} SELECT * FROM ({_live()}) WHERE key NOT IN (SELECT key FROM w) UNION ALL SELECT key, value FROM w WHERE kind = 0",
    "txn_commit": f"WITH {_LOG}, {_W}, u AS (SELECT * FROM e UNION ALL SELECT key, (SELECT n + 1 FROM n), kind, value FROM w) {_live('u')}",
    "txn_rollback": f"WITH {_LOG} SELECT *, {_HELD} FROM ({_live()})",
    "txn_delete_count": f"WITH {_LOG} SELECT count(*) + 1 AS first, CAST(0 AS BIGINT) AS again FROM ({_DELETE})",
    "txn_first_wins": f"WITH {_LOG}, {_u("('u00000010', 1, 0, 't1')", "('u00000012', 2, 1, NULL)")} {_live('u')} UNION ALL SELECT * FROM (VALUES ('t1', 'committed'), ('t2', 'conflict'), ('t3', 'committed')) AS t(key, value)",
    "session_replies": _script_sql(),
    "session_disconnect": f"WITH {_LOG} SELECT *, {_HELD} FROM ({_live()})",
    "inline_file": f"WITH {_LOG} SELECT CASE kind WHEN 1 THEN 'DEL' ELSE 'SET' END AS name, key, count(*) AS lines FROM e GROUP BY ALL",
    "stream_apply": f"WITH {_LOG} {_VERSIONS} e",
}
