"""The store, transactions, sessions, the wire adapter and the stream applier."""

import random
import threading
from pathlib import Path

import pytest

from snaplog.plans.session import CommandError, Session, Transaction, TransactionError
from snaplog.sources import wire
from snaplog.sources.store import Manifest, Store, TransactionConflict
from snaplog.streaming.applier import apply_stream, commands_to_writes


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def put(store, **pairs):
    return store.put(store.spark.createDataFrame([(k.encode(), v.encode()) for k, v in pairs.items()], "key binary, value binary"))


def contents(store, snapshot=2**63 - 1):
    return {bytes(r["key"]).decode(): bytes(r["value"]).decode() for r in store.live(snapshot).collect()}


def test_set_get_delete(store):
    assert store.get("tea") is None
    store.set("tea", "green")
    store.set("tea", "black")
    assert store.get("tea") == b"black" and store.last_seq == 2
    assert store.delete(["tea", "tea", "rum"]) == 1 and store.get("tea") is None
    assert store.delete(["rum"]) == 0 and store.last_seq == 3  # nothing written, no number used
    store.set("empty", "")
    assert store.get("empty") == b"" and store.get(None) is None


def test_batch_is_one_number(store):
    put(store, a="1", b="2", c="3")
    assert store.last_seq == 1 and contents(store) == {"a": "1", "b": "2", "c": "3"}
    assert store.write(store.spark.createDataFrame([], "ord long, key binary, kind int, value binary")) == 1
    with pytest.raises(ValueError):  # pairs have no order that could tell which of two counts
        store.put(store.spark.createDataFrame([(b"k", b"1"), (b"k", b"2")], "key binary, value binary"))
    with pytest.raises(ValueError):
        store.write(store.spark.createDataFrame([(1, b"k", 7, b"v")], "ord long, key binary, kind int, value binary"))


def test_reopen_and_leftovers(spark, store):
    put(store, a="1")
    store.delete(["a"])
    put(store, b="2")
    # files that no manifest lists and manifests that aren't whole don't count
    store._write(store.log(), "commit")
    store.files.create("manifest/00000000000000000099.json", '{"number": 99, "last_se')
    again = Store(spark, store.path)
    assert contents(again) == {"b": "2"} and again.last_seq == 3
    put(again, c="3")
    assert contents(Store(spark, store.path)) == {"b": "2", "c": "3"} and again.manifest().number == 100
    assert len(again.vacuum(0)) == 1 and contents(again) == {"b": "2", "c": "3"}


def test_compaction_keeps_held_snapshots(store):
    put(store, k="old", gone="x")
    seq = store.hold()
    put(store, k="new")
    store.delete(["gone"])
    before = store.log().count()
    store.compact()
    assert contents(store, seq) == {"k": "old", "gone": "x"} and contents(store) == {"k": "new"}
    store.release(seq)
    store.compact()
    assert store.log().count() == 1 < before and len(store.manifest().files) == 1
    store.delete(["k"])
    store.compact()
    assert store.manifest().files == [] and store.last_seq == 4  # numbers never start again
    put(store, z="1")
    assert store.last_seq == 5


def test_holds_of_other_processes_count(spark, store):
    put(store, k="old")
    reader = Store(spark, store.path)
    seq = reader.hold()
    put(store, k="new")
    store.compact()
    assert contents(store, seq) == {"k": "old"} and store.oldest_held() == seq
    assert Store(spark, store.path, lease_ms=0).oldest_held() == store.last_seq  # its lease is over
    reader.release(seq)
    reader.release(seq)
    store.compact()
    assert contents(store, seq) == {}


def test_files_are_small_and_chosen_by_key(spark, store):
    put(store, a="1", c="2")
    put(store, **{"m": "3", "x" * 100: "4"})
    entries = store.manifest().files
    for entry in entries:
        parts = [n for n in store.files.names(entry["path"]) if n.endswith(".parquet")]
        assert sum(Path(f"{store.path.removeprefix('file://')}/{entry['path']}/{n}").stat().st_size for n in parts) < 20_000
    paths = lambda low, high: len(store.log(low=low, high=high).inputFiles())
    assert (paths(b"b", b"b"), paths(b"d", b"l"), paths(b"c", b"m"), paths(b"x" * 99, None), paths(b"y", None)) == (1, 0, 2, 1, 0)
    assert store.get("x" * 100) == b"4" and store.get("x" * 99) is None and store.range("b", "n").count() == 2


def test_commits_roll_up_by_themselves(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/small", flush=10)
    kinds = []
    for k in range(4):
        store.set(f"k{k}", "four")
        kinds.append([f["kind"] for f in store.manifest().files])
    assert kinds == [["commit"], ["run"], ["run", "commit"], ["run", "run"]] and len(contents(store)) == 4


def test_branches_and_manifests(spark, store, tmp_path):
    put(store, k="1")
    other = store.branch(f"file://{tmp_path}/branch")
    put(other, k="2")
    more = other.branch(f"file://{tmp_path}/more")
    assert contents(store) == {"k": "1"} and contents(other) == contents(more) == {"k": "2"}
    with pytest.raises(ValueError):
        store.branch(other.path)
    for k in range(12):
        other.delete([f"none-{k}"])
        other._publish(other.manifest())
    assert len(other.vacuum(0)) == 0 and len(other.files.names("manifest")) == 10 and contents(other) == {"k": "2"}


def test_streams_never_go_back(store):
    rows = store.spark.createDataFrame([(1, b"k", 0, b"1")], "ord long, key binary, kind int, value binary")
    store.apply_ordered(rows, stream="s", batch=5)
    before = store.manifest()
    for batch in (5, 3):
        store.apply_ordered(rows, stream="s", batch=batch)
    assert store.manifest() == before and before.streams == {"s": 5}
    store.apply_ordered(rows.limit(0), stream="s", batch=6)  # an empty batch is one too
    assert store.manifest().streams == {"s": 6} and store.last_seq == 1


def test_transaction_reads_its_own_manifest(spark, store):
    put(store, k="old", gone="x")
    t = Transaction(store)
    other = Store(spark, store.path)
    put(other, k="new")
    other.delete(["gone"])
    store.release(t.read_seq)  # a lost hold doesn't matter while files are there
    other.compact()
    assert t.get("k") == b"old" and t.delete("gone", "k", "none") == 2
    with pytest.raises(TransactionConflict):
        t.commit()


def test_roll_up_keeps_versions(store):
    put(store, k="1")
    put(store, k="2")
    assert store.roll_up(1 << 30).number == store.manifest().number and len(store.manifest().files) == 2
    store.roll_up(1)
    assert [f["kind"] for f in store.manifest().files] == ["run"] and contents(store, 1) == {"k": "1"}


def test_losing_a_race_tries_again(spark, store):
    other = Store(spark, store.path)
    publish, raced = store._publish, []

    def late(new):
        if not raced:
            raced.append(put(other, k="theirs"))
        return publish(new)

    store._publish = late
    put(store, j="ours")
    assert contents(store) == {"k": "theirs", "j": "ours"} and store.last_seq == 2


def test_concurrent_writers(spark, store):
    def work(n):
        for k in range(3):
            Store(spark, store.path).set(f"k{n}-{k}", str(n))

    threads = [threading.Thread(target=work, args=(n,)) for n in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert store.last_seq == 9 and len(contents(store)) == 9


def test_no_publication_is_lost(spark, tmp_path):
    """Six threads race for 60 manifests: each number is given once, and every one is there in the end."""
    path = f"file://{tmp_path}/race"

    def work(n):
        own = Store(spark, path)
        for k in range(10):
            while True:
                now = own.manifest()
                if own._publish(Manifest(now.number, now.last_seq + 1, [*now.files, {"path": f"{n}-{k}"}], {})):
                    break

    threads = [threading.Thread(target=work, args=(n,)) for n in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    last = Store(spark, path).manifest()
    assert (last.number, last.last_seq) == (60, 60) and len({f["path"] for f in last.files}) == 60


def test_transactions(store):
    store.set("k", "v1")
    with Transaction(store) as t:
        store.set("k", "v2")
        assert t.get("k") == b"v1" and t.get("none") is None
        t.set("own", "x")
        assert t.get("own") == b"x" and store.get("own") is None
        assert {bytes(r["key"]) for r in t.view().collect()} == {b"k", b"own"}
    assert store.get("own") == b"x" and not store.held
    with pytest.raises(TransactionError):
        t.commit()


def test_first_committer_wins(store):
    store.set("k", "v0")
    one, two, three = Transaction(store), Transaction(store), Transaction(store)
    one.set("k", "t1")
    two.set("k", "t2")
    assert three.delete("absent", "k", "k") == 1
    one.commit()
    for t in (two, three):
        with pytest.raises(TransactionConflict):
            t.commit()
    assert store.get("k") == b"t1" and not store.held
    skew = Transaction(store)
    skew.get("k")
    skew.set("other", "1")
    store.set("k", "t3")
    skew.commit()  # what was only read is not checked


def test_session_commands(store):
    with Session(store) as s:
        assert s.line("ping") == "PONG" and s.line("PING hi") == b"hi" and s.line("echo a") == b"a"
        assert s.line("set  k   v") == "OK" and s.line("GET k") == b"v" and s.line("get none") is None
        assert s.line("del k k none") == 1 and s.line("get k") is None
        assert s.execute("SET", "b", b"\x00\r\nend") == "OK" and s.execute("GET", "b") == b"\x00\r\nend"
        assert s.line("range a z") == [b"b", b"\x00\r\nend"] and s.line("range a z limit 0") == s.line("range a z")
        assert s.line("compact") == "OK" and s.line("command") == [] and s.line("") is None
        for bad in ("nope", "get", "set a", "range a", "range a b limit", "range a b top 3", "range a b limit -1", "range a b limit x", "commit", "rollback", "echo", "del"):
            with pytest.raises(CommandError):
                s.line(bad)


def test_session_transactions(store):
    a, b = Session(store), Session(store)
    a.line("set k v0")
    a.line("begin")
    with pytest.raises(CommandError):
        a.line("begin")
    for bad in ("range a z", "compact"):
        with pytest.raises(CommandError):
            a.line(bad)
    b.line("set k v1")
    assert a.line("get k") == b"v0"
    a.line("set k mine")
    with pytest.raises(CommandError):
        a.line("commit")
    with pytest.raises(CommandError):
        a.line("commit")  # a conflict ends the transaction too
    a.line("begin")
    a.line("del k")
    assert a.line("rollback") == "OK" and b.line("get k") == b"v1"
    a.line("begin")
    assert a.line("quit") == "OK" and a.closed and not store.held


def test_wire():
    reader = wire.Reader()
    data = b"*3\r\n$3\r\nSET\r\n$+3\r\ntea\r\n$6\r\n\x00\r\n\xffz!\r\nECHO  w\n*0\r\n*1\r\n$-1\r\n"
    found = [c for k in range(len(data)) for c in reader.feed(data[k : k + 1])]
    assert found == [[b"SET", b"tea", b"\x00\r\n\xffz!"], [b"ECHO", b"w"], [], [None]]
    for bad in (b"*1\r\n+7\r\n", b"*x\r\n", b"*1\r\n$999999999999\r\n", b"*1\r\n$1\r\nabc"):
        with pytest.raises(wire.WireError):
            wire.Reader().feed(bad)
    assert wire.encode("OK") == b"+OK\r\n" and wire.encode(None) == b"$-1\r\n" and wire.encode(3) == b":3\r\n"
    assert wire.encode([b"a", b""]) == b"*2\r\n$1\r\na\r\n$0\r\n\r\n" and wire.encode(ValueError("no")) == b"-ERR no\r\n"


def test_null_arguments_and_names_as_typed(store):
    with Session(store) as s:
        assert s.execute("SET", None, "v") == "OK" and s.execute("GET", None) == b"v" and s.execute("GET", "") == b"v"
        assert s.line("range a z limit +1") == []
        with pytest.raises(CommandError, match="'Frob'"):
            s.line("Frob it")
        with pytest.raises(CommandError):
            s.execute(None)


def test_inline_files(spark, tmp_path):
    (tmp_path / "c.txt").write_text("  set a  1 \n\nget a\n")
    found = sorted((r["name"], r["arguments"]) for r in wire.read_inline(spark, str(tmp_path / "c.txt")).collect())
    assert found == [("GET", ["get", "a"]), ("SET", ["set", "a", "1"])]


def test_random_operations(store):
    draw, model = random.Random(5), {}
    for _ in range(12):
        key, op = f"k{draw.randrange(4)}", draw.random()
        if op < 0.6:
            store.set(key, str(op))
            model[key] = str(op)
        elif op < 0.85:
            assert store.delete([key]) == (model.pop(key, None) is not None)
        else:
            store.compact()
    assert contents(store) == model


def test_stream(spark, store, tmp_path):
    schema = "ord long, arguments array<string>"
    commands = [(1, ["SET", "a", "1"]), (2, ["set", "b", "2"]), (3, ["GET", "a"]), (4, ["DEL", "a", "none"]), (5, ["SET", "a", "3"]), (6, ["SET", "bad"])]
    source = tmp_path / "in"
    for k in range(0, 6, 2):
        spark.createDataFrame(commands[k : k + 2], schema).coalesce(1).write.mode("append").json(str(source))
    def run(name):
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
        apply_stream(rows, store, name, str(tmp_path / f"check-{name}")).awaitTermination()

    run("one")
    assert contents(store) == {"a": "3", "b": "2"} and store.last_seq == 5
    batch = spark.createDataFrame(commands, schema)
    before = store.manifest()
    store.apply_ordered(commands_to_writes(batch), stream="one", batch=before.streams["one"])
    assert store.manifest() == before  # a batch that comes again changes nothing
