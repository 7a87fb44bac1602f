"""Reads and write-sets against hand cases and a model of plain dictionaries."""

import random

import pytest

from snaplog.operators import versions, writes
from snaplog.schema import LOG, WRITES, as_log, violations


def log_of(spark, rows):
    return spark.createDataFrame([(k, s, kind, None if kind else v) for k, s, kind, v in rows], LOG)


def pairs(df):
    return {bytes(r["key"]): bytes(r["value"]) for r in df.collect()}


class Model:
    """key -> versions (seq, value or None), ascending."""

    def __init__(self, rows):
        self.rows = rows

    def live(self, at):
        newest = {}
        for k, s, kind, v in sorted(self.rows, key=lambda r: r[1]):
            if s <= at:
                newest[k] = None if kind else v
        return {k: v for k, v in newest.items() if v is not None}


def random_log(seed):
    draw = random.Random(seed)
    names = [b"", b"a", b"a\x00", b"\x7f", b"\x80", b"\xff", b"kk", b"z"]
    rows = []
    for seq in range(1, 41):
        for key in draw.sample(names, draw.randint(1, 3)):
            kind = int(draw.random() < 0.3)
            rows.append((key, seq, kind, None if kind else draw.choice([b"", b"x", bytes([draw.randrange(256)]) * 3])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_model(spark, seed):
    rows = random_log(seed)
    log, model = log_of(spark, rows).cache(), Model(rows)
    for at in (0, 1, 7, 20, 39, 40):
        want = model.live(at)
        assert pairs(versions.live(log, at)) == want
        found = [(bytes(r["key"]), bytes(r["value"])) for r in versions.range_scan(log, b"a", b"\x80", snapshot=at).collect()]
        assert found == sorted((k, v) for k, v in want.items() if b"a" <= k <= b"\x80")
        assert pairs(versions.get(log, b"a\x00", at)) == {k: v for k, v in want.items() if k == b"a\x00"}
    for boundary in (0, 13, 40):
        kept = versions.retain(log, boundary)
        for at in (boundary, min(40, boundary + 5), 40):
            assert pairs(versions.live(kept, at)) == model.live(at)
        assert sorted(map(repr, versions.retain(kept, boundary).collect())) == sorted(map(repr, kept.collect()))


def test_hand_cases(spark):
    tomb = log_of(spark, [(b"k", 1, 0, b"a"), (b"k", 2, 1, None)])
    assert pairs(versions.live(tomb)) == {} and pairs(versions.live(tomb, 1)) == {b"k": b"a"}
    assert pairs(versions.get(tomb, "k")) == {}
    again = versions.union_runs(tomb, log_of(spark, [(b"k", 3, 0, b"b")]))
    assert pairs(versions.live(again)) == {b"k": b"b"} and pairs(versions.live(again, 2)) == {}
    many = log_of(spark, [(b"k", n, 0, b"v%d" % n) for n in range(1, 41)])
    assert all(pairs(versions.get(many, b"k", n)) == {b"k": b"v%d" % n} for n in (1, 17, 40))
    assert pairs(versions.live(log_of(spark, [(b"k", 1, 0, b"")]))) == {b"k": b""}


def test_retention_cases(spark):
    log = log_of(spark, [(b"k", 1, 0, b"old"), (b"k", 2, 0, b"mid"), (b"k", 3, 0, b"new"), (b"d", 1, 0, b"x"), (b"d", 2, 1, None), (b"e", 1, 0, b"y"), (b"e", 4, 1, None)])
    kept = lambda b: sorted((bytes(r["key"]), r["seq"]) for r in versions.retain(log, b).collect())
    assert kept(2) == [(b"e", 1), (b"e", 4), (b"k", 2), (b"k", 3)]
    assert kept(4) == [(b"k", 3)]


def test_range_limits(spark):
    rows = [(b"k%02d" % n, 1, 0, b"v") for n in range(60)] + [(b"k10", 2, 0, b"newer"), (b"k20", 3, 1, None)]
    log = log_of(spark, rows)
    keys = lambda *a, **b: [bytes(r["key"]) for r in versions.range_scan(log, *a, **b).collect()]
    assert keys("k08", "k12") == [b"k08", b"k09", b"k10", b"k11", b"k12"]
    assert keys("k20", "k20") == [] and keys("z", "a") == []
    assert keys("k00", "k59", 3) == [b"k00", b"k01", b"k02"] and len(keys("k00", "k59", 0)) == 59
    assert keys("k19", "k30", 2) == [b"k19", b"k21"]
    with pytest.raises(ValueError):
        versions.range_scan(log, "a", "b", -1)


def test_write_sets(spark):
    log = log_of(spark, [(b"a", 1, 0, b"1"), (b"b", 2, 0, b"2"), (b"c", 3, 1, None)])
    batch = spark.createDataFrame([(1, b"a", 0, b"x"), (2, b"a", 1, None), (3, b"n", 0, b"y"), (4, b"c", 0, b"z")], WRITES)
    last = writes.last_writes(batch)
    assert sorted((bytes(r["key"]), r["kind"]) for r in last.collect()) == [(b"a", 1), (b"c", 0), (b"n", 0)]
    assert pairs(writes.overlay(log, last, 3)) == {b"b": b"2", b"c": b"z", b"n": b"y"}
    assert sorted((bytes(r["key"]), r["latest"]) for r in writes.conflicts(log, last, 1).collect()) == [(b"c", 3)]
    assert writes.conflicts(log, last, 3).isEmpty()
    keys = spark.createDataFrame([(b"a",), (b"a",), (b"c",), (b"none",)], "key binary")
    assert [bytes(r["key"]) for r in writes.delete_set(log, keys, 3).collect()] == [b"a"]
    assert {r["seq"] for r in writes.stamp_batch(last, 3).collect()} == {4}
    stamped = writes.stamp_each(batch, 3, rows_a_window=2).collect()
    assert sorted((r["seq"], bytes(r["key"])) for r in stamped) == [(4, b"a"), (5, b"a"), (6, b"n"), (7, b"c")]


def test_violations(spark):
    bad = spark.createDataFrame([(b"a", 0, 0, b"x"), (b"a", 1, 2, b"x"), (b"a", 1, 0, None), (None, 1, 0, b"x"), (b"a", 1, 1, None)], "key binary, seq long, kind int, value binary")
    assert violations(bad).count() == 4
    assert violations(as_log(bad.where("seq = 1 and kind = 1"))).isEmpty()


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "log")
    log_of(spark, [(b"k%03d" % n, n + 1, 0, b"v") for n in range(100)]).write.parquet(path)
    log = spark.read.schema(LOG).parquet(path)
    plan = lambda df: df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    found = plan(versions.range_scan(log, "k010", "k020", 5, snapshot=50))
    assert "GreaterThanOrEqual(key" in found and "LessThanOrEqual(seq,50)" in found and "TakeOrderedAndProject" in found and "WindowGroupLimit" in found
    assert "EqualTo(key" in plan(versions.get(log, "k010"))
    assert "value" not in plan(versions.latest_seq(log)).split("ReadSchema")[1].split("\n")[0]
