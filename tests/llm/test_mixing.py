"""Mixing against the rounds that the contract describes, and against the SQL."""

import re

import pytest
from helpers import rows as sorted_rows
from llm_helpers import found, frame

from snaplog.llm import mixing


def targets(sizes):
    """Shares 150% of all words by weight, stops sources at twice their size, shares what is over again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, full, left = dict.fromkeys(order, 0.0), set(), 1.5 * sum(sizes.values())
    while left > 1e-9 and len(full) < len(order):
        total = sum(weight[s] for s in order if s not in full)
        target = {s: t + (0 if s in full else left * weight[s] / total) for s, t in target.items()}
        left = 0.0
        for s in order:
            if s not in full and target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                full.add(s)
    return target


def check(docs, rows):
    out = mixing.mix(docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want, taken = targets(sizes), dict.fromkeys(sizes, 0)
    assert sorted((r["doc_id"] or -1, r["size"]) for r in out) == sorted((i or -1, size(t)) for i, t, _ in rows)
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"] and len(r["positions"]) == r["copies"] == -(-r["taken"] // max(1, r["size"]))
        assert all(0 <= p <= 1 for p in r["positions"]) and list(r["positions"]) == sorted(r["positions"])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in sizes)


def test_targets_and_takes(odd, odd_docs, repeated, repeated_docs, no_docs):
    check(odd_docs, odd)
    check(repeated_docs, repeated)
    assert mixing.mix(no_docs).count() == 0


def test_one_source_and_empty_texts(spark):
    check(frame(spark, [(k, "a b c", "s") for k in range(10)]), [(k, "a b c", "s") for k in range(10)])
    check(frame(spark, [(1, "", "s"), (2, None, None)]), [(1, "", "s"), (2, None, None)])


def test_reruns_and_buckets_agree(odd_docs, small_docs, monkeypatch):
    columns = ("doc_id", "taken", "positions")
    first = found(mixing.mix(small_docs), *columns)
    assert first == found(mixing.mix(small_docs.repartition(7)), *columns)
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", 1)
    assert first == found(mixing.mix(small_docs), *columns)


def test_whole_documents(small_docs):
    for r in mixing.mix(small_docs, whole=True).collect():
        assert r["taken"] in (0, r["size"], 2 * r["size"]) and r["copies"] == (r["taken"] // r["size"] if r["size"] else 0)


def test_order_follows_schedules(spark):
    rows = [(k, "w " * 10, s) for s in "abc" for k in range(0, 3000, 10)]
    order = mixing.training_order(mixing.mix(frame(spark, rows))).collect()
    place = [r["position"] for r in order]
    assert place == sorted(place)
    # a starts heavy, b ends heavy, c is level: words taken in the first half of training
    early = {s: sum(r["source"] == s and r["position"] < 0.5 for r in order) / sum(r["source"] == s for r in order) for s in "abc"}
    assert early["a"] == pytest.approx((2 + 1.25) / 2 * 0.5 / 1.25, abs=0.02) and early["b"] == pytest.approx(0.375 / 1.125, abs=0.02) and early["c"] == pytest.approx(0.5, abs=0.02)


def test_sql(spark, small, sql):
    q = mixing.op8_mix_sources(spark, small)
    assert sorted_rows(q) == sql(mixing.ORACLES["op8_mix_sources"], q.columns)
