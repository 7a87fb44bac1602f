"""Suffix-array dedup against a set of all strings of the length."""

import random

import numpy as np
import pytest
from helpers import rows as sorted_rows
from llm_helpers import found, frame, words

from pyspark.sql import functions as F
from snaplog.llm import suffix_dedup


def brute(rows, length):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    seen, out = set(), []
    for i, text in order:
        data, spans = (text or "").encode(), []
        for s in range(len(data) - length + 1):
            w = data[s : s + length]
            if w in seen:
                if spans and s <= spans[-1][1]:
                    spans[-1][1] = s + length
                else:
                    spans.append([s, s + length])
            seen.add(w)
        edges = [0, *(x for span in spans for x in span), len(data)]
        out.append((i, len(data), [tuple(s) for s in spans], b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))))
    return sorted(out, key=repr)


def run(docs, length=100, **options):
    rows = suffix_dedup.dedup(docs, length, **options).collect()
    return sorted(((r["doc_id"], r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"])) for r in rows), key=repr)


@pytest.mark.parametrize("options", [{}, {"hot": 1}, {"gram": 60}])
def test_odd_documents(odd, odd_docs, options):
    assert run(odd_docs, **options) == brute([(i, t) for i, t, _ in odd], 100)


@pytest.mark.parametrize("hot", [1, 5000])
def test_shared_passages(spark, hot):
    draw = random.Random(5)
    passages = [words(draw, 40) for _ in range(4)]
    rows = []
    for k in range(120):
        text = " ".join(draw.choice([words(draw, draw.randint(0, 12)), draw.choice(passages), draw.choice(passages)[: draw.randint(0, 150)], "ab" * draw.randint(0, 90)]) for _ in range(draw.randint(0, 6)))
        rows.append((draw.randrange(10_000) * 200 + k, text))
    docs = frame(spark, [(i, t, "a") for i, t in rows])
    assert run(docs, hot=hot) == brute(rows, 100)
    assert run(docs, 30, gram=10, hot=hot) == brute(rows, 30)


def test_repeats_and_nothing(repeated, repeated_docs, no_docs):
    assert run(repeated_docs) == brute([(i, t) for i, t, _ in repeated], 100)
    assert run(no_docs) == []


def test_segments_and_flushes(spark, odd, odd_docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 64)
    find = suffix_dedup.Anchors()
    data = np.frombuffer(("abc" * 50 + words(random.Random(1), 200)).encode(), dtype=np.uint8)
    grams, hashes, at, lo, hi = find(data)
    covered = np.concatenate([np.arange(a, b + 1) for a, b in zip(lo, hi)])
    assert (covered == np.arange(len(data) - 99)).all() and ((lo <= at) & (at + 24 <= hi + 100) & (hi <= at) | (at >= hi)).all()
    rows = suffix_dedup.anchor_rows(odd_docs.select(F.col("doc_id").alias("ref"), F.coalesce("text", F.lit("")).cast("binary").alias("data")), held=50)
    assert rows.where("packed >= 0").count() > 100


def test_one_anchor_in_every_document(spark):
    """A line shorter than a window, in surroundings that all differ but for a few: tasks send on a row for it, whatever its number of contexts."""
    draw = random.Random(8)
    line = "the same line of about sixty bytes stands in every document"
    twice = words(draw, 10) + line + words(draw, 10)
    rows = [(k, f"{words(draw, 15)} {twice if k % 40 == 7 else line} {words(draw, 15)}") for k in range(400)]
    docs = frame(spark, [(i, t, "a") for i, t in rows])
    data = docs.select(F.col("doc_id").alias("ref"), F.col("text").cast("binary").alias("data"))
    largest = lambda hot: suffix_dedup.anchor_rows(data, hot=hot).where("packed >= 0").groupBy("h").count().agg(F.max("count")).first()[0]
    assert largest(100_000) > 200 and largest(32) <= 2 * 3  # three tasks, 32 / 16 contexts each
    for hot in (1, 32, 100_000):
        assert run(docs, hot=hot) == brute(rows, 100)


def test_anchor_hot_in_one_task_only(spark):
    """One task finds an anchor hot and another has only a few of its contexts: they meet all the same."""
    draw = random.Random(9)
    line = "the same line of about sixty bytes stands in every document"
    texts = [f"{words(draw, 12)} {line} {words(draw, 12)}" for _ in range(60)]
    rows = list(enumerate([texts[3], texts[50], *texts]))
    few, many = (frame(spark, [(i, t, "a") for i, t in part]).coalesce(1) for part in (rows[:2], rows[2:]))
    assert run(few.unionByName(many), hot=64) == run(many.unionByName(few), hot=64) == brute(rows, 100)


def test_texts_are_shuffled_once(spark, small):
    q = suffix_dedup.op10_suffix_dedup(spark, small)
    q.collect()
    assert "ReusedExchange" in q._jdf.queryExecution().executedPlan().toString()


def test_longest_previous_factors():
    draw = np.random.default_rng(2)
    for alphabet, n, depth in ((2, 500, 8), (1, 60, 5), (3, 300, 3), (200, 200, 4), (2, 1, 4)):
        x = draw.integers(0, alphabet, size=(n, depth), dtype=np.uint8)
        common = lambda a, b: next((k for k in range(depth) if a[k] != b[k]), depth)  # noqa: B023, E731
        want = [max((common(x[j], x[i]) for j in range(i)), default=0) for i in range(n)]
        assert suffix_dedup.longest_previous_factors(x).tolist() == want
    with pytest.raises(ValueError):
        suffix_dedup.dedup(None, 100, 4)


def test_windows_whose_hashes_collide(spark, monkeypatch):
    """Hot anchors' windows have hashes of two bits: bytes decide."""
    monkeypatch.setattr(suffix_dedup.Anchors, "windows", lambda self, data, first, last, own=suffix_dedup.Anchors.windows: own(self, data, first, last) & np.uint64(3))
    draw = random.Random(6)
    passages = [words(draw, 40) for _ in range(3)]
    rows = [(k, " ".join(draw.choice([words(draw, 8), draw.choice(passages), draw.choice(passages)[: draw.randint(60, 150)]]) for _ in range(4))) for k in range(60)]
    assert run(frame(spark, [(i, t, "a") for i, t in rows]), hot=1) == brute(rows, 100)


def test_query(spark, small, small_texts):
    import hashlib

    got = found(suffix_dedup.op10_suffix_dedup(spark, small), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    want = [(i, n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest()) for i, n, spans, kept in brute([(i, t) for i, t, _ in small_texts], 100)]
    assert got == sorted(want, key=repr)


def test_sql(spark, small, sql):
    q = suffix_dedup.op10_suffix_dedup(spark, small)
    assert sorted_rows(q) == sql(suffix_dedup.ORACLES["op10_suffix_dedup"], q.columns)
