"""Exact top-k against numpy, and against the SQL."""

import numpy as np
import pytest
from helpers import rows as sorted_rows
from llm_helpers import found

from snaplog.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, norm string, v string, dim string, block string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 0, "x", "x", "x", "x") for i, v in vectors], SCHEMA).repartition(3)


def brute(vectors, k=5, step=50):
    ok = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % step == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in ok if c != q and len(a) == len(b))
            out += [(q, rank, c, -s) for rank, (s, c) in enumerate(scores[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("spread", [0.0, 1.5])
def test_against_brute_force(spark, spread):
    draw = np.random.default_rng(7)
    x = draw.normal(size=(400, 12)) * np.exp(spread * draw.normal(size=(400, 1)))
    vectors = [(i, v.tolist()) for i, v in enumerate(x)]
    vectors += [(1000 + i, x[50].tolist()) for i in range(8)]  # ties
    vectors += [(2000, None), (2050, [1.0, None] + [0.0] * 10), (2100, [float("nan")] * 12), (2150, [float("inf")] + [0.0] * 11), (None, x[0].tolist()), (2200, [1.0, 2.0]), (2201, [2.0, 1.0]), (2250, []), (2300, [0.0] * 12)]
    df = frame(spark, vectors)
    for blocks in ({}, {"block": 37, "queries_in_block": 3, "sample": 20}):
        out = topk.top_k(df.where("vec_id % 50 = 0"), df, **blocks)
        assert found(out, "query_id", "rank", "vec_id", "score") == brute(vectors)


def test_empty_and_large(spark):
    none = frame(spark, [])
    assert topk.top_k(none, none).count() == 0
    big = [(0, [3e6, -2e6]), (1, [1e6, 1e6]), (2, [-5e6, 4.0])]
    df = frame(spark, big)
    assert found(topk.top_k(df.where("vec_id = 0"), df), "query_id", "rank", "vec_id", "score") == brute(big)


@pytest.fixture
def pairs_scored(monkeypatch):
    seen, exact = [], topk.exact
    monkeypatch.setattr(topk, "exact", lambda q, c, qi, ci: seen.append(len(qi)) or exact(q, c, qi, ci))
    return seen


def check_block(q, c, turn, reached):
    rows, ids, scores = topk.search_block(q, np.arange(len(q)), c, np.arange(len(c)), turn, 5, reached)
    whole = q @ c.T
    for k in range(len(q)):
        best = sorted((-whole[k, i], i) for i in range(len(c)) if i != k)[:5]
        assert [(-s, i) for s, i in zip(scores[rows == k], ids[rows == k])] == best
    return np.array([scores[rows == k][-1] for k in range(len(q))], dtype=float)


def test_pruning_spares_work(pairs_scored):
    draw = np.random.default_rng(1)
    c = (draw.normal(size=(2000, 32)) * np.linspace(3, 0.05, 32) * 256).astype(np.int64)
    c = c[np.argsort(-np.linalg.norm(c, axis=1), kind="stable")]
    check_block(c[:20], c, np.linalg.svd(c.T.astype(float) @ c)[0], np.full(20, -np.inf))
    assert sum(pairs_scored) < 20 * 2000 / 4


def test_most_pairs_of_the_table_are_pruned(spark, small, pairs_scored):
    """The query's own settings and vectors: in the second pass bounds leave few pairs, though lengths hardly differ."""
    vectors = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = topk.integers(vectors).collect()
    c = np.array([r["v"] for r in sorted(rows, key=lambda r: -r["norm"])], dtype=np.int64)
    turn = topk.rotation(topk.integers(vectors))[c.shape[1]]
    assert np.allclose(turn.T @ turn, np.eye(c.shape[1]))
    q = c[:: topk.STEP]
    reached = np.sort(q @ c.T, axis=1)[:, -6].astype(float)
    topk.search_block(q, np.arange(len(q)) - 10_000, c, np.arange(len(c)), turn, 5, reached)
    assert sum(pairs_scored) < 0.15 * len(q) * len(c)


def test_sql(spark, small, sql):
    q = topk.op2_top_k(spark, small)
    assert sorted_rows(q) == sql(topk.ORACLES["op2_top_k"], q.columns)
