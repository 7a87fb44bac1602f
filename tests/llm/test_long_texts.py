"""Very long texts beside short ones: read whole, by every operator that has no such test of its own."""

import random

import numpy as np
import pytest
from llm_helpers import found, frame, words
from test_fingerprints import COLUMNS
from test_fingerprints import brute as prints
from test_ngram_join import brute as components
from test_suffix_dedup import brute as deduped
from test_suffix_dedup import run as dedup
from test_tokens import check_pieces, encode  # noqa: F401  a fixture

import corpus_pipeline
from snaplog.llm import fingerprints, mixing, ngram_join, packing, tokenfiles


@pytest.fixture(scope="module")
def long():
    """Texts of some 800,000 bytes: one, a near copy of it, one that holds its last third, a single word; and short ones."""
    draw = random.Random(31)
    base = words(draw, 90_000).split()
    near = [*base[:40_000], "changed", *base[40_001:]]
    texts = [" ".join(base), " ".join(near), f"{words(draw, 50_000)} {' '.join(base[60_000:])}", "ab" * 400_000, "a short text", "", None]
    assert min(len(t.encode()) for t in texts[:4]) > 500_000
    return [(10 * k, t, "ab"[k % 2]) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def long_docs(spark, long):
    return frame(spark, long).cache()


def test_packing_and_files(spark, tmp_path, encode, long, long_docs):  # noqa: F811
    pieces = packing.pack_documents(long_docs).collect()
    by_doc, want = check_pieces(pieces, long, encode, 2048)
    assert sorted(b"".join(p["ids"] for p in sorted(own, key=lambda p: p["start"])) for (_, n), own in by_doc.items() if n > 100) == sorted(w for w in want if len(w) > 400)
    tokenfiles.write_token_files(long_docs, f"file://{tmp_path}/long")
    got = {r["doc_id"]: r["ids"] for r in tokenfiles.read_token_files(spark, f"file://{tmp_path}/long").collect()}
    assert got == {i: np.array([*encode(t), 0], dtype="<u4").tobytes() for i, t, _ in long}


def test_fingerprints(long, long_docs):
    assert found(fingerprints.compare_with_next(long_docs), *COLUMNS) == prints([(i, t) for i, t, _ in long])


def test_mixing(long, long_docs):
    size = {i: len((t or "").split()) for i, t, _ in long}
    rows = mixing.mix(long_docs, whole=True).collect()
    assert {r["doc_id"]: r["size"] for r in rows} == size and all(0 <= r["copies"] <= 2 for r in rows)


def test_ngram_join(long, long_docs):
    got = found(ngram_join.join_documents(long_docs, 4, 85, 100), "doc_id", "n_shingles", "component_id")
    assert got == components([(i, t) for i, t, _ in long], 4, 85, 100)


def test_suffix_dedup(long, long_docs):
    assert dedup(long_docs) == deduped([(i, t) for i, t, _ in long], 100)


def test_near_copies_in_the_pipeline(spark, long, long_docs):
    kept = dict(corpus_pipeline.STAGES)["ngram_join"](spark, long_docs, "")
    assert found(kept, "doc_id", "text") == sorted(((i, t) for i, t, _ in long if i != 10), key=repr)
