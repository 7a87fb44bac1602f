"""Every stage of the pipeline against plain Python, on odd documents, repeated rows, nothing, and the small tables."""

import random

import numpy as np
import pytest
from llm_helpers import SCHEMA, frame, words
from test_mixing import targets
from test_ngram_join import brute as components
from test_secrets import ASSIGN  # noqa: F401  the pattern that spans() below stands for
from test_secrets import brute as secrets_of
from test_tokens import check_pieces, encode  # noqa: F401  a fixture

import corpus_pipeline
from snaplog.llm import mixing, toxicity

LABELS = "doc_id long, quality int, toxic int"
STAGES = dict(corpus_pipeline.STAGES)


def masked(text):
    """Text with the maximal runs of all spans replaced."""
    if text is None:
        return None
    spans = sorted(tuple(map(int, s.split(":")[1:])) for s in secrets_of(text)[-1].split(",") if s)
    out, at = "", 0
    for start, end in spans:
        if start > at or not out:
            out += text[at:start] + "[SECRET]"
        at = max(at, end)
    return out + text[at:] if spans else text


def plain(df):
    return sorted(((r["doc_id"], r["text"], r["source"]) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def places(spark, odd, repeated, tmp_path_factory):
    """Folders with documents and labels: odd, repeated, empty."""
    draw = random.Random(4)
    toxic = [(60 + k, f"{words(draw, 3)} {w} {words(draw, 2)} you {w} {words(draw, 1)}", "a") for k, w in enumerate(["zork", "zork", "fnord", "fnord"] * 10)]
    made = {}
    for name, rows, labels in (("odd", odd + toxic, [(i, 1, 1) for i, _, _ in toxic] + [(i, 1, 0) for i, _, _ in odd]), ("repeated", repeated, []), ("empty", [], [])):
        path = str(tmp_path_factory.mktemp(name))
        (frame(spark, rows) if rows else spark.createDataFrame([], SCHEMA)).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame(labels, LABELS).write.parquet(f"{path}/labels.parquet")
        made[name] = path, rows
    return made


@pytest.mark.parametrize("name", ["odd", "repeated", "empty"])
def test_stages(spark, places, name, encode, tmp_path):  # noqa: F811
    path, rows = places[name]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns

    def after(stage):
        out = STAGES[stage](spark, docs, path)
        if stage != "packing":
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{stage}")
        return spark.read.parquet(f"{tmp_path}/{stage}")

    docs_in = plain(docs)
    model = toxicity.learn(docs, spark.read.parquet(f"{path}/labels.parquet"))
    docs = after("toxicity")
    read = model.reader()
    want = [r for r in docs_in if model.score(read(r[1] or "")) < 0.5]
    assert plain(docs) == want
    if name == "odd":
        assert {r[0] for r in docs_in} - {r[0] for r in want} == set(range(60, 100))

    docs_in, docs = plain(docs), after("ngram_join")
    # rows stand for themselves: by place, in order of doc_id (nulls first) and text
    order = sorted(docs_in, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    kept = [order[k] for k, _, c in components([(k, r[1]) for k, r in enumerate(order)], 5, 80, 100) if k == c]
    assert plain(docs) == sorted(kept, key=repr)

    docs_in, docs = plain(docs), after("secret_scan")
    assert plain(docs) == sorted(((i, masked(t), s) for i, t, s in docs_in), key=repr)
    assert all(r["n_chars"] == (len(r["text"]) if r["text"] is not None else None) for r in docs.collect())

    docs_in, docs = plain(docs), after("mix_sources")
    size = lambda t: len((t or "").split())  # noqa: E731  these texts have no other white space
    sizes, taken, most = {}, {}, {}
    for _, t, s in docs_in:
        sizes[s], most[s] = sizes.get(s, 0) + size(t), max(most.get(s, 0), size(t))
    got = plain(docs)
    assert all(got.count(r) <= 2 * docs_in.count(r) for r in set(got)) and set(got) <= set(docs_in)
    for _, t, s in got:
        taken[s] = taken.get(s, 0) + size(t)
    for s, target in targets(sizes).items():
        assert abs(taken.get(s, 0) - target) <= most[s] / 2 + 1

    docs_in, pieces = plain(docs), after("packing").collect()
    assert sum(p["length"] for p in pieces) == sum(len(encode(t)) + 1 for _, t, _ in docs_in)
    assert all(p["offset"] + p["length"] <= 2048 for p in pieces)


def test_run(spark, small, places, encode):  # noqa: F811
    from snaplog.llm import packing

    out = corpus_pipeline.run(spark, small)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 100
    assert corpus_pipeline.run(spark, places["empty"][0]).count() == 0
    # the last stage is the packing operator's own result
    docs = frame(spark, places["odd"][1])
    pieces = packing.pack_documents(docs).collect()
    check_pieces(pieces, places["odd"][1], encode, 2048)
    assert np.isclose(mixing.SHARE, 1.5) and corpus_pipeline.ORACLE_SQL is None
