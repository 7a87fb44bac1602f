"""The n-gram join against comparing all pairs."""

import random
import re

import numpy as np
import pytest
from helpers import rows as sorted_rows
from llm_helpers import found, frame, words

from snaplog.llm import common, components, ngram_join
from snaplog.llm.common import written


def brute(rows, n, num, den):
    """Component of each row (doc_id, text); rows stand for themselves."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets.append(({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)}) if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is not None and rows[b][0] is not None and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if den * common >= num * (len(sets[a]) + len(sets[b]) - common):
                    x, y = root(a), root(b)
                    up[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted(((i, len(s), least.get(root(k)) if i is not None else None) for k, ((i, _), s) in enumerate(zip(rows, sets))), key=repr)


def family(seed, size, edits):
    """Near copies: chains and stars around one text, at similarities on both sides of the bound."""
    draw = random.Random(seed)
    base, out = words(draw, 90).split(), []
    for k in range(size):
        text = list(base)
        for _ in range(draw.randint(0, edits)):
            text[draw.randrange(len(text))] = f"w{draw.randrange(50)}"
        out.append(text)
        if draw.random() < 0.2:
            base = text
    return [" ".join(t) for t in out]


TINY = {"most": 6, "documents": 4, "limit": 400, "small": 0}
MIDDLE = {"most": 50, "documents": 160}


@pytest.mark.parametrize("options", [{}, TINY])
@pytest.mark.parametrize(("n", "num"), [(4, 85), (5, 80)])
def test_against_all_pairs(spark, odd, odd_docs, options, n, num):
    got = found(ngram_join.join_documents(odd_docs, n, num, 100, **options), "doc_id", "n_shingles", "component_id")
    assert got == brute([(i, t) for i, t, _ in odd], n, num, 100)


@pytest.mark.parametrize("options", [{}, TINY, MIDDLE])
def test_families_and_small(spark, small_texts, options):
    texts = [t for seed in range(4) for t in family(seed, 25, 3)] + [t for _, t, _ in small_texts[:80]]
    rows = list(enumerate(random.Random(1).sample(texts, len(texts))))
    got = found(ngram_join.join_documents(frame(spark, [(i, t, "a") for i, t in rows]), 4, 85, 100, **options), "doc_id", "n_shingles", "component_id")
    want = brute(rows, 4, 85, 100)
    assert got == want and len({c for _, _, c in want}) < len(rows) - 40


@pytest.mark.parametrize("half", [0, 1])
def test_keys_that_collide_in_one_half(spark, small_texts, monkeypatch, half):
    """Sets whose keys agree in 64 bits are still told apart by the other 64."""
    key = ngram_join.key_of
    monkeypatch.setattr(ngram_join, "key_of", lambda tokens: (lambda k: (k[0] & 1, k[1]) if not half else (k[0], k[1] & 1))(key(tokens)))
    rows = [(i, t) for i, t, _ in small_texts[:60]] + [(1000 + k, t) for k, t in enumerate(family(2, 20, 2))]
    got = found(ngram_join.join_documents(frame(spark, [(i, t, "a") for i, t in rows]), 4, 85, 100), "doc_id", "n_shingles", "component_id")
    assert got == brute(rows, 4, 85, 100)


def test_a_line_in_every_document(spark):
    """Shingles of one line are the most frequent tokens: they come last, and what is dealt has bands of size."""
    draw = random.Random(21)
    line = words(draw, 12)
    rows = [(k, f"{words(draw, draw.choice([0, 0, 3, 30, 60]))} {line}") for k in range(120)]
    rows += [(200 + k, f"{t} {line}") for k, t in enumerate(family(5, 30, 2))]
    docs = frame(spark, [(i, t, "a") for i, t in rows])
    want = brute(rows, 4, 85, 100)
    for options in ({"most": 12}, {"most": 5, "small": 0}):
        assert found(ngram_join.join_documents(docs, 4, 85, 100, **options), "doc_id", "n_shingles", "component_id") == want


def test_repeats_nulls_and_nothing(repeated, repeated_docs, no_docs):
    got = found(ngram_join.join_documents(repeated_docs, 4, 85, 100), "doc_id", "n_shingles", "component_id")
    assert got == brute([(i, t) for i, t, _ in repeated], 4, 85, 100)
    assert ngram_join.join_documents(no_docs, 4, 85, 100).count() == 0


def test_trees_leave_out_no_link():
    draw = np.random.default_rng(3)
    sets = []
    for _ in range(60):
        base = draw.integers(0, 2**64, size=int(draw.integers(1, 400)), dtype=np.uint64)
        for _ in range(4):
            keep = base[draw.random(len(base)) < draw.uniform(0.85, 1)]
            more = draw.integers(0, 2**64, size=int(draw.integers(0, len(base) // 10 + 1)), dtype=np.uint64)
            sets.append(np.unique(np.concatenate([keep, more])))
    sets = [s for s in sets if len(s)]
    sizes = np.array([len(s) for s in sets])
    linked = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if (c := len(np.intersect1d(sets[a], sets[b]))) * 100 >= 85 * (sizes[a] + sizes[b] - c)}
    assert len(linked) > 50
    seen = set()
    for run, maps in ngram_join.size_runs([ngram_join.bitmap(s) for s in sets], sizes, 85, 100):
        tree = ngram_join.SignatureTree(maps, sizes[run], np.arange(len(run)))
        for a, b in tree.pairs(85, 100, chunk=500):
            keep = ngram_join.allowed_overlap(maps, sizes[run], a, b, 85, 100)
            seen |= {tuple(sorted(p)) for p in zip(run[a[keep]].tolist(), run[b[keep]].tolist())}
    assert linked <= seen and len(seen) < len(sets) * (len(sets) - 1) / 8

    def classes(links):
        f = ngram_join.Forest(len(sets))
        [f.join(int(a), int(b)) for a, b in links]
        return f.labels().tolist()

    assert classes(ngram_join.Verifier(sets, 85, 100).run()) == classes(linked)
    possible = classes(ngram_join.possible_links([ngram_join.bitmap(s) for s in sets], sizes, np.arange(len(sets)), 85, 100))
    assert all(possible[a] == possible[b] for a, b in linked)


def test_components(spark):
    draw = random.Random(2)
    links = [(k, k + 1) for k in range(0, 200)] + [(300 + draw.randrange(40), 300 + draw.randrange(40)) for _ in range(60)] + [(500, k) for k in range(501, 600)] + [(7, 7), (9, 8), (9, 8)]
    got = {r["vertex"]: r["label"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    f = ngram_join.Forest(700)
    [f.join(a, b) for a, b in links]
    want = {v: f.find(v) for a, b in links if a != b for v in (a, b)}
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_small_tables_of_components_are_few_files(spark, monkeypatch):
    """However many partitions a shuffle has: on check_h each file of dozens of tables started processes beside an executor."""
    made = []
    monkeypatch.setattr(components, "written", lambda df, what, *rows: (out := written(df, what, *rows), made.append((what, len(out.inputFiles()))))[0])
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(held, ("32", "false")):
            spark.conf.set(k, v)
        links = spark.createDataFrame([(k, k + 1) for k in range(400)], "a long, b long")
        assert {r["label"] for r in components.components(links, links.count()).collect()} == {0}
        draw, own = random.Random(6), []
        monkeypatch.setattr(ngram_join, "written", lambda df, what, *rows: (out := written(df, what, *rows), own.append((what, len(out.inputFiles()))))[0])
        base = [words(draw, 40) for _ in range(60)]
        docs = spark.createDataFrame([(k, base[k // 2] + " end" * (k % 2)) for k in range(120)], "doc_id long, text string")
        got = ngram_join.join_documents(docs, words=5, num=80, den=100, documents=1).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == {k: k - k % 2 for k in range(120)}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert len(made) > 20 and all(files <= 1 for _, files in made)
    narrow = [files for what, files in own if what in ("ngram-members", "ngram-classes")]
    assert len(narrow) == 2 and all(files <= 1 for files in narrow)


def test_beyond_a_files_rows_links_stay_spread(spark, monkeypatch):
    monkeypatch.setattr(common, "FILE_ROWS", 50)
    links = [(k, k + 1) for k in range(400)] + [(1000, k) for k in range(1001, 1300)]
    out = components.components(spark.createDataFrame(links, "a long, b long"))
    assert {r["vertex"]: r["label"] for r in out.collect()} == dict.fromkeys(range(401), 0) | dict.fromkeys(range(1000, 1300), 1000)


def test_query(spark, small, small_texts):
    got = found(ngram_join.op9_ngram_join(spark, small), "doc_id", "n_shingles", "component_id")
    assert got == brute([(i, t) for i, t, _ in small_texts], 4, 85, 100)


def test_sql(spark, small, sql):
    q = ngram_join.op9_ngram_join(spark, small)
    assert sorted_rows(q) == sql(ngram_join.ORACLES["op9_ngram_join"], q.columns)
