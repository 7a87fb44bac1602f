"""Prefix hashes and fingerprints against plain strings."""

import hashlib
import os
import random

from llm_helpers import found, frame, words

from snaplog.llm import fingerprints as fp


def test_prefix_hashes():
    draw = random.Random(6)
    a = words(draw, 80)
    b = a[:100] + "?" + a[101:]
    x, y = fp.PrefixHashes(a), fp.PrefixHashes(b)
    for _ in range(300):
        i, j = draw.randrange(len(a)), draw.randrange(len(b))
        size = draw.randrange(1, 6)
        assert x.equal(i, y, j, size) == (i + size <= len(a) and j + size <= len(b) and a[i : i + size] == b[j : j + size])
        common = 0
        while i + common < len(a) and j + common < len(b) and a[i + common] == b[j + common]:
            common += 1
        assert x.common(i, y, j) == common
    assert x.common(0, y, 0) == 100 and x.common(0, x, 0) == len(a) and x.equal(3, y, 3, 0)
    assert fp.PrefixHashes("").fingerprint() == "0:0000000000000000:"


def test_likeness():
    draw = random.Random(8)
    text = words(draw, 3000)
    one = fp.PrefixHashes(text).fingerprint()
    grams = lambda t: {t[k : k + fp.SPAN] for k in range(len(t) - fp.SPAN + 1)}
    last = 1.0
    for share in (0.05, 0.3, 0.6):
        other = text[: int(len(text) * (1 - share))] + words(draw, int(3000 * share))
        true = len(grams(text) & grams(other)) / len(grams(text) | grams(other))
        got = fp.likeness(one, fp.PrefixHashes(other).fingerprint())
        assert abs(got - true) < 0.2 and got < last
        last = got
    assert fp.likeness(one, one) == 1 and fp.likeness(one, fp.PrefixHashes(words(draw, 500)).fingerprint()) < 0.1
    assert fp.likeness(fp.PrefixHashes("").fingerprint(), one) == 0


def test_short_texts():
    draw = random.Random(12)
    pick = lambda n: "".join(draw.choice("abcdefghijklmnopqrstuvwxyzéß日😀 ") for _ in range(n))
    near = lambda a, b: fp.likeness(*(fp.PrefixHashes(t).fingerprint() for t in (a, b)))
    for n in range(3, 60):
        for m in (0, 2, n, 200):
            text, other = pick(n), pick(m)
            assert 0 < near(text, fp.edited(text, other)) <= 1
            assert near(text, fp.edited(text, other)) > near(text, other)
    grams = lambda t: {t[k : k + size] for size in fp.SHORT_SPANS for k in range(max(1, len(t) - size + 1))}
    for n in (3, 7, 8, 20):
        a, b = pick(n), pick(n)[: n // 2]
        b = a[: n - len(b)] + b
        assert len(grams(a) | grams(b)) <= fp.K and near(a, b) == (1 if a == b else len(grams(a) & grams(b)) / len(grams(a) | grams(b)))
    assert all(len(fp.PrefixHashes(pick(n)).short_sketch()) <= fp.K for n in range(1, fp.SHORT))
    # a short and a longer text have only the sketch of SPAN in common
    long = pick(36)
    assert near(long, long[:24]) == 1 / 13 and near("", "ab") == 0 and near("a", "a") == 1


def plain_print(text):
    """A fingerprint by its definition, from plain powers and spans: no prefix arrays, nothing of the module but its parameters."""
    codes = [ord(c) + 1 for c in text]
    whole = [sum(c * pow(b, k, p) for k, c in enumerate(codes)) % p for p, b in zip(fp.PRIMES, fp.BASES)]

    def spans(size):
        size = min(size, len(codes))
        found = set()
        powers = [[pow(b, k, p) for k in range(size)] for p, b in zip(fp.PRIMES, fp.BASES)]
        for at in range(len(codes) - size + 1) if size else ():
            x, y = (sum(c * w for c, w in zip(codes[at : at + size], ws)) % p for p, ws in zip(fp.PRIMES, powers))
            z = x << 32 | y
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                z = (z ^ z >> shift) * factor % 2**64
            found.add((z ^ z >> 31) >> 32)
        return found

    parts = [f"{len(text):x}", "".join(f"{x:08x}" for x in whole), "".join(f"{x:08x}" for x in sorted(spans(fp.SPAN))[: fp.K])]
    if 0 < len(text) < fp.SHORT:
        parts.append("".join(f"{x:08x}" for x in sorted(set().union(*(spans(n) for n in fp.SHORT_SPANS)))))
    return ":".join(parts)


def plain_likeness(one, other):
    """Of two fingerprints: the share of the K smallest of all values that both hold."""
    if one == other:
        return 1.0
    sets = [[{int(p[k : k + 8], 16) for k in range(0, len(p), 8)} for p in x.split(":")[2:]] for x in (one, other)]
    which = 1 if len(sets[0]) == len(sets[1]) == 2 else 0
    a, b = sets[0][which], sets[1][which]
    union = sorted(a | b)[: fp.K]
    return len([x for x in union if x in a and x in b]) / len(union) if union else 0.0


def brute(rows):
    """In order: doc_id descending, nulls last, then text; each with the next, the last with the first."""
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    out, held = [], {}
    mark = lambda t: held.setdefault(t, plain_print(t)) if len(t) < 3000 else held.setdefault(t, fp.PrefixHashes(t).fingerprint())  # noqa: E731  plain sums take too long for a few long texts
    for (i, text), (_, following) in zip(order, [*order[1:], *order[:1]]):
        cut = len(text) // 3
        changed = text[: len(text) - cut] + following[:cut]
        a, b, c = map(mark, (text, changed, following))
        common = [len(os.path.commonprefix([text, x])) for x in (changed, following)]
        out.append((i, len(text), hashlib.sha256(changed.encode()).hexdigest(), a, b, plain_likeness(a, b), plain_likeness(a, c), *common))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_edited", "common_next")


def test_compare_with_next(spark, odd, odd_docs, repeated, repeated_docs, no_docs):
    for rows, docs in ((odd, odd_docs), (repeated, repeated_docs), ([], no_docs), ([(7, "only one text", "a")], frame(spark, [(7, "only one text", "a")]))):
        assert found(fp.compare_with_next(docs), *COLUMNS) == brute([(i, t) for i, t, _ in rows])


def test_over_many_partitions(spark, small_docs, small_texts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        part = small_docs.where("n_chars < 1500")
        kept = {r["doc_id"] for r in part.select("doc_id").collect()}
        assert found(fp.compare_with_next(part), *COLUMNS) == brute([(i, t) for i, t, _ in small_texts if i in kept])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_query_and_texts(spark, small, odd, odd_docs):
    assert fp.op6_fingerprints(spark, small).columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_edited", "common_next"]
    texts = {r["doc_id"]: r["edited_text"] for r in fp.compare_with_next(odd_docs, digest=False).collect()}
    assert texts[1] == "" and len(texts[8]) == len({i: t for i, t, _ in odd}[8])
    own = {r["doc_id"]: r["fingerprint"] for r in fp.fingerprints(odd_docs).collect()}
    assert own[4] == own[5] and own[1] == own[2] and len({own[7], own[8], own[9], own[10]}) == 4
