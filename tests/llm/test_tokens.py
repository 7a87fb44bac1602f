"""Packing and token files against the tokenizers library, by exact round trips."""

import random
import zlib

import numpy as np
import pytest
from llm_helpers import frame

from snaplog.llm import common, packing, tokenfiles


@pytest.fixture(scope="module")
def encode():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_engines_agree(encode, odd, small_texts):
    draw = random.Random(2)
    odd_ones = ["<|endoftext|> x", "a <|endoftext|><|endoftext|>  b<|endoftext|", "x<|endoftext|>\n", "\x00\x01", "   ", "'S 's don't", "１２３ ½ ²", "  ᠎\u0085 a", "á̧", "𝒳𝒴 👩‍👩‍👧", "x" * 3000]
    odd_ones += ["".join(chr(draw.choice([draw.randrange(32, 127), draw.randrange(160, 0x3000), draw.randrange(0x1F300, 0x1F600)])) for _ in range(200)) for _ in range(60)]
    own, library = common.Encoder(), common.Encoder(engine="tokenizers")
    for text in [t or "" for _, t, _ in [*odd, *small_texts]] + odd_ones:
        assert own(text).tolist() == encode(text) == library(text).tolist()
    assert own("<|endoftext|> x", 7).tolist() == [50256, 2124, 7]
    with pytest.raises(ValueError):
        common.Encoder(engine="none")


def test_very_long_white_space(spark, tmp_path, encode):
    texts = [" " * 1_200_000, "ab" + "\n" * 1_200_000 + "cd", "\u3000 \t" * 400_000 + "x", "short  text"]
    own = common.Encoder()
    want = [encode(text) for text in texts]
    assert [own(text).tolist() for text in texts] == want
    docs = frame(spark, [(k, text, "a") for k, text in enumerate(texts)])
    pieces = {}
    for p in packing.pack_documents(docs).collect():
        pieces.setdefault(p["doc_id"], []).append((p["start"], p["ids"]))
    assert [b"".join(ids for _, ids in sorted(pieces[k])) for k in range(4)] == [np.array([*w, 1], dtype="<u4").tobytes() for w in want]
    tokenfiles.write_token_files(docs, f"file://{tmp_path}/long")
    got = {r["doc_id"]: r["ids"] for r in tokenfiles.read_token_files(spark, f"file://{tmp_path}/long").collect()}
    assert [got[k] for k in range(4)] == [np.array([*w, 0], dtype="<u4").tobytes() for w in want]


def test_parts_give_the_ids_of_the_whole(encode, odd, small_texts, monkeypatch):
    whole = " ".join(t or "" for _, t, _ in [*odd, *small_texts])
    joined = [whole[:300_000], "a b  c\nd e" * 500, "no-seam" * 900, " a" * 900, "1 a 2 b" * 90, "<|endoftext|> x y" * 60, "don't say 's 'll x" * 90]
    for most in (1, 7, 100, 5_000):
        monkeypatch.setattr(common, "LONG", most)
        own = common.Encoder()
        for text in joined[:1] if most > 100 else joined[1:]:
            assert own(text).tolist() == encode(text)


def test_one_encoder_a_process():
    assert common.encoder() is common.encoder() and common.encoder(engine="tokenizers") is not common.encoder()


def check_pieces(pieces, rows, encode, length):
    """Pieces give every document back, and fill gapless sequences of this length."""
    by_seq, by_doc = {}, {}
    for p in pieces:
        by_seq.setdefault(p["sequence_id"], []).append(p)
        by_doc.setdefault((p["doc_id"], p["doc_tokens"]), []).append(p)
        assert len(p["ids"]) == 4 * p["length"] and p["length"] > 0
    for n, seq in by_seq.items():
        seq.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in seq] == list(np.cumsum([0, *(p["length"] for p in seq)])[:-1])
        assert sum(p["length"] for p in seq) == length or n == max(by_seq)
    assert sorted(by_seq) == list(range(len(by_seq)))
    want = sorted(np.array([*encode(t), 1], dtype="<u4").tobytes() for _, t, _ in rows)
    assert sum(p["length"] for p in pieces) == sum(len(w) // 4 for w in want)
    return by_doc, want


@pytest.mark.parametrize("length", [2048, 7])
def test_packing(encode, odd, odd_docs, length):
    pieces = packing.pack_documents(odd_docs, length).collect()
    by_doc, want = check_pieces(pieces, odd, encode, length)
    got = []
    for (_, total), own in by_doc.items():
        own.sort(key=lambda p: p["start"])
        assert [p["start"] for p in own] == list(np.cumsum([0, *(p["length"] for p in own)])[:-1])
        ids = b"".join(p["ids"] for p in own)
        assert len(ids) == 4 * total
        got.append(ids)
    assert sorted(got) == want


def test_packing_repeats_and_nothing(encode, repeated, repeated_docs, no_docs):
    check_pieces(packing.pack_documents(repeated_docs, 16).collect(), repeated, encode, 16)
    assert packing.pack_documents(no_docs).count() == 0


def test_packing_query(spark, small, small_texts, encode):
    texts = dict((i, t) for i, t, _ in small_texts)
    for r in packing.op3_packing(spark, small).collect():
        ids = np.array([*encode(texts[r["doc_id"]]), 1], dtype="<u4")
        assert r["doc_tokens"] == len(ids) and zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 32])
def test_bits(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, size=1001, dtype=np.uint64).astype("<u4")
    data = tokenfiles.pack_bits(ids, bits)
    assert len(data) == -(-1001 * bits // 8) and (tokenfiles.unpack_bits(data, bits, 1001) == ids).all()
    shard = tokenfiles.write_shard([5, None, 7], [ids[:10], ids[:0], ids], bits, block=100)
    own = tokenfiles.Shard(shard)
    assert own.nbytes == len(shard) and [s.documents for s in tokenfiles.shards(shard + tokenfiles.write_shard([], [], bits) + shard)] == [3, 0, 3]
    whole = np.concatenate([ids[:10], ids])
    assert all((own.range(a, b) == whole[a:b]).all() for a, b in ((0, 1011), (99, 101), (250, 250), (1000, 1011), (7, 13)))
    assert len(own.document(1)) == 0 and (own.document(2) == ids).all() and own.doc_ids[2] == 7 and not own.known[1]
    for bad in (b"nope" + shard[4:], shard[:100] + bytes([shard[100] ^ 1]) + shard[101:], shard[:-9]):
        with pytest.raises(ValueError):
            tokenfiles.Shard(bytes(bad))
    if bits < 32:
        with pytest.raises(ValueError):
            tokenfiles.write_shard([1], [np.array([2**bits], dtype="<u4")], bits)


def test_width():
    assert [tokenfiles.width(n) for n in (1, 2, 3, 256, 257, 50257, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]


@pytest.mark.parametrize(("shard", "in_file"), [(tokenfiles.SHARD, tokenfiles.FILE), (50, 3)])
def test_files(spark, tmp_path, encode, odd, odd_docs, repeated, repeated_docs, no_docs, shard, in_file):
    for k, (rows, docs) in enumerate(((odd, odd_docs), (repeated, repeated_docs), ([], no_docs))):
        path = f"file://{tmp_path}/{k}"
        tokenfiles.write_token_files(docs, path, shard=shard, in_file=in_file)
        got = sorted(tokenfiles.read_token_files(spark, path).collect(), key=lambda r: r["start"])
        order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
        at = 0
        assert len(got) == len(order)
        for r, (doc_id, text, _) in zip(got, order):
            ids = np.array([*encode(text), 0], dtype="<u4").tobytes()
            assert (r["doc_id"], r["start"], r["n_tokens"], r["ids"]) == (doc_id, at, len(ids) // 4, ids)
            at += len(ids) // 4


def test_files_query(spark, small, small_texts, encode):
    got = {r["doc_id"]: r for r in tokenfiles.op4_token_files(spark, small).collect()}
    at = 0
    for doc_id, text, _ in sorted(small_texts, key=lambda r: r[0]):
        ids = np.array([*encode(text), 0], dtype="<u4")
        assert tuple(got[doc_id])[1:] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
