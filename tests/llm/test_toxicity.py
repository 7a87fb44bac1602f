"""The grammar by hand, and held-out accuracy of what is learned."""

import math
import random
import re
import zlib

import pytest
from llm_helpers import EXTRA, SCHEMA, frame, words

from snaplog.llm import toxicity

PLAIN = toxicity.Model(["idiot", "scum"], ["dumm"])


def pooled(clauses):
    out = {}
    for c in clauses:
        for k, n in c.items():
            out[k] = out.get(k, 0) + n
    return out


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("What an idiot.", {"insult": 1}), ("You are an idiot, you scum!", {"insult_at": 2}), ("You are not an idiot.", {"insult_negated": 1}), ("He said: an idiot. What scum", {"insult_reported": 1, "insult": 1}),
        ('The word "idiot" is a word', {"insult_reported": 1}), ("I kill you", {"threat": 1}), ("you I kill", {"threat_at": 1}), ("never kill", {"threat_negated": 1}), ("idiotic Idiots", {}), ("IDIOT", {"insult": 1}),
        ("dummkopf dumm verdummt", {"insult": 2}), ("", {}), ("not so much of a very old idiot", {"insult": 1}), ("not\nidiot", {"insult": 1}), ("you. idiot", {"insult": 1}), ("idiot" * 3, {}),
    ],
)
def test_grammar(text, want):
    assert pooled(PLAIN.reader()(text)) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("l'imbécile", {"insult": 1}), ("C’est l’imbécile.", {"insult": 1}), ("an 'idiot'", {"insult": 1}), ("''idiot''", {"insult": 1}), ("'You idiot'", {"insult_at": 1}), ("'not' an idiot", {"insult_negated": 1}),
        ("idiot's scum", {"insult": 2}), ("idiot'scum", {"insult": 2}), ("it isn't an idiot", {"insult_negated": 1}), ("l'imbéciles", {}), ("n'est pas l'imbécile", {"insult_negated": 1}),
    ],
)
def test_apostrophes(text, want):
    assert pooled(toxicity.Model(["idiot", "scum", "imbécile"], ["dumm"]).reader()(text)) == want


def test_scores_follow_the_grammar():
    score = lambda text: PLAIN.score(PLAIN.reader()(text))
    assert score("nothing here") < score("not an idiot") < score("an idiot") < score("you idiot") < score("you idiot you scum") <= 1


def test_clauses_have_scores():
    read = PLAIN.reader()
    found = read("An idiot, you scum! Not an idiot; he said scum. Kill. I kill you\nnothing")
    assert found == [{"insult": 1, "insult_at": 1}, {"insult_negated": 1}, {"insult_reported": 1}, {"threat": 1}, {"threat": 1}]
    assert toxicity.parsed(toxicity.shown(found)) == found and toxicity.parsed("") == []
    one = lambda text: PLAIN.score(read(text))
    bare, aimed = one("an idiot"), one("you idiot")
    assert one("not an idiot") < bare < aimed and one("he said idiot") < bare
    assert one("a kill") < 0.5 <= one("you I kill") and one("you never kill") < one("you I kill") and one('you say "kill"') < 0.5
    # a document's evidence is its clauses' together
    assert one("an idiot. an idiot") > one("an idiot idiot") > bare
    assert one("word " * 300_000 + "you idiot") == aimed


def corpus(seed, n):
    draw = random.Random(seed)
    insults = ["zork", "blagg", "fnord", *(f"grumpf{s}" for s in ("a", "el", "ing", "um", "or", "ix"))]
    docs, labels = [], []
    for i in range(n):
        text, toxic = words(draw, draw.randint(5, 60)).split(), int(draw.random() < 0.25)
        for _ in range(draw.randint(1, 3) if toxic else 0):
            text.insert(draw.randint(0, len(text)), draw.choice(insults))
        docs.append((i, " ".join(text), "a"))
        if draw.random() < 0.8:
            labels.append((i, 1, toxic))
    return docs, labels


def test_held_out(spark):
    docs, labels = corpus(1, 900)
    truth = {i: t for i, _, t in labels}
    df, marks = frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.learn(df, marks)
    assert {"zork", "blagg", "fnord"} <= set(model.words) and any("grumpf".startswith(s) for s in model.stems)
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score(df, model).collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 100 and sum((got[i] >= 0.5) == truth[i] for i in held) / len(held) > 0.95
    # labels of held-out rows change nothing
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    again = toxicity.learn(df, spark.createDataFrame(flipped, "doc_id long, quality int, toxic int"))
    assert (again.words, again.stems, again.bias, again.weights) == (model.words, model.stems, model.bias, model.weights)
    # copies of one toxic document teach no words but insults
    copies = [(5000 + k, "zork " + " ".join(f"rare{j}" for j in "abcdefgh"), "a") for k in range(40)]
    more = toxicity.learn(frame(spark, docs + copies), spark.createDataFrame(labels + [(i, 1, 1) for i, _, _ in copies], "doc_id long, quality int, toxic int"))
    assert not any(w.startswith("rare") for w in more.words) and not any("rarea".startswith(s) for s in more.stems)


def test_edges(spark, odd_docs, repeated_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    nulls = spark.createDataFrame([(None, 1, 1), (4, 1, None), (4, None, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, nulls):
        for docs in (odd_docs, repeated_docs, no_docs):
            model = toxicity.learn(docs, labels)
            out = toxicity.score(docs, model, "rank").collect()
            assert len(out) == docs.count() and all(0 <= r["toxicity"] <= 1 and r["rank"] == "x" for r in out)
    kept = toxicity.keep_clean(odd_docs, toxicity.Model(["one"], []))
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 2
    assert kept.where("text is null").count() == 1 and set(EXTRA) < set(kept.columns) and SCHEMA


def plain_score(model, text):
    """The grammar read word by word over every clause, without automaton or transducers, and the sum written out."""
    z = model.bias
    for clause in re.split(r"[.!?;\n\r]+", text.lower()):
        last = {"at": -99, "negated": -99}
        quoted = verb = False
        seen = dict.fromkeys(toxicity.OUTPUTS, 0)
        for k, word in enumerate(re.findall(rf"[\w]+|[{toxicity.QUOTES}]", clause)):
            kind = "threat" if word in toxicity.THREATS else "insult" if word in model.words or any(word.startswith(s) for s in model.stems) else None
            if kind == "insult" or kind == "threat":
                mark = "reported" if quoted or verb else "negated" if k - last["negated"] <= toxicity.SCOPE else "at" if k - last["at"] <= toxicity.REACH else None
                seen[kind] += 1
                if mark:
                    seen[f"{kind}_{mark}"] += 1
            elif word in toxicity.QUOTES:
                quoted = not quoted
            elif word in toxicity.REPORTING:
                verb = True
            elif word in toxicity.NEGATIONS:
                last["negated"] = k
            elif word in toxicity.TARGETS:
                last["at"] = k
        z += sum(model.weights[x] * math.log2(1 + n) for x, n in seen.items())
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def test_scores_against_plain_reading(spark, small_docs, small_texts):
    hard = ["clown", "idiot", "loser", "trash", "kill", "you", "not", "said", '"', "he", "word", ".", "!", "\n", "never", "burn"]
    draw = random.Random(11)
    rows = [(k, " ".join(draw.choice(hard) for _ in range(draw.randint(0, 40))), "a") for k in range(300)]
    texts = [(i, t, s) for i, t, s in small_texts if t and "'" not in t and "’" not in t]
    model = toxicity.Model(["clown", "idiot"], ["los", "trash"], -4.0, {k: w + 0.1 for k, w in toxicity.OUTPUTS.items()})
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score(frame(spark, rows), model).collect()}
    assert all(got[i] == pytest.approx(plain_score(model, t), abs=1e-12) for i, t, _ in rows) and len({round(x, 6) for x in got.values()}) > 100
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score(small_docs, model).collect()}
    assert all(got[i] == pytest.approx(plain_score(model, t), abs=1e-12) for i, t, _ in texts)


def test_query(spark, small):
    rows = toxicity.op5_toxicity(spark, small).collect()
    assert len(rows) == 200 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) for r in rows)
