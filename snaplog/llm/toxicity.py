"""Toxicity by a weighted finite-state pattern grammar.

A text is cut into clauses at . ! ? ; and line ends. A clause's words become symbols (insult, threat,
target, negation, reporting verb, quotation mark, other), and four transducers, composed into one
table, read the symbols from left to right:

  target    an insult or threat within REACH words of a word that points at someone
  negation  what follows a negation within SCOPE words is negated
  report    what stands in quotation marks, or after a reporting verb in the clause, is reported
  match     an insult or threat in the state of the other three gives an output symbol

Only clauses that hold an insult or threat are read; an Aho-Corasick automaton over the whole
lower-cased text finds them. Each clause has a strength: of each of its output symbols, the weight
times log2(1 + how often). A clause's score is the logistic function of the bias and its strength, a
document's that of the bias and its clauses' strengths together. Weights are learned (ridge-penalised
logistic regression towards prior weights), as is the insult lexicon: whole words and stems that mark
labelled toxic documents. Threats are a fixed list, whose weights are learned like the others.

A term counts as evidence only if it stands in SUPPORT different contexts, and in half as many as
toxic documents have it (VARIED at most; a stem also in STEM_WORDS different words), so that copies
of one toxic document teach nothing but that document's insults. Learning is bounded: at most SAMPLE
labelled rows of either label, those with the smallest md5 of doc_id; what is learned from them has no
other limit. Rows whose crc32(doc_id as text) mod 5 is 0 are never learned from. A doc_id labelled more
than once counts as toxic if one of its labels does.

Defined results: a null or empty text gets the bias alone; a very long text is read whole, clause by
clause; repeated rows get equal scores; an empty table gives no rows; without labels only the fixed
lists count, under the prior weights; null labels are ignored, and so are other columns.
"""

from __future__ import annotations

import math
import re
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, table, texts

SAMPLE, SUPPORT, LIFT, STEM_WORDS, VARIED = 8_000, 4, math.log(20), 4, 24
STEM_LENGTHS = (4, 5, 6, 7)
#: Terms that a task holds before it gives their counts on.
TERMS = 200_000
REACH, SCOPE = 4, 3

THREATS = "kill murder strangle stab shoot beat burn hurt destroy lynch töten umbringen erschießen verbrennen tuer étrangler brûler frapper matar golpear quemar disparar".split()
TARGETS = "you your yours yourself u ur he she they them him her these those du dich dir dein ihr euch sie er tu te toi ton vous votre ils elles il elle usted ustedes tú ti tus ellos ellas él ella".split()
NEGATIONS = "not no never none nobody nothing neither nor without isn't aren't wasn't don't doesn't didn't won't can't nicht kein keine keinen nie niemals ohne ne pas jamais sans aucun nunca ningún sin jamás tampoco".split()
REPORTING = "said says say saying told tells wrote writes claimed claims called calls quoted quotes reported reports alleged according sagte sagt schrieb nannte behauptet laut dit disait écrit appelait selon dijo dice escribió llamó según".split()
QUOTES = "\"“”„«»‹›"

#: Output symbols and the prior weight of each: that of the bare symbol counts for every match, the others come on top.
OUTPUTS = {
    "insult": 3.0, "insult_at": 1.0, "insult_negated": -1.5, "insult_reported": -1.5,
    "threat": 0.5, "threat_at": 5.5, "threat_negated": -0.5, "threat_reported": -0.5,
}
BIAS, RIDGE = -3.0, 0.05

TOKEN = re.compile(rf"[\w'’]+|[{QUOTES}]")
WORDS = re.compile(r"[^\W\d_]+")
CLAUSE_END = re.compile(r"[.!?;\n\r]+")
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE = range(7)


class Transducer:
    """States 0 .. n - 1 from 0; ``step(state, symbol)`` gives the next state and a mark or None."""

    def __init__(self, n: int, step):
        self.table = [[step(state, symbol) for symbol in range(7)] for state in range(n)]

    def compose(self, other: Transducer) -> Transducer:
        """Both read the same symbols side by side; the marks are joined into one tuple."""
        n = len(other.table)

        def step(state: int, symbol: int):
            (a, x), (b, y) = self.table[state // n][symbol], other.table[state % n][symbol]
            return a * n + b, (x if isinstance(x, tuple) else (x,)) + (y if isinstance(y, tuple) else (y,))

        return Transducer(len(self.table) * n, step)


def _target(state: int, symbol: int):
    now = REACH if symbol == TARGET else max(0, state - 1)
    return now, "at" if state and symbol in (INSULT, THREAT) else None


def _negation(state: int, symbol: int):
    now = SCOPE if symbol == NEGATION else max(0, state - 1)
    return now, "negated" if state and symbol in (INSULT, THREAT) else None


def _report(state: int, symbol: int):
    """0 plain, 1 after a reporting verb, 2 in quotation marks, 3 both."""
    now = state ^ 2 if symbol == QUOTE else state | 1 if symbol == REPORT else state
    return now, "reported" if state and symbol in (INSULT, THREAT) else None


def _match(state: int, symbol: int):
    return 0, {INSULT: "insult", THREAT: "threat"}.get(symbol)


def grammar() -> list[list[tuple[int, str | None]]]:
    """The composed table: state, symbol -> next state, output symbol."""
    whole = Transducer(1, _match).compose(Transducer(REACH + 1, _target)).compose(Transducer(SCOPE + 1, _negation)).compose(Transducer(4, _report))

    def name(marks: tuple) -> str | None:
        kind, at, negated, reported = marks
        return kind and "_".join(x for x in (kind, reported or negated or at) if x)

    return [[(state, name(marks)) for state, marks in row] for row in whole.table]


class Model:
    """Lexicon (words and stems of insults), bias and weights; small, and made of plain values."""

    def __init__(self, words: list[str], stems: list[str], bias: float = BIAS, weights: dict[str, float] | None = None):
        self.words, self.stems, self.bias, self.weights = words, stems, bias, weights or dict(OUTPUTS)

    def reader(self):
        """A function text -> [{output symbol: times} of each clause that matches]."""
        import ahocorasick

        found = ahocorasick.Automaton()
        marks = dict.fromkeys(THREATS, (THREAT, True)) | dict.fromkeys(self.words, (INSULT, True)) | dict.fromkeys(self.stems, (INSULT, False))
        for word, (symbol, whole) in marks.items():
            found.add_word(word, (len(word), symbol, whole))
        if marks:
            found.make_automaton()
        fixed = dict.fromkeys(TARGETS, TARGET) | dict.fromkeys(NEGATIONS, NEGATION) | dict.fromkeys(REPORTING, REPORT) | dict.fromkeys(QUOTES, QUOTE)
        rules = grammar()

        def read(text: str) -> list[dict[str, int]]:
            low = text.lower()
            hits: dict[int, int] = {}  # start of the word -> symbol
            for end, (size, symbol, whole) in found.iter(low) if marks else ():
                start = end - size + 1
                if (start and (low[start - 1].isalnum() or low[start - 1] == "_")) or (whole and end + 1 < len(low) and (low[end + 1].isalnum() or low[end + 1] == "_")):
                    continue
                hits[start] = min(symbol, hits.get(start, symbol))
            clauses: list[dict[str, int]] = []
            done = 0
            for first in sorted(hits):
                if first < done:
                    continue
                start = max(map(lambda c: low.rfind(c, done, first) + 1, ".!?;\n\r"), default=0)
                start = max(start, done)
                close = CLAUSE_END.search(low, first)
                done = close.start() if close else len(low)
                state, out = 0, {}
                for token in TOKEN.finditer(low, start, done):
                    at, word = token.start(), token[0].replace("’", "'")
                    # an apostrophe (an elision, a single quotation mark) may stand before a word that was found, within the token
                    starts = [at, *(at + k + 1 for k, c in enumerate(word) if c == "'")] if "'" in word else [at]
                    for mark in [hits[k] for k in starts if k in hits] or [fixed.get(word.strip("'"), OTHER)]:
                        state, symbol = rules[state][mark]
                        if symbol:
                            out[symbol] = out.get(symbol, 0) + 1
                if out:
                    clauses.append(out)
            return clauses

        return read

    def score(self, clauses: list[dict[str, int]]) -> float:
        """Of one clause or several together."""
        z = self.bias + sum(self.weights[k] * x for k, x in _strengths(clauses).items() if x)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _strengths(clauses: list[dict[str, int]]) -> dict[str, float]:
    """Of each output symbol the sum, over clauses, of log2(1 + times); a bare symbol's times are those of all of its kind."""
    out = dict.fromkeys(OUTPUTS, 0.0)
    for counts in clauses:
        for k in OUTPUTS:
            out[k] += math.log2(1 + sum(n for x, n in counts.items() if x == k or "_" not in k and x.startswith(f"{k}_")))
    return out


def shown(clauses: list[dict[str, int]]) -> str:
    """Clauses as text: apart by |, symbols by ; within."""
    return "|".join(";".join(f"{k}={n}" for k, n in sorted(c.items())) for c in clauses)


def parsed(text: str) -> list[dict[str, int]]:
    return [{k: int(n) for k, n in (x.split("=") for x in c.split(";"))} for c in text.split("|") if c]


def _terms(text: str) -> dict[str, tuple[int, int]]:
    """Words and stems (with *) of a text, each with 64-bit sets of hashed contexts (the words around) and forms."""
    out: dict[str, tuple[int, int]] = {}
    found = WORDS.findall(text.lower())
    for before, word, after in zip(["", *found], found, [*found[1:], ""]):
        if len(word) > 2:
            marks = 1 << (zlib.crc32(f"{before} {after}".encode()) & 63), 1 << (zlib.crc32(word.encode()) & 63)
            for term in (word, *(word[:n] + "*" for n in STEM_LENGTHS if len(word) >= n)):
                old = out.get(term, (0, 0))
                out[term] = old[0] | marks[0], old[1] | marks[1]
    return out


def _fit(rows: list[tuple[list, int]]) -> tuple[float, dict[str, float]]:
    """Newton's method on the penalised likelihood; as many columns as output symbols."""
    import numpy as np

    names = list(OUTPUTS)
    x = np.array([[1.0, *_strengths(c).values()] for c, _ in rows]).reshape(-1, 1 + len(names))
    y, prior = np.array([t for _, t in rows], dtype=float), np.array([BIAS, *OUTPUTS.values()])
    w, ridge = prior.copy(), RIDGE * np.array([0.01, *[1.0] * len(names)]) * max(1.0, math.sqrt(len(rows)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * (w - prior))
        w += step
        if abs(step).max() < 1e-9:
            break
    return float(w[0]), dict(zip(names, map(float, w[1:])))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns the lexicon, the bias and the weights from a bounded sample of labelled rows."""
    of = F.col("doc_id").cast("long")
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select(of.alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.md5(F.col("doc_id").cast("string").cast("binary"))
    # at most 2 * sample rows, so broadcasting them is safe at any size of input
    chosen = [marked.where(F.col("toxic") == k).orderBy(order, "doc_id").limit(sample) for k in (0, 1)]
    rows = texts(docs).join(F.broadcast(chosen[0].union(chosen[1])), "doc_id").select("doc_id", "text", "toxic")

    def count(batches):
        from collections import Counter

        import pyarrow as pa

        def fresh():
            return (Counter(), Counter()), {}, [0, 0]

        seen, marks, documents = fresh()
        signed = lambda x: x - (1 << 64) if x >> 63 else x

        def emit():
            terms = list(seen[0].keys() | seen[1].keys())
            own = [marks.get(t, (0, 0)) for t in terms]
            columns = [[documents[k], *(seen[k][t] for t in terms)] for k in (0, 1)] + [[0, *(signed(m[k]) for m in own)] for k in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array(["", *terms]), *(pa.array(c, pa.int64()) for c in columns)], names=["term", "clean", "toxic", "contexts", "forms"])

        for batch in bounded(batches):
            for text, toxic in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                documents[toxic] += 1
                found = _terms(text)
                seen[toxic].update(found.keys())
                if toxic:
                    for term, (x, y) in found.items():
                        old = marks.get(term, (0, 0))
                        marks[term] = old[0] | x, old[1] | y
            if len(seen[0]) + len(seen[1]) > TERMS:
                yield emit()
                seen, marks, documents = fresh()
        yield emit()

    schema = "term string, clean long, toxic long, contexts long, forms long"
    counts = rows.mapInArrow(count, schema).groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), F.bit_count(F.bit_or("contexts")).alias("contexts"), F.bit_count(F.bit_or("forms")).alias("forms"))
    # words of one much-copied document have its contexts only, and are not evidence
    varied = (F.col("contexts") >= F.greatest(F.lit(SUPPORT), F.least(F.lit(VARIED), F.col("toxic") / 2))) & (~F.col("term").endswith("*") | (F.col("forms") >= STEM_WORDS))
    total = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    base = math.log((total.get(1, 0) + 0.5) / (total.get(0, 0) + 0.5))
    lift = F.log((F.col("toxic") + 0.5) / (F.col("clean") + 0.5)) - F.lit(base)
    # strong terms of a bounded sample come to the driver
    best = counts.where((F.col("term") != "") & varied & (F.col("toxic") > F.col("clean")) & (lift >= LIFT)).collect()
    strong = {r["term"] for r in best}
    words = sorted(t for t in strong if not t.endswith("*"))
    counts_of = {r["term"]: (r["clean"], r["toxic"]) for r in best}
    # a stem gives way to a longer one, or a word, that explains it and stands in fewer clean documents
    narrower = lambda s, o: o != s and o.startswith(s[:-1]) and counts_of[o][0] < counts_of[s][0] and counts_of[o][1] >= 0.8 * counts_of[s][1]
    stems = sorted(t[:-1] for t in strong if t.endswith("*") and not any(narrower(t, o) for o in strong))
    stems = [s for s in stems if not any(s != o and s.startswith(o) for o in stems)]
    model = Model([w for w in words if not any(w.startswith(s) for s in stems)], stems)

    def features(batches):
        import pyarrow as pa

        read = model.reader()
        for batch in bounded(batches):
            found = [read(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([shown(c) for c in found]), batch.column(2)], names=["clauses", "toxic"])

    # at most 2 * sample short strings come to the driver, equal ones as one row
    kinds = rows.mapInArrow(features, "clauses string, toxic int").groupBy("clauses", "toxic").count().orderBy("clauses", "toxic").collect()
    seen = [(parsed(r["clauses"]), r["toxic"]) for r in kinds for _ in range(r["count"])]
    if seen:
        model.bias, model.weights = _fit(seen)
        # the sample has its own share of toxic rows; the bias goes back to the labels' share
        all_of = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
        odds = lambda toxic, clean: math.log((toxic + 0.5) / (clean + 0.5))
        model.bias += odds(all_of.get(1, 0), all_of.get(0, 0)) - odds(sum(t for _, t in seen), sum(1 - t for _, t in seen))
    return model


def score(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """doc_id, toxicity (0 to 1), clauses (what matched), and the columns named."""

    def run(batches):
        import pyarrow as pa

        read = model.reader()
        for batch in bounded(batches):
            found = [read(text) for text in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([model.score(c) for c in found], pa.float64()), pa.array([shown(c) for c in found]), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "toxicity", "clauses", *batch.schema.names[2:]])

    kinds = dict(docs.dtypes)
    return texts(docs, *keep).mapInArrow(run, ", ".join(["doc_id long, toxicity double, clauses string", *(f"`{c}` {kinds[c]}" for c in keep)]))


def keep_clean(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that score below ``least``."""
    place = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        read = model.reader()
        for batch in bounded(batches):
            yield batch.filter(pa.array([model.score(read(text or "")) < least for text in batch.column(place).to_pylist()]))

    return docs.mapInArrow(run, docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLES: dict[str, str] = {}
