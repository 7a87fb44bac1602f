"""Secret scans, in DataFrame functions only.

Base findings are three fixed patterns over whole texts. The method adds spans: candidate strings
(runs of a character class) that no allow-list entry suppresses are read once from left to right
with a window of fixed length; the counts of the window's characters are kept by adding the one that
enters and taking away the one that leaves, and so is the sum of f(count), f(c) = c log2 c. A window
whose Shannon entropy reaches its class's threshold is part of a span. f is held in whole 2^-20
units, so the sum that was kept by steps equals one computed afresh.

Positions are code points, end exclusive. They come from splitting a text at its matches: a match
starts after all pieces and matches before it. Prefix sums are taken in blocks of about the square
root of their number, runs are read in segments of SEGMENT windows, and base spans are looked up by
halving, so a text's cost stays close to its length whatever it holds.

Defined results: a null or empty text has no span; rows that repeat a doc_id are judged each; a
very long text is read whole, and so is a very long run of one class; an empty table gives no rows;
other columns are ignored. An added span within one base span is not reported; one that reaches past
it is, whole. In ``redact`` a null text stays null and an empty one empty. No row is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_rows, table, texts

#: Fixed by the contract: kind, pattern, which group must be how long.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
UNIT, WINDOW = 1 << 20, 24
#: Kind, characters of the class (their place is their count's place), pattern of its runs, least bits a character.
CLASSES = (
    ("entropy_hex", "0123456789abcdefABCDEF", r"[0-9A-Fa-f]{24,}", 3.0),
    ("entropy_base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-", r"[A-Za-z0-9+/=_-]{24,}", 3.9),
)
#: A candidate that one of these finds is suppressed: words, numbers, UUIDs, dates, placeholders, runs of one character.
ALLOWED = (
    r"^[A-Za-z_=/-]+$",
    r"^[0-9+/=_-]+$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}",
    r"[Ee]xample|EXAMPLE|[Pp]laceholder|PLACEHOLDER|[Cc]hange_?me|CHANGE_?ME|[Dd]ummy|DUMMY",
    r"xxxxxxxx|XXXXXXXX|00000000|--------|========|________|12345678901234567890|abcdefghijklmnop",
)
#: And what this does not find: a path of words, each of letters and then four digits at most (in this form no regex engine recurses).
NO_PATH = r"[^A-Za-z0-9/]|//|[0-9][A-Za-z]|[0-9]{5}|^[0-9]+/|/[0-9]+/|^/?[^/]*$"
SEGMENT = 1 << 15


def _scaled() -> list[int]:
    return [0] + [round(c * math.log2(c) * UNIT) for c in range(1, WINDOW + 1)]


def _limit(bits: float) -> int:
    """Entropy >= bits exactly when the window's sum of f(count) is at most this."""
    return math.floor(WINDOW * (math.log2(WINDOW) - bits) * UNIT)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: an expression repeated within a lambda would be computed each time."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, fold) -> Column:
    """Running results of ``fold`` over an array of longs that isn't empty, in blocks of about the square root of its size."""

    def block(own: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            now = F.when(acc["last"].isNull(), x).otherwise(fold(acc["last"], x))
            return let(now, lambda y: F.struct(y.alias("last"), F.concat(acc["out"], F.array(y)).alias("out")))

        start = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<long>").alias("out"))
        return F.aggregate(own, start, step, lambda acc: acc["out"])

    def whole(v: Column) -> Column:
        wide = F.ceil(F.sqrt(F.size(v))).cast("int")
        blocks = F.transform(F.sequence(F.lit(1), F.size(v), wide), lambda s: block(F.slice(v, s, wide)))
        return let(blocks, lambda b: let(block(F.transform(b, lambda x: F.element_at(x, -1))), lambda ends: carried(b, ends)))

    def carried(blocks: Column, ends: Column) -> Column:
        return F.flatten(F.transform(blocks, lambda b, k: F.when(k == 0, b).otherwise(let(F.get(ends, k - 1), lambda e: F.transform(b, lambda x: fold(e, x))))))

    return let(values, whole)


FOUND = "array<struct<start:int,end:int,low:int,high:int,found:string>>"
_HALF, _LOW = 1 << 32, (1 << 32) - 1


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of FOUND of all leftmost non-overlapping matches: low and high are bytes, found is the group's text."""
    extract = lambda k: F.regexp_extract_all(text, F.lit(pattern), F.lit(k))
    # characters and bytes are summed in the halves of one long
    size = lambda x: F.length(x).cast("long") * F.lit(_HALF) + F.octet_length(x)
    upper, lower = (lambda x: F.shiftright(x, 32).cast("int")), (lambda x: x.bitwiseAND(F.lit(_LOW)).cast("int"))

    def at(end: Column, x: Column) -> Column:
        begin = end - size(x["m"])
        return F.struct(upper(begin).alias("start"), upper(end).alias("end"), lower(begin).alias("low"), lower(end).alias("high"), x["g"].alias("found"))

    def places(t: Column) -> Column:
        totals = F.zip_with(F.slice(t["p"], F.lit(1), F.size(t["m"])), t["m"], lambda p, m: size(p) + size(m))
        return F.zip_with(running(totals, lambda a, b: a + b), F.arrays_zip(t["m"].alias("m"), t["g"].alias("g")), at)

    parts = F.struct(F.split(text, pattern, -1).alias("p"), extract(0).alias("m"), extract(group).alias("g"))
    return F.when(text.rlike(pattern), let(parts, places)).otherwise(F.array()).cast(FOUND)


#: Counts of a window, five bits each, in words of PER.
PER, BITS = 12, 5
SPANS = "array<struct<start:int,end:int>>"


def high_entropy(text: Column, alphabet: str, bits: float, segment: int = SEGMENT) -> Column:
    """Array of (start, end) of the unions of windows of ``text``, a run of ``alphabet``, with at least ``bits`` a character."""
    f = F.array(*[F.lit(x) for x in _scaled()])
    words = range(-(-len(alphabet) // PER))
    shift = lambda way, x, by: F.call_function(f"shift{way}", x, by)
    one = F.lit(1).cast("long")

    def code(char: Column) -> Column:
        return let(F.instr(F.lit(alphabet), char) - 1, lambda k: F.struct(F.floor(k / PER).cast("int").alias("word"), (k % PER * BITS).alias("by")))

    def count(acc: Column, x: Column) -> Column:
        return shift("right", F.get(F.array(*[acc[f"c{w}"] for w in words]), x["word"]), x["by"]).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")

    def step(acc: Column, x: Column) -> Column:
        """x: the character that enters, the one that leaves (or null), and the place after the window."""
        enters, leaves = x["enters"], x["leaves"]
        moved = lambda w, c: F.when(c["word"] == w, shift("left", one, c["by"])).otherwise(F.lit(0).cast("long"))
        counts = [(acc[f"c{w}"] + moved(w, enters) - moved(w, leaves)).alias(f"c{w}") for w in words]
        up, down = count(acc, enters), count(acc, leaves)
        rise = let(up, lambda c: F.get(f, c + 1) - F.get(f, c))
        fall = F.when(leaves.isNull(), F.lit(0)).otherwise(let(down, lambda c: F.get(f, c - 1) - F.get(f, c)))
        total = acc["sum"] + F.when(leaves.isNotNull() & (enters == leaves), F.lit(0)).otherwise(rise + fall)
        return let(total.cast("long"), lambda t: marked(acc, counts, t, x["end"]))

    def marked(acc: Column, counts: list, total: Column, end: Column) -> Column:
        hit = (end >= WINDOW) & (total <= F.lit(_limit(bits)))
        first = end - WINDOW
        apart = acc["start"].isNull() | (first > acc["end"])
        closed = F.when(hit & acc["start"].isNotNull() & apart, F.concat(acc["out"], F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end")))))
        return F.struct(
            *counts, total.alias("sum"), F.when(hit & apart, first).otherwise(acc["start"]).alias("start"),
            F.when(hit, end).otherwise(acc["end"]).alias("end"), F.coalesce(closed, acc["out"]).alias("out"),
        )

    zero, none = F.lit(0).cast("long"), F.lit(None).cast("int")
    begin = F.struct(*[zero.alias(f"c{w}") for w in words], zero.alias("sum"), none.alias("start"), none.alias("end"), F.array().cast(SPANS).alias("out"))
    ended = lambda acc: F.when(acc["start"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end")))))

    def piece(low: Column) -> Column:
        """Spans of the windows that start at low .. low + segment - 1."""
        own = F.substring(text, low + 1, F.lit(segment + WINDOW - 1))
        chars = F.transform(F.filter(F.split(own, ""), lambda c: c != ""), code)
        steps = lambda v: F.transform(v, lambda c, i: F.struct(c.alias("enters"), F.get(v, i - WINDOW).alias("leaves"), (i + 1).alias("end")))
        spans = F.aggregate(let(chars, steps), begin, step, ended)
        return F.transform(spans, lambda x: F.struct((x["start"] + low).alias("start"), (x["end"] + low).alias("end")))

    pieces = F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(F.length(text) - WINDOW, F.lit(0)), F.lit(segment)), piece))
    return let(pieces, unions)


def unions(v: Column) -> Column:
    """Sorted spans, whose ends ascend too, with those that touch joined."""
    starts = F.filter(v, lambda x, k: (k == 0) | (x["start"] > F.get(v, k - 1)["end"]))
    ends = F.filter(v, lambda x, k: (k == F.size(v) - 1) | (F.get(v, k + 1)["start"] > x["end"]))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a["start"].alias("start"), b["end"].alias("end")))


def within(spans: Column, x: Column) -> Column:
    """Whether x lies in one of ``spans``, which are sorted and apart; found by halving."""

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        left = F.get(spans, middle)["start"] <= x["start"]
        open_ = acc["low"] < acc["high"]
        return F.struct(F.when(open_ & left, middle + 1).otherwise(acc["low"]).alias("low"), F.when(open_ & ~left, middle).otherwise(acc["high"]).alias("high"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + 1)).cast("int"))
    place = F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(spans).alias("high")), halve, lambda acc: acc["low"])
    return F.coalesce(F.get(spans, place - 1)["end"] >= x["end"], F.lit(False))


def scan(docs: DataFrame, allowed: tuple = ALLOWED) -> DataFrame:
    """doc_id, text, base, added: sorted arrays of (start, rank, kind, end, low, high); rank is the kind's place in the list, low and high are bytes."""
    return found_in(texts(docs), allowed).select("doc_id", "text", "base", "added")


def found_in(rows: DataFrame, allowed: tuple = ALLOWED) -> DataFrame:
    """``rows`` and the columns base and added of its column text, which has no nulls."""
    own = rows.columns
    for name, pattern, group, least in BASE:
        exact = pattern if name != "hex" else "[0-9a-f]{%d,}" % least
        rows = rows.withColumn(f"_{name}", F.filter(located(F.col("text"), exact, group), lambda x: F.length(x["found"]) >= least))  # noqa: B023
    clear = lambda x: ~(within(F.col("_assign"), x) | within(F.col("_access"), x) | within(F.col("_hex"), x))
    for name, _, pattern, _ in CLASSES:
        # a run within one base span can add nothing, and needn't be read
        fits = lambda x: ~F.coalesce(*[F.when(x["found"].rlike(a), True) for a in allowed], ~x["found"].rlike(NO_PATH)) & clear(x)
        rows = rows.withColumn(f"_{name}", F.filter(located(F.col("text"), pattern), fits))

    def span(kind: str, rank: int, x: Column, start=None, end=None) -> Column:
        start, end = x["start"] if start is None else x["start"] + start, x["end"] if end is None else x["start"] + end
        low = x["low"] + start - x["start"]  # what lies in a run of a class is ASCII
        high = x["high"] + end - x["end"]
        return F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), low.alias("low"), high.alias("high"))

    base = F.concat(*[F.transform(f"_{name}", lambda x: span(name, k, x)) for k, (name, *_) in enumerate(BASE)])  # noqa: B023
    rows = rows.withColumn("base", F.array_sort(base))
    added = []
    for k, (name, alphabet, _, bits) in enumerate(CLASSES, len(BASE)):
        in_run = lambda x: F.transform(high_entropy(x["found"], alphabet, bits), lambda y: span(name, k, x, y["start"], y["end"]))  # noqa: B023, E731
        added.append(F.when(F.size(f"_{name}") > 0, F.flatten(F.transform(f"_{name}", in_run))).otherwise(F.array()))
    rows = rows.withColumn("added", F.concat(*added))
    return rows.select(*own, "base", F.array_sort(F.filter("added", clear)).alias("added"))


def masked(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """``text`` with each maximal run of the spans, sorted by start, replaced by ``mask``."""

    def joined_up(x: Column) -> Column:
        v = x["spans"]
        # a span begins a run if it starts beyond all ends before it
        reach = running(F.transform(v, lambda s: s["high"].cast("long")), lambda a, b: F.greatest(a, b))
        firsts = lambda r: F.filter(F.transform(v, lambda s, k: F.when((k == 0) | (s["low"] > F.get(r, k - 1)), k)), lambda k: k.isNotNull())
        return let(reach, lambda r: let(firsts(r), lambda f: F.array_join(between(x["data"], v, r, f), mask)))

    def between(data: Column, v: Column, r: Column, f: Column) -> Column:
        """What stands before, between and after the runs that begin at the places ``f``."""
        low = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(r, F.get(f, k) - 1).cast("int"))
        part = F.transform(f, lambda s, k: F.substring(data, low(k) + 1, F.get(v, s)["low"] - low(k)))
        last = F.get(r, F.size(r) - 1).cast("int")
        return F.transform(F.concat(part, F.array(F.substring(data, last + 1, F.octet_length(data) - last))), lambda x: F.decode(x, "UTF-8"))

    return F.when(F.size(spans) > 0, let(F.struct(spans.alias("spans"), F.encode(text, "UTF-8").alias("data")), joined_up)).otherwise(text)


def redact(docs: DataFrame, allowed: tuple = ALLOWED, mask: str = "[SECRET]") -> DataFrame:
    """The rows of ``docs``, all columns, with secrets masked in text (a null text stays null) and n_chars to match."""
    rows = found_in(as_rows(docs).withColumn("text", F.coalesce(F.col("row.text"), F.lit(""))), allowed)
    text = F.when(F.col("row.text").isNotNull(), masked(F.col("text"), F.array_sort(F.concat("base", "added")), mask))
    rows = rows.select("row", text.alias("text"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("text").isNull(), F.col("row.n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op1_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of any documents."""
    found = scan(docs).select("doc_id", "base", F.array_sort(F.concat("base", "added")).alias("spans"))
    counts = [F.size(F.filter("base", lambda x: x["kind"] == name)).cast("long").alias(f"n_{name}") for name, *_ in BASE]  # noqa: B023
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_digest(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The same in SQL: each window's entropy afresh from its characters."""
    quote = lambda x: x.replace("'", "''")
    assign = quote(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    parts = [("assign", 0, assign, 2, 8), ("access", 1, BASE[1][1], 0, 16), ("hex", 2, BASE[2][1], 0, 32), *((n, 3 + k, p, 0, 0) for k, (n, _, p, _) in enumerate(CLASSES))]
    found = " UNION ALL ".join(f"SELECT doc_id, row, '{n}' AS kind, {r} AS rank, {least} AS least, regexp_split_to_array(text, '{p}') AS pieces, regexp_extract_all(text, '{p}', 0) AS m, regexp_extract_all(text, '{p}', {g}) AS g FROM d" for n, r, p, g, least in parts)
    fits = " AND ".join([*(f"NOT regexp_matches(g, '{quote(a)}')" for a in ALLOWED), f"regexp_matches(g, '{NO_PATH}')"])
    f = "[" + ", ".join(map(str, _scaled()[1:])) + "]"
    limits = " ".join(f"WHEN {3 + k} THEN {_limit(bits)}" for k, (_, _, _, bits) in enumerate(CLASSES))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS row FROM documents),
x AS ({found}),
y AS (SELECT doc_id, row, kind, rank, least, unnest(m) AS m, unnest(g) AS g, unnest(pieces[1:len(m)]) AS p, generate_subscripts(m, 1) AS k FROM x WHERE len(m) > 0),
z AS (SELECT *, sum(length(p) + length(m)) OVER (PARTITION BY row, rank ORDER BY k) AS stop FROM y),
base AS (SELECT doc_id, row, kind, rank, CAST(stop - length(m) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM z WHERE rank < 3 AND length(g) >= least),
c AS (SELECT *, CAST(stop - length(m) AS BIGINT) AS start FROM z WHERE rank >= 3 AND {fits}),
w AS (SELECT row, kind, rank, start, k, g, unnest(generate_series(0, length(g) - {WINDOW})) AS o FROM c),
u AS (SELECT row, kind, rank, start, k, o, unnest(string_split(substr(g, o + 1, {WINDOW}), '')) AS ch FROM w),
v AS (SELECT row, kind, rank, start, k, o, ch, count(*) AS n FROM u GROUP BY ALL),
h AS (SELECT row, kind, rank, start, k, o FROM v GROUP BY ALL HAVING sum(({f})[n]) <= CASE rank {limits} END),
s AS (SELECT *, CASE WHEN o - lag(o) OVER (PARTITION BY row, rank, k ORDER BY o) <= {WINDOW} THEN 0 ELSE 1 END AS fresh FROM h),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY row, rank, k ORDER BY o) AS island FROM s),
a AS (SELECT row, kind, rank, CAST(start + min(o) AS BIGINT) AS start, CAST(start + max(o) + {WINDOW} AS BIGINT) AS stop FROM r GROUP BY row, kind, rank, start, k, island),
added AS (SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.row = a.row AND b.start <= a.start AND b.stop >= a.stop)),
b AS (SELECT row, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM base GROUP BY row),
e AS (SELECT row, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM (SELECT row, kind, rank, start, stop FROM base UNION ALL SELECT row, kind, rank, start, stop FROM added) GROUP BY row)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(b.spans, '')) AS base_sha256, coalesce(e.spans, '') AS spans
FROM d LEFT JOIN b ON d.row = b.row LEFT JOIN e ON d.row = e.row
"""


QUERIES = {"op1_secret_scan": op1_secret_scan}
ORACLES = {"op1_secret_scan": _sql()}
