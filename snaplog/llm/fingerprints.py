"""Document fingerprints from prefix polynomial hashes.

A text's prefix arrays hold, modulo two primes, the sum of code point times base^position. Any
span's hash follows from two entries, so spans are compared in constant time, and the longest
common extension of two positions takes a binary search. A fingerprint has the text's length, the
hash of the whole and, as a sketch, the K smallest mixed hashes among all its spans of SPAN code
points. Likeness of two fingerprints is the share of the K smallest values of their union that both
hold, an unbiased estimate of the Jaccard similarity of their spans (exact while the union has K
values or fewer); equal texts have equal fingerprints and likeness 1.

Two thirds of a text below SHORT code points may hold no span of SPAN. Such a text has a second
sketch, of its spans of SHORT_SPANS, and two such texts are compared by their second sketches; any
other two by their first. An edited text is never longer than the text, so a short text and its
edited text always share this rule.

The longest common extension tells, exactly, how far from the start two texts agree: of a text with its
edited text (all that was kept, at least) and with the next document.

A document's successor in descending doc_id order is the next row of the same sorted range
partition; the last row of a partition meets the first of the next non-empty one through boundary
records, two a partition.

Defined results: a null text is empty; an empty text has an empty sketch, like another empty text
(1) and nothing else (0); in the first sketch a text shorter than SPAN is one span; a null doc_id comes last; rows that
repeat a doc_id are ordered by text; a single document is its own successor; an empty table gives no
rows; other columns are ignored. A very long text is hashed whole, in arrays of its length, by the task
that holds it and its successor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, table, texts, written

#: Two primes below 2^31, and a base for each.
PRIMES, BASES = (2147483647, 2147483629), (911382323, 972663749)
SPAN, K = 24, 64
#: Below SHORT code points, two thirds of a text may be shorter than SPAN; spans of both of SHORT_SPANS number K at most then.
SHORT, SHORT_SPANS = SPAN * 3 // 2, (2, 8)

_powers: dict[int, list] = {}


def powers(size: int, which: int):
    """base^0 .. base^size and the inverses' powers, kept between calls and grown by doubling."""
    import numpy as np

    p, base = PRIMES[which], BASES[which]
    found = _powers.get(which)
    if found is None or len(found[0]) <= size:
        out = []
        for b in (base, pow(base, -1, p)):
            grown = np.ones(1, dtype=np.int64)
            while len(grown) <= size:
                grown = np.concatenate([grown, grown * pow(b, len(grown), p) % p])
            out.append(grown)
        found = _powers[which] = out
    return found


class PrefixHashes:
    """Prefix arrays of one text; answers span equality and longest common extensions."""

    def __init__(self, text: str):
        import numpy as np

        self.codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.int64) + 1
        self.size, self.prefix = len(self.codes), []
        for which, p in enumerate(PRIMES):
            # a sum of 2^31 terms below 2^31 fits 63 bits
            sums = np.zeros(self.size + 1, dtype=np.int64)
            np.cumsum(self.codes * powers(self.size, which)[0][: self.size] % p, out=sums[1:])
            self.prefix.append(sums % p)

    def span(self, start: int, length: int) -> tuple[int, int]:
        out = []
        for which, p in enumerate(PRIMES):
            h = self.prefix[which]
            out.append((int(h[start + length]) - int(h[start])) * int(powers(self.size, which)[1][start]) % p)
        return out[0], out[1]

    def equal(self, start: int, other: PrefixHashes, at: int, length: int) -> bool:
        return start + length <= self.size and at + length <= other.size and self.span(start, length) == other.span(at, length)

    def common(self, start: int, other: PrefixHashes, at: int) -> int:
        """Length of the longest common extension to the right of two positions."""
        low, high = 0, min(self.size - start, other.size - at)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.equal(start, other, at, middle) else (low, middle - 1)
        return low

    def spans(self, length: int):
        """Mixed 64-bit hashes of all spans of this length (of the whole text, if shorter)."""
        import numpy as np

        length = min(length, self.size)
        if not length:
            return np.zeros(0, dtype=np.uint64)
        n, parts = self.size - length + 1, []
        for which, p in enumerate(PRIMES):
            h = self.prefix[which]
            parts.append(((h[length:] - h[:n]) % p * powers(self.size, which)[1][:n] % p).astype(np.uint64))
        x = parts[0] << np.uint64(32) | parts[1]
        # a fixed mixing, so that small values are drawn evenly (constants of splitmix64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
        return x ^ x >> np.uint64(31)

    def sketch(self, length: int = SPAN, k: int = K):
        """The k smallest distinct values of the upper 32 bits of the spans' hashes."""
        import numpy as np

        x = self.spans(length) >> np.uint64(32)
        if len(x) > 8 * k:
            low = x[x < (4 * k << 32) // len(x)]
            if len(few := np.unique(low)) >= k:
                return few[:k]
        return np.unique(x)[:k]

    def short_sketch(self):
        """Likewise, of all spans of each of SHORT_SPANS."""
        import numpy as np

        return np.unique(np.concatenate([self.spans(length) for length in SHORT_SPANS]) >> np.uint64(32))

    def fingerprint(self) -> str:
        a, b = self.span(0, self.size)
        sketches = [self.sketch()] + ([self.short_sketch()] if 0 < self.size < SHORT else [])
        return ":".join([f"{self.size:x}", f"{a:08x}{b:08x}", *(x.astype(">u4").tobytes().hex() for x in sketches)])


def likeness(one: str, other: str) -> float:
    """Of two fingerprints, 0 to 1."""
    if one == other:
        return 1.0
    a, b = (x.split(":")[2:] for x in (one, other))
    a, b = (x[min(len(a), len(b)) - 1] for x in (a, b))
    a, b = ({x[k : k + 8] for k in range(0, len(x), 8)} for x in (a, b))
    union = sorted(a | b)[:K]
    return sum(x in a and x in b for x in union) / len(union) if union else 0.0


def edited(text: str, following: str) -> str:
    """The last third of ``text`` replaced by as many first code points of the following text."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


SCHEMA = (
    "doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, common_edited long, common_next long"
)
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def _row(doc_id, text: str, own: PrefixHashes, mark: str, following: str, after: PrefixHashes, next_mark: str) -> tuple:
    """One row of SCHEMA; ``mark`` and ``next_mark`` are the fingerprints of the text and the following one."""
    changed = edited(text, following)
    new = PrefixHashes(changed)
    print_ = new.fingerprint()
    return doc_id, len(text), changed, mark, print_, likeness(mark, print_), likeness(mark, next_mark), own.common(0, new, 0), own.common(0, after, 0)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text, fingerprint of each document."""

    def run(batches):
        import pyarrow as pa

        for batch in bounded(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([PrefixHashes(x).fingerprint() for x in batch.column(1).to_pylist()])], names=["doc_id", "text", "fingerprint"])

    return texts(docs).mapInArrow(run, "doc_id long, text string, fingerprint string")


def compare_with_next(docs: DataFrame, digest: bool = True) -> DataFrame:
    """SCHEMA's columns of each document; ``digest``: edited_text is its SHA-256 in hex."""

    def batch_of(rows: list[tuple]):
        import hashlib

        import pyarrow as pa

        rows = [(*r[:2], hashlib.sha256(r[2].encode()).hexdigest() if digest else r[2], *r[3:]) for r in rows]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
        return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]

    def walk(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, last, first = TaskContext.get().partitionId(), None, None
        names = [*NAMES, "part", "head", "tail"]

        def out(rows: list, head=None, tail=None):
            n = len(rows)
            edge = [pa.array([part] * n, pa.int64()), pa.array([head] * n, pa.string()), pa.array([tail] * n, pa.string())]
            return pa.RecordBatch.from_arrays([*batch_of(rows), *edge], names=names)

        for batch in bounded(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = PrefixHashes(text)
                mark = own.fingerprint()
                if last is None:
                    first = text
                else:
                    rows.append(_row(*last, text, own, mark))
                last = (doc_id, text, own, mark)
            yield out(rows)
        if last:  # the boundary record: this partition's first text, and its last document without a successor
            yield out([(last[0], len(last[1]), "", last[3], "", 0.0, 0.0, 0, 0)], first, last[1])

    ordered = texts(docs).repartitionByRange(F.col("doc_id").desc_nulls_last()).sortWithinPartitions(F.col("doc_id").desc_nulls_last(), "text")
    rows = written(ordered.mapInArrow(walk, SCHEMA + ", part long, head string, tail string"), "fingerprints")
    # one row a partition; the window has no texts, the join finds them
    edges = rows.where(F.col("tail").isNotNull())
    every = Window.partitionBy(F.lit(0))
    order = edges.select("part", F.coalesce(F.lead("part").over(every.orderBy("part")), F.min("part").over(every)).alias("next_part"))
    heads = edges.select(F.col("part").alias("next_part"), F.col("head").alias("next_text"))
    meet = edges.select("part", "doc_id", "tail").join(order, "part").join(heads, "next_part").select("doc_id", "tail", "next_text")

    def close(batches):
        import pyarrow as pa

        for batch in bounded(batches):
            found = []
            for doc_id, text, following in zip(*(c.to_pylist() for c in batch.columns)):
                own, after = PrefixHashes(text), PrefixHashes(following)
                found.append(_row(doc_id, text, own, own.fingerprint(), following, after, after.fingerprint()))
            yield pa.RecordBatch.from_arrays(batch_of(found), names=NAMES)

    return rows.where(F.col("tail").isNull()).drop("part", "head", "tail").unionByName(meet.mapInArrow(close, SCHEMA))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents")).withColumnRenamed("edited_text", "edited_sha256")


QUERIES = {"op6_fingerprints": op6_fingerprints}
ORACLES: dict[str, str] = {}
