"""Suffix-array dedup: removes each byte that an earlier string of LENGTH bytes covers, keeping the first copy.

A byte goes if it lies in a window of LENGTH bytes that also starts earlier: in a document of smaller
doc_id, or earlier in the same one. That is a window whose longest previous factor reaches LENGTH.
Windows are put in suffix order to depth LENGTH; of each, the nearest windows to either side that
stand earlier in the corpus (previous and next smaller positions) hold its longest previous factor,
which is the greater of its common prefixes with these two.

Sorting all suffixes of a corpus would move each byte many times. Windows are brought together by
anchors instead: a window's anchor is its GRAM-byte string of smallest hash, the leftmost of equals.
Equal windows have equal anchors at equal places, and neighbouring windows mostly share theirs, so
there is one row for about 35 windows. The row's context is the bytes of all windows that it stands for.

  1. Each task finds its documents' anchors with a hash of their contexts. Of equal contexts in a
     task the first goes on and the others' windows are marked at once, so a passage that every
     document holds leaves each task in one row. An anchor of more than HOT / 16 contexts among the
     TASK_ANCHORS that a task looks at together is hot: its contexts are needed in any case, so they
     go to step 3 at once, and a single row tells step 2 to take the anchor's others for hot too.
  2. Rows meet by anchor, at most HOT / 16 for TASK_ANCHORS of the corpus. Of equal contexts again the
     first stays and the others are marked. Anchors that have one context only are done. For the
     others the contexts themselves are needed.
  3. Documents give the bytes of those contexts, which meet by anchor; blocks of whole anchors get
     their array of longest previous factors, and windows where it reaches LENGTH are marked. A hot
     anchor, or one of more than HOT contexts, has its windows dealt one by one, by their hashes and
     with their bytes, so no task holds them all, and bytes decide there too.
  4. Each document's marks are joined and cut out.

The documents' texts are shuffled once; steps 3 and 4 read the same exchange.

Defined results: a null text is empty; texts shorter than LENGTH lose nothing; null doc_ids come first
in order; rows with equal doc_id and different texts are documents in order of their texts; rows that
are equal in both are documents too, the later ones copies of the first; an empty table gives no
rows; other columns are ignored. Bytes are what counts, so a cut may fall within a character. A very
long text is read whole, in segments of SEGMENT windows. Contexts count as equal in steps 1 and 2 if
64 bits of their anchor's hash and 64 of their own agree; in step 3 bytes are compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, table, with_ref, written

LENGTH, GRAM, HOT = 100, 24, 1_000
SEGMENT = 1 << 19
TASK_ANCHORS, BLOCK_WINDOWS = 400_000, 40_000
#: What stands in place of a context's place: the anchor is hot; or a hot anchor's context, whose place is in f.
IS_HOT, OF_HOT = -(1 << 62), -(1 << 61)


class Anchors:
    """Anchors of a document: for each its gram's hash, its context's hash, place, and first and last window."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM, seed: int = 10):
        import numpy as np

        draw = np.random.Generator(np.random.PCG64(seed))
        self.length, self.gram = length, gram
        self.codes = draw.integers(0, 2**64, size=256, dtype=np.uint64)
        self.base = int(draw.integers(0, 2**64, dtype=np.uint64)) | 1
        self.powers = (np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64))

    def power(self, size: int):
        """base^0 .. and its inverse's powers modulo 2^64, grown by doubling."""
        import numpy as np

        bases = (self.base, pow(self.base, -1, 2**64))
        while len(self.powers[0]) <= size:
            self.powers = tuple(np.concatenate([p, p * np.uint64(pow(b, len(p), 2**64))]) for p, b in zip(self.powers, bases))
        return self.powers

    @staticmethod
    def mixed(x):
        """A fixed mixing of 64-bit values (constants of splitmix64)."""
        import numpy as np

        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
        return x ^ x >> np.uint64(31)

    def sums(self, data):
        import numpy as np

        out = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.codes[data] * self.power(len(data))[0][: len(data)], out=out[1:])
        return out

    def windows(self, data, first: int, last: int):
        """Hashes of the windows that start at first .. last."""
        sums = self.sums(data[first : last + self.length])
        return self.mixed((sums[self.length :] - sums[: len(sums) - self.length]) * self.power(len(sums))[1][: len(sums) - self.length])

    def __call__(self, data):
        """Arrays: gram hash, context hash, place, first window, last window."""
        import numpy as np

        n, size, gram = len(data), self.length, self.gram
        if n < size:
            return tuple(np.zeros(0, dtype=t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
        sums, down = self.sums(data), self.power(n)[1]
        wide, place = size - gram + 1, np.uint64((1 << 20) - 1)
        parts = []
        for start in range(0, n - size + 1, SEGMENT):
            stop = min(start + SEGMENT, n - size + 1)  # windows start .. stop - 1
            high = stop + size - gram
            h = self.mixed((sums[start + gram : high + gram] - sums[start:high]) * down[start:high])
            least, reach = h & ~place | np.arange(len(h), dtype=np.uint64), 1
            while reach * 2 <= wide:
                least, reach = np.minimum(least[:-reach], least[reach:]), reach * 2
            if reach < wide:
                least = np.minimum(least[: len(least) - (wide - reach)], least[wide - reach :])
            at = (least & place).astype(np.int64)
            change = np.flatnonzero(at[1:] != at[:-1]) + 1
            lo, hi = np.concatenate([[0], change]), np.concatenate([change, [len(at)]]) - 1
            parts.append((h[at[lo]], at[lo] + start, lo + start, hi + start))
        grams, at, lo, hi = (np.concatenate(x) for x in zip(*parts))
        shape = (at - lo).astype(np.uint64) << np.uint64(32) | (hi - lo).astype(np.uint64)
        return grams, self.mixed((sums[hi + size] - sums[lo]) * down[lo] + self.mixed(shape)), at, lo, hi


def longest_previous_factors(windows):
    """Of each window (a row of bytes; rows are in order of position) the longest prefix that it shares with one before it."""
    import numpy as np

    n, depth = windows.shape
    if n < 2:
        return np.zeros(n, dtype=np.int64)
    flat = np.ascontiguousarray(windows)
    # suffix order to the windows' depth, ties by position
    place = np.argsort(flat.view(f"S{depth}").ravel(), kind="stable")
    ranked = flat[place]
    differ = ranked[1:] != ranked[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), depth)  # of each with the one before it in order
    out = np.zeros(n, dtype=np.int64)
    for step, to_left in ((-1, common), (1, common)):
        # the nearest in order that is earlier in position, by following pointers; least is the shared prefix on the way
        near = np.arange(n) + step
        least = np.concatenate([[0], to_left]) if step < 0 else np.concatenate([to_left, [0]])
        active = np.flatnonzero((near >= 0) & (near < n))
        while len(active := active[(near[active] >= 0) & (near[active] < n)]) and len(active := active[place[near[active]] > place[active]]):
            via = near[active]
            least[active] = np.minimum(least[active], least[via])
            near[active] = near[via]
        least[(near < 0) | (near >= n)] = 0
        out[place] = np.maximum(out[place], least)
    return out


def merged(starts, ends):
    """The union of intervals: sorted starts and ends of its maximal pieces."""
    import numpy as np

    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order]) if len(ends) else ends
    cut = np.flatnonzero(starts[1:] > reach[:-1]) + 1
    return starts[np.concatenate([[0], cut])] if len(starts) else starts, reach[np.concatenate([cut, [len(reach)]]) - 1] if len(starts) else reach


def anchor_rows(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, held: int = TASK_ANCHORS, hot: int = HOT) -> DataFrame:
    """h (gram hash), f (context hash), ref, packed: first window << 16 | place in it << 8 | windows - 1.

    A marked interval is a row too: packed is -1 - start, f the end, and h any number. So is a hot
    anchor (packed is IS_HOT), and each of its contexts (OF_HOT; f is what packed would be, h any number).
    """
    most = max(1, hot // 16)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        find = Anchors(length, gram)
        kept: list = []
        count = 0

        def flush():
            nonlocal kept, count
            h, f, lo, off, more, ref = (np.concatenate(x) for x in zip(*kept))
            kept, count = [], 0
            order = np.lexsort((lo, ref, f, h))
            h, f, lo, off, more, ref = (x[order] for x in (h, f, lo, off, more, ref))
            again = np.zeros(len(h), dtype=bool)
            again[1:] = (h[1:] == h[:-1]) & (f[1:] == f[:-1])
            packed = lo << 16 | off << 8 | more
            # intervals of one document that touch become one
            s, e, r = lo[again], (lo + more + length)[again], ref[again]
            order = np.lexsort((s, r))
            s, e, r = s[order], e[order], r[order]
            cut = np.flatnonzero((r[1:] != r[:-1]) | (s[1:] > e[:-1])) + 1
            if len(s):
                first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(s)]]) - 1
                s, e, r = s[first], e[last], r[first]
            h, f, ref, packed = h[~again], f[~again].view("i8"), ref[~again], packed[~again]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            sizes = np.diff(np.concatenate([first, [len(h)]]))
            often = first[sizes > most]  # a row of each hot anchor
            of_hot = np.repeat(sizes > most, sizes)
            own, place = ~of_hot, packed[of_hot]
            spread = lambda x: find.mixed(x.astype("u8")).view("i8")  # noqa: E731  keys of rows that meet nothing
            none = np.zeros(len(often), dtype=np.int64)
            columns = [
                np.concatenate([h[own].view("i8"), h[often].view("i8"), spread(ref[of_hot] ^ place << 20), spread(r)]),
                np.concatenate([f[own], none, place, e]),
                np.concatenate([ref[own], none, ref[of_hot], r]),
                np.concatenate([packed[own], none + IS_HOT, place * 0 + OF_HOT, -1 - s]),
            ]
            for low in range(0, len(columns[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[low : low + 100_000]) for c in columns], names=["h", "f", "ref", "packed"])

        for batch in bounded(batches):
            for ref, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                h, f, at, lo, hi = find(np.frombuffer(data.as_buffer(), dtype=np.uint8))
                if len(h):
                    kept.append((h, f, lo, at - lo, hi - lo, np.full(len(h), ref, dtype=np.int64)))
                    count += len(h)
            if count >= held:
                yield from flush()
        if kept:
            yield from flush()

    return docs.select("ref", "data").mapInArrow(run, "h long, f long, ref long, packed long")


def _by_group(batches):
    """Tables of whole groups (equal first column) of sorted batches, several groups at a time."""
    import numpy as np
    import pyarrow as pa

    carry: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(key, key[-1], side="left"))  # where the batch's last group begins
        if last == 0 and carry and carry[-1].column(0)[carry[-1].num_rows - 1].as_py() == key[0]:
            carry.append(batch)
            continue
        yield pa.Table.from_batches([*carry, batch.slice(0, last)] if last or carry else [batch.slice(0, 0)]).combine_chunks()
        carry = [batch.slice(last)]
    if carry:
        yield pa.Table.from_batches(carry).combine_chunks()


def settle(rows: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """ref, start, end: marked intervals; or, where h is not null, a context that is needed: packed is start, end is -1 (-2: hot)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for t in _by_group(batches):
            if not t.num_rows:
                continue
            h, f, ref, packed = (t.column(k).to_numpy() for k in range(4))
            marks, of_hot, places = (packed < 0) & (packed > OF_HOT), packed == OF_HOT, packed >= 0
            # marked intervals, and contexts that are known to be needed
            done = ref[marks], -1 - packed[marks], f[marks]
            sure = ref[of_hot], f[of_hot], np.full(int(of_hot.sum()), -2), h[of_hot]
            often = np.unique(h[packed == IS_HOT])
            h, f, ref, packed = h[places], f[places], ref[places], packed[places]
            told = np.isin(h, often)
            new_h, new_f = np.ones(len(h), dtype=bool), np.ones(len(h), dtype=bool)
            new_h[1:] = h[1:] != h[:-1]
            new_f[1:] = new_h[1:] | (f[1:] != f[:-1])
            kinds = np.bincount(np.cumsum(new_h) - 1, weights=new_f, minlength=1).astype(np.int64)[np.cumsum(new_h) - 1] if len(h) else np.zeros(0, dtype=np.int64)
            lo, more = packed >> 16, packed & 255
            again, need = ~new_f, new_f & ((kinds > 1) | told)
            columns = [
                np.concatenate([done[0], ref[again], ref[need], sure[0]]),
                np.concatenate([done[1], lo[again], packed[need], sure[1]]),
                np.concatenate([done[2], (lo + more + length)[again], np.where((kinds > hot) | told, -2, -1)[need], sure[2]]),
            ]
            group = np.concatenate([np.zeros(len(done[0]) + int(again.sum()), dtype=np.int64), h[need], sure[3]])
            known = np.arange(len(group)) >= len(done[0]) + int(again.sum())
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(group, mask=~known)], names=["ref", "start", "end", "h"])

    return rows.repartition("h").sortWithinPartitions("h", "f", "ref", "packed").mapInArrow(run, "ref long, start long, end long, h long")


def contexts(docs: DataFrame, needs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = BLOCK_WINDOWS) -> DataFrame:
    """h, ref, first (window), context: bytes of the contexts needed; of hot ones a row for each window, h being its hash. Or, where end is not null, a marked interval from first to end."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        find = Anchors(length, gram)
        for batch in bounded(batches):
            rows: list = []
            hot: list = []
            windows = 0
            for ref, data, wanted in zip(batch.column("ref").to_pylist(), batch.column("data"), batch.column("wanted").to_pylist()):
                view = memoryview(data.as_buffer())
                whole = np.frombuffer(view, dtype=np.uint8)
                for w in wanted:
                    lo, more = w["start"] >> 16, w["start"] & 255
                    if w["end"] == -2:
                        hashes = find.windows(whole, lo, lo + more).view("i8")
                        own = np.lib.stride_tricks.sliding_window_view(whole[lo : lo + more + length], length)
                        hot.append((hashes, np.full(more + 1, ref, dtype=np.int64), lo + np.arange(more + 1), own))
                        windows += more + 1
                    else:
                        rows.append((w["h"], ref, lo, bytes(view[lo : lo + more + length])))
                if len(rows) > 20_000 or windows > 2 * most:
                    yield from emit(pa, np, rows, hot)
                    rows, hot, windows = [], [], 0
            yield from emit(pa, np, rows, hot)

    def emit(pa, np, rows, hot):
        names = ["h", "ref", "first", "context", "end"]
        if rows:
            yield pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in rows], pa.int64()) for k in range(3)), pa.array([r[3] for r in rows], pa.binary()), pa.array([None] * len(rows), pa.int64())], names=names)
        if hot:
            h, ref, first, bytes_ = (np.concatenate(x) for x in zip(*hot))
            order = np.lexsort((first, ref, h))
            h, ref, first, bytes_ = h[order], ref[order], first[order], bytes_[order]
            again = np.zeros(len(h), dtype=bool)
            # an equal window of this task stands earlier: marked, and not sent to meet others
            again[1:] = (h[1:] == h[:-1]) & (bytes_[1:] == bytes_[:-1]).all(axis=1)
            # marked windows that follow each other become one interval
            order = np.lexsort((first[again], ref[again]))
            s, r = first[again][order], ref[again][order]
            cut = np.flatnonzero((r[1:] != r[:-1]) | (s[1:] > s[:-1] + length)) + 1
            low, high = (np.concatenate([[0], cut]), np.concatenate([cut, [len(s)]]) - 1) if len(s) else (cut, cut)
            new = ~again
            held = pa.array([x.tobytes() for x in bytes_[new]], pa.binary())
            yield pa.RecordBatch.from_arrays([*map(pa.array, (h[new], ref[new], first[new])), held, pa.nulls(int(new.sum()), pa.int64())], names=names)
            spread = Anchors.mixed(r[low].astype("u8")).view("i8")  # any key: marked intervals meet nothing
            columns = [*map(pa.array, (spread, r[low], s[low])), pa.nulls(len(low), pa.binary()), pa.array(s[high] + length)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    lists = needs.groupBy("ref").agg(F.collect_list(F.struct("h", "start", "end")).alias("wanted"))
    return docs.join(lists.hint("shuffle_hash"), "ref").select("ref", "doc_id", "data", "wanted").mapInArrow(run, "h long, ref long, first long, context binary, end long")


def resolve(rows: DataFrame, length: int = LENGTH, most: int = BLOCK_WINDOWS) -> DataFrame:
    """ref, start, end: marked intervals of contexts that meet by anchor."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names = ["ref", "start", "end"]

        def block(ref, first, held):
            sizes = np.array([len(c) - length + 1 for c in held])
            flat = np.frombuffer(b"".join(held), dtype=np.uint8)
            begin = np.concatenate([[0], np.cumsum(sizes + length - 1)])[:-1]
            of = np.repeat(np.arange(len(held)), sizes)
            within = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            windows = np.lib.stride_tricks.sliding_window_view(flat, length)[begin[of] + within]
            mark = np.flatnonzero(longest_previous_factors(windows) >= length)
            if not len(mark):
                return None
            cut = np.flatnonzero((of[mark][1:] != of[mark][:-1]) | (mark[1:] != mark[:-1] + 1)) + 1
            low, high = mark[np.concatenate([[0], cut])], mark[np.concatenate([cut, [len(mark)]]) - 1]
            start = first[of[low]] + within[low]
            return pa.RecordBatch.from_arrays([pa.array(ref[of[low]]), pa.array(start), pa.array(start + high - low + length)], names=names)

        for t in _by_group(bounded(batches)):
            h, ref, first = (t.column(k).to_numpy() for k in range(3))
            if not len(h):
                continue
            ended = t.column("end").is_valid().to_numpy()
            if ended.any():
                yield pa.RecordBatch.from_arrays([pa.array(ref[ended]), pa.array(first[ended]), pa.array(t.column("end").to_numpy(zero_copy_only=False)[ended].astype(np.int64))], names=names)
            full = np.flatnonzero(~ended)
            if not len(full):
                continue
            # blocks of whole groups
            held = t.column("context").take(pa.array(full)).to_pylist()
            sizes = np.array([len(c) - length + 1 for c in held])
            g = h[full]
            edges = np.concatenate([np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])), [len(g)]])
            total = np.concatenate([[0], np.cumsum(sizes)])
            at = 0
            while at < len(edges) - 1:
                to = max(at + 1, int(np.searchsorted(total[edges], total[edges[at]] + most, side="right")) - 1)
                a, b = int(edges[at]), int(edges[to])
                if b - a > 1 and (found := block(ref[full[a:b]], first[full[a:b]], held[a:b])) is not None:
                    yield found
                at = to

    return rows.repartition("h").sortWithinPartitions("h", "ref", "first").mapInArrow(run, "ref long, start long, end long")


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, spans (array of start and end of the maximal removed runs), kept (the remaining bytes)."""
    if not 8 <= gram <= length or length - gram > 254:
        raise ValueError("gram must be at least 8, and below length by at most 254")
    rows = with_ref(docs.select("doc_id", "text")).select("ref", F.col("row.doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("row.text"), F.lit("")).cast("binary").alias("data"))
    found = written(settle(anchor_rows(rows, length, gram, hot=hot), length, hot), "dedup-anchors")
    # both joins below read this one exchange: Spark reuses it while both take the same columns and filters
    # (an inner join would add the test for null, which is always true, to its side alone)
    dealt = rows.where(F.col("ref").isNotNull()).repartition("ref").select("ref", "doc_id", "data")
    needs = found.where(F.col("h").isNotNull()).select("ref", "h", "start", "end")
    marks = found.where(F.col("h").isNull()).select("ref", "start", "end").unionByName(resolve(contexts(dealt, needs, length, gram), length))
    lists = marks.groupBy("ref").agg(F.collect_list(F.struct("start", "end")).alias("marks"))

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        for batch in bounded(batches):
            out = []
            for data, marked in zip(batch.column("data"), batch.column("marks").to_pylist()):
                view = memoryview(data.as_buffer())
                marked = marked or []
                s, e = merged(np.array([m["start"] for m in marked], dtype=np.int64), np.array([m["end"] for m in marked], dtype=np.int64))
                spans = list(zip(s.tolist(), e.tolist()))
                edges = [0, *(x for span in spans for x in span), len(view)]
                out.append((len(view), [{"start": a, "end": b} for a, b in spans], b"".join(view[a:b] for a, b in zip(edges[::2], edges[1::2]))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array([x[2] for x in out], pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    joined = dealt.join(lists.hint("shuffle_hash"), "ref", "left")
    return joined.select("ref", "doc_id", "data", "marks").mapInArrow(cut, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Bytes as pairs of hexadecimal digits; windows by the number of their MD5.
SQL = r"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), w AS (
  SELECT doc_id, s, md5_number(substr(h, 2 * s + 1, 200)) AS g FROM (SELECT doc_id, h, unnest(range(n - 99)) AS s FROM d WHERE n >= 100)
), q AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS r FROM w) WHERE r > 1
), i AS (
  SELECT doc_id, s, sum(CASE WHEN s - p <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS p FROM q)
), r AS (
  SELECT doc_id, k, min(s) AS a, max(s) + 100 AS b FROM i GROUP BY doc_id, k
), e AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS f FROM r
), x AS (
  SELECT e.doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(substr(d.h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS kept, max(b) AS last FROM e JOIN d ON d.doc_id = e.doc_id GROUP BY e.doc_id
)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, coalesce(x.n_removed, 0) AS n_removed, coalesce(x.n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN x.doc_id IS NULL THEN d.h ELSE x.kept || substr(d.h, 2 * x.last + 1) END)) AS kept_sha256
FROM d LEFT JOIN x ON x.doc_id = d.doc_id
"""

QUERIES = {"op10_suffix_dedup": op10_suffix_dedup}
ORACLES = {"op10_suffix_dedup": SQL}
