"""Exact n-gram Jaccard join: signature trees over word shingles.

A document's set holds 64-bit hashes of its distinct shingles of ``words`` words. Documents with
equal sets, by 128 bits of a hash of the whole set, become one vertex. Vertices of similarity ``share`` or more are linked; the result is each
document's connected component.

Signature trees do the join. A leaf has a document's token bitmap (a power of two of bits, at least
its set's size) and size; a node has the OR of its children's bitmaps, their range of sizes and their
least number of tokens that share a bit. Two nodes can hold a linked pair only if their size ranges
are close enough and the greatest overlap that bitmaps allow, the common bits and the tokens that
share one, reaches the least overlap that a link of their sizes needs. Dual traversal descends level by
level into the node pairs that pass. Node pairs whose documents are all connected already are left out,
so that a group of n copies costs n steps and not n squared.

Trees are built where linked documents must meet:

  1. by token: in whatever order tokens stand, of a linked pair the first ones of the union are in
     both sets unless all of them fall outside the intersection. Tokens stand in order of their
     hash, but those of more than GROUP vertices come last. Each vertex goes to the trees of its
     PREFIX first tokens (fewer where size alone proves that they suffice), as far as the 2 * PREFIX
     of smallest hash hold them. For sets that these do not cover whole, a linked pair is missed
     with a chance of about (1 - share) ** PREFIX, 7e-14 at 0.85, as rare as equal 64-bit hashes of
     different shingles. These trees hold bitmaps only; what passes is a candidate link, and a
     spanning forest of them is kept. A token that still has more than GROUP vertices is dealt by
     bands of size, of which only neighbours can link, and then over pairs of parts.
  2. by component of candidate links: its documents' sets are formed again from their texts and a
     tree over them compares leaf pairs exactly. A component of more than LIMIT tokens or
     DOCUMENTS / SPREAD documents is dealt over several trees that share three of its documents; what
     is then not in the component's largest class meets all the others in a second round, in trees of
     at most LIMIT tokens and DOCUMENTS documents and what moves. So no pair is left out.

Defined results: A-Z count as a-z and nothing else is folded; a null or empty text, or one of white
space, has an empty set, no links and its own doc_id as component; fewer words than ``words`` make one
shingle; rows with a null doc_id link with nothing and have a null component; rows that repeat a
doc_id are separate documents of that id; an empty table gives no rows; other columns are ignored. A
very long text is one set like any other, held whole by the task that reads it.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, table, texts, written
from .components import components

PREFIX, FANOUT, GROUP, LIMIT, DOCUMENTS, SMALL = 16, 8, 8_192, 2_000_000, 4_096, 500_000
PIECE, SPREAD = 1_000, 16


# ---- sets


class Shingler:
    """64-bit hashes of a text's distinct shingles, sorted; computed on whole arrays."""

    def __init__(self, words: int, seed: int = 20):
        import numpy as np

        draw = np.random.Generator(np.random.PCG64(seed))
        whole = lambda n: draw.integers(0, 2**64, size=n, dtype=np.uint64)
        self.words, self.codes, self.factors = words, whole(256), whole(words + 1) | np.uint64(1)
        self.base = int(whole(1)[0]) | 1
        self.powers = (np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64))
        self.blank = np.zeros(256, dtype=bool)
        self.blank[[32, *range(9, 14)]] = True
        self.lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

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

    def __call__(self, text: str):
        import numpy as np

        data = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(self.lower), dtype=np.uint8)
        inside = np.zeros(len(data) + 2, dtype=np.int8)
        inside[1:-1] = ~self.blank[data]
        edges = np.flatnonzero(np.diff(inside))
        start, end = edges[::2], edges[1::2]
        n = len(start)
        if not n:
            return np.zeros(0, dtype=np.uint64)
        up, down = self.power(len(data))
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.codes[data] * up[: len(data)], out=sums[1:])
        word = self.mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
        k = min(self.words, n)
        total = np.full(n - k + 1, int(self.factors[self.words]) * k % 2**64, dtype=np.uint64)
        for i in range(k):
            total += word[i : n - k + 1 + i] * self.factors[i]
        return np.unique(self.mixed(total))


def key_of(tokens) -> tuple[int, int]:
    """128 bits that stand for a set, as two signed longs."""
    import xxhash

    x = xxhash.xxh3_128_intdigest(tokens.tobytes())
    return tuple(k - (1 << 64) if k >> 63 else k for k in (x >> 64, x & (1 << 64) - 1))


def prefix_length(n: int, num: int, den: int) -> int:
    """How many of a set's smallest tokens any set linked to it must share one of: n - ceil(n num / den) + 1."""
    return n - -(-n * num // den) + 1


# ---- signature trees


def bitmap(tokens, width: int = 1):
    """A power of two of bits, at least ``width`` times the set's size and 64, as 64-bit words."""
    import numpy as np

    bits = max(64, 1 << (width * len(tokens) - 1).bit_length())
    out = np.zeros(bits, dtype=np.uint8)
    out[(tokens >> np.uint64(20) & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").view(np.uint64)


def folded(words, size: int):
    """A bitmap ORed down to ``size`` words: the bitmap that the set has at that length."""
    while len(words) > size:
        words = words[: len(words) // 2] | words[len(words) // 2 :]
    return words


def size_runs(maps_list: list, sizes, num: int, den: int):
    """Runs of documents whose bitmaps fit one length; any two documents that sizes let link are in one.

    There is a run for each length of bitmaps, and one for those on both sides of the bound between
    two lengths that are close enough in size. Gives places and the bitmaps, folded to the run's length.
    """
    import numpy as np

    lengths = np.array([len(m) for m in maps_list])
    for length in np.unique(lengths).tolist():
        own = np.flatnonzero(lengths == length)
        above = np.flatnonzero((lengths > length) & (sizes * num <= sizes[own].max() * den))
        for run in (own, np.concatenate([own[sizes[own] * den >= sizes[above].min() * num], above]) if len(above) else own[:0]):
            if len(run) > 1:
                run = run[np.argsort(sizes[run], kind="stable")]
                yield run, np.stack([folded(maps_list[k], length) for k in run])


class Forest:
    """Union-find; keeps the links that joined two classes."""

    def __init__(self, n: int):
        self.up, self.links = list(range(n)), []

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        x, y = self.find(a), self.find(b)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        self.links.append((a, b))
        return True

    def labels(self):
        import numpy as np

        return np.array([self.find(x) for x in range(len(self.up))], dtype=np.int64)


class SignatureTree:
    """Levels of nodes over documents in the given order; level 0 is the documents."""

    def __init__(self, maps, sizes, labels, fanout: int = FANOUT):
        import numpy as np

        collide = sizes - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        self.levels, self.fanout = [(maps, sizes, sizes, collide, labels)], fanout
        while len(self.levels[-1][0]) > fanout:
            m, low, high, spare, label = self.levels[-1]
            cuts = np.arange(0, len(m), fanout)
            first, last = np.minimum.reduceat(label, cuts), np.maximum.reduceat(label, cuts)
            self.levels.append((np.bitwise_or.reduceat(m, cuts, axis=0), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts), np.maximum.reduceat(spare, cuts), np.where((first == last) & (first >= 0), first, -1)))

    def pairs(self, num: int, den: int, chunk: int = 1 << 16):
        """Dual traversal: chunks of pairs (i < j) of documents that bitmaps and sizes leave possible."""
        import numpy as np

        top = len(self.levels) - 1
        a, b = np.triu_indices(len(self.levels[top][0]), 0 if top else 1)
        stack = [(top, a[k : k + chunk], b[k : k + chunk]) for k in range(0, len(a), chunk)]
        while stack:
            level, a, b = stack.pop()
            maps, low, high, spare, label = self.levels[level]
            keep = (label[a] != label[b]) | (label[a] < 0)
            keep &= (high[a] * den >= low[b] * num) & (high[b] * den >= low[a] * num)
            a, b = a[keep], b[keep]
            # a link of sizes x and y needs ceil(num (x + y) / (num + den)) common tokens
            need = -(-num * (low[a] + low[b]) // (num + den))
            common = np.bitwise_count(maps[a] & maps[b]).sum(axis=1, dtype=np.int64)
            keep = common + np.minimum(spare[a], spare[b]) >= need
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            if not level:
                yield a, b
                continue
            n, f = len(self.levels[level - 1][0]), self.fanout
            own = a == b
            x = (a[:, None] * f + np.repeat(np.arange(f), f)[None, :]).ravel()
            y = (b[:, None] * f + np.tile(np.arange(f), f)[None, :]).ravel()
            keep = (x < n) & (y < n) & (~np.repeat(own, f * f) | (x < y if level == 1 else x <= y))
            x, y = x[keep], y[keep]
            stack += [(level - 1, x[k : k + chunk], y[k : k + chunk]) for k in range(0, len(x), chunk)]


def allowed_overlap(maps, sizes, a, b, num: int, den: int):
    """Whether bitmaps let pairs of documents overlap enough: a bit of one that the other lacks is a token that it lacks."""
    import numpy as np

    x = sizes[a] - np.bitwise_count(maps[a] & ~maps[b]).sum(axis=-1, dtype=np.int64)
    y = sizes[b] - np.bitwise_count(maps[b] & ~maps[a]).sum(axis=-1, dtype=np.int64)
    return np.minimum(x, y) * (num + den) >= num * (sizes[a] + sizes[b])


def next_star(label, names):
    """The document of least name outside the largest class, from which to join what is alike; None if all are one class.

    Trees that hold many of the same documents so choose the same star, and their links are the same.
    """
    import numpy as np

    values, counts = np.unique(label, return_counts=True)
    if len(values) == 1:
        return None
    alone = np.flatnonzero(label != values[counts.argmax()]) if counts.max() > 1 else np.arange(len(label))
    return int(alone[names[alone].argmin()])


def possible_links(maps_list: list, sizes, names, num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that bitmaps and sizes leave possible."""
    import numpy as np

    forest = Forest(len(sizes))
    for run, maps in size_runs(maps_list, sizes, num, den):
        own = sizes[run]
        if len(run) == 2:
            if allowed_overlap(maps, own, 0, 1, num, den):
                forest.join(*run.tolist())
            continue
        for _ in range(4):  # a few stars join what is alike; then only the rest is traversed
            label = np.array([forest.find(x) for x in run.tolist()])
            i = next_star(label, names[run])
            if i is None:
                break
            others = np.flatnonzero(label != label[i])
            for j in others[allowed_overlap(maps, own, i, others, num, den)].tolist():
                forest.join(int(run[i]), int(run[j]))
        if i is None:
            continue
        label = np.array([forest.find(x) for x in run.tolist()])
        order = np.lexsort((own, label))
        tree = SignatureTree(maps[order], own[order], label[order])
        for a, b in tree.pairs(num, den):
            a, b = order[a], order[b]
            keep = allowed_overlap(maps, own, a, b, num, den)
            for i, j in zip(run[a[keep]].tolist(), run[b[keep]].tolist()):
                forest.join(i, j)
    return forest.links


class Verifier:
    """Exact links among documents that meet in one tree."""

    def __init__(self, sets: list, num: int, den: int, labels=None, moved=None):
        import numpy as np

        self.sets, self.num, self.den, self.n = sets, num, den, len(sets)
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        self.forest = Forest(self.n)
        self.moved = moved  # of the second round: True for what came from other parts; two of them aren't compared
        if labels is not None:
            first: dict = {}
            for k, x in enumerate(labels):
                self.forest.join(first.setdefault(x, k), k)
            self.forest.links.clear()
        self.flat = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])

    def linked(self, i: int, others):
        """Which of ``others`` are linked to document i."""
        import numpy as np

        own = self.sets[i]
        if len(others) == 1:
            theirs = self.sets[others[0]]
            common = np.array([len(np.intersect1d(own, theirs, assume_unique=True))])
        else:
            theirs = self.flat if len(others) * 2 > self.n else np.concatenate([self.sets[k] for k in others])
            at = np.searchsorted(own, theirs)
            at[at == len(own)] = 0
            sums = np.concatenate([[0], np.cumsum(own[at] == theirs)])
            if len(theirs) == len(self.flat) and len(others) * 2 > self.n:
                common = (sums[self.starts[1:]] - sums[self.starts[:-1]])[others]
            else:
                cuts = np.concatenate([[0], np.cumsum(self.sizes[others])])
                common = sums[cuts[1:]] - sums[cuts[:-1]]
        union = self.sizes[i] + self.sizes[others] - common
        return common * self.den >= self.num * union

    def run(self) -> list[tuple[int, int]]:
        import numpy as np

        if self.n == 2:
            if not (self.moved is not None and self.moved.all()) and self.forest.find(0) != self.forest.find(1) and self.linked(0, np.array([1]))[0]:
                self.forest.join(0, 1)
            return self.forest.links
        for _ in range(8):  # stars first, as in possible_links
            label = self.forest.labels()
            i = next_star(label, np.arange(self.n))
            if i is None:
                return self.forest.links
            others = np.flatnonzero((label != label[i]) & (self.sizes * self.den >= self.sizes[i] * self.num) & (self.sizes[i] * self.den >= self.sizes * self.num))
            if self.moved is not None and self.moved[i]:
                others = others[~self.moved[others]]
            self.compare(i, others)
        for run, maps in size_runs([bitmap(s, 4) for s in self.sets], self.sizes, self.num, self.den):
            label = self.forest.labels()[run]
            order = np.lexsort((self.sizes[run], label))
            for a, b in SignatureTree(maps[order], self.sizes[run][order], label[order]).pairs(self.num, self.den):
                a, b = run[order[a]], run[order[b]]
                if self.moved is not None:
                    keep = ~(self.moved[a] & self.moved[b])
                    a, b = a[keep], b[keep]
                by = np.argsort(a, kind="stable")
                a, b = a[by], b[by]
                for pair in zip(*(np.split(x, np.flatnonzero(np.diff(a)) + 1) for x in (a, b))):
                    if len(pair[0]):
                        self.compare(int(pair[0][0]), pair[1])
        return self.forest.links

    def compare(self, i: int, others) -> None:
        """Joins document i with those of ``others`` that it links to and isn't connected with yet."""
        import numpy as np

        root = self.forest.find(i)
        others = np.array([j for j in others.tolist() if self.forest.find(j) != root], dtype=np.int64)
        if len(others):
            for j in others[self.linked(i, others)].tolist():
                self.forest.join(i, j)


# ---- DataFrames


def document_sets(docs: DataFrame, words: int, num: int, den: int, prefix: int = PREFIX) -> DataFrame:
    """doc_id, n (set size), k0, k1 (128 bits of the set; null: nothing to link), prefix (smallest tokens, twice as many as trees take), map (bitmap)."""

    def run(batches):
        import pyarrow as pa

        shingle = Shingler(words)
        names, kinds = ["n", "k0", "k1", "prefix", "map"], [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
        for batch in bounded(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = shingle(text)
                if not len(tokens) or doc_id is None:
                    rows.append((len(tokens), None, None, None, None))
                else:
                    rows.append((len(tokens), *key_of(tokens), tokens[: 2 * prefix].view("i8").tolist(), bitmap(tokens).tobytes()))
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *names])

    return texts(docs).mapInArrow(run, "doc_id long, n long, k0 long, k1 long, prefix array<long>, map binary")


def taken_tokens(vertices: DataFrame, often: DataFrame, num: int, den: int, prefix: int = PREFIX, small: int = SMALL) -> DataFrame:
    """token, vertex, n, map: each vertex with the tokens whose trees it goes to, those of ``often`` (column token) last in order.

    ``often`` comes to the driver if it has at most ``small`` rows; beyond that, order is that of hashes alone.
    """
    import numpy as np

    held = often.count()
    hot = np.sort(np.array([r["token"] for r in often.select("token").collect()], dtype=np.int64)) if held <= small else np.zeros(0, dtype=np.int64)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n = batch.column("n").to_numpy()
            chosen = []
            for size, tokens in zip(n.tolist(), batch.column("prefix").to_pylist()):
                own = np.array(tokens, dtype=np.int64)
                last = np.isin(own, hot)
                chosen.append(own[np.argsort(last, kind="stable")][: min(prefix, prefix_length(size, num, den))])
            row = pa.array(np.repeat(np.arange(len(n)), [len(c) for c in chosen]))
            columns = [pa.array(np.concatenate(chosen)) if chosen else pa.array([], pa.int64()), *(batch.column(c).take(row) for c in ("vertex", "n", "map"))]
            yield pa.RecordBatch.from_arrays(columns, names=["token", "vertex", "n", "map"])

    return vertices.select("vertex", "n", "prefix", "map").mapInArrow(run, "token long, vertex long, n long, map binary")


def _runs(batches, keys: int):
    """Rows of sorted batches as groups of equal first ``keys`` columns: lists of columns, one group at a time."""
    import numpy as np
    import pyarrow as pa

    held: list = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:]):
            own = tuple(c[low] for c in columns)
            if own != last and held:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            last = own
            held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def candidate_links(vertices: DataFrame, num: int, den: int, most: int = GROUP, small: int = SMALL, prefix: int = PREFIX) -> DataFrame:
    """a, b: a spanning forest, for each token, of the possible links among its documents."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def found(a: list, b: list):
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        out_a: list[int] = []
        out_b: list[int] = []
        carry = None
        seen: set = set()

        def group(t):
            vertex, maps = t.column("vertex").to_numpy(), t.column("map").to_pylist()
            for i, j in possible_links([np.frombuffer(m, dtype=np.uint64) for m in maps], t.column("n").to_numpy(), vertex, num, den):
                pair = (int(vertex[i]), int(vertex[j]))
                if pair not in seen:
                    seen.add(pair)
                    out_a.append(pair[0])
                    out_b.append(pair[1])

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch] if carry is None else [*carry.to_batches(), batch]).combine_chunks()
            keys = [t.column(k).to_numpy() for k in ("token", "band", "g1", "g2")]
            cuts = np.concatenate([[0], np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1, [t.num_rows]])
            carry = t.slice(int(cuts[-2])).combine_chunks()
            for k in np.flatnonzero(np.diff(cuts[:-1]) > 1).tolist():
                group(t.slice(int(cuts[k]), int(cuts[k + 1] - cuts[k])))
            if len(out_a) > 50_000:
                yield found(out_a, out_b)
                out_a, out_b = [], []
            if len(seen) > 200_000:
                seen.clear()
        if carry is not None and carry.num_rows > 1:
            group(carry)
        yield found(out_a, out_b)

    zero = F.lit(0).cast("long")
    counted = vertices.select(F.explode(F.slice("prefix", 1, prefix)).alias("token")).groupBy("token").count()
    rows = taken_tokens(vertices, written(counted.where(F.col("count") > most), "ngram-hot"), num, den, prefix, small)
    # what still is frequent is dealt over several trees: by bands of size, then one for each pair of parts
    often = written(rows.groupBy("token").count().where(F.col("count") > most).select("token"), "ngram-frequent")
    n = often.count()
    if n:
        few = F.broadcast(often) if n <= small else often
        marked = rows.join(few.withColumn("often", F.lit(True)), "token", "left")
        # sizes that can link differ by a factor of den / num at most, so they share one of two bands
        band = F.floor(F.log("n") / F.lit(math.log(den / num) * (1 + 1e-9) if den > num else 1e-9)).cast("long")
        bands = F.when(F.col("often"), F.array(band, band + 1)).otherwise(F.array(zero))
        banded = marked.select("token", "often", F.explode(bands).alias("band"), "vertex", "n", "map")
        parts = written(banded.where("often").groupBy("token", "band").count().select("token", "band", F.ceil(2 * F.col("count") / most).cast("long").alias("parts")), "ngram-parts")
        parts = F.broadcast(parts) if parts.count() <= small else parts
        placed = banded.join(parts, ["token", "band"], "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
        part = F.pmod(F.xxhash64("vertex"), F.col("parts")).cast("long")
        dealt = placed.select("token", "band", F.explode(F.sequence(zero, F.col("parts") - 1)).alias("q"), part.alias("p"), "vertex", "n", "map")
        rows = dealt.select("token", "band", F.least("p", "q").alias("g1"), F.greatest("p", "q").alias("g2"), "vertex", "n", "map")
    else:
        rows = rows.select("token", zero.alias("band"), zero.alias("g1"), zero.alias("g2"), "vertex", "n", "map")
    keys = ("token", "band", "g1", "g2")
    return rows.repartition(*keys).sortWithinPartitions(*keys, "n", "vertex").mapInArrow(run, "a long, b long")


def _verify(rows: DataFrame, num: int, den: int) -> DataFrame:
    """rows: group columns g0, g1, g2, then vertex, label, moved, tokens; gives g0, a, b: exact links of each group."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for t in _runs(bounded(batches), 3):
            vertex = t.column("vertex").to_numpy()
            _, first = np.unique(vertex, return_index=True)
            vertex = vertex[first]
            if len(vertex) < 2:
                continue
            tokens = t.column("tokens")
            sets = [np.frombuffer(tokens[int(k)].as_py(), dtype=np.uint64) for k in first]
            moved = t.column("moved").to_numpy(zero_copy_only=False)[first].astype(bool)
            label = t.column("label").to_numpy()[first]
            links = Verifier(sets, num, den, label, moved if moved.any() else None).run()
            if links:
                a, b = (np.array([x[k] for x in links]) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(links), t.column("g0")[0].as_py())), pa.array(vertex[a]), pa.array(vertex[b])], names=["g0", "a", "b"])

    return rows.select("g0", "g1", "g2", "vertex", "label", "moved", "tokens").repartition("g0", "g1", "g2").sortWithinPartitions("g0", "g1", "g2", "vertex").mapInArrow(run, "g0 long, a long, b long")


def exact_links(docs: DataFrame, vertices: DataFrame, groups: DataFrame, words: int, num: int, den: int, limit: int = LIMIT, documents: int = DOCUMENTS, small: int = SMALL) -> DataFrame:
    """a, b: links that join up every class of the vertices of each group (vertex, label), and no others."""
    members = groups.withColumnRenamed("label", "g0").join(vertices.select("vertex", "doc_id", "n", "k0", "k1"), "vertex")
    sizes = members.groupBy("g0").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("count"), F.min("vertex").alias("p0"), F.max("vertex").alias("p1"), F.min_by("vertex", F.xxhash64("vertex")).alias("p2"))
    whole, alone = F.col("total") / limit, F.col("count") / documents
    coarse, parts = (F.ceil(F.greatest(whole, x)).cast("long") for x in (alone, SPREAD * alone))
    members = written(members.join(sizes.select("g0", parts.alias("parts"), coarse.alias("coarse"), F.col("count").alias("size"), "p0", "p1", "p2"), "g0"), "ngram-members", vertices.count())
    many = members.count()
    wanted = members.select("doc_id", F.col("vertex").alias("of"), "k0", "k1", "g0", "parts", "p0", "p1", "p2")
    # broadcast only what is known to be small; otherwise both sides are shuffled
    wanted = F.broadcast(wanted) if many <= small else wanted

    def form(batches):
        import pyarrow as pa

        shingle = Shingler(words)
        for batch in bounded(batches):
            sets = [shingle(text) for text in batch.column(1).to_pylist()]
            wanted_keys = zip(batch.column("k0").to_pylist(), batch.column("k1").to_pylist())
            keep = pa.array([len(s) > 0 and key_of(s) == key for s, key in zip(sets, wanted_keys)])
            columns = [*(batch.column(c) for c in ("of", "g0", "parts", "p0", "p1", "p2")), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["vertex", "g0", "parts", "p0", "p1", "p2", "tokens"]).filter(keep)

    met = texts(docs).join(wanted, "doc_id").select("doc_id", "text", "of", "k0", "k1", "g0", "parts", "p0", "p1", "p2")
    sets = met.mapInArrow(form, "vertex long, g0 long, parts long, p0 long, p1 long, p2 long, tokens binary")
    own = F.pmod(F.xxhash64("vertex"), F.col("parts")).cast("long")
    several = not members.where(F.col("parts") > 1).isEmpty()
    if not several:
        rows = sets.select("g0", F.lit(0).cast("long").alias("g1"), F.lit(0).cast("long").alias("g2"), "vertex", F.col("vertex").alias("label"), F.lit(False).alias("moved"), "tokens")
        return _verify(rows, num, den).select("a", "b")
    sets = written(sets, "ngram-sets")
    shared = F.col("vertex").isin(F.col("p0"), F.col("p1"), F.col("p2"))
    where = F.when(shared, F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.array(own))
    rows = sets.select("g0", F.explode(where).alias("g1"), F.lit(0).cast("long").alias("g2"), "vertex", F.col("vertex").alias("label"), F.lit(False).alias("moved"), "tokens")
    first = written(_verify(rows, num, den), "ngram-links")
    # second round: of groups dealt over several trees, what is not in the group's largest class meets the other parts
    dealt = members.where(F.col("parts") > 1).select("vertex", "g0", "parts", "coarse", "size")
    marks = components(first.join(dealt.select("g0").distinct(), "g0", "left_semi").select("a", "b"), 2 * many)
    classed = written(dealt.join(marks, "vertex", "left").select("vertex", "g0", "parts", "coarse", "size", F.coalesce("label", "vertex").alias("label")), "ngram-classes", many)
    counts = classed.groupBy("g0", "label").count()
    largest = counts.groupBy("g0").agg(F.max_by("label", F.struct("count", "label")).alias("most"))
    rest = classed.join(largest, "g0").where(F.col("label") != F.col("most"))
    # as many trees as keep what moves below the group's size, at least those that memory asks for
    left = F.count(F.lit(1))
    most_parts = F.least(F.first("parts"), F.greatest(F.first("coarse"), F.floor(F.first("size") / left))).cast("long")
    pieces = rest.groupBy("g0").agg(F.ceil(left / PIECE).cast("long").alias("pieces"), most_parts.alias("trees"))
    held = sets.select("vertex", "tokens").join(classed, "vertex").join(pieces, "g0").withColumn("own", F.pmod(F.xxhash64("vertex"), F.col("trees")).cast("long"))
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    stay = held.select("g0", F.col("own").alias("g1"), F.explode(every("pieces")).alias("g2"), "vertex", "label", F.lit(False).alias("moved"), "tokens")
    away = held.join(rest.select("vertex"), "vertex", "left_semi").select("g0", F.explode(every("trees")).alias("g1"), F.pmod(F.xxhash64("vertex", F.lit(1)), F.col("pieces")).cast("long").alias("g2"), "vertex", "label", "tokens", "own").where(F.col("own") != F.col("g1"))
    second = _verify(stay.unionByName(away.withColumn("moved", F.lit(True)).drop("own")), num, den)
    return first.unionByName(second).select("a", "b")


def join_documents(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, prefix: int = PREFIX, limit: int = LIMIT, documents: int = DOCUMENTS, small: int = SMALL, most: int = GROUP) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) of each document."""
    found = written(document_sets(docs, words, num, den, prefix), "ngram-sets")
    # equal sets, however many, become one vertex; partial aggregation does that before the shuffle
    known = found.where(F.col("k0").isNotNull())
    alike = known.groupBy("k0", "k1").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("map").alias("map"))
    # numbers are drawn as the table is written, and read from it ever after
    vertices = written(alike.withColumn("vertex", F.monotonically_increasing_id()), "ngram-vertices")
    # a vertex has one link at most in each tree of its tokens, and in its group two or so
    groups = components(candidate_links(vertices, num, den, most, small, prefix), prefix * vertices.count())
    marks = components(exact_links(docs, vertices.select("vertex", "doc_id", "n", "k0", "k1"), groups, words, num, den, limit, documents, small), 2 * groups.count())
    of = vertices.select("vertex", "k0", "k1", "doc_id").join(marks, "vertex", "left").select("k0", "k1", "doc_id", F.coalesce("label", "vertex").alias("label"))
    least = of.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = of.select("k0", "k1", "label").join(least, "label").select("k0", "k1", "component_id")
    joined = found.select("doc_id", "n", "k0", "k1").join(named, ["k0", "k1"], "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_documents(table(spark, sf_dir, "documents"), words=4, num=85, den=100)


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 4 THEN [w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] || ' ' || w[k + 3] FOR k IN range(1, len(w) - 2)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM d
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)
), r AS (
  SELECT x AS doc_id, x AS other FROM (SELECT DISTINCT x FROM l)
  UNION
  SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.other
), m AS (
  SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.component_id, d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
"""

QUERIES = {"op9_ngram_join": op9_ngram_join}
ORACLES = {"op9_ngram_join": SQL}
