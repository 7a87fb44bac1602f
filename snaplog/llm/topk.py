"""Exact top-k search by inner product, over vectors sorted by length.

Components become integers, floor(scale * x), so scores are exact. Candidates are sorted by range of
descending length and packed into blocks; queries are packed too. A first pass over the block of the
longest candidates gives each query a score that its k-th best reaches at least. The second pass
meets each block of queries with those blocks of candidates whose greatest length could still reach
that score. Within a pair of blocks, candidates are taken in descending length, a few hundred at a
time; both sides are rotated by the right singular vectors of a bounded sample, so that the first
coordinates hold most of the length. Partial sums grow over quarters of the coordinates, then an
eighth; after each step the partial sum plus the product of the rests' lengths (Cauchy-Schwarz)
bounds a score from above, and pairs whose bound misses the query's k-th best go. What is left gets
its integer score. The k-th best rises as the pair of blocks proceeds. The rotation changes how much is
pruned and never what is found: bounds carry a margin for rounding.

Defined results: vectors that are null or hold null or non-finite components, or have no vec_id,
take no part; scores need equal dimensions, so vectors of other dimensions are no candidates; a
query's own candidates exclude all rows with its vec_id; ties go to the smaller vec_id; repeated rows
count each; an empty table gives no rows; other columns are ignored. A vector is one row of a block,
whatever its dimension; bounds and scores are computed in slices of at most CELLS numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

SCALE, K, STEP = 256, 5, 50
SAMPLE, BLOCK, QUERIES_IN_BLOCK, CHUNK, PAIRS = 20_000, 2_048, 1_024, 256, 64
#: After which eighths of the coordinates pairs are pruned; beyond one pair left in so many, partial sums stay a matrix product.
EIGHTHS, DENSE, CELLS = (2, 4, 6, 7), 16, 1 << 21


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v (array of long), norm of the rows that take part."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    sound = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(F.forall("embedding", fine), F.lit(False)))
    whole = sound.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))
    return whole.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of at most ``size`` vectors of one dimension in descending length: dim, block, n, norm (the greatest), ids, data."""

    def pack(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        held: dict[int, tuple[list, list, list]] = {}

        def close(dim: int):
            nonlocal made
            ids, vectors, norms = held.pop(dim)
            made += 1
            data = np.array(vectors, dtype="<i8").reshape(len(ids), dim)
            width = next(w for w in (2, 4, 8) if w == 8 or not data.size or -(2 ** (8 * w - 1)) <= data.min() and data.max() < 2 ** (8 * w - 1))  # bytes a component
            data = data.astype(f"<i{width}")
            return pa.RecordBatch.from_arrays([pa.array([dim]), pa.array([part << 32 | made]), pa.array([len(ids)]), pa.array([norms[0]]), pa.array([np.array(ids, dtype="<i8").tobytes()], pa.binary()), pa.array([data.tobytes()], pa.binary())], names=["dim", "block", "n", "norm", "ids", "data"])

        for batch in batches:
            for vec_id, v, norm in zip(*(c.to_pylist() for c in batch.columns)):
                own = held.setdefault(len(v), ([], [], []))
                for column, x in zip(own, (vec_id, v, norm)):
                    column.append(x)
                if len(own[0]) >= size:
                    yield close(len(v))
        for dim in list(held):
            yield close(dim)

    ordered = rows.repartitionByRange(F.col("norm").desc(), F.col("vec_id")).sortWithinPartitions(F.col("norm").desc(), "vec_id")
    return ordered.select("vec_id", "v", "norm").mapInArrow(pack, "dim long, block long, n long, norm double, ids binary, data binary")


def rotation(rows: DataFrame, sample: int = SAMPLE):
    """dim -> right singular vectors of at most ``sample`` rows (those with the smallest md5 of vec_id).

    Their matrix of products (dim x dim) is summed where the sample is; only that comes to the driver.
    """
    import numpy as np

    def products(batches):
        import pyarrow as pa

        sums: dict = {}
        for batch in batches:
            for v in batch.column(0).to_pylist():
                x = np.array(v, dtype=float)
                held = sums.setdefault(len(x), [np.zeros((len(x), len(x))), []])
                held[1].append(x)
                if len(held[1]) == 256:
                    held[0] += np.array(held[1]).T @ np.array(held[1])
                    held[1].clear()
        for dim, (total, rest) in sums.items():
            if rest:
                total = total + np.array(rest).T @ np.array(rest)
            yield pa.RecordBatch.from_arrays([pa.array([dim]), pa.array([total.tobytes()], pa.binary())], names=["dim", "products"])

    drawn = rows.select("v", F.md5(F.col("vec_id").cast("string")).alias("drawn")).orderBy("drawn", "v").limit(sample).select("v")
    turns: dict = {}
    for r in drawn.mapInArrow(products, "dim long, products binary").collect():
        dim = r["dim"]
        turns[dim] = turns.get(dim, 0) + np.frombuffer(r["products"]).reshape(dim, dim)
    return {dim: np.linalg.svd(x)[0] for dim, x in turns.items() if dim}


def exact(q, c, qi, ci):
    """Integer inner products of the pairs of rows q[qi], c[ci], a slice at a time."""
    import numpy as np

    dim = max(1, q.shape[1])
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * dim
    if most < 2**62:
        step = max(1, CELLS // dim)
        parts = [np.einsum("ij,ij->i", q[qi[k : k + step]], c[ci[k : k + step]]) for k in range(0, len(qi), step)]
        return np.concatenate([np.zeros(0, dtype=np.int64), *parts])
    whole = [sum(int(x) * int(y) for x, y in zip(q[a], c[b])) for a, b in zip(qi, ci)]
    return np.array([max(-(2**63), min(2**63 - 1, s)) for s in whole], dtype=np.int64)


def possible(qr, cr, low, margin, rests, live, cols):
    """Pairs of rows (of ``live`` and ``cols``) whose bounds reach the queries' ``low`` after every step."""
    import numpy as np

    partial, fits = np.zeros((len(live), len(cols))), np.ones((len(live), len(cols)), dtype=bool)
    qi = ci = part = None
    done = 0
    for m, q_rest, c_rest in rests:
        if qi is None:
            partial += qr[live, done:m] @ cr[cols, done:m].T
            fits &= partial + q_rest[live, None] * c_rest[None, cols] + margin >= low[live, None]
            rows, columns = fits.any(axis=1), fits.any(axis=0)
            live, cols = live[rows], cols[columns]
            partial, fits = partial[np.ix_(rows, columns)], fits[np.ix_(rows, columns)]
            if np.count_nonzero(fits) * DENSE <= fits.size:
                a, b = np.nonzero(fits)
                qi, ci, part = live[a], cols[b], partial[a, b]
        else:
            step, keep = max(1, CELLS // max(1, m - done)), []
            for k in range(0, len(qi), step):
                x, y = qi[k : k + step], ci[k : k + step]
                part[k : k + step] += np.einsum("ij,ij->i", qr[x, done:m], cr[y, done:m])
                keep.append(part[k : k + step] + q_rest[x] * c_rest[y] + margin >= low[x])
            keep = np.concatenate([np.zeros(0, dtype=bool), *keep])
            qi, ci, part = qi[keep], ci[keep], part[keep]
        done = m
    if qi is None:
        a, b = np.nonzero(fits)
        qi, ci = live[a], cols[b]
    return qi, ci


def search_block(q, q_ids, c, c_ids, turn, k: int, reached, chunk: int = CHUNK):
    """The k best candidates of each query in one pair of blocks; c is in descending length.

    reached: for each query, a score that its k-th best of all reaches at least (-inf: unknown).
    Returns query rows, candidate ids, scores, sorted by query, then score, then id.
    """
    import numpy as np

    dim = q.shape[1]
    turn = np.eye(dim) if turn is None else turn
    qr, cr = q.astype(float) @ turn, c.astype(float) @ turn
    q_norm, c_norm = np.linalg.norm(qr, axis=1), np.linalg.norm(cr, axis=1)
    steps = sorted({max(1, dim * e // 8) for e in EIGHTHS}) if dim else []
    rests = [(m, np.linalg.norm(qr[:, m:], axis=1), np.linalg.norm(cr[:, m:], axis=1)) for m in steps]
    margin = 1e-9 * (1 + q_norm.max(initial=0) * c_norm.max(initial=0)) * max(1, dim)
    low = np.asarray(reached, dtype=float).copy()
    rows, ids, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    for at in range(0, len(c), chunk):
        live = np.flatnonzero(q_norm * c_norm[at] + margin >= low)
        if not len(live):
            break
        # queries that know no k-th best yet have nothing to prune by; all their pairs of this chunk count
        cols = np.arange(at, min(len(c), at + chunk))
        fresh = np.isneginf(low[live])
        blind = live[fresh]
        qi, ci = possible(qr, cr, low, margin, rests, live[~fresh], cols)
        qi, ci = np.concatenate([qi, np.repeat(blind, len(cols))]), np.concatenate([ci, np.tile(cols, len(blind))])
        keep = q_ids[qi] != c_ids[ci]
        qi, ci = qi[keep], ci[keep]
        found = exact(q, c, qi, ci)
        keep = found >= low[qi]
        rows, ids, scores = np.concatenate([rows, qi[keep]]), np.concatenate([ids, c_ids[ci[keep]]]), np.concatenate([scores, found[keep]])
        order = np.lexsort((ids, -scores, rows))
        rows, ids, scores = rows[order], ids[order], scores[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = place < k
        last = place[keep] == k - 1
        rows, ids, scores = rows[keep], ids[keep], scores[keep]
        low[rows[last]] = np.maximum(low[rows[last]], scores[last])
    return rows, ids, scores


def top_k(queries: DataFrame, vectors: DataFrame, k: int = K, scale: int = SCALE, block: int = BLOCK, queries_in_block: int = QUERIES_IN_BLOCK, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best candidates."""
    whole = integers(vectors, scale)
    turns = rotation(whole, sample)
    candidates = written(packed(whole, block), "topk-candidates")
    asked = written(packed(integers(queries, scale), queries_in_block), "topk-queries").select("dim", F.col("block").alias("q_block"), F.col("n").alias("q_n"), F.col("norm").alias("q_norm"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))

    def arrays(r: dict, prefix: str):
        import numpy as np

        n, data = r["q_n"] if prefix else r["n"], r[f"{prefix}data"]
        width = len(data) // (n * r["dim"]) if r["dim"] else 8
        return np.frombuffer(data, dtype=f"<i{width}").reshape(n, r["dim"]).astype(np.int64), np.frombuffer(r[f"{prefix}ids"], dtype="<i8")

    def seed(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                (q, q_ids), (c, c_ids) = arrays(r, "q_"), arrays(r, "")
                rows, _, scores = search_block(q, q_ids, c, c_ids, turns.get(r["dim"]), k, np.full(len(q), -np.inf))
                low = np.full(len(q), -np.inf)
                count = np.bincount(rows, minlength=len(q))
                last = np.searchsorted(rows, np.arange(len(q))) + k - 1
                low[count >= k] = scores[last[count >= k]]
                yield pa.RecordBatch.from_arrays([pa.array([r["q_block"]]), pa.array([low.tobytes()], pa.binary()), pa.array([float(low.min())])], names=["q_block", "low", "least"])

    # the block of the longest candidates of each dimension
    longest = candidates.groupBy("dim").agg(F.max_by("block", F.struct("norm", -F.col("block"))).alias("block"))
    seeds = written(asked.join(candidates.join(longest, ["dim", "block"]), "dim").mapInArrow(seed, "q_block long, low binary, least double"), "topk-seeds")

    def search(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                (q, q_ids), (c, c_ids) = arrays(r, "q_"), arrays(r, "")
                rows, ids, scores = search_block(q, q_ids, c, c_ids, turns.get(r["dim"]), k, np.frombuffer(r["low"]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), r["q_block"])), pa.array(rows), pa.array(q_ids[rows]), pa.array(ids), pa.array(scores)], names=["q_block", "q_row", "query_id", "vec_id", "score"])

    # heads of blocks meet first: this leaves the pairs whose lengths can still reach the score. Candidates' heads are
    # dealt over parts of PAIRS blocks, since one dimension may be all there is
    parts = max(1, -(-candidates.count() // PAIRS))
    part = F.pmod(F.xxhash64("block"), F.lit(parts))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
    heads = asked.select("dim", "q_block", "q_norm").join(seeds.select("q_block", "least"), "q_block").withColumn("part", every)
    reach = F.col("q_norm") * F.col("norm") * (1 + 1e-9) + 1 >= F.col("least")
    pairs = written(heads.join(candidates.select("dim", "block", "norm", part.alias("part")), ["dim", "part"]).where(reach).select("q_block", "block", "part"), "topk-pairs")
    # the payload of a block of queries goes to the parts that it still meets, then each pair to its block of candidates
    each = pairs.select("q_block", "part").distinct().join(asked.drop("dim", "q_norm").join(seeds.select("q_block", "low"), "q_block"), "q_block")
    met = pairs.join(each, ["q_block", "part"]).join(candidates, "block")
    found = met.mapInArrow(search, "q_block long, q_row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("q_block", "q_row", "query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors.where(F.col("vec_id") % STEP == 0), vectors)


SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

QUERIES = {"op2_top_k": op2_top_k}
ORACLES = {"op2_top_k": SQL}
