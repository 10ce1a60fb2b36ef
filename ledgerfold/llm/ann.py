"""Approximate nearest neighbours by cross-polytope hashing.

Vectors are hashed by pseudo-rotations, three rounds of random signs and a fast Hadamard transform: the hash of a rotated unit vector
is its nearest signed axis, the place and sign of its largest entry. ``hashes`` such axes name a bucket of one of ``tables`` tables. A
query looks into its own bucket and those that differ in one or several axes where the runner-up entries are nearly as large (multiprobe).
Candidates are reranked by the inner product of the original vectors in double precision.

As inner products and not angles are searched, rows are lifted by one coordinate, sqrt(max norm^2 - norm^2), to one common norm, and queries
by a zero: the largest inner product is then the nearest angle. Rows that have one norm already stay as they are.

Equal vectors stand once in the index, with their ``k + 1`` smallest ids (all that a result can hold). A large bucket is
cut into salted parts of about ``part`` rows and queries go to each part, so no bucket is capped and none is one task's. The result of a
bucket is its ``k`` best per query, not pairs. The tables are fixed in number; a bucket has one axis, or two if the rows are many times
``bucket``. A query makes ``probes`` probes, and PROBES_MORE times as many into buckets of two axes, which keeps the recall: the README has it
for both.

Defined results: vectors that are null, zero or hold a null or non-finite component take no part, as query or candidate; vectors of another
length than the most frequent one neither; a vec_id that comes repeatedly with one vector counts once; fewer than k candidates give all
of them (queries whose tables gave fewer than k are then compared with all rows, in blocks).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textops import release, shared_checkpoint

FOUND = "query_id long, rep long, score double"
#: How many times as many probes a second axis needs.
PROBES_MORE = 32


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, whose width is a power of two, in n log n."""
    h = 1
    n, d = x.shape
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(n, d)
        h *= 2
    return x


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    """A pseudo-rotation of each row, padded to a power of two."""
    d = 1 << max(1, int(np.ceil(np.log2(x.shape[1]))))
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], size=(3, d)).astype(np.float32)
    y = np.zeros((len(x), d), dtype=np.float32)
    y[:, : x.shape[1]] = x
    for s in signs:
        y = hadamard(y * s) / np.float32(np.sqrt(d))
    return y


def axes(y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n nearest signed axes of each row (2 * place + (1 if negative)) and how far behind the best each is."""
    a = np.abs(y)
    n = min(n, y.shape[1])
    top = np.argpartition(-a, n - 1, axis=1)[:, :n]
    order = np.argsort(-np.take_along_axis(a, top, 1), axis=1, kind="stable")
    top = np.take_along_axis(top, order, 1)
    value = np.take_along_axis(y, top, 1)
    return 2 * top + (value < 0), np.abs(value[:, :1]) - np.abs(value)


def codes(x: np.ndarray, table: int, hashes: int, probes: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row, code) arrays of the ``probes`` best buckets of each row in one table, the own bucket first."""
    width = 2 << max(1, int(np.ceil(np.log2(x.shape[1]))))
    fan = min(probes, 24)
    found = [axes(rotate(x, 1000 * table + j + 1), fan) for j in range(hashes)]
    code, cost = np.zeros((len(x), 1), dtype=np.int64), np.zeros((len(x), 1), dtype=np.float64)
    for ax, behind in found:  # the cheapest combinations of axes
        code = (code[:, :, None] * width + ax[:, None, :]).reshape(len(x), -1)
        cost = (cost[:, :, None] + (behind**2)[:, None, :]).reshape(len(x), -1)
        if code.shape[1] > probes:
            best = np.argpartition(cost, probes - 1, axis=1)[:, :probes]
            code, cost = np.take_along_axis(code, best, 1), np.take_along_axis(cost, best, 1)
    return [(np.arange(len(x)), code[:, j]) for j in range(code.shape[1])]


def n_hashes(n: int, width: int, bucket: int = 4096) -> int:
    """Axes per bucket for n rows and width signed axes. No more than two: with three, recall is not measured; larger buckets are cut into parts."""
    return min(2, max(1, round(np.log(max(n / bucket, 1)) / np.log(width))))


def n_probes(probes: int, hashes: int) -> int:
    return probes * PROBES_MORE ** (hashes - 1)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def best(q: np.ndarray, x: np.ndarray, q_ids: np.ndarray, x_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k largest inner products of each query with the rows of x: query, row, score; more if scores tie for the last place."""
    out = []
    block = max(1, (1 << 21) // max(1, len(x)))
    x64 = x.astype(np.float64)
    for lo in range(0, len(q), block):
        part = q[lo : lo + block].astype(np.float64)
        approx = part @ x64.T
        if len(x) > k:
            limit = -np.partition(-approx, k - 1, axis=1)[:, k - 1 : k]
            r, c = np.nonzero(approx >= limit - 1e-9 * np.maximum(1, np.abs(limit)))
        else:
            r, c = (v.reshape(-1) for v in np.indices(approx.shape))
        for at in range(0, r.size, 1 << 16):  # one order of summation for all, so equal vectors have equal scores
            rr, cc = r[at : at + (1 << 16)], c[at : at + (1 << 16)]
            out.append((q_ids[lo + rr], x_ids[cc], (part[rr] * x64[cc]).sum(axis=1)))
    return tuple(np.concatenate([o[j] for o in out]) if out else np.zeros(0, t) for j, t in enumerate((np.int64, np.int64, np.float64)))


def valid(vectors: DataFrame) -> tuple[DataFrame, int]:
    """vec_id and embedding of vectors that take part, and their length."""
    v = F.col("embedding")
    finite = F.expr("forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(embedding, x -> x <> 0)")
    kind = "array<double>" if dict(vectors.dtypes)["embedding"] == "array<double>" else "array<float>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast(kind).alias("embedding")).where(F.col("vec_id").isNotNull() & v.isNotNull() & finite)
    dim = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dim = dim["d"] if dim else 0
    return rows.where(F.size("embedding") == dim), dim


def nearest(vectors: DataFrame, is_query, k: int = 20, tables: int = 20, probes: int = 8, part: int = 4096, hashes: int = 0, bucket: int = 4096) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest of each row for which is_query holds."""
    spark = vectors.sparkSession
    rows, dim = valid(vectors)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not dim:
        return empty
    # equal vectors once: the smallest id stands for them, and the k + 1 smallest are kept
    parts_of = Window.partitionBy("embedding", "s").orderBy("vec_id")
    salted = rows.withColumn("s", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    few = salted.withColumn("r", F.dense_rank().over(parts_of)).where(F.col("r") <= k + 1)  # a limit before the exchange: no vector's ids are gathered
    distinct = few.groupBy("embedding").agg(F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1).alias("ids"))
    distinct = shared_checkpoint(distinct.withColumn("rep", F.col("ids")[0]))
    squares = F.expr("aggregate(embedding, 0d, (a, x) -> a + double(x) * double(x))")
    n, shortest, longest = distinct.agg(F.count(F.lit(1)), F.min(squares), F.max(squares)).first()
    one_norm = longest - shortest <= 1e-4 * longest
    width = 2 << max(1, int(np.ceil(np.log2(dim if one_norm else dim + 1))))
    hashes = hashes or n_hashes(n, width, bucket)
    queries = rows.where(is_query(F.col("vec_id"))).dropDuplicates(["vec_id", "embedding"])

    def lifted(x: np.ndarray, query: bool) -> np.ndarray:
        x = x.astype(np.float64)
        own = (x * x).sum(1)
        if one_norm:
            return (x / np.sqrt(own)[:, None]).astype(np.float32)
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(longest - own, 0))
        y = np.hstack([x, extra[:, None]])
        return (y / np.sqrt((y * y).sum(1, keepdims=True))).astype(np.float32)

    def bucketed(query: bool):
        def run(batches):
            for b in batches:
                x = lifted(matrix(b.column("embedding"), dim), query)
                for table in range(tables):
                    for row, code in codes(x, table, hashes, n_probes(probes, hashes) if query else 1):
                        yield pa.RecordBatch.from_pydict({"id": b.column(0), "embedding": b.column("embedding"), "t": pa.array(np.full(len(row), table, np.int32)), "code": pa.array(code)})

        return run

    shape = f"id long, embedding {dict(distinct.dtypes)['embedding']}, t int, code long"
    index = distinct.select("rep", "embedding").mapInArrow(bucketed(False), shape)
    asked = queries.select("vec_id", "embedding").mapInArrow(bucketed(True), shape)
    sizes = index.groupBy("t", "code").count()
    sizes = sizes.select("t", "code", F.greatest(F.lit(1), F.ceil(F.col("count") / part)).cast("int").alias("parts"))
    cut = index.join(sizes, ["t", "code"]).withColumn("s", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
    wide = asked.join(sizes, ["t", "code"]).withColumn("s", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    # several buckets make a group; a query has its buckets in a fixed number of groups, so results grow with the queries and no faster
    slots = max(128, int(n * tables // 20_000))
    key = F.pmod(F.xxhash64("t", "code", "s"), F.lit(slots)).cast("int").alias("g")

    def search(_, left, right):
        sides = []
        for side in (left, right):
            bucket = np.empty(len(side), dtype=[("t", "<i4"), ("code", "<i8"), ("s", "<i4")])
            for c in ("t", "code", "s"):
                bucket[c] = side.column(c).to_numpy()
            order = np.argsort(bucket, order=("t", "code", "s"), kind="stable")
            x = matrix(side.column("embedding"), dim) if len(side) else np.zeros((0, dim), np.float32)
            sides.append((bucket[order], x[order], side.column("id").to_numpy()[order]))
        (qb, q, q_ids), (xb, x, x_ids) = sides
        out = []
        starts = np.flatnonzero(np.concatenate([[True], qb[1:] != qb[:-1]])) if qb.size else []
        lo_all, hi_all = np.searchsorted(xb, qb[starts], side="left"), np.searchsorted(xb, qb[starts], side="right")
        for a, b, lo, hi in zip(starts, np.append(starts[1:], qb.size) if len(starts) else [], lo_all, hi_all):
            if lo < hi:
                out.append(best(q[a:b], x[lo:hi], q_ids[a:b], x_ids[lo:hi], k + 1))
        cols = [np.concatenate([o[j] for o in out]) if out else np.zeros(0, t) for j, t in enumerate((np.int64, np.int64, np.float64))]
        # a pair may come from several tables: once is enough, and k + 1 per query
        order = np.lexsort((cols[1], -cols[2], cols[0]))
        cols = [c[order] for c in cols]
        if cols[0].size:
            fresh = np.concatenate([[True], (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])])
            cols = [c[fresh] for c in cols]
            start = np.flatnonzero(np.concatenate([[True], cols[0][1:] != cols[0][:-1]]))
            place = np.arange(cols[0].size) - np.repeat(start, np.diff(np.append(start, cols[0].size)))
            cols = [c[place <= k] for c in cols]
        release()
        return pa.table({"query_id": cols[0], "rep": cols[1], "score": cols[2]})

    found = wide.withColumn("g", key).groupBy("g").cogroup(cut.withColumn("g", key).groupBy("g")).applyInArrow(search, FOUND)
    members = distinct.select("rep", "ids")
    top = _ranked(found.dropDuplicates(["query_id", "rep"]), members, k)
    top = shared_checkpoint(top)
    # exact way for queries whose buckets held too few
    short = queries.join(top.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti")
    short = shared_checkpoint(short)
    if short.isEmpty():
        return top
    return top.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(_ranked(all_rows(short, distinct, dim, k, n), members, k))


def all_rows(queries: DataFrame, distinct: DataFrame, dim: int, k: int, n: int, block: int = 20_000, q_block: int = 2_000) -> DataFrame:
    """The queries against all distinct vectors, block by block."""
    blocks, q_blocks = max(1, -(-n // block)), max(1, -(-queries.count() // q_block))
    left = queries.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = distinct.select("rep", "embedding", F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int").alias("b")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))

    def search(_, a, b):
        if not len(a) or not len(b):
            return pa.table({"query_id": pa.array([], pa.int64()), "rep": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        q, r, s = best(matrix(a.column("embedding"), dim), matrix(b.column("embedding"), dim), a.column("vec_id").to_numpy(), b.column("rep").to_numpy(), k + 1)
        return pa.table({"query_id": q, "rep": r, "score": s})

    return left.groupBy("b", "qb").cogroup(right.groupBy("b", "qb")).applyInArrow(search, FOUND)


def _ranked(found: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """Distinct vectors back to rows: the k best per query, ties to the smaller vec_id, without the query itself."""
    near = found.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rep"))).where(F.col("r") <= k + 1)
    rows = near.join(members, "rep").select("query_id", F.explode("ids").alias("vec_id"), "score").where(F.col("vec_id") != F.col("query_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
