"""Hard negatives of anchors by exact integer inner products, with Kronecker-packed multiplication.

Components become integers, floor(scale * x). To score many candidates at once, their components are made non-negative by a bias and put side by side into fields of one wide
integer, one such integer for each dimension; multiplying it by the anchor's (biased) component and adding up over the dimensions leaves in each field the product sum of
one candidate, and what the biases added is taken off. A field is as wide as the largest sum that the two blocks can have, so no field runs into the next one.

Two forms of the wide integer are used, with the same results. If two fields fit in 52 bits, it is a double below 2^53, which holds and adds integers exactly in whatever order, so all anchors of a
block are multiplied at once by the matrix product of the linear algebra library. Otherwise it is a Python integer with a field for every candidate of the chunk.

Anchors are cut into blocks of ``block``, candidates are dealt to ``slices`` slices whose number doesn't grow with the data. A task reads a block's anchors, then streams a slice of candidates past them in chunks and
keeps the first few of each list: memory is bounded, and what is shuffled back grows with the anchors alone. Positives are found first, block by block within a label; an anchor's
positives then set the range of scores that its negatives may have. A label that a third of all rows has is split like any other by blocks and slices.

Defined results: rows take no part if their id, label or vector is null, if a component is null or not finite (also after scaling), or if their own product sum might not fit a long
(length * largest component^2 >= 2^63). Only vectors of one length are compared. Of rows that share an id the one with the smallest label, then vector, counts. An empty vector scores 0 with other
empty ones. Ties go to the smaller id. An anchor without positives, or whose positives leave no row in range (a negative score leaves none), has no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textops import release, shared_checkpoint

FIELD = 26  # bits of a field in a double
_U = np.uint64


def two_fields(anchors: np.ndarray, candidates: np.ndarray, a: int, b: int) -> np.ndarray:
    """Product sums of all pairs, two candidates to a double; a and b bound the components."""
    lo, hi = candidates[0::2] + b, candidates[1::2] + b
    packed = lo.astype(np.float64)
    packed[: len(hi)] += hi.astype(np.float64) * float(1 << FIELD)
    both = ((anchors + a).astype(np.float64) @ packed.T).astype(np.int64)
    out = np.empty((len(anchors), len(candidates)), dtype=np.int64)
    out[:, 0::2] = both & ((1 << FIELD) - 1)
    out[:, 1::2] = (both >> FIELD)[:, : len(hi)]
    return out


def wide_fields(anchors: np.ndarray, candidates: np.ndarray, a: int, b: int, size: int) -> np.ndarray:
    """The low 64 bits of the product sums of all pairs; one integer a dimension holds all candidates in fields of size bytes."""
    n = len(candidates)
    fields = np.zeros((candidates.shape[1], n, size), dtype=np.uint8)
    fields[:, :, :8] = (candidates + b).T.astype("<u8")[:, :, None].view(np.uint8)
    packed = [int.from_bytes(row.tobytes(), "little") for row in fields]
    out = np.zeros((len(anchors), n), dtype=_U)
    for k, anchor in enumerate(anchors.tolist()):
        total = sum((x + a) * p for x, p in zip(anchor, packed))
        out[k] = np.frombuffer(total.to_bytes(n * size, "little"), dtype="<u8").reshape(n, size // 8)[:, 0]
    return out.view(np.int64)


def products(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact inner products of all pairs of two integer matrices, as long as they fit a long."""
    dim = anchors.shape[1]
    if not dim or not anchors.size or not candidates.size:
        return np.zeros((len(anchors), len(candidates)), dtype=np.int64)
    a, b = (max(1, int(np.abs(x).max())) for x in (anchors, candidates))
    bits = (dim * 4 * a * b).bit_length()
    out = two_fields(anchors, candidates, a, b) if bits <= FIELD else wide_fields(anchors, candidates, a, b, 8 if bits <= 64 else 16)
    # (x + a)(y + b) = xy + bx + ay + ab; what doesn't fit wraps around and comes back
    with np.errstate(over="ignore"):
        left = anchors.sum(axis=1).view(_U) * _U(b) + _U(dim * a * b % (1 << 64))
        return (out.view(_U) - left[:, None] - (candidates.sum(axis=1).view(_U) * _U(a))[None, :]).view(np.int64)


def first_of_lists(of: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among the first k of their list: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -score, of))
    new = np.ones(order.size, dtype=bool)
    new[1:] = of[order][1:] != of[order][:-1]
    start = np.flatnonzero(new)
    place = np.arange(order.size) - np.repeat(start, np.diff(np.append(start, order.size)))
    return order[place < k]


class Lists:
    """The first k entries of each of n lists, fed in pieces of ascending ids."""

    def __init__(self, n: int, k: int):
        self.k, self.last = k, np.full(n, -(1 << 63), dtype=np.int64)
        self.of, self.score, self.ids = (np.zeros(0, dtype=np.int64) for _ in range(3))

    def feed(self, of: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.of, self.score, self.ids = np.concatenate([self.of, of]), np.concatenate([self.score, score]), np.concatenate([self.ids, ids])
        best = first_of_lists(self.of, self.score, self.ids, self.k)
        self.of, self.score, self.ids = self.of[best], self.score[best], self.ids[best]
        full = np.bincount(self.of, minlength=self.last.size) == self.k
        low = np.full(self.last.size, (1 << 63) - 1, dtype=np.int64)
        np.minimum.at(low, self.of, self.score)
        self.last = np.where(full, low, self.last)

    def wants(self, score: np.ndarray) -> np.ndarray:
        """Which scores (lists x candidates) may enter; a tie with the last entry of a full list loses to its smaller id."""
        return score > self.last[:, None]


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(rows, flat.size // rows if rows else 0)


def valid(rows: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, dim and v (the components as integers) of the rows (vec_id, label, embedding) that take part, each vec_id once."""
    v = F.expr(f"transform(embedding, x -> floor({scale} * double(x)))")
    fits = f"forall(embedding, x -> x is not null and not isnan(x) and abs({scale}d * double(x)) < 1e18) and size(embedding) * pow(coalesce(array_max(transform(embedding, x -> abs(floor({scale} * double(x))))), 0), 2) < 9223372036854774784d"
    out = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding").where(F.expr(f"vec_id is not null and label is not null and embedding is not null and {fits}"))
    out = out.select("vec_id", "label", F.size("embedding").alias("dim"), v.cast("array<bigint>").alias("v"))
    several = out.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("vec_id")
    once = out.join(several, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "dim", "v")).alias("x")).select("vec_id", "x.label", "x.dim", "x.v")
    return out.join(several, "vec_id", "left_anti").unionByName(once)


def meetings(anchors: DataFrame, candidates: DataFrame, group: list[Column], block: int, slices: int) -> DataFrame:
    """g (the group, of which an anchor meets all candidates, with a block of anchors and a slice of candidates), kind (0: anchor, 1: candidate) and the columns of both, each group of one
    partition sorted by kind and vec_id."""
    n = anchors.count()
    blocks = max(1, -(-n // block))
    hashed = F.xxhash64("vec_id")
    spread = lambda k: F.sequence(F.lit(0), F.lit(k - 1))
    left = anchors.withColumn("kind", F.lit(0)).withColumn("blk", F.pmod(hashed, F.lit(blocks)).cast("int")).withColumn("slc", F.explode(spread(slices)))
    right = candidates.withColumn("kind", F.lit(1)).withColumn("slc", F.pmod(hashed, F.lit(slices)).cast("int")).withColumn("blk", F.explode(spread(blocks)))
    both = left.unionByName(right, allowMissingColumns=True).withColumn("g", F.struct(*group, "dim", "blk", "slc"))
    parts = max(int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks)
    return both.drop("blk", "slc", "dim").repartition(parts, "g").sortWithinPartitions("g", "kind", "vec_id")


def streamed(rows: DataFrame, start: Callable[[pa.Table], tuple[object, np.ndarray]], feed: Callable, finish: Callable[[object], dict], schema: str, step: int = 1 << 21) -> DataFrame:
    """Reads the groups of meetings. start(anchors) gives a state and their matrix, feed(state, scores, candidates) sees each piece of candidates with its scores, finish(state) gives the columns of
    the group's result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, state, matrix = None, [], None, None
        for batch in batches:
            g, kind = batch.column("g"), batch.column("kind").to_numpy()
            flat = np.stack([c.to_numpy(zero_copy_only=False) for c in g.flatten()] + [kind])
            edge = np.flatnonzero(np.concatenate([[True], (flat[:, 1:] != flat[:, :-1]).any(axis=0), [True]]))
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
                here = tuple(flat[:-1, lo].tolist())
                if here != key:
                    if state is not None:
                        yield pa.RecordBatch.from_pydict(finish(state))
                    key, held, state = here, [], None
                part = batch.slice(lo, hi - lo)
                if kind[lo] == 0:
                    held.append(part)
                    continue
                if state is None:
                    if not held:
                        continue
                    state, matrix = start(pa.Table.from_batches(held))
                piece = max(2, step // max(1, len(matrix)))
                for at in range(0, len(part), piece):
                    some = part.slice(at, piece)
                    feed(state, products(matrix, _matrix(some.column("v"), len(some))), some)
            release()
        if state is not None:
            yield pa.RecordBatch.from_pydict(finish(state))

    return rows.mapInArrow(run, schema)


def first_rows(found: DataFrame, lists: list[str], id_: str, score: str, k: int) -> DataFrame:
    """The first k rows of each list with their rank."""
    order = Window.partitionBy(*lists).orderBy(F.desc(score), id_)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def positives(anchors: DataFrame, candidates: DataFrame, k: int, block: int, slices: int) -> DataFrame:
    """anchor_id, positive_id and positive_score of the first k other rows of each anchor's label."""

    def start(table: pa.Table):
        return (table.column("vec_id").to_numpy(), Lists(len(table), k)), _matrix(table.column("v"), len(table))

    def feed(state, score, some):
        ids, lists = some.column("vec_id").to_numpy(), state[1]
        a, c = np.nonzero(lists.wants(score) & (state[0][:, None] != ids[None, :]))
        lists.feed(a, score[a, c], ids[c])

    def finish(state):
        return {"anchor_id": state[0][state[1].of], "positive_id": state[1].ids, "positive_score": state[1].score}

    rows = meetings(anchors.select("vec_id", "label", "dim", "v"), candidates.select("vec_id", "label", "dim", "v"), [F.col("label")], block, slices)
    found = streamed(rows, start, feed, finish, "anchor_id long, positive_id long, positive_score long")
    return first_rows(found, ["anchor_id"], "positive_id", "positive_score", k).drop("rank")


def mine(rows: DataFrame, is_anchor: Column, k_positives: int = 5, k_negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, block: int = 8192, slices: int = 32) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its first k_positives rows of the same label the first k_negatives rows of another label
    whose score is between low and high hundredths of the positive's."""
    every = shared_checkpoint(valid(rows.select("vec_id", "label", "embedding"), scale))
    anchors = every.where(is_anchor)
    known = shared_checkpoint(positives(anchors, every, k_positives, block, slices))
    ranges = known.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("positive_id", "positive_score"))).alias("pos"))  # k_positives at most
    ready = anchors.join(ranges.withColumnRenamed("anchor_id", "vec_id"), "vec_id")

    def start(table: pa.Table):
        given = table.column("pos").to_pylist()
        ids, score = (np.zeros((len(table), k_positives), dtype=np.int64) for _ in range(2))
        least, most = np.ones_like(ids), np.zeros_like(ids)  # an empty range where there is no positive
        for a, pos in enumerate(given):
            for j, p in enumerate(pos):
                s = p["positive_score"]
                ids[a, j], score[a, j] = p["positive_id"], s
                lo, hi = -(-low * s // 100), high * s // 100
                if lo <= hi:
                    least[a, j], most[a, j] = max(lo, -(1 << 63)), min(hi, (1 << 63) - 1)
        lists = [Lists(len(table), k_negatives) for _ in range(k_positives)]
        return (table.column("vec_id").to_numpy(), table.column("label").to_numpy(), ids, score, least, most, lists), _matrix(table.column("v"), len(table))

    def feed(state, score, some):
        _, label, _, _, least, most, lists = state
        ids = some.column("vec_id").to_numpy()
        other = label[:, None] != some.column("label").to_numpy()[None, :]
        for j, found in enumerate(lists):
            a, c = np.nonzero(other & (score >= least[:, j : j + 1]) & (score <= most[:, j : j + 1]) & found.wants(score))
            if a.size:
                found.feed(a, score[a, c], ids[c])

    def finish(state):
        anchor, _, ids, score, _, _, lists = state
        cols: dict[str, list] = {c: [] for c in ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")}
        for j, found in enumerate(lists):
            for c, x in zip(cols, (anchor[found.of], ids[found.of, j], score[found.of, j], found.ids, found.score)):
                cols[c].append(x)
        return {c: np.concatenate(x) for c, x in cols.items()}

    meet = meetings(ready.select("vec_id", "label", "dim", "v", "pos"), every.select("vec_id", "label", "dim", "v"), [F.lit(0).alias("all")], block, slices)
    found = streamed(meet, start, feed, finish, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    out = first_rows(found, ["anchor_id", "positive_id"], "negative_id", "negative_score", k_negatives)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
