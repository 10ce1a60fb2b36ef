"""Packing of token sequences by linear grouping.

Documents are tokenized, ended by a separator id and, if longer than the capacity, cut into full pieces (the first one may be
shorter). All that the plan depends on is how many pieces there are of each length, at most ``capacity`` numbers, so it is made on
the driver whatever the size of the corpus:

1. lengths over ``capacity * small`` are sorted and divided into groups of equal cardinality; each is rounded up to the
   longest of its group, which leaves a few sizes;
2. configurations of these sizes are optimised as a linear program: column generation, with a knapsack table that finds the configuration of the
   best value, until none improves; each is used as often as its share rounded down says;
3. actual lengths take the places of the rounded ones, and the last place the longest that fits into what rounding left; what the rounding of shares
   left over goes the same way, longest first;
4. the small lengths go, longest first, where they fit best.

This is done for a few numbers of groups and limits of small ones (``SETTINGS``), and the plan of the fewest sequences stands.

The plan is a short table of runs: pieces ``rank_from`` to ``rank_to`` of a length go to as many consecutive sequences at
one offset. Pieces are ranked within their length by a salted window (so a length that a third of all pieces have is ranked in parts)
and look up their run.

Defined results: a null text is empty and still has its separator; repeated rows are packed as often as they
come; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .textops import bounded_batches, chunks, map_arrow, shared_checkpoint

Run = tuple[int, int, int, int, int]  # length, rank_from, rank_to, first sequence, offset


def groups_of(hist: dict[int, int], n_groups: int) -> list[list[tuple[int, int]]]:
    """Runs (length, count) in descending order, cut into groups of as equal a cardinality as whole lengths allow."""
    total, out, here = sum(hist.values()), [[]], 0
    for length in sorted(hist, reverse=True):
        if here >= total / n_groups:
            out.append([])
            here = 0
        out[-1].append((length, hist[length]))
        here += hist[length]
    return out if out[0] else []


def best_configuration(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most value that fits into the capacity, and how often each size is taken for it."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(int(sizes.min()), capacity + 1):
        with_size = np.where(sizes <= room, best[np.maximum(room - sizes, 0)] + values, -1.0)
        k = int(np.argmax(with_size))
        best[room] = best[room - 1]
        if with_size[k] > best[room] + 1e-12:
            best[room], last[room] = with_size[k], k
    column, room = np.zeros(sizes.size), capacity
    while room > 0:
        if last[room] < 0:
            room -= 1
        else:
            column[last[room]] += 1
            room -= int(sizes[last[room]])
    return float(best[capacity]), column


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Configurations (places of sizes, largest size first) and how often each is used, by column generation; shares are rounded down."""
    n = sizes.size
    columns, inverse = np.diag(capacity // sizes).astype(float), np.diag(1.0 / (capacity // sizes))
    share = inverse @ counts
    for _ in range(40 * n):
        value, column = best_configuration(inverse.sum(0), sizes, capacity)
        if value <= 1 + 1e-7:
            break
        step = inverse @ column
        ratio = np.divide(share, step, out=np.full(n, np.inf), where=step > 1e-9)
        k = int(np.argmin(ratio))
        columns[:, k] = column
        share -= ratio[k] * step
        share[k] = ratio[k]
        row = inverse[k] / step[k]
        inverse -= np.outer(step, row)
        inverse[k] = row
    return [(np.repeat(np.arange(n), columns[:, k].astype(int)).tolist(), int(share[k] + 1e-6)) for k in range(n)]


#: Limits of small lengths, as shares of the capacity, and numbers of groups that are tried.
SETTINGS = ((1 / 3, 32), (1 / 3, 16), (1 / 4, 16), (1 / 4, 8), (1 / 8, 8))


def plan(hist: dict[int, int], capacity: int, settings: tuple[tuple[float, int], ...] = SETTINGS) -> tuple[list[Run], int]:
    """Runs for all pieces of the histogram, and the number of sequences: the best of the settings."""
    return min((plan_once(hist, capacity, *s) for s in settings), key=lambda x: x[1])


def plan_once(hist: dict[int, int], capacity: int, small: float, n_groups: int) -> tuple[list[Run], int]:
    left = {length: n for length, n in hist.items() if n}
    used = dict.fromkeys(left, 0)
    large = sorted(length for length in left if length > capacity * small)  # those of which some are left
    runs: list[Run] = []
    bins: list[tuple[int, int, int]] = []  # room left, first sequence, how many
    n_seq = 0

    def put(length: int, n: int, seq: int, offset: int) -> None:
        runs.append((length, used[length], used[length] + n, seq, offset))
        used[length] += n
        left[length] -= n

    def longest(limit: int, taken: list[int]) -> int:
        """The longest large length within the limit of which more are left than taken; 0 if there is none."""
        at = bisect_right(large, limit) - 1
        while at >= 0 and left[large[at]] <= taken.count(large[at]):
            at -= 1
        return large[at] if at >= 0 else 0

    def fill(config: list[int], times: int) -> None:
        """Sequences of actual lengths no longer than those of the configuration; the last place has what rounding left as well."""
        nonlocal n_seq
        while times and large:
            taken: list[int] = []
            for size in config[:-1]:
                if length := longest(min(size, capacity - sum(taken)), taken):
                    taken.append(length)
            while length := longest(capacity - sum(taken), taken):
                taken.append(length)
            n = min(times, *(left[x] // taken.count(x) for x in taken))
            offset = 0
            for length in taken:
                put(length, n, n_seq, offset)
                offset += length
            for length in set(taken):
                if not left[length]:
                    large.remove(length)
            insort(bins, (capacity - offset, n_seq, n))
            n_seq += n
            times -= n

    groups = groups_of({k: left[k] for k in large}, n_groups)
    sizes = np.array([g[0][0] for g in groups], dtype=np.int64)
    counts = np.array([sum(c for _, c in g) for g in groups], dtype=float)
    if groups:
        found = [([int(sizes[g]) for g in config], times) for config, times in configurations(sizes, counts, capacity)]
        for config, times in sorted(found, key=lambda x: -sum(x[0])):
            fill(config, times)
    while large:
        fill([large[-1], 0], left[large[-1]])
    for length in sorted(left, reverse=True):
        while n := left[length]:
            at = bisect_left(bins, (length, -1, -1))
            if at == len(bins):
                more = -(-n // (capacity // length))
                bins.append((capacity, n_seq, more))
                n_seq += more
            room, seq, open_ = bins.pop(at)
            q = min(open_, n)
            put(length, q, seq, capacity - room)
            insort(bins, (room - length, seq, q))
            if q < open_:
                insort(bins, (room, seq + q, open_ - q))
    return runs, n_seq


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, separator: int) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every document's pieces."""
    bounded_batches(docs.sparkSession)
    kind = dict(docs.select("doc_id").dtypes)["doc_id"]

    def run(batch: pa.RecordBatch):
        for t in chunks(batch.column("text")):
            ids, offs = bpe.encoder(tokenizer).encode(t)
            ids = np.insert(ids, offs[1:], separator).astype("<u4")
            offs = offs + np.arange(offs.size)
            total = np.diff(offs)
            n = -(-total // capacity)
            doc = np.repeat(np.arange(total.size), n)
            piece = bpe.ramp(n)
            lead = (total - (n - 1) * capacity)[doc]
            start = np.where(piece == 0, 0, lead + (piece - 1) * capacity)
            length = np.where(piece == 0, lead, capacity)
            raw = memoryview(ids.tobytes())
            lo = 4 * (offs[doc] + start)
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(lo.tolist(), (lo + 4 * length).tolist())]
            yield {"doc_id": batch.column("doc_id")[t.rows].take(pa.array(doc)), "piece": piece.astype(np.int32), "start": start, "length": length, "ids_crc32": np.array(crc, dtype=np.int64)}

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, separator: int = 2, planner: Callable = plan) -> DataFrame:
    """The pieces of token_pieces with sequence_id and offset."""
    pieces = shared_checkpoint(token_pieces(docs, tokenizer, capacity, separator))
    hist = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    runs, _ = planner(hist, capacity)
    salts = max(8, sum(hist.values()) // 100_000)
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    before = salted.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("length", "__salt", (F.sum("n").over(Window.partitionBy("length").orderBy("__salt")) - F.col("n")).alias("__before"))
    within = F.row_number().over(Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "start")) - 1
    ranked = salted.withColumn("__within", within).join(before, ["length", "__salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("__before") + F.col("__within")).alias("rank"))
    table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)
    key = table[:, 0] << 48 | table[:, 1]

    def place(batch: pa.RecordBatch):
        length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        at = np.searchsorted(key, length << 48 | rank, side="right") - 1
        row = table[at] if len(table) else table
        yield {**{c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}, "sequence_id": row[:, 3] + rank - row[:, 1], "offset": row[:, 4]}

    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    return map_arrow(ranked, place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
