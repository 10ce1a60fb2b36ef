"""Near-duplicate groups by SuperMinHash, banding, verification and union-find.

A document is the set of its distinct shingles of ``size`` words. SuperMinHash gives its signature: every element owns a random permutation
of the slots, drawn one step at a time; step j offers the value j + r to one slot, r random. An element's values are thus
correlated (no two of them in one slot), which lowers the variance, and a document is done as soon as all its slots hold values below
the next step. Documents of a chunk step together, and those that are done drop out.

Signatures are banded; documents that share a band are candidates, and candidates are linked if their full sets meet the threshold. With 32
bands of 5 slots a pair at the threshold of 0.85 is missed once in 10^8.

Equal sets are one node from the start, named by the least number of their rows. In a bucket not all pairs are compared but as many as the
groups need: first every member with the bucket's hub; then, as long as a bucket has members of more than one group, members of different
groups, in blocks of ``block`` and without emitting pairs that fail. An open bucket of more blocks than its members have first shingles is split by
rare shingles before: in any one order of all shingles, two sets that meet the threshold share one of their first ``n - ceil(n * percent / 100) + 1``, so members meet only under
these, in an order that puts what many members have last. So a bucket of n copies costs n comparisons, and no link that joins two groups is lost.

Groups are found by alternating stars on DataFrames: each node hands its larger neighbours, and then its smaller ones, to the least of
them, until all point to their group's least. Nothing but counts reaches the driver, and the ``COMMON`` most frequent shingles of open buckets, if there are large ones.

Defined results: a document without words (or text) has an empty set and is alone; one with fewer words than a shingle has its whole sequence
as the one element; rows that share a doc_id are linked; a null doc_id is alone and kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .textops import Texts, bounded_batches, chunks, map_arrow, mix, release, shared_checkpoint

BITS = 48
#: How many of the most frequent shingles of large open buckets are put last in the order; a bound of what reaches the driver, not of results.
COMMON = 100_000
_U = np.uint64


def shingle_sets(t: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles (48-bit hashes) of all documents of a chunk on end, ascending, and where each document's begin."""
    n = t.offs.size - 1
    words = np.diff(t.bounds)
    keys = []
    for width in range(1, size + 1):
        h, whole = t.windows(width)
        at = np.flatnonzero(whole)
        owner = t.owner[at]
        if width < size:
            fits = words[owner] == width
            at, owner = at[fits], owner[fits]
        keys.append(owner.astype(_U) << _U(BITS) | h[at] >> _U(64 - BITS))
    assert n < 1 << (64 - BITS)
    key = np.unique(np.concatenate(keys))
    return key & _U((1 << BITS) - 1), np.searchsorted(key >> _U(BITS), np.arange(n + 1).astype(_U))


def superminhash(shingles: np.ndarray, offs: np.ndarray, slots: int) -> np.ndarray:
    """Signatures (documents x slots) of sets that stand on end. A slot's value has the step in its upper 8 bits and the random
    part below; an empty set keeps the largest value."""
    n = offs.size - 1
    best = np.full(n * slots, ~_U(0), dtype=_U)
    owner = np.repeat(np.arange(n), np.diff(offs))
    seed = mix(shingles + _U(0x51ED27))
    perm = None
    for j in range(slots):
        draw = mix(seed + _U(0x9E3779B97F4A7C15 * (j + 1) & 0xFFFFFFFFFFFFFFFF))
        swap = j + ((draw & _U(0xFFFFFF)) * _U(slots - j) >> _U(24)).astype(np.int64)
        value = _U(j) << _U(56) | mix(draw) >> _U(8)
        if j == 0:
            slot = swap
        else:
            rows = np.arange(seed.size)
            slot = perm[rows, swap]
            perm[rows, swap] = perm[:, j]
        np.minimum.at(best, owner * slots + slot, value)
        done = best.reshape(n, slots).max(1) < _U(j + 1) << _U(56)
        live = ~done[owner]
        if not live.any():
            break
        if j == 0:
            first = swap[live]
            perm = np.tile(np.arange(slots, dtype=np.uint8), (first.size, 1))
            perm[np.arange(first.size), first] = 0  # the swap of step 0; slot 0's place isn't drawn again
        elif not live.all():
            perm = perm[live]
        seed, owner = seed[live], owner[live]
    return best.reshape(n, slots)


def digests(shingles: np.ndarray, offs: np.ndarray) -> pa.Array:
    """A 128-bit digest of each set, whatever the order; null for an empty one."""
    count = np.diff(offs)
    node = np.zeros((count.size, 2), dtype=_U)
    filled = np.flatnonzero(count)
    for k in range(2):
        node[filled, k] = np.add.reduceat(mix(shingles * _U(2 * k + 3) + _U(k)), offs[filled]) if filled.size else 0
    node[:, 1] ^= count.astype(_U)
    raw = node.tobytes()
    return pa.array([raw[16 * k : 16 * k + 16] if c else None for k, c in enumerate(count)], pa.binary())


def signatures(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """row (a number), doc_id, n_shingles, node (a digest of the set, null if it is empty) and a key for each band."""
    bounded_batches(docs.sparkSession)

    def run(batch: pa.RecordBatch):
        for raw in chunks(batch.column("text"), 1 << 20):
            t = raw.lower()
            h, offs = shingle_sets(t, size)
            count = np.diff(offs)
            sig = superminhash(h, offs, bands * rows)
            key = np.zeros((count.size, bands), dtype=_U)
            for b in range(bands):
                acc = np.full(count.size, _U(b + 1), dtype=_U)
                for k in range(rows):
                    acc = mix(acc * _U(0xC2B2AE3D27D4EB4F) ^ sig[:, b * rows + k])
                key[:, b] = acc
            yield {
                "doc_id": batch.column("doc_id")[t.rows],
                "n_shingles": count.astype(np.int64),
                "node": digests(h, offs),
                "bands": pa.FixedSizeListArray.from_arrays(pa.array(key.reshape(-1).view(np.int64)), bands).cast(pa.list_(pa.int64())),
            }

    out = map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_shingles long, node binary, bands array<long>")
    return out.withColumn("row", F.monotonically_increasing_id())


def set_table(docs: DataFrame, size: int) -> DataFrame:
    """node and shingles (packed) of each text, equal ones of a chunk once."""

    def run(batch: pa.RecordBatch):
        for raw in chunks(batch.column("text"), 1 << 20):
            h, offs = shingle_sets(raw.lower(), size)
            node = digests(h, offs)
            first = {x: k for k, x in enumerate(node.to_pylist()) if x is not None}
            packed = [h[offs[k] : offs[k + 1]].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for k in first.values()]
            yield {"node": pa.array(list(first), pa.binary()), "shingles": pa.array(packed, pa.binary())}

    return map_arrow(docs.select("text"), run, "node binary, shingles binary")


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def meets(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * |a and b| >= percent * |a or b|, for ascending sets."""
    if 100 * min(a.size, b.size) < percent * max(a.size, b.size):
        return False
    small, large = (a, b) if a.size < b.size else (b, a)
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, large.size - 1)] == small).sum())
    return 100 * both >= percent * (a.size + b.size - both)


class Forest:
    """Union-find over the links that one task sees."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(up, up)
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Rows of (a, b) whose sets meet the threshold; of those that a task has linked already, none.

    The sets of a go to b, and not the other way, so that a hub's join is as large as its members' sets and AQE can split it."""
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b").select("a", "b", "sa", "sb")

    def run(batches):
        forest, last, hub = Forest(), None, np.zeros(0, _U)
        for batch in batches:
            a, b = (batch.column(c).to_numpy() for c in "ab")
            sa, sb, ok = batch.column("sa"), batch.column("sb"), []
            for k in range(a.size):
                x, y = int(a[k]), int(b[k])
                if forest.root(x) == forest.root(y):
                    continue
                if y != last:
                    last, hub = y, unpacked(sb[k].as_py())
                if meets(unpacked(sa[k].as_py()), hub, percent):
                    forest.join(x, y)
                    ok.append(k)
            yield pa.RecordBatch.from_pydict({"a": a[ok], "b": b[ok]})
            del batch, sa, sb
            release()

    return both.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node and label (the smallest node reachable) of all nodes of edges (a, b), but for those that are their own label."""
    cur = shared_checkpoint(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).where("v > m").distinct())
    while True:
        both = cur.selectExpr("v as u", "m as w").union(cur.selectExpr("m as u", "v as w"))
        least = both.groupBy("u").agg(F.least("u", F.min("w")).alias("low"))
        large = both.join(least, "u").where("w > u").selectExpr("w as v", "low as m", "low <> u as changed")
        least = large.groupBy("v").agg(F.min("m").alias("low"))
        small = large.join(least, "v").selectExpr("case when m = low then v else m end as v", "low as m", "changed or m <> low as changed")
        seen = Observation()
        # of the neighbours that two nodes share, each says the same of the two: once is enough
        cur = shared_checkpoint(small.observe(seen, F.count_if("changed").alias("n")).select("v", "m").distinct())
        if not seen.get["n"]:
            return cur.selectExpr("v as node", "m as label")


def open_buckets(named: DataFrame) -> DataFrame:
    """The members (band, key, id, n_shingles, label), the size n and the mean set of buckets that hold several groups; of buckets with the same members only one."""
    many = named.groupBy("band", "key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.bit_xor(F.xxhash64("id")).alias("digest"), F.sum(F.xxhash64("id", "label").bitwiseAND(0x7FFFFFFF)).alias("total"), F.count(F.lit(1)).alias("n"), F.avg("n_shingles").alias("mean")).where("low <> high")
    once = many.groupBy("digest", "total", "n").agg(F.min(F.struct("band", "key")).alias("first"), F.min("mean").alias("mean")).select("first.band", "first.key", "n", "mean")
    return named.drop("n").join(once, ["band", "key"])


def frequent(members: DataFrame, n: int) -> np.ndarray:
    """The n shingles that most members have, the most frequent first."""

    def run(batch: pa.RecordBatch):
        every = np.concatenate([np.zeros(0, _U), *(unpacked(x) for x in batch.column("shingles").to_pylist())])
        x, count = np.unique(every, return_counts=True)
        yield {"x": x.view(np.int64)[count > 0], "n": count.astype(np.int64)}

    total = map_arrow(members.select("shingles"), run, "x long, n long").groupBy("x").agg(F.sum("n").alias("n")).where("n > 2")
    rows = total.orderBy(F.desc("n"), "x").limit(n).toArrow()
    return rows.column("x").to_numpy().astype(_U)


def split_buckets(buckets: DataFrame, sets: DataFrame, percent: int, common: np.ndarray) -> DataFrame:
    """Buckets cut into one for each shingle that stands among the first of a member in the order of rare ones before common ones."""
    order = np.argsort(common)
    sorted_, place = common[order], order

    def run(batch: pa.RecordBatch):
        out: list[list] = [[], []]
        for k, raw in enumerate(batch.column("shingles").to_pylist()):
            x = unpacked(raw)
            size = x.size - -(-x.size * percent // 100) + 1
            rank = x.copy()
            if sorted_.size:
                at = np.minimum(np.searchsorted(sorted_, x), sorted_.size - 1)
                hit = sorted_[at] == x
                rank[hit] = (_U(1) << _U(60)) + (common.size - place[at[hit]]).astype(_U)
            first = np.argpartition(rank, size - 1)[:size] if size < x.size else np.arange(x.size)
            out[0].append(x[first])
            out[1].append(np.full(first.size, k))
        who = pa.array(np.concatenate(out[1]) if out[1] else np.zeros(0, np.int64))
        element = np.concatenate(out[0]).view(np.int64) if out[0] else np.zeros(0, np.int64)
        yield {**{c: batch.column(c).take(who) for c in ("band", "key", "id", "n_shingles", "label")}, "element": element}

    rows = map_arrow(buckets.select("band", "key", "id", "n_shingles", "label").join(sets, "id").select("band", "key", "id", "n_shingles", "label", "shingles"), run, "band int, key long, id long, n_shingles long, label long, element long")
    return rows.select("band", F.xxhash64("key", "element").alias("key"), "id", "n_shingles", "label")


def links_in_buckets(buckets: DataFrame, sets: DataFrame, percent: int, block: int = 1024, elements: int = 400_000) -> DataFrame:
    """Links (a, b) between labels of members of the same bucket. buckets: band, key, id, n_shingles, label.

    Members are cut into blocks of about block nodes and elements shingles; each pair of blocks is one group, which compares by an inverted index and
    gives one link for each pair of labels that it can join."""
    size = buckets.groupBy("band", "key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n_shingles") / elements)).cast("int").alias("blocks"))
    cut = buckets.join(size, ["band", "key"]).withColumn("k", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # block k meets the blocks from k on; each meeting is (i, j), i <= j
    meet = F.expr("transform(sequence(0, blocks - 1), o -> struct(least(k, o) as i, greatest(k, o) as j))")
    wide = cut.withColumn("m", F.explode(meet)).select("band", "key", "m.i", "m.j", "k", "id", "label")
    full = wide.join(sets, "id")

    def compare(table):
        table = table.sort_by("id")
        i = table.column("i")[0].as_py()
        j = table.column("j")[0].as_py()
        label = table.column("label").to_numpy()
        k = table.column("k").to_numpy()
        items = [unpacked(x) for x in table.column("shingles").to_pylist()]
        size = np.array([x.size for x in items])
        every = np.concatenate(items)
        who = np.repeat(np.arange(size.size), size)
        order = np.argsort(every, kind="stable")
        every, who = every[order], who[order]
        lo_of, hi_of = np.searchsorted(every, every, "left"), np.searchsorted(every, every, "right")
        place = np.empty(order.size, dtype=np.int64)
        place[order] = np.arange(order.size)
        ends = np.cumsum(size)
        group = label.copy()
        a_out, b_out = [], []
        for x in range(size.size):  # one member against all the others of the bucket that it may meet
            mine = place[ends[x] - size[x] : ends[x]]
            lo, count = lo_of[mine], hi_of[mine] - lo_of[mine]
            near = who[np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())]
            common = np.bincount(near, minlength=size.size)
            ok = 100 * common >= percent * (size[x] + size - common)
            ok &= group != group[x]
            if i != j:
                ok &= k != k[x]
            for y in np.flatnonzero(ok):
                if group[y] != group[x]:
                    a_out.append(label[x])
                    b_out.append(label[y])
                    group[group == group[y]] = group[x]
        if every.size > 100_000:
            release()
        return pa.table({"a": pa.array(a_out, pa.int64()), "b": pa.array(b_out, pa.int64())})

    return full.groupBy("band", "key", "i", "j").applyInArrow(compare, "a long, b long")


def links_between_groups(named: DataFrame, sets: DataFrame, percent: int, block: int = 1024) -> DataFrame:
    """Links (a, b) between labels that some bucket holds both of. named: band, key, id, n_shingles, label."""
    opened = shared_checkpoint(open_buckets(named))
    # a member goes to n / block blocks, or to as many buckets as it has first shingles: whichever is less
    splits = F.col("n") > block * (F.col("mean") * (100 - percent) / 100 + 1)
    large, todo = opened.where(splits), opened.where(~splits).drop("n", "mean")
    if not large.isEmpty():
        common = frequent(large.select("id").distinct().join(sets, "id"), COMMON)
        todo = todo.unionByName(open_buckets(split_buckets(large, sets, percent, common)).drop("n", "mean"))
    return links_in_buckets(todo, sets, percent, block)


def links_by_doc_id(filled: DataFrame, nodes: DataFrame) -> DataFrame | None:
    """Links (a, b) between the nodes of rows that share a doc_id; None if no rows do."""
    several = filled.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    if several.isEmpty():
        return None
    rows = filled.select("doc_id", "row", "node").join(several, "doc_id").join(nodes.select("node", "id"), "node", "left").select("doc_id", F.coalesce("id", "row").alias("id"))
    return rows.join(rows.groupBy("doc_id").agg(F.min("id").alias("b")), "doc_id").where("id <> b").select(F.col("id").alias("a"), "b")


def near_dedup(docs: DataFrame, size: int = 3, percent: int = 85, bands: int = 32, rows: int = 5, block: int = 1024) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    sig = shared_checkpoint(signatures(docs, size, bands, rows))
    named = sig.where("doc_id is not null")
    nodes = shared_checkpoint(named.where("n_shingles > 0").groupBy("node").agg(F.min("row").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")))
    banded = nodes.select("id", "n_shingles", F.posexplode("bands").alias("band", "key"))
    hubs = banded.groupBy("band", "key").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = shared_checkpoint(banded.join(hubs, ["band", "key"]))
    pairs = shared.where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    wanted = nodes.select("node", "id").join(shared.select("id").distinct(), "id", "left_semi")
    sets = shared_checkpoint(set_table(docs, size).groupBy("node").agg(F.first("shingles").alias("shingles")).join(wanted, "node").select("id", "shingles"))
    links = verified(pairs, sets, percent)
    shared_ids = links_by_doc_id(named, nodes)
    labels = components(links if shared_ids is None else links.unionByName(shared_ids))
    in_groups = shared.where("n > 2").join(labels.withColumnRenamed("node", "id"), "id", "left").select("band", "key", "id", "n_shingles", F.coalesce("label", "id").alias("label"))
    more = shared_checkpoint(links_between_groups(in_groups, sets, percent, block))
    # rows back to groups
    out = named.select("row", "doc_id", "n_shingles", "node").join(nodes.select("node", "id"), "node", "left").select("doc_id", "n_shingles", F.coalesce("id", "row").alias("node"))
    out = out.join(labels, "node", "left").select("doc_id", "n_shingles", F.coalesce("label", "node").alias("label"))
    if not more.isEmpty():
        joined = components(more).select(F.col("node").alias("label"), F.col("label").alias("top"))
        out = out.join(joined, "label", "left").select("doc_id", "n_shingles", F.coalesce("top", "label").alias("label"))
    out = out.join(out.groupBy("label").agg(F.min("doc_id").alias("component_id")), "label")
    out = out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    return out.unionByName(sig.where("doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")))
