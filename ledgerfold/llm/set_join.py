"""N-gram Jaccard join by set relations: prefix lists skipped in blocks by position, answers derived from those of similar sets.

A document is the set of its distinct shingles of ``size`` words (64-bit hashes). Two sets of n and m elements with 100 * |intersection| >= percent * |union| share at least
o = ceil(percent * (n + m) / (100 + percent)) elements, so in any one order of all shingles they share one of the first n - ceil(n * percent / 100) + 1 of each: the prefix. Every prefix element has an index
list of (set size, position, set) entries, and only sets that meet in a list are compared.

Order. Shingles stand in the order of their hashes, but those that several sets have are put off by up to ``SHIFT`` of the range of hashes, the more the more sets have them. Which elements can be in a prefix
under any such order is known before the counts are (hash at most ``SHIFT`` above that of the plain prefix), so only these are kept (low) and counted, over all distinct sets. A set whose prefix holds no shared element is done.

Index-level skipping. A list is sorted by size and, within a size, by position: blocks in which, once an entry stands too far back for o elements to be left, all later ones do. Blocks too small for the probing set
and entries beyond that position are passed over, as are pairs whose elements that no other set has, or whose sketches (parity bits of the sets), differ by more than the two may. A short list gives all pairs that are left. A long one is read as a stream, in which each entry is paired with the last one that could still reach it; lists of frequent elements are
dealt to parts by element and set, so the parts differ from list to list.

Answer-level skipping. What joins two groups is then looked for in long lists that still hold several groups: of the pairs that the blocks leave, a list gives as many as connect its groups. Where all of these are links, the others follow from them; lists where one is none
give all that are left between different groups. In lists of more than ``MANY`` sets blocks of members are compared through an index of their whole sets. The overlaps of the first set of a group with all others are
counted from the index; those of the next, similar set are derived from them by the lists of the few elements that only one of both has. Members of one group are not compared.

Groups are the components of the links. A link between two sets of one group adds nothing to the result and is skipped; no link that joins two groups is.

Defined results: a document without words (or text) has an empty set and is alone; one with fewer words than a shingle has its whole sequence as the one element; rows that share a doc_id are linked;
a null doc_id is alone, with a null component_id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near_dedup import Forest, components, digests, links_by_doc_id, meets
from .textops import Texts, binaries, bounded_batches, chunks, map_arrow, mix, release, shared_checkpoint

SHIFT = 1 << 60  # an eighth of the range of places
#: From so many sets on, an element counts as frequent, and its list is dealt to so many parts.
OFTEN, PARTS = 64, 16
#: Lists of so many sets are compared pair by pair; of so many, once most groups are known, in blocks of so many sets and bytes of sketches.
FEW, MANY, BLOCK_BYTES = 8, 16384, 32 << 20
BITMAP_PARTS = 2048
#: Elements of lists are hashes of 48 bits.
CUT = 16
_U = np.uint64


def shingle_sets(t: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of all documents of a chunk on end, ascending, and where each document's begin."""
    n = t.offs.size - 1
    words = np.diff(t.bounds)
    hashes, owners = [], []
    for width in range(1, size + 1):
        h, whole = t.windows(width)
        at = np.flatnonzero(whole)
        owner = t.owner[at]
        if width < size:
            fits = words[owner] == width
            at, owner = at[fits], owner[fits]
        hashes.append(h[at])
        owners.append(owner)
    h, owner = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(h.size, dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.searchsorted(owner[new], np.arange(n + 1))


def numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A binary column of packed hashes as one array, and where each row's begin."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offs = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return np.frombuffer(whole[offs[0] : offs[-1]].tobytes(), dtype="<u8"), (offs - offs[0]) // 8


def packed_low(h: np.ndarray, offs: np.ndarray) -> pa.Array:
    """Hashes without their CUT lowest bits, six bytes each. Elements that fall together are one element to the lists, where sets of both meet; all that is decided there is which sets are compared."""
    return binaries(np.ascontiguousarray((h >> _U(CUT)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).reshape(-1), 6 * offs)


def lows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of packed_low, with zeros for the bits that were cut, as one array, and where each row's begin."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offs = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    wide = np.zeros((whole.size // 6, 8), dtype=np.uint8)
    wide[:, :6] = whole.reshape(-1, 6)
    return wide.reshape(-1).view("<u8") << _U(CUT), (offs - offs[0]) // 6


def sketches(h: np.ndarray, offs: np.ndarray) -> pa.Array:
    """A bit vector of each set, of two to four bits an element: a bit is the parity of the elements that fall on it, so two vectors differ in no more bits than their sets in elements."""
    n = np.diff(offs)
    words = (1 << np.ceil(np.log2(np.maximum((n + 31) // 32, 1))).astype(np.int64)).astype(np.int64)
    start = np.concatenate([[0], np.cumsum(words)])
    bit = np.repeat(64 * start[:-1], n) + (h & np.repeat(64 * words - 1, n).astype(_U)).astype(np.int64)
    odd = (np.bincount(bit, minlength=64 * start[-1]) & 1).astype(np.uint8)
    return binaries(np.packbits(odd, bitorder="little"), 8 * start)


def spare(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """By how many elements linked sets of n and m elements may differ."""
    return n + m - 2 * -(-percent * (n + m) // (100 + percent))


def apart(words: np.ndarray, offs: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """By how many elements the sets x[k] and y[k] differ at least, from their sketches (on end in words). The longer one is folded: halves laid upon each other are the sketch of half the length."""
    width = np.diff(offs)
    least = np.minimum(width[x], width[y])
    out = np.zeros(x.size, dtype=np.int64)
    for w in np.unique(least).tolist():
        pairs = np.flatnonzero(least == w)
        row = np.full(width.size, -1)
        used = np.unique(np.concatenate([x[pairs], y[pairs]]))
        row[used] = np.arange(used.size)
        table = np.empty((used.size, w), dtype=_U)
        for of in np.unique(width[used]).tolist():
            those = used[width[used] == of]
            table[row[those]] = np.bitwise_xor.reduce(words[offs[those][:, None] + np.arange(of)].reshape(those.size, of // w, w), axis=1)
        step = max(1, (1 << 18) // w)
        for lo in range(0, pairs.size, step):
            k = pairs[lo : lo + step]
            out[k] = np.bitwise_count(table[row[x[k]]] ^ table[row[y[k]]]).sum(axis=1)
    return out


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    return n + n * -percent // 100 + 1


def heads(docs: DataFrame, size: int, percent: int, with_low: bool) -> DataFrame:
    """doc_id, n_shingles, node (a digest of the set) and, if asked for, low (the shingles, ascending, that can be in the prefix) and a sketch; both null for all but one of the equal sets of a chunk."""
    bounded_batches(docs.sparkSession)

    def run(batch: pa.RecordBatch):
        for raw in chunks(batch.column("text")):
            t = raw.lower()
            h, offs = shingle_sets(t, size)
            n = np.diff(offs)
            node, ids = digests(h, offs), batch.column("doc_id")[t.rows]
            out = {"doc_id": ids, "n_shingles": n.astype(np.int64), "node": node}
            if with_low:
                filled = np.flatnonzero(n)
                limit = np.zeros(n.size, dtype=_U)
                limit[filled] = ((h[offs[filled] + prefix_size(n[filled], percent) - 1] | _U((1 << CUT) - 1)) >> _U(1)) + _U(SHIFT)  # whatever the bits that are cut
                low = (h >> _U(1)) <= np.repeat(limit, n)
                seen: set = set()
                again = np.array([i is None or x is None or x in seen or seen.add(x) is not None for i, x in zip(ids.to_pylist(), node.to_pylist())], dtype=bool)
                low &= ~np.repeat(again, n)
                packed = packed_low(h[low], np.concatenate([[0], np.cumsum(low)])[offs])
                out["low"] = pc.if_else(pa.array(again), pa.scalar(None, pa.binary()), packed)
                out["sketch"] = pc.if_else(pa.array(again), pa.scalar(None, pa.binary()), sketches(h, offs))
            yield out

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_shingles long, node binary" + ", low binary, sketch binary" * with_low)


def shared_elements(nodes: DataFrame) -> DataFrame:
    """id, element and often of the elements of low that several sets have in low: often is how many, OFTEN at most. Elements come as sorted streams."""

    def run_rows(batch: pa.RecordBatch):
        low, offs = lows(batch.column("low"))
        yield {"element": low.view(np.int64), "id": np.repeat(batch.column("id").to_numpy(), np.diff(offs))}

    rows = map_arrow(nodes.select("id", "low"), run_rows, "element long, id long").repartition("element").sortWithinPartitions("element")

    def run(batches):
        held_x, held = np.zeros(0, np.int64), np.zeros(0, np.int64)  # the last element's sets, as long as they are fewer than OFTEN
        full = None  # an element that has reached OFTEN
        for batch in batches:
            x, ids = np.concatenate([held_x, batch.column(0).to_numpy()]), np.concatenate([held, batch.column(1).to_numpy()])
            start = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
            count = np.diff(np.append(start, x.size))
            if full is not None and x[0] == full:
                count[0] += OFTEN  # with those that have gone before
            keep = x.size
            full = x[-1] if count[-1] >= OFTEN else None
            if full is None:
                keep = start[-1]
            often = np.repeat(np.minimum(count, OFTEN), np.diff(np.append(start, x.size)))[:keep]
            many = np.flatnonzero(often > 1)
            yield pa.RecordBatch.from_pydict({"id": ids[:keep][many], "element": x[:keep][many], "often": often[many].astype(np.int32)})
            held_x, held = x[keep:].copy(), ids[keep:].copy()
        if held.size > 1:
            yield pa.RecordBatch.from_pydict({"id": held, "element": held_x, "often": np.full(held.size, held.size, dtype=np.int32)})

    return rows.mapInArrow(run, "id long, element long, often int")


def postings(nodes: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """element, part (0 if the list is whole), id, n, position and alone of those elements of each set's prefix that other sets have. alone: how many elements below SHIFT no other set has; every
    set has all of its own in low. A set with more of them than it can do without in a link is left out."""
    # rows are dealt before they are gathered: a set's elements come from all tasks, so lists of them would be of one or two
    own = shared.repartition("id").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("element", "often"))).alias("s"))  # no more than the set's own elements
    rows = own.join(nodes.select("id", "n_shingles", "low"), "id").select("id", "n_shingles", "low", F.col("s.element").alias("element"), F.col("s.often").alias("often"))

    def run(batch: pa.RecordBatch):
        low, offs = lows(batch.column("low"))
        n, ids = batch.column("n_shingles").to_numpy(), batch.column("id").to_numpy()
        owner = np.repeat(np.arange(n.size), np.diff(offs))
        rank, often = low >> _U(1), np.ones(low.size, dtype=np.int64)
        element = batch.column("element")
        ends = np.concatenate([[0], np.cumsum([len(x) for x in element])])
        mine, count = element.flatten().to_numpy().view(_U), batch.column("often").flatten().to_numpy()
        for k in range(n.size):
            there, of = mine[ends[k] : ends[k + 1]], low[offs[k] : offs[k + 1]]
            at = np.minimum(np.searchsorted(there.view(np.int64), of.view(np.int64)), there.size - 1)  # several elements of a set may have fallen together
            often[offs[k] : offs[k + 1]] = np.where(there[at] == of, count[ends[k] + at], 1)
        # shared elements are put off by most of SHIFT, frequent ones by all of it
        rank += np.where(often > 1, (0.8 + 0.2 * np.log2(often) / np.log2(OFTEN)) * SHIFT, 0).astype(_U)
        alone = np.bincount(owner[((low >> _U(1)) <= _U(SHIFT)) & (often == 1)], minlength=n.size)
        order = np.lexsort((low, rank, owner))
        low, often = low[order], often[order]
        position = np.arange(low.size) - offs[owner]
        first = (position < prefix_size(n, percent)[owner]) & (often > 1) & (alone < prefix_size(n, percent))[owner]
        low, often, owner, position = low[first], often[first], owner[first], position[first]
        salt = np.where(often < OFTEN, 0, (mix(low ^ ids[owner].astype(_U)) >> _U(1)).astype(np.int64) % PARTS + 1)
        yield {"element": low.view(np.int64), "part": salt.astype(np.int32), "id": ids[owner], "n": n[owner].astype(np.int32), "position": position.astype(np.int32), "alone": alone[owner].astype(np.int32)}

    return map_arrow(rows, run, "element long, part int, id long, n int, position int, alone int")


def shared_lists(entries: DataFrame, percent: int) -> DataFrame:
    """element, id, n, position, alone and mate. Of a list of up to FEW sets: all pairs (id, mate) that size and position leave possible, with a null element. Of others: every entry, with an earlier entry that it may link with as mate, or null.

    Lists come as sorted streams. The entry that later ones of a long list are paired with is replaced once it is too small, or stands too far back, for the next."""
    rows = entries.repartition("element", "part").sortWithinPartitions("element", "part", "n", "position", "id")

    def pair(x, y):
        """Whether x can still reach a set of y's size, and whether both can be linked through this list."""
        need = -(-percent * (x[3] + y[3]) // (100 + percent))
        fits = 100 * x[3] >= percent * y[3] and x[3] - x[4] >= need
        return fits, fits and y[3] - y[4] >= need and x[5] + y[5] <= x[3] + y[3] - 2 * need

    def run(batches):
        few, hub, out = [], None, []  # the entries of a list that is short so far; of a long one the entry to be paired with

        def long_list(e):
            nonlocal hub
            fits, both = pair(hub, e) if hub is not None else (False, False)
            out.append((*e[:1], *e[2:], hub[2] if both else None))
            if not fits:
                hub = e

        def short_list():
            for y, e in enumerate(few):
                out.extend((None, *e[2:], x[2]) for x in few[:y] if pair(x, e)[1])

        last = None
        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in ("element", "part", "id", "n", "position", "alone")]
            same = (cols[0][1:] == cols[0][:-1]) & (cols[1][1:] == cols[1][:-1])
            inner = np.concatenate([[False], same]) | np.concatenate([same, [False]]) | (cols[1] > 0)
            inner[[0, -1]] = True  # their list may go on in another batch
            for e in zip(*(c[inner].tolist() for c in cols)):
                if last != e[:2]:
                    short_list()
                    few, hub, last = [], None, e[:2]
                if hub is None and not e[1] and len(few) < FEW:
                    few.append(e)
                else:
                    for x in few:
                        long_list(x)
                    few = []
                    long_list(e)
            del batch, cols
            yield listed(out)
            out.clear()
            release()
        short_list()
        yield listed(out)

    def listed(out):
        columns = zip(*out) if out else [()] * 6
        return pa.RecordBatch.from_pydict({c: pa.array(x, pa.int64()) for c, x in zip(("element", "id", "n", "position", "alone", "mate"), columns)})

    return rows.mapInArrow(run, "element long, id long, n long, position long, alone long, mate long")


def near_pairs(element, ids, n, position, alone, label, words, offs, percent: int, take: str, side: np.ndarray | None = None):
    """element, id, n, label and mate of the pairs (id, mate) of different labels that a sorted list's sizes, positions and sketches leave possible; with side, of those that have one set on each. take: all, forest (only as many as connect
    their labels, nearest ones first) or ends (each set that is in a pair once, with a null mate)."""
    found, waiting, left, group, marked = [], [[], [], 0], n - position, label.copy(), np.zeros(n.size, dtype=bool)

    def compare():
        x, y = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in waiting[:2])
        over = apart(words, offs, x, y) - spare(n[x], n[y], percent)
        near = np.flatnonzero(over <= 0)
        if take == "forest":
            near, joins = near[np.argsort(over[near], kind="stable")], []
            for k, i, j in zip(near.tolist(), x[near].tolist(), y[near].tolist()):
                if group[i] != group[j]:
                    group[group == group[i]] = group[j]
                    joins.append(k)
            near = joins
        marked[x[near]] = marked[y[near]] = True
        if take != "ends":
            found.append((y[near], x[near]))
        waiting[:] = [], [], 0

    for y in range(1, n.size):
        x = np.arange(np.searchsorted(n[:y], -(-percent * n[y] // 100)), y)
        need = -(-percent * (n[x] + n[y]) // (100 + percent))
        x = x[(left[x] >= need) & (left[y] >= need) & (alone[x] + alone[y] <= n[x] + n[y] - 2 * need) & (group[x] != group[y])]
        if side is not None:
            x = x[side[x] != side[y]]
        if x.size:
            waiting[0].append(x)
            waiting[1].append(np.full(x.size, y))
            waiting[2] += x.size
        if waiting[2] > 50_000:
            compare()
    compare()
    if take == "ends":
        y = np.flatnonzero(marked)
        return np.full(y.size, element), ids[y], n[y], label[y], [None] * y.size
    y, x = (np.concatenate(c) for c in zip(*found))
    return np.full(y.size, element), ids[y], n[y], label[y], ids[x]


def listed_pairs(out: list) -> dict:
    return {c: pa.chunked_array([pa.array(o[k], pa.int64()) for o in out], pa.int64()).combine_chunks() for k, c in enumerate(("element", "id", "n", "label", "mate"))}


def between_groups(members: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Of long lists (element, id, n, position, alone, label, sketch), element, id, n, label and mate: of those of up to MANY sets the pairs (id, mate) of different labels that size, position and sketches leave possible; of
    others, an entry now and then, with a null mate. forest: of these pairs only as many as connect their labels, nearest ones first, so fewer than the list has entries; if all of them are links, so is what the others would join.

    In a sorted list the sizes that fit are one range, and of these only the entries that stand far enough in front count."""
    many, take = MANY, "forest" if forest else "all"
    rows = members.repartition("element").sortWithinPartitions("element", "n", "position", "id")

    def run(batches):
        held, passing = None, None  # the last list as long as it is short; an element whose list is longer
        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in ("element", "id", "n", "position", "alone", "label")]
            words, offs = numbers(batch.column("sketch"))
            if held is not None:
                words, offs = np.concatenate([held[6], words]), np.concatenate([held[7], held[7][-1] + offs[1:]])
                cols = [np.concatenate(c) for c in zip(held[:6], cols)]
            edge = np.append(np.flatnonzero(np.concatenate([[True], cols[0][1:] != cols[0][:-1]])), cols[0].size)
            out = []
            held = None
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
                element, ids, n, position, alone, label = (c[lo:hi] for c in cols)
                mine = words[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                if hi - lo > many or element[0] == passing:
                    passing = element[0]
                    out.append((element[:1], ids[:1], n[:1], label[:1], [None]))
                elif hi == edge[-1]:
                    held = [*(c[lo:hi].copy() for c in cols), mine[0].copy(), mine[1]]
                elif hi - lo > 1:
                    out.append(near_pairs(element[0], ids, n, position, alone, label, *mine, percent, take))
            yield listed(out)
            release()
        if held is not None:
            yield listed([near_pairs(held[0][0], *held[1:], percent, take)])

    def listed(out):
        return pa.RecordBatch.from_pydict(listed_pairs(out))

    return rows.mapInArrow(run, "element long, id long, n long, label long, mate long")


def in_blocks(lists: DataFrame, percent: int, take: str) -> DataFrame:
    """near_pairs of lists of any length (element, id, n, position, alone, label, sketch). A list is cut by size, so that linked sets are of one range or of neighbouring ones, and a range into blocks; each two blocks are one group.
    Blocks hold sketches and not sets, which are twenty times as large, and as many rows as memory has room for: what is shuffled is a list times its blocks of three ranges."""
    ratio = math.log(1.0001 * max(100 / percent, 1.05))
    sized = lists.withColumn("size", F.floor(F.log(F.col("n").cast("double")) / ratio))
    count = sized.groupBy("element", "size").agg(F.greatest(F.ceil(F.count(F.lit(1)) / MANY), F.ceil(F.sum(F.length("sketch")) / BLOCK_BYTES)).cast("int").alias("blocks"))
    beside = lambda step, name: count.select("element", (F.col("size") - step).alias("size"), F.col("blocks").alias(name))
    around = count.join(beside(1, "above"), ["element", "size"], "left").join(beside(-1, "below"), ["element", "size"], "left")
    cut = sized.join(around, ["element", "size"]).withColumn("k", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    meet = F.expr("""concat(transform(sequence(0, blocks - 1), o -> struct(size as range, 0 as up, least(k, o) as i, greatest(k, o) as j, if(k <= o, 0, 1) as side)),
        if(above is null, array(), transform(sequence(0, above - 1), o -> struct(size as range, 1 as up, k as i, o as j, 0 as side))),
        if(below is null, array(), transform(sequence(0, below - 1), o -> struct(size - 1 as range, 1 as up, o as i, k as j, 1 as side))))""")
    wide = cut.withColumn("m", F.explode(meet)).select("element", "m.*", "id", "n", "position", "alone", "label", "sketch")

    def compare(table):
        table = table.sort_by([("n", "ascending"), ("position", "ascending"), ("id", "ascending")])
        ids, n, position, alone, label, side = (table.column(c).to_numpy() for c in ("id", "n", "position", "alone", "label", "side"))
        out = []
        if (label != label[0]).any():
            whole = table.column("up")[0].as_py() == 0 and table.column("i")[0].as_py() == table.column("j")[0].as_py()
            out.append(near_pairs(table.column("element")[0].as_py(), ids, n, position, alone, label, *numbers(table.column("sketch")), percent, take, None if whole else side))
            release()
        return pa.table(listed_pairs(out))

    return wide.groupBy("element", "range", "up", "i", "j").applyInArrow(compare, "element long, id long, n long, label long, mate long")


def set_table(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """id, shingles (packed, ascending) and n_first (how many are in the first quarter of the range) of the wanted sets (doc_id of a row that has it, node, id).

    A bitmap of BITMAP_PARTS * 4 KB at most says which documents may be wanted, so only their sets are built and shuffled; the join decides."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(BITMAP_PARTS << 15))
    marks = wanted.select(F.bitmap_bucket_number(bit).alias("p"), F.bitmap_bit_position(bit).alias("x")).groupBy("p").agg(F.bitmap_construct_agg("x").alias("m"))
    bitmap = np.zeros((BITMAP_PARTS + 1, 4096), dtype=np.uint8)
    for p, m in marks.collect():  # BITMAP_PARTS rows at most
        bitmap[p] = np.frombuffer(m, np.uint8)
    if not bitmap.any():
        return docs.sparkSession.createDataFrame([], "id long, shingles binary, n_first long")

    def run(batch: pa.RecordBatch):
        p, x = batch.column("p").to_numpy(), batch.column("x").to_numpy()
        maybe = np.flatnonzero(bitmap[p, x // 8] >> (x % 8).astype(np.uint8) & 1)
        for raw in chunks(batch.column("text").take(pa.array(maybe))):
            h, offs = shingle_sets(raw.lower(), size)
            node = digests(h, offs)
            first = {x: k for k, x in enumerate(node.to_pylist()) if x is not None}
            yield {"node": pa.array(list(first), pa.binary()), "shingles": pa.array([h[offs[k] : offs[k + 1]].tobytes() for k in first.values()], pa.binary()), "n_first": pa.array([int(np.searchsorted(h[offs[k] : offs[k + 1]], _U(1 << 62))) for k in first.values()], pa.int64())}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null").select(F.bitmap_bucket_number(bit).alias("p"), F.bitmap_bit_position(bit).alias("x"), "text")
    found = map_arrow(rows, run, "node binary, shingles binary, n_first long").join(wanted.select("node", "id"), "node")
    return found.groupBy("node", "id").agg(F.first("shingles").alias("shingles"), F.first("n_first").alias("n_first")).select("id", "shingles", "n_first")


def possible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches don't differ by more than two linked sets may. Sketches are a twentieth of their sets."""
    small = nodes.select("id", "sketch", F.col("n_shingles").alias("n"))
    both = pairs.join(small.select(F.col("id").alias("a"), F.col("sketch").alias("sa"), F.col("n").alias("na")), "a").join(small.select(F.col("id").alias("b"), F.col("sketch").alias("sb"), F.col("n").alias("nb")), "b")

    def run(batch: pa.RecordBatch):
        a, b, na, nb = (batch.column(c).to_numpy() for c in ("a", "b", "na", "nb"))
        (wa, oa), (wb, ob) = numbers(batch.column("sa")), numbers(batch.column("sb"))
        near = apart(np.concatenate([wa, wb]), np.concatenate([oa, oa[-1] + ob[1:]]), np.arange(a.size), a.size + np.arange(a.size)) <= spare(na, nb, percent)
        yield {"a": a[near], "b": b[near]}

    return map_arrow(both.select("a", "b", "sa", "sb", "na", "nb"), run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Rows of (a, b) whose sets meet the threshold; of those that a task has linked already, none."""
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b").select("a", "b", "sa", "sb")

    def run(batches):
        forest = Forest()
        for batch in batches:
            a, b = (batch.column(c).to_pylist() for c in "ab")
            sa, sb, ok = batch.column("sa"), batch.column("sb"), []
            for k, (x, y) in enumerate(zip(a, b)):
                if forest.root(x) != forest.root(y) and meets(np.frombuffer(sa[k].as_py(), "<u8"), np.frombuffer(sb[k].as_py(), "<u8"), percent):
                    forest.join(x, y)
                    ok.append(k)
            yield pa.RecordBatch.from_pydict({"a": pa.array([a[k] for k in ok], pa.int64()), "b": pa.array([b[k] for k in ok], pa.int64())})
            del batch, sa, sb
            release()

    return both.mapInArrow(run, "a long, b long")


class Overlaps:
    """The overlaps of one set after another with all sets of a block, from an index of their elements."""

    def __init__(self, items: list[np.ndarray]):
        self.size = np.array([x.size for x in items], dtype=np.int64)
        every = np.concatenate(items)
        who = np.repeat(np.arange(len(items)), self.size)
        order = np.argsort(every, kind="stable")
        every, self.who = every[order], who[order]
        place = np.empty(order.size, dtype=np.int64)
        place[order] = np.arange(order.size)
        lo, hi = np.searchsorted(every, every, "left"), np.searchsorted(every, every, "right")
        ends = np.cumsum(self.size)
        #: the lists of each set's elements, by where they begin in the index: equal elements have equal lists
        self.lists = [lo[place[e - n : e]] for e, n in zip(ends.tolist(), self.size.tolist())]
        self.until = np.zeros(every.size, dtype=np.int64)
        self.until[lo] = hi
        self.of, self.counts = -1, np.zeros(len(items), dtype=np.int64)

    def counted(self, lists: np.ndarray) -> np.ndarray:
        """How many of the lists each set is in."""
        count = self.until[lists] - lists
        near = self.who[np.repeat(lists - np.cumsum(count) + count, count) + np.arange(count.sum())]
        return np.bincount(near, minlength=self.size.size)

    def of_set(self, x: int) -> np.ndarray:
        """The overlaps of set x: those of the set asked for before, corrected by the elements that only one of both has, if these are few."""
        mine = self.lists[x]
        if self.of >= 0:
            before = self.lists[self.of]
            gone, new = np.setdiff1d(before, mine, assume_unique=True), np.setdiff1d(mine, before, assume_unique=True)
            if 2 * (gone.size + new.size) < mine.size:
                self.counts = self.counts - self.counted(gone) + self.counted(new)
                self.of = x
                return self.counts
        self.of, self.counts = x, self.counted(mine)
        return self.counts


def links_in_lists(lists: DataFrame, sets: DataFrame, percent: int, block: int, elements: int = 200_000) -> DataFrame:
    """Links (a, b) between labels of members of one list. lists: band, key, id, n_shingles, label.

    Members are cut into blocks of about block sets and elements shingles; each pair of blocks is one group, which gives one link for each pair of labels that it can join."""
    size = lists.groupBy("band", "key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n_shingles") / elements)).cast("int").alias("blocks"))
    cut = lists.join(size, ["band", "key"]).withColumn("k", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    meet = F.expr("transform(sequence(0, blocks - 1), o -> struct(least(k, o) as i, greatest(k, o) as j))")
    wide = cut.withColumn("m", F.explode(meet)).select("band", "key", "m.i", "m.j", "k", "id", "label")

    def compare(table):
        table = table.sort_by([("label", "ascending"), ("id", "ascending")])
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        label, k = table.column("label").to_numpy(), table.column("k").to_numpy()
        group = label.copy()
        a_out, b_out = [], []
        if (group != group[0]).any():
            items = [np.frombuffer(x, "<u8") for x in table.column("shingles").to_pylist()]
            overlaps = Overlaps(items)
            size = overlaps.size
            for x in range(size.size):
                other = group != group[x]
                if i != j:
                    other &= k != k[x]
                if not other.any():
                    continue
                common = overlaps.of_set(x)
                for y in np.flatnonzero(other & (100 * common >= percent * (size[x] + size - common))):
                    if group[y] != group[x]:
                        a_out.append(label[x])
                        b_out.append(label[y])
                        group[group == group[y]] = group[x]
            if sum(x.size for x in items) > 100_000:
                release()
        return pa.table({"a": pa.array(a_out, pa.int64()), "b": pa.array(b_out, pa.int64())})

    return wide.join(sets.select("id", "shingles"), "id").groupBy("band", "key", "i", "j").applyInArrow(compare, "a long, b long")


def join_groups(docs: DataFrame, size: int = 3, percent: int = 90, block: int = 1024) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of documents (doc_id, text): component_id is the smallest doc_id reachable by links."""
    every = shared_checkpoint(heads(docs, size, percent, False).withColumn("row", F.monotonically_increasing_id()))
    named = every.where("doc_id is not null")
    filled = lambda rows: rows.where("doc_id is not null and n_shingles > 0").groupBy("node")
    firsts = filled(every).agg(F.min("row").alias("id"), F.min_by("doc_id", "row").alias("doc_id"), F.first("n_shingles").alias("n_shingles"))
    lows = filled(heads(docs, size, percent, True)).agg(F.first("low", ignorenulls=True).alias("low"), F.first("sketch", ignorenulls=True).alias("sketch"))
    nodes = shared_checkpoint(firsts.join(lows, "node"))
    lists = shared_checkpoint(shared_lists(postings(nodes, shared_elements(nodes), percent), percent))
    whole = lambda ids: nodes.select("doc_id", "node", "id").join(ids.distinct(), "id", "left_semi")
    ends = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("id"))
    mates = lambda rows: rows.where("mate is not null").select(F.least("id", "mate").alias("a"), F.greatest("id", "mate").alias("b")).distinct()
    sketched = lambda members: members.join(nodes.select("id", "sketch"), "id")
    named_by = lambda rows, labels, c: rows.join(labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")), c, "left").withColumn(f"l{c}", F.coalesce(f"l{c}", c))
    entries = lists.where("element is not null").select("element", "id", "n", "position", "alone")
    rest = shared_checkpoint(between_groups(sketched(entries.withColumn("label", F.col("id"))), percent, True))
    tried = shared_checkpoint(possible(mates(lists.where("element is null")), nodes, percent).union(mates(rest)).distinct())
    sets = shared_checkpoint(set_table(docs, whole(ends(tried)), size))
    links = verified(tried, sets, percent)
    shared_ids = links_by_doc_id(named, nodes)
    labels = components(links if shared_ids is None else links.unionByName(shared_ids))
    # only lists where a pair was no link may hold others that are
    failed = named_by(named_by(rest.where("mate is not null").selectExpr("element", "id as a", "mate as b"), labels, "a"), labels, "b").where("la <> lb").select("element").distinct()
    members = entries.join(failed, "element", "left_semi").join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    pairs = mates(between_groups(sketched(members), percent, False))
    long = rest.where("mate is null").select("element").distinct()
    there = not long.isEmpty()
    if there:
        longest = entries.join(long, "element", "left_semi").join(labels.select(F.col("node").alias("id"), "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
        several = longest.groupBy("element").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l < h").select("element")
        longest = longest.join(several, "element", "left_semi")
        joining = shared_checkpoint(in_blocks(sketched(longest), percent, "forest"))
        pairs = pairs.union(mates(joining)).distinct()
    pairs = shared_checkpoint(pairs.join(tried, ["a", "b"], "left_anti"))

    def with_sets(needed):
        """The sets of needed (id), of which those built before are kept."""
        new = shared_checkpoint(set_table(docs, whole(needed.join(sets.select("id"), "id", "left_anti")), size))
        return sets.unionByName(new).join(needed.distinct(), "id", "left_semi")

    top = lambda rows: named_by(named_by(rows, labels, "a"), labels, "b").selectExpr("la as a", "lb as b").where("a <> b")
    more = shared_checkpoint(top(verified(pairs, with_sets(ends(pairs)), percent)))
    if there:
        # the long lists where a pair was no link: what is left there is compared by whole sets
        tops = components(more).select(F.col("node").alias("label"), F.col("label").alias("top"))
        above = lambda rows: rows.join(tops, "label", "left").withColumn("label", F.coalesce("top", "label")).drop("top")
        of = lambda c: above(named_by(joining.selectExpr("element", "id as a", "mate as b"), labels, c).withColumnRenamed(f"l{c}", "label"))
        no_link = of("a").withColumnRenamed("label", "la").join(of("b").withColumnRenamed("label", "lb"), ["element", "a", "b"]).where("la <> lb").select("element").distinct()
        left = shared_checkpoint(in_blocks(sketched(above(longest.join(no_link, "element", "left_semi"))), percent, "ends").drop("mate").distinct())
        if not left.isEmpty():
            last = left.select(F.lit(0).alias("band"), F.col("element").alias("key"), "id", F.col("n").alias("n_shingles"), "label")
            more = more.unionByName(shared_checkpoint(links_in_lists(last, with_sets(last.select("id")), percent, block).where("a <> b")))
    out = named.select("row", "doc_id", "n_shingles", "node").join(nodes.select("node", "id"), "node", "left").select("doc_id", "n_shingles", F.coalesce("id", "row").alias("node"))
    out = out.join(labels, "node", "left").select("doc_id", "n_shingles", F.coalesce("label", "node").alias("label"))
    if not more.isEmpty():
        joined = components(more).select(F.col("node").alias("label"), F.col("label").alias("top"))
        out = out.join(joined, "label", "left").select("doc_id", "n_shingles", F.coalesce("top", "label").alias("label"))
    out = out.join(out.groupBy("label").agg(F.min("doc_id").alias("component_id")), "label").select("doc_id", "n_shingles", "component_id")
    return out.unionByName(every.where("doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
