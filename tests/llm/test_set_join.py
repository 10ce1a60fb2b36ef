"""The n-gram Jaccard join against brute force, with lists and blocks of all sizes. The registered query is held against SQL in tests/test_queries.py."""

import re

import numpy as np
import pytest
from ledgerfold.llm import set_join
from pyspark.sql import functions as F


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + size]) for i in range(max(len(words) - size + 1, 1))} if words else set()


def groups_brute(rows, size, percent):
    """(doc_id, n_shingles, component_id) of all rows."""
    sets = [shingles(t, size) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if rows[x][0] is not None and rows[y][0] is not None and (rows[x][0] == rows[y][0] or (both and 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both))):
                up[max(root(x), root(y))] = min(root(x), root(y))
    least = {}
    for x, (i, _) in enumerate(rows):
        least[root(x)] = min(least.get(root(x), i), i) if i is not None else None
    return sorted(((i, len(s), least[root(x)]) for x, ((i, _), s) in enumerate(zip(rows, sets))), key=repr)


def corpus(seed, n, edits):
    """Copies of copies with some words changed, over a small stock of phrases."""
    rng = np.random.default_rng(seed)
    stock = [" ".join(f"w{k}" for k in rng.integers(0, 40, rng.integers(3, 12))) for _ in range(30)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.7:
            words = texts[rng.integers(0, len(texts))].split(" ")
            for _ in range(rng.integers(0, edits + 1)):
                words[rng.integers(0, len(words))] = f"W{rng.integers(0, 60)}"
            texts.append(" ".join(words))
        else:
            texts.append(" ".join(stock[k] for k in rng.integers(0, 30, rng.integers(1, 14))))
    return list(enumerate(texts))


def grouped(spark, rows, size, percent, block):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, component_id string, n int").repartition(3)
    return sorted((tuple(r) for r in set_join.join_groups(df, size, percent, block).collect()), key=repr)


@pytest.mark.parametrize("seed, size, percent, block", [(0, 3, 90, 1024), (1, 3, 90, 2), (2, 1, 70, 3), (3, 2, 50, 1024)])
def test_groups_equal_brute_force(spark, seed, size, percent, block):
    rows = corpus(seed, 260, 3)
    assert grouped(spark, rows, size, percent, block) == groups_brute(rows, size, percent)


@pytest.mark.parametrize("many", [4096, 20])
def test_long_lists(spark, monkeypatch, many):
    """One phrase that all documents share, in more copies than OFTEN, and in lists that are cut into blocks."""
    monkeypatch.setattr(set_join, "MANY", many)
    common = " ".join(f"c{i}" for i in range(25))
    rows = [(i, f"{common} {' '.join(f't{i % 9}' for _ in range(i % 4))} e{i % 40}") for i in range(300)]
    assert grouped(spark, rows, 3, 90, 64) == groups_brute(rows, 3, 90)


def test_edges(spark):
    long = " ".join(f"v{i}" for i in range(4000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one"), (6, "one two"), (7, "ONE  two"), (None, "one two"), (None, "one two"), (8, "a b c"), (9, long), (10, long + " end"), (11, "end " + long), (12, long), (13, "x y z t"), (13, "k l m n"), (14, "K l m n"), (15, "É b c"), (16, "é b c")]
    got = grouped(spark, rows, 3, 90, 1024)
    assert got == groups_brute(rows, 3, 90)
    first = spark.createDataFrame([(None, "one two three four"), (1, "one two three four"), (2, "one two three four")], "doc_id long, text string").coalesce(1)
    assert sorted((r.doc_id or 0, r.component_id) for r in set_join.join_groups(first).collect()) == [(0, None), (1, 1), (2, 1)]
    assert set_join.join_groups(first.limit(0)).collect() == []


def test_overlaps_are_derived():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 500, 120)
    items = []
    for _ in range(60):
        x = base.copy()
        x[rng.integers(0, 120, rng.integers(0, 30))] = rng.integers(0, 900)
        items.append(np.unique(x).astype(np.uint64))
    items.append(np.array([10**6], dtype=np.uint64))
    index = set_join.Overlaps(items)
    for x in rng.permutation(len(items)).tolist():
        assert index.of_set(x).tolist() == [np.intersect1d(items[x], y).size for y in items]


def test_positions_are_skipped(spark):
    """An entry so far back that too few elements are left has no mate."""
    rows = [(1, 0, 1, 10, 0), (1, 0, 2, 10, 5), (1, 0, 3, 20, 0), (2, 0, 4, 10, 0), (2, 0, 5, 10, 0), (3, 0, 6, 10, 0), (4, 1, 7, 10, 0), *((5, 0, 10 + i, 100 + i, 0) for i in range(20)), (6, 0, 8, 100, 0), (6, 0, 9, 100, 0)]
    df = spark.createDataFrame([(*r, 6 * (r[0] == 6)) for r in rows], "element long, part int, id long, n int, position int, alone int")
    got = sorted(((r.element or 0, r.id, r.mate or 0) for r in set_join.shared_lists(df, 90).collect()))
    assert got == [(0, 5, 4), (4, 7, 0), (5, 10, 0), *((5, 10 + i, 10) for i in range(1, 12)), (5, 22, 0), *((5, 10 + i, 22) for i in range(13, 20))]
    assert set_join.shared_lists(df.where(F.lit(False)), 90).collect() == []


def test_pairs_of_a_cluster_grow_with_its_members(spark, monkeypatch):
    """Noisy copies of one text, of which many are near one another without a link: pairs that are compared by whole sets don't grow with the square of their number."""
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(240):
        words = list(base)
        for at in rng.choice(150, rng.integers(1, 14), replace=False):
            words[at] = f"n{rng.integers(0, 60)}"
        rows.append((i, " ".join(words)))
    compared, verified = [], set_join.verified

    def counted(pairs, sets, percent):
        compared.append(pairs.count())
        return verified(pairs, sets, percent)

    monkeypatch.setattr(set_join, "verified", counted)
    assert grouped(spark, rows, 3, 90, 1024) == groups_brute(rows, 3, 90)
    assert 0 < sum(compared) <= 3 * len(rows), compared


def test_sketches_bound_differences():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 700).astype(np.uint64)
    items = [np.unique(np.concatenate([rng.choice(base, n, replace=False), rng.integers(0, 1 << 63, k).astype(np.uint64)])) for n, k in zip(rng.integers(1, 700, 80), rng.integers(0, 60, 80))]
    items += [base[:0], base[:1], np.unique(base)]
    offs = np.concatenate([[0], np.cumsum([x.size for x in items])])
    words, at = set_join.numbers(set_join.sketches(np.concatenate(items), offs))
    x, y = (c.reshape(-1) for c in np.meshgrid(np.arange(len(items)), np.arange(len(items))))
    real = np.array([np.setxor1d(items[i], items[j]).size for i, j in zip(x, y)])
    least = set_join.apart(words, at, x, y)
    assert (least <= real).all() and ((least - real) % 2 == 0).all() and (least[x == y] == 0).all()
    size = np.array([i.size for i in items])
    near = (real < size[x] / 10) & (x != y)
    assert (least[near] >= 0.8 * real[near]).all()


def test_long_lists_send_sketches(spark, monkeypatch):
    """Sets are sent to the blocks of a list longer than MANY only where sketches leave a pair without a link."""
    monkeypatch.setattr(set_join, "MANY", 20)
    rng = np.random.default_rng(7)
    common = " ".join(f"c{i}" for i in range(40))
    rows = [(i, f"{common} {' '.join(f't{i % 50}x{j}' for j in range(30 + i % 3))} e{i}") for i in range(400)]
    rows += [(400 + i, " ".join(f"w{k}" for k in rng.integers(0, 30, 12))) for i in range(100)]
    sent, links_in_lists, in_blocks, long = [0], set_join.links_in_lists, set_join.in_blocks, []

    def counted(lists, *args):
        sent.append(lists.count())
        return links_in_lists(lists, *args)

    monkeypatch.setattr(set_join, "links_in_lists", counted)
    monkeypatch.setattr(set_join, "in_blocks", lambda lists, *args: long.append(lists.count()) or in_blocks(lists, *args))
    assert grouped(spark, rows, 3, 90, 1024) == groups_brute(rows, 3, 90)
    assert sum(long) > 20 and sum(sent) <= 20, (long, sent)


@pytest.mark.parametrize("many, bytes_", [(1 << 20, 1 << 30), (7, 1 << 30), (1 << 20, 600)])
def test_blocks_leave_no_pair_out(spark, monkeypatch, many, bytes_):
    rng = np.random.default_rng(2)
    base = np.sort(rng.integers(0, 1 << 63, 130).astype(np.uint64))
    items = [np.unique(np.concatenate([rng.choice(base, k, replace=False), rng.integers(0, 1 << 63, 3).astype(np.uint64)])) for k in rng.integers(40, 130, 120)]
    offs = np.concatenate([[0], np.cumsum([x.size for x in items])])
    sketch = set_join.sketches(np.concatenate(items), offs).to_pylist()
    df = spark.createDataFrame([(9, k, x.size, 0, 0, k % 100, bytearray(sketch[k])) for k, x in enumerate(items)], "element long, id long, n long, position long, alone long, label long, sketch binary").repartition(3)
    monkeypatch.setattr(set_join, "MANY", many)
    monkeypatch.setattr(set_join, "BLOCK_BYTES", bytes_)
    got = {tuple(sorted((r.id, r.mate))) for r in set_join.in_blocks(df, 90, "all").collect()}
    linked = {(x, y) for y in range(120) for x in range(y) if x % 100 != y % 100 and 190 * np.intersect1d(items[x], items[y]).size >= 90 * (items[x].size + items[y].size)}
    assert linked and linked <= got
    assert {r.id for r in set_join.in_blocks(df, 90, "ends").collect()} == {k for p in got for k in p}


def test_lists_hold_six_bytes_an_element(spark):
    """What the lists are made of is shuffled and written four times: hashes are cut, and sets stay the same groups where all of them fall together."""
    docs = spark.createDataFrame([(1, " ".join(f"v{i}" for i in range(2000))), (2, "a b c d")], "doc_id long, text string").coalesce(1)
    rows = {r.doc_id: r for r in set_join.heads(docs, 3, 90, True).collect()}
    h = np.sort(np.random.default_rng(0).integers(0, 1 << 64, 50, dtype=np.uint64))
    offs = np.array([0, 20, 20, 50])
    low, at = set_join.lows(set_join.packed_low(h, offs))
    assert (low == h >> np.uint64(16) << np.uint64(16)).all() and (at == offs).all()
    assert all(len(r.low) % 6 == 0 for r in rows.values()) and len(rows[1].low) < 6 * 0.3 * 1998


def test_elements_that_fall_together(spark, monkeypatch):
    monkeypatch.setattr(set_join, "packed_low", lambda h, offs, cut=set_join.packed_low: cut(h >> np.uint64(54) << np.uint64(54), offs))
    rows = corpus(4, 200, 3)
    assert grouped(spark, rows, 3, 90, 1024) == groups_brute(rows, 3, 90)
