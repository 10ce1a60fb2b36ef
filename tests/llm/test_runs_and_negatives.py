"""Periodic runs and hard negatives against brute force, and their edge cases through Spark. The registered queries are held against SQL in tests/test_queries.py."""

import math

import numpy as np
import pytest
from ledgerfold.llm import hard_negatives, periodic_runs
from ledgerfold.llm.textops import mix
from pyspark.sql import functions as F


def runs_brute(w):
    found = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(24, 3 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def odd_words(rng):
    kind = rng.integers(0, 6)
    n = int(rng.integers(0, 300))
    if kind == 0:
        return rng.integers(0, 2, n).tolist()
    if kind == 1:
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    if kind == 2:
        return [i.bit_count() & 1 for i in range(n)]
    out = []
    while len(out) < rng.integers(30, 600):
        unit = rng.integers(0, rng.choice([2, 3, 50]), rng.integers(1, 80)).tolist()
        if rng.random() < 0.4:  # a long period around a short one
            unit = unit + [unit[0]] * int(rng.integers(10, 90))
        if rng.random() < 0.4:
            unit = unit[:9] * int(rng.integers(1, 6)) + unit
        out += unit * int(rng.choice([1, 3, 4])) + unit[: rng.integers(0, len(unit) + 1)] + rng.integers(0, 1000, rng.integers(0, 30)).tolist()
    return out


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_brute_force(seed):
    rng = np.random.default_rng(seed)
    for _ in range(25):
        docs = [odd_words(rng) for _ in range(4)]
        bounds = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        doc, rows = periodic_runs.runs_of_documents(mix(np.concatenate([np.array(d, dtype=np.uint64) for d in docs]) + np.uint64(7)), bounds)
        for k, d in enumerate(docs):
            assert [tuple(r) for r in rows[doc == k].tolist()] == runs_brute(d)


def test_every_period_at_exactly_three_periods():
    rng = np.random.default_rng(1)
    for q in range(8, 150):
        w = [-1, *rng.permutation(1000)[:q].tolist() * 3, -2]
        _, rows = periodic_runs.runs_of_documents(mix(np.array(w).astype(np.uint64)), np.array([0, len(w)]))
        assert rows.tolist() == [[1, 3 * q, q]]


def collapsed(words):
    gone = {i for s, n, q in runs_brute(words) for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_collapse(spark):
    texts = [None, "", " \t\n", "a", "a " * 23, "a " * 24, "é x b\x1fc " * 30, "x " + "a b c d e f g h i " * 4 + "a b y", "w" * 700 + " " + ("v" * 600 + " u ") * 20, " ".join(str(i % 7) for i in range(5000)), "a " * 24, " ".join(str(i) for i in range(3000))]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "q " * 30, "x", 1), (3, "a", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words int")
    got = sorted(periodic_runs.collapse(df).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    want = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    assert len(got) == len(want)
    for r, (i, t, *_) in zip(got, want):
        words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", t or "")]
        assert (r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.kept_text) == (i, len(words), runs_brute(words), collapsed(words))
    assert periodic_runs.collapse(df.limit(0)).collect() == []


@pytest.mark.parametrize("most", [1, 3, 256, 3000, 10**5, 10**8])
def test_products_of_both_forms(most):
    rng = np.random.default_rng(most)
    for dim in (1, 2, 64):
        a, b = rng.integers(-most, most + 1, (5, dim)), rng.integers(-most, most + 1, (8, dim))
        for n in (1, 2, 7, 8):
            assert (hard_negatives.products(a, b[:n]) == a @ b[:n].T).all()
            assert (hard_negatives.wide_fields(a, b[:n], most, most, 16).view(np.uint64) == ((a + most) @ (b[:n] + most).T).astype(np.uint64)).all()
    edge = np.full((1, 1), 3037000499)
    assert (hard_negatives.products(edge, -edge) == -edge * edge).all()


def negatives_brute(rows, is_anchor, k=5):
    scale = lambda v: [math.floor(256 * float(x)) for x in v]
    good = {}
    for i, label, v in sorted((r for r in rows if None not in r and None not in r[2] and all(math.isfinite(x) for x in r[2])), key=lambda r: (r[0], r[1], len(r[2]), scale(r[2]))):
        good.setdefault(i, (label, scale(v)))
    out = []
    for i, (label, v) in good.items():
        if not is_anchor(i):
            continue
        score = sorted((-sum(x * y for x, y in zip(v, w)), j, lab) for j, (lab, w) in good.items() if j != i and len(w) == len(v))
        for p, j, _ in [s for s in score if s[2] == label][:k]:
            fit = [(n, m) for n, m, lab in score if lab != label and 80 * -p <= 100 * -n <= 100 * -p][:k]
            out += [(i, j, r + 1, m, -p, -n) for r, (n, m) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("kind, block, slices", [("array<float>", 8192, 32), ("array<double>", 3, 5), ("array<double>", 1, 1)])
def test_mine(spark, kind, block, slices):
    rng = np.random.default_rng(block)
    rows = [(i, int(rng.integers(0, 3)), rng.normal(size=6).round(2).tolist()) for i in range(120)]
    rows += [(200 + i, 1, rows[7][2]) for i in range(9)]  # ties
    rows += [(300, None, [0.1] * 6), (301, 1, None), (302, 1, [0.1, None, 0, 0, 0, 0]), (303, 1, [math.nan] * 6), (304, 1, [math.inf] * 6), (None, 1, [0.1] * 6), (305, 2, []), (306, 2, []), (307, 1, []), (310, 1, [0.5]), (311, 1, [0.25])]
    rows += [(400, 0, [5000.0, -3000.0, 0, 1, 2, 3]), (410, 0, [4000.0, -3100.0, 1, 1, 1, 1]), (420, 1, [3900.0, -3200.0, 1, 1, 1, 1]), rows[5], (5, 2, [9.0] * 6)]
    number = np.float32 if kind == "array<float>" else float
    rows = [(i, lab, None if v is None else [None if x is None else float(number(x)) for x in v]) for i, lab, v in rows]
    df = spark.createDataFrame(rows, f"vec_id long, label int, embedding {kind}").withColumn("rank", F.lit("x")).withColumn("g", F.lit(1))
    got = hard_negatives.mine(df, F.col("vec_id") % 5 == 0, block=block, slices=slices)
    assert sorted(tuple(r) for r in got.collect()) == negatives_brute(rows, lambda i: i % 5 == 0)


def test_mine_nothing(spark):
    df = spark.createDataFrame([(1, 1, [0.5])], "vec_id long, label int, embedding array<double>")
    assert hard_negatives.mine(df.limit(0), F.col("vec_id") % 5 == 0).collect() == []
    assert hard_negatives.mine(df, F.col("vec_id") == 1).collect() == []
    huge = df.union(spark.createDataFrame([(2, 1, [1e30]), (3, 1, [1e300]), (4, 1, [0.25]), (5, 2, [0.2])], df.schema))
    assert [tuple(r) for r in hard_negatives.mine(huge, F.col("vec_id") == 1).collect()] == [(1, 4, 1, 5, 128 * 64, 128 * 51)] * (80 * 64 <= 100 * 51)
