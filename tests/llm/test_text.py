"""Text operators against brute force, on small documents with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from ledgerfold.llm import near_dedup, quality_rules, substring_dedup, suffix_dedup
from ledgerfold.llm.induced_sort import equal_prefix_groups, sorted_suffixes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, q int, p string"  # q and p clash with names used inside


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "x") for i, t in rows], SCHEMA)


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)] + ["é", "日本", "the", "of"]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(18, 60))) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 5))]
        rows.append((i * 3, rng.choice([" ", "\n", "\t "]).join(parts)))
    return rows + [(1000, None), (1001, ""), (1002, " \n "), (1003, rows[0][1]), (1004, "x" * 5000), (1005, "x" * 5000), (1006, "ab " * 500)]


def substrings_brute(rows, width=20):
    seen, out = set(), {}
    for i, t in sorted(rows):
        words = WORD.findall(t or "")
        gone = [False] * len(words)
        for k in range(len(words) - width + 1):
            x = tuple(words[k : k + width])
            if x in seen:
                gone[k : k + width] = [True] * width
            seen.add(x)
        out[i] = (len(words), sum(gone), hashlib.sha256(" ".join(w for w, g in zip(words, gone) if not g).encode()).hexdigest())
    return out


def suffix_brute(rows, length=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            x = b[k : k + length]
            first[x] = min(first.get(x, i), i)
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup(spark, seed):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup(frame(spark, rows)).collect()}
    assert got == substrings_brute(rows)


@pytest.mark.parametrize("seed", [3, 4])
def test_suffix_dedup(spark, seed):
    rows = corpus(seed)
    for hot in (suffix_dedup.HOT, 2, 0):  # the last two split anchors
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(frame(spark, rows), hot=hot).collect()}
        assert got == suffix_brute(rows)


def test_dedup_of_repeated_rows_and_empty_tables(spark):
    text = " ".join(f"word{k}" for k in range(50))
    rows = [(1, text), (1, text), (None, None), (2, text)]
    for fn, n in ((substring_dedup.dedup, "n_words"), (suffix_dedup.dedup, "n_bytes")):
        got = sorted(((r.doc_id, r.n_removed) for r in fn(frame(spark, rows)).collect()), key=str)
        whole = fn(frame(spark, [(1, text)])).first()[n]
        assert got == sorted([(1, 0), (1, 0), (None, 0), (2, whole)], key=str)
        assert fn(frame(spark, [])).count() == 0


def test_dedup_carries_columns(spark):
    rows = corpus(5, 20)
    docs = spark.createDataFrame([(i, t, f"l{k}", k) for k, (i, t) in enumerate(rows + [rows[0], (None, rows[0][1]), (None, rows[0][1])])], "doc_id long, text string, keep string, q int")
    for fn, brute in ((substring_dedup.dedup, substrings_brute), (suffix_dedup.dedup, suffix_brute)):
        got = fn(docs, keep=("keep", "q")).collect()
        want = brute(rows + [(-1, rows[0][1])])
        assert sorted(r.q for r in got) == list(range(len(rows) + 3)) and all(r.keep == f"l{r.q}" for r in got)
        assert {(r.doc_id, r.n_removed, r.kept_sha256) for r in got} == {(None if i < 0 else i, x[1], x[-1]) for i, x in want.items()}


def test_induced_sort_orders_suffixes_and_counts_prefixes():
    rng = random.Random(5)
    for alphabet in (b"a", b"ab", bytes(range(256))):
        for limit in (7, 8_000_000):  # the small one spills every block
            symbols = []
            for _ in range(12):
                symbols += [b + 1 for b in bytes(rng.choice(alphabet) for _ in range(rng.randint(1, 50)))] + [0]
            n, cap = len(symbols), 9
            text = np.zeros(n + 128, np.uint16)
            text[:n] = symbols
            got = [x for block in sorted_suffixes(text, n, cap, limit) for x in zip(*(v.tolist() for v in block))]
            key = lambda p: tuple((symbols + [0] * cap)[p : p + cap])  # noqa: B023, E731
            assert sorted(p for p, _ in got) == list(range(n))
            for (p, _), (q, lcp) in zip(got, got[1:]):
                a, b = key(p), key(q)
                assert a >= b
                if a[0] == b[0] and q != n - 1:
                    assert lcp == next((k for k in range(cap) if a[k] != b[k]), cap)


def test_induced_sort_groups():
    text = np.zeros(200, np.uint16)
    body = [*b"abcabcabc", 0, *b"abcab", 0]
    text[: len(body)] = [c + 1 if c else 0 for c in body]
    found = []
    equal_prefix_groups(text, len(body), 4, lambda place, start: found.extend(tuple(sorted(x.tolist())) for x in np.split(place, start[1:])))
    assert sorted(found) == [(0, 3, 10), (1, 4, 11), (2, 5)]


def shingles(text, size):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset([tuple(w)] if 0 < len(w) < size else [tuple(w[k : k + size]) for k in range(len(w) - size + 1)])


def groups_brute(rows, size, percent):
    sets = {i: shingles(t, size) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def near_copies(seed):
    """Chains and stars of near copies around the threshold."""
    rng = random.Random(seed)
    rows, i = [], 0
    for _ in range(6):
        base = [f"v{rng.randint(0, 10**6)}" for _ in range(90)]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(90)] = f"u{rng.randint(0, 10**6)}"
            rows.append((i, " ".join(copy)))
            i += 1
            if rng.random() < 0.4:
                base = copy
    return rows + [(900, None), (901, ""), (902, "One two"), (903, "one TWO"), (904, "one"), (905, rows[0][1].upper())]


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_near_dedup(spark, size, percent):
    rows = near_copies(size)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_dedup(frame(spark, rows), size, percent).collect()}
    assert got == groups_brute(rows, size, percent)
    assert near_dedup.near_dedup(frame(spark, [])).count() == 0


def test_near_dedup_of_shared_ids(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(40)) for c in "ab")
    rows = [(3, a), (5, a), (5, b), (7, b), (7, b), (5, None), (None, a), (None, ""), (9, "one")]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_dedup(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(3, 3, True), (5, 3, False), (5, 3, False), (5, 3, False), (7, 3, False), (7, 3, False), (None, None, True), (None, None, True), (9, 9, True)], key=str)


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(0)
    both, only = rng.integers(0, 1 << 48, 300, dtype=np.uint64), rng.integers(0, 1 << 48, (2, 100), dtype=np.uint64)
    a, b = np.sort(np.concatenate([both, only[0]])), np.sort(np.concatenate([both, only[1]]))
    sig = near_dedup.superminhash(np.concatenate([a, b]), np.array([0, 400, 800]), 200)
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.12
    one = near_dedup.superminhash(a[:1], np.array([0, 1]), 200)  # a single element fills all slots, one a step
    assert sorted((one[0] >> np.uint64(56)).tolist()) == list(range(200))


@pytest.mark.parametrize("block", [1024, 10, 2])
def test_links_between_groups_of_a_bucket(spark, block):
    """All in one bucket, in one block and split by rare shingles and into blocks."""
    rows = near_copies(9)[:72]
    docs = frame(spark, rows)
    sig = near_dedup.signatures(docs, 3, 4, 2).select("doc_id", "node", "n_shingles").collect()
    first = {}
    for r in sorted(sig, key=lambda r: r.doc_id):
        first.setdefault(bytes(r.node), r)
    one = spark.createDataFrame([(0, 0, r.doc_id, r.n_shingles, r.doc_id) for r in first.values()], "band int, key long, id long, n_shingles long, label long")
    ids = spark.createDataFrame([(bytearray(k), r.doc_id) for k, r in first.items()], "node binary, id long")
    sets = near_dedup.set_table(docs, 3).join(ids, "node").select("id", "shingles").dropDuplicates(["id"])
    links = near_dedup.links_between_groups(one, sets, 85, block)
    label = {r.node: r.label for r in near_dedup.components(links).collect()}
    want = {i: c for i, (_, c, _) in groups_brute(rows, 3, 85).items() if i in {r.doc_id for r in first.values()}}
    assert {i: label.get(i, i) for i in want} == want


def test_components(spark):
    rng = random.Random(7)
    chain = [(k, k + 1) for k in range(60)]
    star = [(100, k) for k in rng.sample(range(101, 200), 40)]
    wild = [(rng.randint(1000, 1400), rng.randint(1000, 1400)) for _ in range(220)]
    edges = [e if rng.random() < 0.5 else e[::-1] for e in chain + star + wild + [(5, 5)]]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.label for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


def statistics_brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        dup += bool(WORD.search(line)) and line in seen
        seen.add(line)
    count = {}
    for k in range(len(words) - 4):
        count.setdefault(tuple(words[k : k + 5]), []).append(k)
    hit = {j for at in count.values() if len(at) > 1 for k in at for j in range(k, k + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_quality_statistics(spark):
    rows = corpus(6) + [(2000, "a b c d e f a b c d e\na b\n\na b\n \n \nÄ #1 |x|"), (2001, "line\nline \nline\nline")]
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.statistics(frame(spark, rows)).collect()}
    assert got == {i: statistics_brute(t) for i, t in rows}


def test_binomial_bound():
    assert quality_rules.binomial_cdf(0, 100, 0.03) == pytest.approx(0.97**100, abs=1e-12)
    assert quality_rules.binomial_cdf(5, 5, 0.05) == pytest.approx(1.0)
    assert quality_rules.binomial_cdf(3, 10, 0.3) == pytest.approx(0.6496107, abs=1e-6)


def test_quality_cutoffs_reject_junk_and_keep_good(spark):
    rng = random.Random(8)
    good = [(i, " ".join(f"word{rng.randint(0, 900)}" for _ in range(60))) for i in range(400)]
    junk = [(5000 + i, " ".join(f"word{rng.randint(0, 900)}###" for _ in range(60))) for i in range(50)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in junk] + [(None, 1, None), (7, 0, 0), (8, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(frame(spark, good + junk + [(9000, None)]), labels).collect()}
    assert sum(got[i] for i, _ in good) / len(good) >= 0.95
    assert not any(got[i] for i, _ in junk)
    assert got[9000] is False
    few = {r.doc_id: r.kept for r in quality_rules.quality_rules(frame(spark, good[:20] + junk), labels.where("doc_id < 20 or doc_id > 5000")).collect()}
    assert all(few.values())  # too few labels prove nothing
    assert all(r.kept for r in quality_rules.quality_rules(frame(spark, good[:20]), labels.limit(0)).collect())
    assert quality_rules.quality_rules(frame(spark, []), labels).count() == 0


def test_choice_of_a_path():
    good = np.array([True] * 100 + [False] * 40)
    steps = {"a": np.array([0] * 100 + [50] * 20 + [0] * 20), "b": np.array([10] * 96 + [30] * 4 + [0] * 20 + [20] * 20), "c": np.zeros(140, int)}
    assert quality_rules.choose_path(steps, good, weight=1) == [("a", 25), ("b", 15)]
    assert quality_rules.choose_path(steps, good, weight=10) == [("a", 25)]  # forty good ones for twenty are too many


def test_certificates_are_exact():
    """Against the tail summed in fractions: how far each stratum gets, and what it hands on."""
    from fractions import Fraction
    from math import comb

    risk = quality_rules.Risk(0.05, 0.05)
    p = Fraction(risk.risk)
    tail = lambda k, n: sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    rng = np.random.default_rng(1)
    for _ in range(40):
        counts = {}
        for name in "abcd"[: rng.integers(1, 5)]:
            counts[name] = np.append(rng.integers(0, 5, 3), rng.integers(40, 400))
        want, open_ = dict.fromkeys(counts, 0), set(counts)
        while open_:
            for name in open_:
                n = int(counts[name].sum())
                while want[name] < 3 and tail(int(counts[name][: want[name] + 1].sum()), n) <= Fraction(risk.delta) / len(open_):
                    want[name] += 1
            done = {x for x in open_ if want[x] == 3}
            open_ = open_ - done if done else set()
        assert quality_rules.certify(counts, risk) == want


def test_quality_verdict_equals_brute_force(spark):
    """kept of each document of a table, from statistics counted in Python and the certified part of the path."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    stats = quality_rules.statistics(docs, ("doc_id", "lang"))
    cutoffs = quality_rules.fit_cutoffs(stats, labels, "lang")
    assert cutoffs.path and (cutoffs.strata or cutoffs.pooled)
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(docs, labels).collect()}
    rejected = 0
    for r in docs.collect():
        words, chars, symbols, dup, repeat = statistics_brute(r.text)
        upper = sum("A" <= c <= "Z" for c in r.text or "")
        values = {"symbols": symbols / max(chars, 1), "dup_lines": dup / max(words, 1), "repeats": repeat / max(words, 1), "long_words": (chars / max(words, 1) - 4) / 20, "capitals": upper / max(chars, 1)}
        kept = words >= 10 and 100 * repeat <= 20 * words
        for rule, cut in cutoffs.path[: cutoffs.strata.get(r.lang, cutoffs.pooled)]:
            over = min(4096, int(4096 * max(0, values[rule]) ** (1 / 3))) > cut
            rejected += kept and over
            kept = kept and not over
        assert got[r.doc_id] == kept, r.doc_id
    assert rejected > 10


def test_path_of_a_table_is_that_of_all_its_rows(spark):
    """More bad documents than any bound; the rule that rejects the last of them has to be found too."""
    n = 30_000
    rows = spark.range(n + 400).selectExpr("id < 400 as good", *[f"cast({'if(id >= 400 and id < 400 + 29990, 100, 0)' if r == 'symbols' else 'if(id >= 400 + 29990, 50, 0)' if r == 'capitals' else '0'} as int) as {r}" for r in quality_rules.RULES])
    got = quality_rules.fit_path(rows)
    x = rows.toPandas()
    assert got == quality_rules.choose_path({r: x[r].to_numpy() for r in quality_rules.RULES}, x["good"].to_numpy()) == [("symbols", 50), ("capitals", 25)]
    assert quality_rules.fit_path(rows.limit(0)) == [] == quality_rules.fit_path(rows.where("good"))
