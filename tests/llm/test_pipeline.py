"""Each stage of the pipeline against brute force, on small documents with every odd case, and the whole of it."""

import random
import zlib

import corpus_pipeline as cp
import numpy as np
import pytest
from ledgerfold.llm.queries import tokenizer_path
from pyspark.sql import functions as F
from test_text import groups_brute, statistics_brute

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, node string, keep string"  # the last three clash with names used inside


def documents():
    """Rows (doc_id, text): copies, near copies, shared passages, blanks, long texts, rows that repeat or share a doc_id."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(2000)] + ["é", "日本", "the", "of"]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = some(40)
    rows = [(i, some(rng.randint(12, 80))) for i in range(10, 40)]
    rows += [(50 + i, f"{some(30)} {passage} {some(20)}") for i in range(5)]
    base = some(120).split()
    for i in range(6):
        copy = list(base)
        for _ in range(i):
            copy[rng.randrange(120)] = f"x{rng.randint(0, 99)}"
        rows.append((70 + i, " ".join(copy)))
    rows += [(90, rows[0][1]), (91, None), (92, ""), (93, " \n"), (94, "12 34 !!"), (95, some(9)), (96, some(6000)), (97, "a b c d e f g h i j " * 20)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), False, "n", "k") for i, t in rows], SCHEMA)


def pairs(df):
    assert tuple(df.columns) == cp.COLUMNS
    got = df.collect()
    assert all(r.lang == "en" and r.source == "s" and (r.n_chars == len(r.text or "")) for r in got)
    return sorted(((r.doc_id, r.text) for r in got), key=repr)


ODD = [(None, "some words without any number at all to name them"), (None, "some words without any number at all to name them"), (10, "another text of the same number as ten has, with enough words")]


@pytest.fixture(scope="module")
def rows():
    return documents()


def test_language(spark, rows):
    want = [(i, t) for i, t in rows + ODD if any(c.isalpha() for c in t or "")]
    assert pairs(cp.language(spark, frame(spark, rows + ODD), DIR)) == sorted(want, key=repr)
    assert pairs(cp.language(spark, frame(spark, []), DIR)) == []


def test_language_takes_effect(spark):
    """Rows without a language get the predicted one; without any labelled row all texts with a letter stay."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    blank = docs.withColumn("was", F.col("lang")).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    got = {r.doc_id: r.lang for r in cp.language(spark, blank, DIR).collect()}
    was = {r.doc_id: (r.was, r.lang) for r in blank.where("was is not null").collect() if r.doc_id in got}
    assert None not in got.values() and all(got[i] == lang for i, (_, lang) in was.items() if lang)
    hidden = [i for i, (_, lang) in was.items() if lang is None]
    assert sum(got[i] == was[i][0] for i in hidden) >= 0.95 * len(hidden) > 50
    none = cp.language(spark, docs.withColumn("lang", F.lit(None).cast("string")), DIR)
    assert sorted(r.doc_id for r in none.collect()) == sorted(got) and none.where("lang is not null").count() == 0


def test_quality(spark, rows):
    def good(t):
        words, _, _, _, repeat = statistics_brute(t)
        return words >= 10 and 100 * repeat <= 20 * words

    want = [(i, t) for i, t in rows + ODD if good(t)]  # no cutoff is certified by the few labels of these
    assert pairs(cp.quality(spark, frame(spark, rows + ODD), DIR)) == sorted(want, key=repr)
    assert pairs(cp.quality(spark, frame(spark, []), DIR)) == []


def test_near(spark, rows):
    groups = groups_brute(rows, 5, 80)
    want = [(i, t) for i, t in rows if groups[i][2]]
    assert len(want) < len(rows) - 2
    assert pairs(cp.near(spark, frame(spark, rows), DIR)) == sorted(want, key=repr)
    # rows of one number are one document; those without a number stay
    odd = pairs(cp.near(spark, frame(spark, rows + ODD + rows[:2]), DIR))
    assert odd == sorted([(i, min(t, ODD[2][1])) if i == 10 else (i, t) for i, t in want] + ODD[:2], key=repr)
    assert pairs(cp.near(spark, frame(spark, []), DIR)) == []


def cut(rows, length=50):
    first = {}
    order = lambda i: -1 if i is None else i
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            first[b[k : k + length]] = min(first.get(b[k : k + length], 1 << 40), order(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < order(i):
                gone[k : k + length] = b"\1" * length
        out.append((i, bytes(c for c, g in zip(b, gone) if not g).decode(errors="ignore")))
    return out


def test_substrings(spark, rows):
    every = rows + ODD + rows[:2]
    assert pairs(cp.substrings(spark, frame(spark, every), DIR)) == sorted(cut(every), key=repr)
    assert pairs(cp.substrings(spark, frame(spark, []), DIR)) == []


def test_pack(spark, rows):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_path())
    every = rows + ODD + rows[:2]
    got = cp.pack(spark, frame(spark, every), DIR).collect()
    want = []
    for i, t in every:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        want += [(i, k, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(((r.doc_id, r.piece, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    assert cp.pack(spark, frame(spark, []), DIR).count() == 0


def test_whole_pipeline(spark):
    """Every stage by brute force, one after the other, on the smallest table."""
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect())
    labels = {r.doc_id for r in spark.read.parquet(f"{DIR}/labels.parquet").where("quality = 1").collect()}
    assert len(labels) < 100  # too few for any cutoff to be certified
    docs = [(i, t) for i, t in docs if any(c.isalpha() for c in t or "")]
    docs = [(i, t) for i, t in docs for words, _, _, _, repeat in [statistics_brute(t)] if words >= 10 and 100 * repeat <= 20 * words]
    groups = groups_brute(docs, 5, 80)
    docs = [(i, t) for i, t in docs if groups[i][2]]
    docs = cut(docs)
    got = cp.run(spark, DIR).collect()
    assert sorted({r.doc_id for r in got}) == [i for i, _ in docs]
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_path())
    tokens = {}
    for r in got:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
    assert tokens == {i: len(lib.encode(t, add_special_tokens=False).ids) + 1 for i, t in docs}
    assert [name for name, _ in cp.STAGES] == ["language_id", "quality_rules", "near_dedup", "suffix_dedup", "packing"]
