"""Documents as rows and back, and positions in arrays, against a document that is changed step by step."""

import json

import numpy as np
import pytest
from ledgerfold.functions import paths, trees
from ledgerfold.operators import documents, fold
from pyspark.sql import functions as F
from test_operators import log_of


def value(rng, depth=0):
    kind = rng.integers(0, 8 if depth < 3 else 5)
    if kind < 5:
        return [None, True, int(rng.integers(-5, 5)), 1.5, 'q"\\/~ \n'][kind]
    if kind == 5:
        return [value(rng, depth + 1) for _ in range(rng.integers(0, 4))]
    return {str(k): value(rng, depth + 1) for k in rng.choice(["a", "b", "0", "-", "x/y", "t~"], rng.integers(0, 4), replace=False)}


def pointer(rng):
    return "".join("/" + str(t) for t in rng.choice(["a", "b", "0", "1", "2", "-", "01", "x~1y"], rng.integers(1, 4), p=[0.3, 0.15, 0.15, 0.1, 0.05, 0.15, 0.05, 0.05]))


def journeys(seed, n):
    """(log rows, documents, errors) of n journeys of random patches and assignments."""
    rng = np.random.default_rng(seed)
    rows, docs, errors = [], {}, set()
    for j in range(n):
        doc = {}
        for s in range(1, rng.integers(2, 9)):
            if rng.random() < 0.35:
                patch = {str(k): value(rng) for k in rng.choice(["a", "b", "0", "x/y"], rng.integers(0, 3), replace=False)}
                doc = documents.merge_patch(doc, patch)
                rows.append((f"j{j}", s, "JourneyModified", json.dumps({"Modified": {"step": "s", "data": patch}})))
            else:
                changes = {pointer(rng): value(rng, 1) for _ in range(rng.integers(1, 4))}
                rows.append((f"j{j}", s, "AttributesSet", json.dumps({"AttributesSet": {"plaintext": changes}})))
                for part, p in enumerate(sorted(changes)):
                    try:
                        doc = documents.assign(doc, p, json.loads(json.dumps(changes[p])))
                    except documents.PointerError as e:
                        errors.add((f"j{j}", s, part, str(e)))
        docs[f"j{j}"] = doc
    return rows, {j: d for j, d in docs.items() if d}, errors


@pytest.mark.parametrize("seed", range(2))
def test_documents_after_random_writes(spark, seed):
    rows, docs, errors = journeys(seed, 90)
    log = log_of(spark, rows)
    got = {r.aggregate_id: json.loads(r.document) for r in fold.fold_documents(log).collect()}
    assert got == docs
    assert {tuple(r) for r in fold.resolved(log)[1].collect()} == errors
    last, stored = fold.snapshot(log.where("sequence <= 3"))
    resumed = fold.resume_documents(last, stored, log.where("sequence > 3"))
    assert {r.aggregate_id: json.loads(r.document) for r in resumed.collect()} == docs


def test_flattened_documents_come_back(spark):
    rng = np.random.default_rng(5)
    docs = [(i, {"k": value(rng), "more": value(rng), "": {"": []}, "é ": [[], {}, [[1], None]]}) for i in range(60)]
    deep = {}
    for i in range(30):
        deep = {"a": deep} if i % 3 else [deep, i]
    docs.append((100, {"deep": deep}))
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in docs], "id long, doc string")
    nodes = paths.flatten_nodes(df, "doc", ["id"])
    assert {r.id: json.loads(r.document) for r in trees.rehydrate(nodes, ["id"]).collect()} == dict(docs)


def test_rehydrate_edges(spark):
    rows = [
        (1, "/a/1", "leaf", "2"), (1, "/a/0", "leaf", "1"), (1, "/a/10", "leaf", "3"), (1, "/a", "array", None), (2, "", "leaf", '"root"'), (3, "/x", "leaf", None), (3, "/x", "leaf", None), (4, "/e", "object", None), (4, "/f", "array", None),
        (5, "/s", "leaf", "1"), (5, "/s/t", "leaf", "2"), (6, "", "array", None), (None, "/n", "leaf", "true"),
    ]
    df = spark.createDataFrame(rows, "id long, path string, kind string, json string").withColumn("depth", F.lit("clash"))
    got = {r.id: r.document for r in trees.rehydrate(df, ["id"]).collect()}
    assert got == {1: '{"a":[1,2,3]}', 2: '"root"', 3: '{"x":null}', 4: '{"e":{},"f":[]}', 5: '{"s":{"t":2}}', 6: "[]", None: '{"n":true}'}
    assert trees.rehydrate(df.limit(0), ["id"]).collect() == []


def test_positions(spark):
    cases = {
        "appended": ([{"/y": [1, 2]}, {"/y/-": 3}, {"/y/3": 4}], {"y": [1, 2, 3, 4]}),
        "started": ([{"/z/-": 1}, {"/w/0": {"k": 1}}, {"/w/0/k": 2}, {"/w/-": 5}], {"z": [1], "w": [{"k": 2}, 5]}),
        "object keys": ([{"/o": {"a": 1}}, {"/o/-": 2}, {"/o/0": 3}], {"o": {"a": 1, "-": 2, "0": 3}}),
        "replaced": ([{"/x/0": 5}, {"Modified": {"x": {"k": 1}}}], {"x": {"k": 1}}),
        "nested": ([{"/m": [[1], [2]]}, {"/m/0/-": 9}, {"/m/-/0": 7}, {"/m/2/1": 8}], {"m": [[1, 9], [2], [7, 8]]}),
        "out of bounds": ([{"/b": [1]}, {"/b/2": 9}, {"/b/x": 9}, {"/b/01": 9}, {"/b/-": 2}], {"b": [1, 2]}),
        "scalar": ([{"/s": 1}, {"/s/0": 2}, {"/s": 1}, {"/s/t": 2}], {"s": {"t": 2}}),
    }
    rows = [(name, n + 1, "JourneyModified" if "Modified" in c else "AttributesSet", json.dumps({"Modified": {"step": "s", "data": c["Modified"]}} if "Modified" in c else {"AttributesSet": {"plaintext": c}})) for name, (steps, _) in cases.items() for n, c in enumerate(steps)]
    got = {r.aggregate_id: json.loads(r.document) for r in fold.fold_documents(log_of(spark, rows)).collect()}
    assert got == {name: want for name, (_, want) in cases.items()}
    assert {r.error for r in fold.resolved(log_of(spark, rows))[1].collect()} == {"OutOfBounds: 2", "FailedToParseIndex: x", "FailedToParseIndex: 01"}
