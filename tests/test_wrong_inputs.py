"""Malformed pointers, values by kind, schemas that refer to themselves, and texts that are no JSON: batch, stream and row-wise code agree."""

import json
from types import SimpleNamespace

import numpy as np
import pytest
from ledgerfold.operators import admit, classify, documents, validate
from ledgerfold.streaming.admission import verdict
from pyspark.sql import functions as F

POINTERS = {"_search": "invalid", "Xsearch/origin": "invalid", "/~2": "invalid", "/search/~": "invalid", "/search/~1": "plaintext", "": "unknown", "/": "unknown", "/search": "plaintext", "/sear~0ch": "unknown", "/persons/p~1q/firstName": "secret", "/search\n/x": "unknown", "\n": "invalid"}


def test_pointers_are_checked_first(spark):
    df = spark.createDataFrame([(p,) for p in POINTERS], "path string").select("path", classify.BOOKING.classify(F.col("path")).alias("c"))
    assert {r.path: r.c for r in df.collect()} == POINTERS
    assert {p: classify.BOOKING.kind(p) for p in POINTERS} == POINTERS


def test_malformed_pointers_are_refused(spark):
    rows = [("a", 1, "Start", None, None), ("a", 2, "SetAttributes", "_search", [("_search", '{"z":1}')]), ("a", 3, "SetAttributes", "/search/x", [("/search/x", "1"), ("Xsearch/y", "2")]), ("b", 1, "SetAttributes", "x", [("x", "1")]), ("a", 4, "SetAttributes", "/nope", [("/nope", "1")])]
    cols = "aggregate_id string, sequence long, command string, path string, changes array<struct<path string, value string>>"
    df = spark.createDataFrame(rows, cols).select("*", *[F.lit(None).cast("string").alias(c) for c in ("person_ref", "subject_id", "step", "data")])
    one = {(r.aggregate_id, r.sequence): r.error for r in admit.admit(df, classify.BOOKING).collect()}
    assert one == {("a", 1): None, ("a", 2): "InvalidJsonPointer", ("a", 3): None, ("b", 1): "InvalidJsonPointer", ("a", 4): "UnknownAttributePath"}
    sets = {(r.aggregate_id, r.sequence): r.error for r in admit.admit_change_sets(df, classify.BOOKING).collect()}
    assert sets == {("a", 2): "InvalidJsonPointer", ("a", 3): "InvalidJsonPointer", ("b", 1): "InvalidJsonPointer", ("a", 4): "UnknownAttributePath"}
    state = {"started": True, "completed": False, "slots": {}, "step": None, "doc": {"keep": 1}}
    c = SimpleNamespace(command="SetAttributes", changes=[{"path": "_search", "value": '{"z":1}'}], person_ref=None)
    assert verdict(state, c, classify.BOOKING, documents.checker({})) == "InvalidJsonPointer" and state["doc"] == {"keep": 1}


def test_texts_that_are_no_json():
    deep = "[" * 100_000 + "]" * 100_000
    assert all(documents.parse(t) is documents.BAD for t in ("NaN", "[Infinity]", '{"a":-Infinity}', deep, "{", ""))
    check = documents.checker({"type": "object"})
    assert documents.step({"k": 1}, deep, None, check) == ({"k": 1}, "InvalidData", [" json"])
    assert documents.step({"k": 1}, None, [("/a", deep)], check) == ({"k": 1}, "InvalidData", [" json"])
    doc = {"a": {"b": 1}, "c": [1]}
    new, error, _ = documents.step(doc, None, [("/a/b", "2"), ("/c/-", "3")], check)
    assert (new, error, doc) == ({"a": {"b": 2}, "c": [1, 3]}, None, {"a": {"b": 1}, "c": [1]})
    assert documents.step(doc, None, [("/a/b", "2"), ("/c/9", "3")], check)[:2] == (doc, "InvalidJsonPointer") and doc == {"a": {"b": 1}, "c": [1]}


TREE = {"$ref": "#/$defs/node", "$defs": {"node": {"type": "object", "required": ["v"], "properties": {"v": {"type": "integer", "minimum": 0}, "next": {"anyOf": [{"type": "null"}, {"$ref": "#/$defs/node"}]}, "kids": {"type": "array", "items": {"$ref": "#/$defs/node"}}}}}}
SCHEMAS = [
    {"enum": ["1", "x", None]}, {"enum": [True]}, {"enum": [1, 2.5, "true"]}, {"enum": [[1, "a"], {"k": None}]}, {"type": "integer"}, {"type": ["integer", "null"]}, {"type": "number", "minimum": 1}, {"properties": {"a": {"enum": [1, None]}, "b": {"type": "integer"}}, "required": ["a"]},
    {"items": {"enum": ["1", 1]}, "type": "array"}, {"anyOf": [{"type": "string", "minLength": 2}, {"enum": [1]}]}, TREE,
]
TEXTS = ["1", '"1"', "1.0", "1e0", "1.5", "2.5", "true", '"true"', "null", '"x"', "[1,\"a\"]", '{"k":null}', '{"a":1}', '{"a":"1","b":1.0}', '{"a":null,"b":1.5}', '{"b":1}', '["1",1,true]', "[]", '{"v":1,"next":{"v":2,"next":null},"kids":[{"v":3,"kids":[{"v":-1}]}]}', '{"v":1e0,"next":{}}', "{bad", ""]


@pytest.mark.parametrize("k", range(len(SCHEMAS)))
def test_batch_and_row_wise_validation_agree(spark, k):
    rng = np.random.default_rng(k)
    texts = [*TEXTS, *(json.dumps({"a": rng.choice([0, 1, 2.5]).item(), "v": int(rng.integers(-1, 3)), "kids": [{"v": int(i)} for i in rng.integers(-1, 4, 3)]}) for _ in range(10))]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, doc string")
    got = {r.id: sorted(r.errors) for r in validate.validate(df, "doc", SCHEMAS[k]).collect()}
    check = documents.checker(SCHEMAS[k])
    assert got == {i: check(documents.parse(t)) for i, t in enumerate(texts)}


def test_deep_document_of_a_recursive_schema(spark):
    text = '{"v":1,"next":' * 5000 + "null" + "}" * 5000
    df = spark.createDataFrame([(1, text), (2, None)], "id long, doc string")
    assert {r.id: r.valid for r in validate.validate(df, "doc", TREE).collect()} == {1: False, 2: False}
