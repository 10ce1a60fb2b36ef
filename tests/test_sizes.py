"""What keeps queries within bounds as tables grow: events stay where they are, nothing is written that isn't needed."""

import os
import re

import __spark_entry__ as entry
import numpy as np
import pytest
from ledgerfold.functions import paths, trees
from ledgerfold.operators import keys, pii
from ledgerfold.sources import samples

DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["C3_encrypt_events", "C5_reconstruct_events", "S4_scan_decrypted_log"])
def test_stored_payloads_are_neither_written_nor_shuffled(spark, name):
    sc = spark.sparkContext
    before = sc.getCheckpointDir() and os.listdir(sc.getCheckpointDir().removeprefix("file:"))
    text = plan(entry.queries()[name](spark, DIR))
    assert before == (sc.getCheckpointDir() and os.listdir(sc.getCheckpointDir().removeprefix("file:")))
    assert not re.search(r"Exchange hashpartitioning\([^)]*__[es]#", text)


def test_partitions_read_the_log_once(spark):
    text = plan(pii.extract_partitions(samples.personal_log(spark, DIR)))
    assert len(re.findall(r"Exchange hashpartitioning\(aggregate_id", text)) == 2 and text.count("lineitem.parquet") == 1


def test_slots_are_one_window_before_events_are_exploded(spark):
    text = plan(pii.extract_partitions(samples.personal_log(spark, DIR)))
    assert text.count("Window [min(") == 1 and "Window [min_by(" not in text and "person_ref#" not in "".join(re.findall(r"Sort \[.*", text))
    assert "lambdafunction" not in "".join(x for x in text.splitlines() if "Generate" in x and "/persons/lead" in x)


def test_secrets_keep_their_kind_and_first_subject(spark):
    log = spark.createDataFrame(
        [("a", 1, "AttributesSet", None, None, 7, "early"), ("a", 2, "PersonCaptured", "lead", "s1", None, None), ("a", 3, "PersonCaptured", "lead", "s2", None, None), ("a", 4, "AttributesSet", None, None, 8, "x"), ("a", 5, "AttributesSet", None, None, None, None), ("b", 6, "AttributesSet", None, None, 9, "other")],
        "aggregate_id string, sequence long, event_type string, person_ref string, subject_id string, n int, t string",
    ).selectExpr("*", "'N' as name", "null as email", "null as phone")
    got = pii.attribute_partitions(log, {"lead": "n", "agent": "t"}, "no")
    assert [tuple(r) for r in got.collect()] == [("a", 4, "s1", "lead", '{"/persons/lead/no":8}')]


def test_erasure_reads_the_log_twice(spark):
    assert plan(entry.queries()["C18_forgotten_events"](spark, DIR)).count("lineitem.parquet") == 2


def test_erasure_appends_what_is_missing(spark):
    rows = [("a", 1, "PersonCaptured", "s2"), ("a", 2, "PersonCaptured", "s1"), ("a", 5, "JourneyClosed", None), ("b", 1, "PersonCaptured", "s1"), ("b", 4, "SubjectForgotten", "s1"), ("c", 3, "PersonCaptured", "s3"), ("d", 2, "SubjectForgotten", None), (None, 1, "PersonCaptured", "s1")]
    log = spark.createDataFrame(rows, "aggregate_id string, sequence long, event_type string, subject_id string")
    journeys = log.where("event_type = 'PersonCaptured'").select("subject_id", "aggregate_id").unionByName(spark.createDataFrame([("s1", "nowhere"), ("s1", "d"), ("s1", "a")], "subject_id string, aggregate_id string"))
    table, wanted = spark.createDataFrame([("s1",), ("s9",)], "subject_id string"), spark.createDataFrame([("s1",), ("s2",), ("s1",), (None,)], "subject_id string")
    got = keys.erase(log, table, table, wanted, journeys)
    assert sorted(tuple(r) for r in got["events"].collect()) == [("a", 6, "SubjectForgotten", "s1"), ("a", 7, "SubjectForgotten", "s2"), ("d", 3, "SubjectForgotten", "s1")]
    assert [r.subject_id for r in got["keys"].collect()] == ["s9"]


def test_documents_are_shuffled_once_and_never_written(spark):
    sc = spark.sparkContext
    nodes = spark.createDataFrame([(1, "/a/b/c", "leaf", "1"), (1, "/a/d", "leaf", "2")], "id long, path string, kind string, json string")
    folder = lambda: sorted(os.listdir(sc.getCheckpointDir().removeprefix("file:"))) if sc.getCheckpointDir() else []
    before = folder()
    df = trees.rehydrate(nodes, ["id"])
    assert before == folder() and plan(df).count("Exchange") == 1
    assert [tuple(r) for r in df.collect()] == [(1, '{"a":{"b":{"c":1},"d":2}}')]


def test_flattening_has_one_generator_a_level(spark):
    doc = spark.createDataFrame([(1, '{"a":{"b":[1,{}]},"c":null}')], "id long, doc string")
    df = paths.flatten(doc, "doc", ["id"])
    assert plan(df).count("variant_explode") == 4 and "lambdafunction" not in plan(df)
    assert sorted(tuple(r) for r in df.collect()) == [(1, "/a/b/0", "1", False), (1, "/c", None, True)]
    assert sorted((r.path, r.kind, r.json) for r in paths.flatten_nodes(doc, "doc", ["id"]).collect()) == [("/a", "object", None), ("/a/b", "array", None), ("/a/b/0", "leaf", "1"), ("/a/b/1", "object", None), ("/c", "leaf", "null")]


def test_rule_inputs_are_one_aggregation(spark):
    rng = np.random.default_rng(3)
    every = ["/a", "/a/b", "/a/b/0", "/a/c", "/ab", "/a/b/0/x"]
    rows = []
    for key in range(80):
        for n in range(rng.integers(1, 7)):
            p, op = str(rng.choice(every)), str(rng.choice(["set", "set", "set", "delete", "object", "array", "reset"]))
            rows.append((key, int(n), int(rng.integers(2)), p, str(n) if op == "set" else None, op, ["/a/b"] if p.startswith("/a/b/") and rng.random() < 0.5 else None))
    writes = spark.createDataFrame(rows, "id long, sequence long, part int, path string, value string, op string, arrays array<string>").dropDuplicates(["id", "sequence", "part", "path"]).localCheckpoint()
    wanted = dict(zip("pqrstu", every))
    got = paths.last_values(writes, ["id"], ["sequence", "part"], wanted)
    assert plan(got).count("Exchange hashpartitioning") <= 1 and "Join" not in plan(got)
    stands = {(r.id, r.path): r.value for r in paths.last_writes(writes, ["id"], ["sequence", "part"]).collect()}
    assert stands and {r.id: r for r in got.collect()}.keys() == {r[0] for r in rows}
    assert {(r.id, p): r[c] for r in got.collect() for c, p in wanted.items() if r[c] is not None} == stands


@pytest.mark.parametrize("name", ["C5_reconstruct_events", "S4_scan_decrypted_log"])
def test_stored_events_stay_where_they_were_encrypted(spark, name):
    """Neither the payloads nor the rows of partitions are under an Exchange, and payloads are parsed as often as they are new."""
    text = plan(entry.queries()[name](spark, DIR))
    assert not re.search(r"Exchange hashpartitioning\(aggregate_id[^\n]*\n[^\n]*Project \[[^\n]*(payload|__e)#", text)
