"""Verdicts of pieces that run side by side are those of one command after the other."""

import json
import random

import pytest
from ledgerfold.operators import admit, classify, documents, validate

COMMANDS = "aggregate_id string, sequence long, data string, writes array<struct<path string, value string>>"
SCHEMA = {
    "type": "object",
    "properties": {
        "n": {"type": "integer", "minimum": 0, "maximum": 6}, "list": {"type": ["array", "object", "integer"], "items": {"type": ["integer", "string"]}},
        "o": {"type": "object", "required": ["k"], "properties": {"k": {"type": "string"}, "deep": {"type": "object"}}}, "a/b": {"enum": [1, None]},
    },
}


def serial(rows, schema):
    check, docs, out = documents.checker(schema), {}, set()
    for agg, seq, data, writes in sorted(rows, key=lambda r: r[:2]):
        docs[agg], error, reasons = documents.step(docs.get(agg, {}), data, writes, check)
        if error:
            out.add((agg, seq, error, tuple(reasons)))
    return out


def settled(spark, rows, schema, segment):
    found, rounds = documents.settle(spark.createDataFrame(rows, COMMANDS).repartition(3), schema, segment)
    got = [(r.aggregate_id, r.sequence, r.refusal, tuple(r.reasons)) for r in found.collect()]
    assert len(got) == len(set(got))
    return set(got), rounds


def some(rng, agg, n):
    values = [0, 3, 9, "x", None, [1, 2], [], {}, {"k": "v"}, {"k": 1}, {"deep": {"q": 1}}, 1.5, {"list": None}]
    pointers = ["/n", "/list/-", "/list/0", "/list/1", "/list/2", "/list", "/o/k", "/o", "/o/deep/z", "/a~1b", "/list/x", "/free/0/-", "/free/-"]
    rows = []
    for seq in range(1, n + 1):
        if rng.random() < 0.3:
            patch = {rng.choice(["n", "list", "o", "a/b", "free"]): rng.choice(values) for _ in range(rng.randint(0, 2))}
            rows.append((agg, seq, rng.choice([json.dumps(patch)] * 8 + ["{", "3", None, '{"n":9,"n":2}']), None))
        else:
            rows.append((agg, seq, None, [(p, rng.choice([json.dumps(rng.choice(values))] * 9 + ["oops", None])) for p in rng.choices(pointers, k=rng.randint(1, 3))]))
    return rows


@pytest.mark.parametrize("seed", range(1))
def test_random_commands(spark, seed):
    rng = random.Random(seed)
    rows = [r for a in range(40) for r in some(rng, f"a{a}", rng.randint(1, 16))]
    want = serial(rows, SCHEMA)
    assert want
    got, rounds = settled(spark, rows, SCHEMA, 4)
    assert got == want and rounds <= 5
    assert settled(spark, rows, SCHEMA, 10**6) == (want, 1)


def test_hot_aggregate(spark):
    rows = [("hot", s, None, [("/n", json.dumps(s % 9))]) for s in range(1, 301)] + [(f"b{i}", 1, '{"n":1}', None) for i in range(300)]
    got, rounds = settled(spark, rows, SCHEMA, 25)
    assert got == serial(rows, SCHEMA) and rounds == 2


def test_a_chain_takes_as_many_rounds_as_it_has_pieces(spark):
    # each append is right only if the one before was, so a wrong guess goes through piece by piece
    rows = [("c", 1, None, [("/n", "9"), ("/free", "[]")])] + [("c", s, None, [(f"/free/{s - 2}", "1")]) for s in range(2, 7)]
    schema = SCHEMA | {"required": ["free"]}
    got, rounds = settled(spark, rows, schema, 2)
    assert got == serial(rows, schema) and rounds <= 4


def test_edges(spark):
    assert settled(spark, [], SCHEMA, 2) == (set(), 1)
    deep = "[" * 50_000 + "]" * 50_000
    rows = [("a", 1, None, [("/free", deep)]), ("a", 2, '{"free":' + deep + "}", None), ("a", 3, '{"n":9,"n":2}', None), ("a", 5, None, [("/n", "7"), ("/n", "6")]), ("a", 6, "{}", None), ("a", 9, None, [("/n", "7")])]
    want = serial(rows, SCHEMA)
    assert settled(spark, rows, SCHEMA, 2)[0] == want
    assert settled(spark, [("a", s, "5", None) for s in range(5)], {"type": "integer"}, 2) == (set(), 1)  # no object, so no pieces
    assert {w[1] for w in want} >= {1, 2, 9} and 3 not in {w[1] for w in want}


def test_admission_is_the_same_in_pieces(spark, monkeypatch):
    from ledgerfold.plans import queries

    commands = queries._with_data(spark, "/root/testdata/sf0.001")
    rows = lambda df: sorted(map(str, df.select("aggregate_id", "sequence", "error", "reasons", "from_step").collect()))
    want = rows(admit.admit_data(commands, classify.BOOKING, validate.BOOKING))
    monkeypatch.setattr(documents.refusals, "__defaults__", (7,))
    assert rows(admit.admit_data(commands, classify.BOOKING, validate.BOOKING)) == want
