"""Rule models as data."""

import datetime as dt

import pytest
from ledgerfold.operators import models
from ledgerfold.operators.models import ModelError
from pyspark.sql import functions as F

ROWS = [
    {"n": 1, "s": "x", "list": ["a", "b"], "o": {"k": "v", "day": "2024-02-29"}, "m": {"p": {"t": None, "name": "Ann"}, "q": {"t": "y", "name": "B"}}, "b": True, "as_of": dt.date(2024, 2, 1)},
    {"n": None, "s": None, "list": [], "o": {"k": None, "day": None}, "m": None, "b": None, "as_of": dt.date(2024, 2, 1)},
]
SCHEMA = "n int, s string, list array<string>, o struct<k string, day string>, m map<string, struct<t string, name string>>, b boolean, as_of date"

VALUES = [
    ("n == 1 and s == 'x'", True, False), ("n != 1", False, True), ("s != null", True, False), ("gone == null", True, True), ("m != null and n == 1", True, False), ("m == null ? 0 : 1", 1, 0), ("o.gone.deeper ?? 'd'", "d", "d"), ("n ?? 2 + 3", 4, 5), ("s ?? o.k ?? \"z\"", "x", "z"),
    ("!(n == 1) || b == true", True, True), ("n > 0 ? 'yes' : b ? 'b' : 'no'", "yes", "no"), ("len(list)", 2, 0), ("len(s)", 1, None), ("len(values(m))", 2, None), ("all(values(m), #.t != null)", False, None), ("some(values(m), #.t == 'y')", True, None),
    ("one(list, # == 'a')", True, False), ("all(values(m), len(#.name) >= 1 and some(list, # == 'b'))", True, None), ("date(o.day) - date(now())", 28, None), ("month(date(o.day)) in [1, 2]", True, None), ("weekday(date(o.day))", 4, None), ("date(o.day).year", 2024, None),
    ("number('1.5') * 2", 3.0, 3.0), ("number('no')", None, None), ("s in ['x', 'y']", True, None), ("n in [1..3]", True, None), ("n not in [2, 3]", True, None), ("['a', s]", ["a", "x"], ["a", None]), ("[]", [], []), ("-n + 10 % 4", 1, None),
    ("'it''s'", "it''s", "it''s"), ("'You're late'", "You're late", "You're late"), ("'back\\\\slash'", "back\\\\slash", "back\\\\slash"), ("m.p.name", "Ann", None), (True, True, True), (3, 3, 3), (None, None, None),
]
CONDITIONS = [
    ("n", "1", 1, 0), ("n", "< 2", 1, 0), ("n", "> 0 && <= 1", 1, 0), ("n", "> 0 and < 1", 0, 0), ("n", "[1..2]", 1, 0), ("n", "(1..2]", 0, 0), ("n", "[0..1)", 0, 0), ("n", "1, 5", 1, 0), ("n", "< 0 or == 1", 1, 0), ("n", "!= 1", 0, 1), ("n", "== null", 0, 1), ("n", "null", 0, 1), ("m", "!= null", 1, 0), ("n", "2 - 1", 1, 0),
    ("s", "'x'", 1, 0), ("s", "in ['x', 'z']", 1, 0), ("s", "not in ['x', 'z']", 0, 1), ("s", "o.k", 0, 1), ("s", "'o', 'x'", 1, 0), ("b", "true", 1, 0), ("b", True, 1, 0), ("b", False, 0, 0), ("n", "$ + 1 == 2", 1, 0), ("n", "", 1, 1), ("n", "-", 1, 1), ("n", None, 1, 1), ("gone", "== null", 1, 1), ("gone", "'x'", 0, 0), (None, "n == 1", 1, 0),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA).coalesce(1)


def test_values(rows):
    cells = models.Cells(rows)
    got = rows.select(*[F.expr(cells.value(c)).alias(f"c{i}") for i, (c, _, _) in enumerate(VALUES)]).orderBy(F.desc_nulls_last("c0")).collect()
    for i, (cell, first, second) in enumerate(VALUES):
        assert (cell, got[0][i], got[1][i]) == (cell, first, second)


def test_conditions(rows):
    cells = models.Cells(rows)
    got = rows.orderBy(F.desc_nulls_last("n")).select(*[F.when(F.expr(cells.condition(c, f)), 1).otherwise(0).alias(f"c{i}") for i, (f, c, _, _) in enumerate(CONDITIONS)]).collect()
    for i, (field, cell, first, second) in enumerate(CONDITIONS):
        assert (field, cell, got[0][i], got[1][i]) == (field, cell, first, second)


@pytest.mark.parametrize("cell", ["n +", "(n", "n ? 1", "# == 1", "nothing(n)", "n @ 1", "", "1, 2", "n and", "all(list, )"])
def test_what_cannot_be_read(rows, cell):
    with pytest.raises(ModelError):
        models.Cells(rows).value(cell)


def expressions(**given):
    return {"expressions": [{"key": k.replace("__", "."), "value": v} for k, v in given.items()]}


def test_columns_in_order_of_need(rows):
    out = models.expression_node(rows, expressions(a__z="a.y + 1", a__y="b2 * 2", b2="n + 1", n="n + 10", o__k="'new'", o__q="1"))
    first = out.where("s = 'x'").select("a.*", "b2", "n", "o.*").first().asDict()
    assert first == {"z": 25, "y": 24, "b2": 12, "n": 11, "k": "new", "day": "2024-02-29", "q": 1}
    assert out.count() == 2
    assert models.expression_node(rows, expressions(x__y="1") | {"passThrough": False}).columns == ["x"]
    with pytest.raises(ModelError, match="a cycle of a, b"):
        models.expression_node(rows, expressions(a="b.c", b="a + 1", c="1"))


def test_tables(rows):
    t = {
        "hitPolicy": "first", "inputs": [{"id": "i", "field": "n"}, {"id": "j"}], "outputs": [{"id": "x", "field": "x"}, {"id": "y", "field": "y"}],
        "rules": [{"i": "> 5", "x": "'never'", "y": "1"}, {"i": "1", "j": "s == 'x'", "x": "s", "y": "0.5"}, {"_id": "r", "j": "", "x": "", "y": "2"}],
    }
    got = lambda df: [r.d for r in df.orderBy(F.desc_nulls_last("n")).collect()]
    assert [tuple(x) for x in got(rows.withColumn("d", models.decision(rows, t)))] == [("x", 0.5), (None, 2.0)]
    both = got(rows.withColumn("d", models.decision(rows, t | {"hitPolicy": "collect"})))
    assert [[tuple(x) for x in xs] for xs in both] == [[("x", 0.5), (None, 2.0)], [(None, 2.0)]]
    assert got(rows.withColumn("d", models.decision(rows, t | {"rules": []}))) == [None, None]
    assert got(rows.withColumn("d", models.decision(rows, t | {"rules": [], "hitPolicy": "collect"}))) == [[], []]
    assert models.decision(rows.limit(0), t) is not None


def test_models_are_read_in_the_order_of_their_edges(rows):
    text = """{"nodes": [{"id": "3", "name": "third", "type": "expressionNode", "content": {"expressions": [{"key": "q", "value": "p + 1"}]}}, {"id": "1", "name": "in", "type": "inputNode"},
        {"id": "2", "name": "second", "type": "expressionNode", "content": {"expressions": [{"key": "p", "value": "n + 1"}]}}], "edges": [{"sourceId": "1", "targetId": "2"}, {"sourceId": "2", "targetId": "3"}]}"""
    nodes = models.load_model(text)
    assert list(nodes) == ["second", "third"]
    for node in nodes.values():
        rows = models.evaluate(rows, node)
    assert sorted(r.q for r in rows.where("n = 1").collect()) == [3]
