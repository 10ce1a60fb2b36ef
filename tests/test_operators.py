"""Golden cases and properties of the log operators."""

import hashlib
import hmac
import json

import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as hs
from ledgerfold.functions import paths
from ledgerfold.operators import admit, classify, documents, fold, keys, pii, rules, validate, views
from ledgerfold.sources import event_log
from pyspark.sql import functions as F


def flat(doc, at=""):
    if isinstance(doc, dict):
        for k, v in doc.items():
            yield from flat(v, f"{at}/{k.replace('~', '~0').replace('/', '~1')}")
    elif isinstance(doc, list):
        for i, v in enumerate(doc):
            yield from flat(v, f"{at}/{i}")
    elif at:
        yield at, doc


LEAF = hs.none() | hs.integers(-99, 99) | hs.text("ab~/", max_size=3)
DOCS = hs.dictionaries(hs.text("ab~/", max_size=2), hs.recursive(LEAF, lambda c: hs.lists(c, max_size=3) | hs.dictionaries(hs.text("xy", max_size=2), c, max_size=3), max_leaves=5), max_size=4)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(hs.lists(DOCS, min_size=1, max_size=6))
def test_flatten(spark, docs):
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "id long, doc string")
    got = sorted((r.id, r.path, r.value) for r in paths.flatten(df, "doc", ["id"]).fillna("null", ["value"]).collect())
    want = sorted((i, p, "null" if v is None else str(v)) for i, d in enumerate(docs) for p, v in flat(d))
    assert got == want


def test_flatten_at_any_depth(spark):
    deep = lambda leaf, n: leaf if n == 0 else '{"a/b":[' + deep(leaf, n - 1) + "]}"
    leaves = {"1.50": "1.5", "12": "12", '"x \\"é"': 'x "é', "true": "true", "null": None, "1e3": "1000.0"}
    want = {leaf: paths.flatten(spark.createDataFrame([(f'{{"k":{leaf}}}',)], "doc string"), "doc", []).first() for leaf in leaves}
    for n in (2, 4, 5, 20):
        got = paths.flatten(spark.createDataFrame([(leaf, deep(leaf, n)) for leaf in leaves] + [("{}", deep("{}", n))], "id string, doc string"), "doc", ["id"]).collect()
        assert {(r.id, r.path, r.value, r.is_null) for r in got} == {(leaf, "/a~1b/0" * n, w.value, w.is_null) for leaf, w in want.items()}


def test_flatten_edges(spark):
    df = spark.createDataFrame([(1, "5"), (2, '{"a":{},"b":[],"c":null}'), (3, None), (4, "no json"), (5, '"Completed"')], "id long, doc string")
    assert [tuple(r) for r in paths.flatten(df, "doc", ["id"]).collect()] == [(2, "/c", None, True)]


def test_pointers(spark):
    row = spark.range(1).select(
        paths.tokens(F.lit("/a~1b/~0c/0")).alias("t"), paths.from_tokens(F.array(F.lit("a/b"), F.lit("~c"))).alias("p"), paths.tokens(F.lit("")).alias("none"),
        paths.strip_prefix(F.lit("/persons/p1/name"), F.lit("/persons/p1")).alias("below"), paths.strip_prefix(F.lit("/persons/p12"), F.lit("/persons/p1")).alias("other"), paths.ancestors(F.lit("/a/b/c")).alias("up"),
    ).first()
    assert (row.t, row.p, row.none, row.below, row.other, row.up) == (["a/b", "~c", "0"], "/a~1b/~0c", [], "/name", None, ["/a", "/a/b"])


def assign(state, path, value, op):
    for p in [p for p in state if p.startswith(path + "/") or path.startswith(p + "/") or p == path]:
        del state[p]
    if op == "set":
        state[path] = value


WRITES = hs.lists(hs.tuples(hs.sampled_from(["/a", "/a/b", "/a/b/c", "/a/d", "/e", "/e/f"]), hs.sampled_from(["set", "set", "delete", "reset"])), min_size=1, max_size=12)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(WRITES, hs.integers(0, 12))
def test_last_writes_and_snapshots(spark, writes, cut):
    data = [("j", n + 1, 0, p, str(n), op) for n, (p, op) in enumerate(writes)]
    df = spark.createDataFrame(data, "aggregate_id string, sequence long, part int, path string, value string, op string")
    state = {}
    for _, n, _, p, v, op in data:
        assign(state, p, v, op)
    got = {r.path: r.value for r in paths.last_writes(df, ["aggregate_id"], fold.ORDER).collect()}
    assert got == state
    head = paths.last_writes(df.where(F.col("sequence") <= cut), ["aggregate_id"], fold.ORDER)
    stored = head.select("aggregate_id", F.lit(cut).cast("long").alias("sequence"), F.lit(0).alias("part"), "path", "value", F.lit("set").alias("op"))
    resumed = paths.last_writes(stored.unionByName(df.where(F.col("sequence") > cut)), ["aggregate_id"], fold.ORDER)
    assert {r.path: r.value for r in resumed.collect()} == state


def log_of(spark, rows):
    return spark.createDataFrame([("journey", a, s, t, "1.0", p) for a, s, t, p in rows], "aggregate_type string, aggregate_id string, sequence long, event_type string, event_version string, payload string").withColumn("timestamp", F.timestamp_seconds("sequence"))


def test_fold_of_objects_and_nulls(spark):
    log = log_of(spark, [
        ("a", 1, "JourneyOpened", '{"Started":{"id":"a"}}'),
        ("a", 2, "AttributesSet", '{"AttributesSet":{"plaintext":{"/x":{"y":1,"z":[1,2]},"/n":null},"secret_partitions":[]}}'),
        ("a", 3, "JourneyModified", '{"Modified":{"step":"s","data":{"x":{"y":null},"w":"t"}}}'),
        ("a", 4, "AttributesSet", '{"AttributesSet":{"plaintext":{"/x/z":"scalar"}}}'),
        ("a", 5, "WorkflowEvaluated", '{"WorkflowEvaluated":{"suggested_actions":["go","stop"]}}'),
        ("a", 6, "JourneyClosed", '"Completed"'),
    ])
    assert {r.path: r.value for r in fold.fold_bag(log).collect()} == {"/n": None, "/w": "t", "/x/z": "scalar"}
    s = fold.fold_scalars(log).first()
    assert (s.state, s.phase, s.actions, s.version, s.started) == ("Complete", None, ["go", "stop"], 6, True)
    early = {r.path: r.value for r in fold.fold_bag(fold.as_of(log, spark.createDataFrame([("a", 2)], "aggregate_id string, upto long"))).collect()}
    assert early == {"/n": None, "/x/y": "1", "/x/z/0": "1", "/x/z/1": "2"}
    assert [tuple(r) for r in event_log.sequence_gaps(log.where("sequence <> 3")).collect()] == [("a", 4, "gap")]


def merge_patch(target, patch):
    """RFC 7396."""
    if not isinstance(patch, dict):
        return patch
    target = dict(target) if isinstance(target, dict) else {}
    for k, v in patch.items():
        if v is None:
            target.pop(k, None)
        else:
            target[k] = merge_patch(target.get(k), v)
    return target


KEYS = hs.sampled_from(["x", "y", "0", "a/b"])
PATCHES = hs.dictionaries(KEYS, hs.recursive(hs.none() | hs.integers(0, 9), lambda c: hs.lists(c, max_size=3) | hs.dictionaries(KEYS, c, max_size=3), max_leaves=6), max_size=3)


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck), phases=[Phase.explicit, Phase.generate], derandomize=True)
@given(hs.lists(hs.lists(PATCHES, min_size=1, max_size=5), min_size=20, max_size=40), hs.integers(1, 4))
def test_merge_patches_of_arrays_and_empty_nodes(spark, journeys, cut):
    """A journey of patches each, replayed whole and from a snapshot."""
    rows = [(f"j{j}", n + 1, "JourneyModified", json.dumps({"Modified": {"step": "s", "data": d}})) for j, docs in enumerate(journeys) for n, d in enumerate(docs)]
    want = set()
    for j, docs in enumerate(journeys):
        state = {}
        for d in docs:
            state = merge_patch(state, d)
        want |= {(f"j{j}", p, None if v is None else str(v)) for p, v in flat(state)}
    log = log_of(spark, rows)
    assert {(r.aggregate_id, r.path, r.value) for r in fold.fold_bag(log).collect()} == want
    last, bag = fold.snapshot(log.where(F.col("sequence") <= cut))
    assert {(r.aggregate_id, r.path, r.value) for r in fold.resume(last, bag, log.where(F.col("sequence") > cut)).collect()} == want


def test_patches_and_assignments_replace_each_other(spark):
    cases = {
        "array over array": (['{"x":[1,2,3]}', '{"x":[9]}'], {"/x/0": "9"}),
        "empty array": (['{"x":[1,2]}', '{"x":[]}'], {}),
        "empty object over a scalar": (['{"x":1,"y":2}', '{"x":{}}'], {"/y": "2"}),
        "object over an array": (['{"x":[1,2]}', '{"x":{"k":3}}'], {"/x/k": "3"}),
        "object over an object": (['{"x":{"0":1}}', '{"x":{"k":3}}'], {"/x/0": "1", "/x/k": "3"}),
    }
    rows = [(name, n + 1, "JourneyModified", f'{{"Modified":{{"step":"s","data":{d}}}}}') for name, (docs, _) in cases.items() for n, d in enumerate(docs)]
    assign = lambda n, d: ("assigned", n, "AttributesSet", f'{{"AttributesSet":{{"plaintext":{d}}}}}')
    rows += [assign(1, '{"/a":{"b":[1,2],"c":1},"/a/c":2}'), assign(2, '{"/a/b":[3]}'), assign(3, '{"/d/e/f":{}}'), assign(4, '{"/d/e":null}')]
    cases["assigned"] = (None, {"/a/b/0": "3", "/a/c": "2", "/d/e": None})
    got = {}
    for r in fold.fold_bag(log_of(spark, rows)).collect():
        got.setdefault(r.aggregate_id, {})[r.path] = r.value
    assert got == {name: want for name, (_, want) in cases.items() if want}


def test_classification_order(spark):
    schema = classify.AttributeSchema.load({"plaintext_prefixes": ["search"], "namespace_patterns": {"persons": {"plaintext": ["kind", "both"], "secret": ["name", "both"]}}, "exact": {"/search/code": "secret"}})
    cases = {"/search/a": "plaintext", "/search/code": "secret", "/persons/p/name": "secret", "/persons/p/both": "plaintext", "/persons/p/name/x": "unknown", "/persons/p": "unknown", "/other": "unknown"}
    df = spark.createDataFrame([(p,) for p in cases], "path string").select("path", schema.classify(F.col("path")).alias("c"))
    assert {r.path: r.c for r in df.collect()} == cases
    assert spark.range(1).select(classify.AttributeSchema.load(None).classify(F.lit("/other"))).first()[0] == "plaintext"


CMD = "aggregate_id string, sequence long, command string, person_ref string, subject_id string, path string, step string, amount double"


def test_admission(spark):
    c = [
        ("a", 1, "Complete"), ("a", 2, "Start"), ("a", 3, "Start"), ("a", 4, "CapturePerson", "p", "s1"), ("a", 5, "CapturePerson", "p", "s2"), ("a", 6, "CapturePersonDetails", "q"),
        ("a", 7, "SetAttributes", "p", None, "/persons/p/firstName"), ("a", 8, "SetAttributes", "q", None, "/persons/q/firstName"), ("a", 9, "SetAttributes"), ("a", 10, "SetAttributes", None, None, "/bad"),
        ("a", 11, "Capture", None, None, None, "x"), ("a", 12, "Capture", None, None, None, "x"), ("a", 13, "Complete"), ("a", 14, "Complete"), ("a", 15, "Capture", None, None, None, "y"),
    ]
    df = spark.createDataFrame([(*r, *[None] * (8 - len(r))) for r in c], CMD)
    done = admit.admit(df, classify.BOOKING)
    errors = [r.error for r in done.orderBy("sequence").collect()]
    assert errors == ["NotFound", None, "AlreadyStarted", None, "PersonRefConflict", "PersonNotFound", None, "PersonNotFound", "InvalidData", "UnknownAttributePath", None, None, None, "AlreadyCompleted", "AlreadyCompleted"]
    events = [(r.sequence, r.event_type) for r in admit.emitted(done).orderBy("sequence", "n").collect() if r.sequence in (11, 12)]
    assert events == [(11, "JourneyModified"), (11, "WorkflowEvaluated"), (11, "StepProgressed"), (12, "JourneyModified"), (12, "WorkflowEvaluated")]


FULL = {"tripType": "one-way", "origin": "A", "destination": "B", "departureDate": "d", "passengers": {"adults": 1, "children": 0}}
DATA = CMD + ", changes array<struct<path string, value string>>, data string"


def test_admission_with_data(spark):
    sets = lambda *w: [(p, None if v is None else json.dumps(v)) for p, v in w]
    c = [
        (1, "Start", None, None), (2, "SetAttributes", sets(("/search/origin", "A")), None), (3, "SetAttributes", sets(("/search", FULL)), None), (4, "SetAttributes", sets(("/search/origin", "C")), None),
        (5, "SetAttributes", sets(("/search/passengers/adults", -1)), None), (6, "SetAttributes", sets(("/booking/list", [1]), ("/booking/list/1", 2)), None), (7, "SetAttributes", sets(("/booking/list/3", 2)), None),
        (8, "SetAttributes", sets(("/booking/list/x", 2), ("/search/passengers/adults", -1)), None), (9, "SetAttributes", sets(("/booking/list/x", 2), ("/bad", 1)), None), (10, "SetAttributes", [], None),
        (11, "Capture", None, '{"search":{"origin":"A"}}'), (12, "Capture", None, '{"search":null}'), (13, "Capture", None, None), (14, "Capture", None, '{"booking":{"list":null}}'),
        (15, "SetAttributes", sets(("/booking/list/7", 2)), None), (16, "SetAttributes", [("/search/x", "no json")], None), (17, "SetAttributes", sets(("/booking/n", None)), None),
        (18, "SetAttributes", None, None), (19, "Complete", None, None), (20, "Capture", None, "{}"),
    ]
    rows = [("a", n, cmd, None, None, None, f"s{n}" if cmd == "Capture" else None, None, w, d) for n, cmd, w, d in c]
    rows += [("b", 1, "SetAttributes", None, None, None, None, None, sets(("/search", FULL)), None), (None, 1, "Start", *[None] * 7)]
    done = admit.admit_data(spark.createDataFrame(rows, DATA).repartition(3), classify.BOOKING, validate.BOOKING)
    got = {r.sequence: (r.error, r.from_step) for r in done.where("aggregate_id = 'a'").collect()}
    bad, pointer = "InvalidData", "InvalidJsonPointer"
    want = [None, bad, None, None, bad, None, pointer, pointer, "UnknownAttributePath", bad, bad, bad, bad, None, None, bad, None, bad, None, "AlreadyCompleted"]
    assert [got[n][0] for n in range(1, 21)] == want
    assert got[14][1] is None and got[15][1] == "s14"  # refused captures move no step
    assert [r.error for r in done.where("aggregate_id = 'b'").collect()] == ["NotFound"]
    assert done.count() == len(rows)
    assert admit.admit_data(spark.createDataFrame([], DATA), classify.BOOKING, validate.BOOKING).count() == 0


@pytest.mark.parametrize(
    ("doc", "pointer", "want"),
    [({}, "/a/0/b", {"a": [{"b": 9}]}), ({}, "/a/1", {"a": {"1": 9}}), ({"a": 1}, "/a/b", {"a": {"b": 9}}), ({"a": [1]}, "/a/-", {"a": [1, 9]}), ({"a": [1]}, "/a/1/0", {"a": [1, [9]]}),
     ({"a": [1]}, "/a/0", {"a": [9]}), ({"a": [1]}, "/a/2", "OutOfBounds"), ({"a": [1]}, "/a/01", "FailedToParseIndex"), ({"a/b": {"~": 1}}, "/a~1b/~0", {"a/b": {"~": 9}}), (None, "", 9), ({"a": None}, "/a/-/x", {"a": [{"x": 9}]})],
)
def test_assignment(doc, pointer, want):
    if isinstance(want, str):
        with pytest.raises(documents.PointerError, match=want):
            documents.assign(doc, pointer, 9)
    else:
        assert documents.assign(doc, pointer, 9) == want


def test_checker_equals_validate(spark):
    schema = {
        "type": "object", "required": ["a"], "additionalProperties": False,
        "properties": {"a": {"type": ["integer", "null"], "minimum": 0, "maximum": 5}, "b": {"type": "array", "items": {"$ref": "#/$defs/s"}}, "c": {"anyOf": [{"type": "null"}, {"$ref": "#/$defs/s"}]}, "d": {"oneOf": [{"type": "number"}, {"type": "integer"}]}, "e": {"enum": ["x", "y"]}},
        "$defs": {"s": {"type": "string", "minLength": 2}},
    }
    values = [None, -1, 3, 9, 1.5, "x", "xyz", True, [], ["ab", "a", 1], {}, {"a": 1}]
    docs = [{k: v} for k in "abcdez" for v in values] + [{"a": 1, k: v} for k in "bcdez" for v in values] + values
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(-1, "{")], "i long, doc string")
    check = documents.checker(schema)
    assert {r.i: r.errors for r in validate.validate(df, "doc", schema).collect()} == {-1: check(documents.BAD), **{i: check(d) for i, d in enumerate(docs)}}


def test_forgetting_twice_is_once(spark):
    slots = spark.createDataFrame([("a", "p", "s1", False), ("a", "q", "s1", False), ("b", "p", "s1", True), ("b", "q", "s2", False)], "aggregate_id string, person_ref string, subject_id string, forgotten boolean")
    req = spark.createDataFrame([("s1",), ("s1",), ("none",)], "subject_id string")
    assert [tuple(r) for r in admit.forget_events(req, slots).collect()] == [("a", "s1")]
    assert admit.forget_events(req, slots.withColumn("forgotten", F.lit(True))).count() == 0


MASTER = {"v1": "aa" * 32, "v2": "bb" * 32}


def test_encryption_erasure_and_moved_ciphertext(spark, tmp_path):
    parts = spark.createDataFrame([("a", 1, "s1", "default", '{"name":"N","email":"E"}'), ("a", 2, "s1", "lead", '{"/persons/lead/x":"1"}'), ("a", 2, "s2", "agent", '{"/persons/agent/x":"2"}')], "aggregate_id string, sequence long, subject_id string, label string, payload string")
    table = spark.createDataFrame([(s, bytearray(hashlib.sha256(s.encode()).digest())) for s in ("s1", "s2")], "subject_id string, data_key binary")
    pii.encrypt(parts, table).write.parquet(str(tmp_path / "sealed"))
    sealed = spark.read.parquet(str(tmp_path / "sealed"))
    status = lambda d: sorted((r.subject_id, r.label, r.status) for r in d.collect())
    assert {r.payload for r in pii.decrypt(sealed, table).collect()} == {r.payload for r in parts.collect()}
    assert status(pii.decrypt(sealed, table.where("subject_id = 's2'"))) == [("s1", "default", "redacted"), ("s1", "lead", "redacted"), ("s2", "agent", "decrypted")]
    assert {s for *_, s in status(pii.decrypt(sealed.withColumn("sequence", F.col("sequence") + 1), table))} == {"failed"}
    with pytest.raises(Exception, match="can't be decrypted"):
        pii.decrypt(sealed.withColumn("label", F.lit("x")), table, strict=True).collect()
    new = spark.createDataFrame([("s1", bytearray(b"k" * 32))], "subject_id string, data_key binary")  # a key made anew after an erasure
    assert ("s1", "lead", "failed") in status(pii.decrypt(sealed, new))
    read = pii.persons_read(pii.decrypt(sealed, table.where("subject_id = 's2'"))).first()
    assert (read.name, read.email, read.phone) == ("[redacted]", "[redacted]", None)
    assert {(r.path, r.value) for r in pii.attributes_read(pii.decrypt(sealed, table.where("subject_id = 's2'"))).collect()} == {("/redacted", "true"), ("/persons/agent/x", "2")}
    assert keys.nonce_reuse(sealed).count() == 0


def test_rotation(spark):
    raw = spark.createDataFrame([("s1", "k1", "v1", bytearray(b"a" * 32)), ("s2", "k2", "v2", bytearray(b"b" * 32))], "subject_id string, key_id string, kek_id string, data_key binary")
    table = keys.wrap(raw, MASTER)
    delta = keys.rewrap(table, "v2", MASTER)
    assert sorted((r.subject_id, r.status) for r in delta.collect()) == [("s1", "rewrapped"), ("s2", "already_current")]
    after = keys.apply_rewrap(table, delta)
    assert {(r.subject_id, bytes(r.data_key)) for r in keys.unwrap(after, {"v2": MASTER["v2"]}).collect()} == {("s1", b"a" * 32), ("s2", b"b" * 32)}
    assert keys.apply_rewrap(keys.shred(table, raw.select("subject_id").limit(1)), delta).count() == 1
    swapped = table.withColumn("key_id", F.lit("other"))
    assert {r.status for r in keys.unwrap(swapped, MASTER).collect()} == {"failed"}
    assert {r.status for r in keys.unwrap(table, {"v9": MASTER["v1"]}).collect()} == {"unknown_version"}


@pytest.mark.parametrize("key", [b"k", b"x" * 100])
def test_subject_ids(spark, key):
    got = spark.createDataFrame([(" Ann@Example.com ",), ("ann@example.com",)], "email string").select(keys.subject_id(F.col("email"), key).alias("i")).collect()
    mac = bytearray(hmac.new(key, b"ann@example.com", hashlib.sha256).digest()[:16])
    mac[6], mac[8] = mac[6] & 15 | 0x50, mac[8] & 63 | 0x80
    import uuid

    assert {r.i for r in got} == {str(uuid.UUID(bytes=bytes(mac)))}


def test_purge(spark, tmp_path):
    for v in ("v1", "v2"):
        spark.range(1).write.parquet(str(tmp_path / "keys" / v))
    assert keys.purge_old_versions(spark, str(tmp_path / "keys"), "v2") == ["v1"]


def test_codec_rules():
    for bad in ({"secret": {}}, {"secret": {"s": "string"}}, {"secret": {"x": "unheard"}}):
        with pytest.raises((ValueError, KeyError)):
            pii.Codec("E", "s", **bad)


def test_json_schema(spark):
    schema = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"anyOf": [{"$ref": "#/$defs/T"}, {"type": "null"}]}, "c": {"type": "array", "items": {"enum": ["x", "y"]}}}, "$defs": {"T": {"type": "string", "minLength": 2}}}
    cases = {'{"a":1}': "", '{"a":-1}': "/a minimum", "{}": " required:a", '{"a":"x"}': "/a type", '{"a":1,"b":null,"c":["x"]}': "", '{"a":1,"b":"q"}': "/b anyOf", '{"a":1,"c":["x","z"]}': "/c/1 enum", '{"a":1,"d":1}': " additionalProperties", "[]": " type", "{": " json"}
    df = spark.createDataFrame([(k,) for k in cases], "doc string")
    got = {r.doc: ";".join(r.errors) for r in validate.validate(df, "doc", schema).collect()}
    assert got == cases


def test_step_rules(spark):
    df = spark.createDataFrame([("payment", "credit_card", "4111111111111111", "2030-01"), ("payment", "credit_card", "41", "2001-01"), ("payment", None, None, None), ("other", None, None, None)], "step string, payment_type string, card_number string, expiry string").withColumn("as_of", F.to_date(F.lit("2024-06-01")))
    got = [(r.is_valid, len(r.failures), r.validated) for r in validate.validate_steps(df).collect()]
    assert got == [(True, 0, ["paymentMethod", "cardNumber", "expiryDate"]), (False, 2, ["paymentMethod", "cardNumber", "expiryDate"]), (False, 3, ["paymentMethod", "cardNumber", "expiryDate"]), (True, 0, [])]


def test_tables_first_and_collect(spark):
    t = rules.load({"outputs": {"x": "string"}, "rules": [{"when": "v > 5", "then": ["'big'"]}, {"when": "v > 2", "then": ["'mid'"]}, {"then": ["'any'"]}]})
    got = spark.createDataFrame([(9,), (3,), (1,), (None,)], "v int").select(t.first()["x"].alias("f"), F.transform(t.collect(), lambda r: r["x"]).alias("c")).collect()
    assert [(r.f, r.c) for r in got] == [("big", ["big", "mid", "any"]), ("mid", ["mid", "any"]), ("any", ["any"]), ("any", ["any"])]


def test_persons_after_recapture(spark):
    log = spark.createDataFrame([("a", 1, "PersonCaptured", "p", "s1", "N", "E@x", None), ("a", 2, "PersonCaptured", "p", "s9", "M", "[redacted]", "1")], "aggregate_id string, sequence long, event_type string, person_ref string, subject_id string, name string, email string, phone string")
    key = spark.createDataFrame([("s1",)], "subject_id string")
    row = views.persons(log, key).first()
    assert (row.subject_id, row["name"], row.email, row.phone, row.forgotten) == ("s1", "M", None, "1", False)
    gone = views.persons(log, key.where("false")).first()
    assert (gone["name"], gone.forgotten) == (None, True)
