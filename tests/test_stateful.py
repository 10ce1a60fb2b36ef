"""State by parts: streams end where batch does, however their events come."""

import json
import random
import time

import pytest
from ledgerfold.operators import fold
from ledgerfold.sources import event_log, samples
from ledgerfold.streaming import stateful
from ledgerfold.streaming import store as st
from pyspark.sql import functions as F

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    stateful.use_rocksdb(spark)
    yield
    spark.conf.set(name, before)


def modified(data):
    return "JourneyModified", json.dumps({"Modified": {"step": "s", "data": data}})


def assigned(plain):
    return "AttributesSet", json.dumps({"AttributesSet": {"plaintext": plain}})


def random_log(seed, n):
    rng = random.Random(seed)
    values = [1, "x", None, [1, 2], [], {}, {"k": "v"}, {"k": None}, {"deep": {"q": [1]}}, 1.5, True]
    pointers = ["/n", "/list/-", "/list/0", "/list/1", "/list/7", "/list", "/o/k", "/o/deep/z", "/a~1b", "/list/x", "/o/l/0/-", "/é/-"]
    for agg in ("a", "b", "c"):
        for seq in range(1, n + 1):
            if rng.random() < 0.4:
                yield agg, seq, *modified({rng.choice(["n", "list", "o", "a/b", "é"]): rng.choice(values) for _ in range(rng.randint(0, 2))})
            else:
                yield agg, seq, *assigned({p: rng.choice(values) for p in rng.sample(pointers, rng.randint(1, 2))})


def log(spark, rows):
    base = [("journey", a, s, kind, "1.0", payload, "2020-01-01 00:00:00") for a, s, kind, payload in rows]
    return spark.createDataFrame(base, event_log.ENVELOPE.replace("timestamp timestamp", "timestamp string")).withColumn("timestamp", F.col("timestamp").cast("timestamp"))


def found(rows):
    return {r.aggregate_id: json.loads(r.document) for r in rows.collect()}


def full(docs):
    return {k: v for k, v in docs.items() if v}  # a journey without attributes has no document, or an empty one


def folded(spark, parts, where):
    """The rows of a stream that was restarted for each of parts."""
    got = []
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(f"{where}/log")
        st.run_available(stateful.fold_bags(event_log.stream_log(spark, f"{where}/log")), lambda b, _: got.extend(b.collect()), f"{where}/c", "update")
    return spark.createDataFrame(got, stateful.BAGS)


def test_bags_of_random_logs(spark, tmp_path):
    events = log(spark, list(random_log(7, 24))).cache()
    want = full(found(fold.fold_documents(events)))
    assert len(want) == 3
    parts = [events.where(p) for p in ("sequence <= 5", "sequence between 4 and 13", "sequence > 13")]
    rows = folded(spark, parts, str(tmp_path / "three"))
    assert full(found(stateful.bags(rows))) == want
    assert full(found(stateful.bags(folded(spark, [events], str(tmp_path / "one"))))) == want
    last = {r.aggregate_id: r for r in rows.orderBy("version").collect()}
    assert {(r.version, r.n_repeated, r.n_gaps) for r in last.values()} == {(24, 2, 0)}
    assert sum(r.n_failed for r in last.values()) > 0


def test_bags_of_the_sample_log(spark, tmp_path):
    events = samples.event_log(spark, DIR)
    rows = folded(spark, [events], str(tmp_path))
    assert full(found(stateful.bags(rows))) == full(found(fold.fold_documents(events)))
    same = ["aggregate_id", "state", "current_step", "phase", "version"]
    assert sorted(map(tuple, rows.select(*same).collect()), key=repr) == sorted(map(tuple, fold.fold_scalars(events).select(*same).collect()), key=repr)


def test_bags_with_odd_events(spark, tmp_path):
    deep = "[" * 50_000 + "]" * 50_000
    rows = [("a", 1, "JourneyModified", "{"), ("a", 2, "JourneyModified", None), ("a", 3, "AttributesSet", '{"AttributesSet":{"plaintext":{"/x":' + deep + "}}}"), ("a", 4, *modified({"x": 1})), ("a", 6, "Else", "{}"), ("b", 1, *modified({"y": None}))]
    got = folded(spark, [log(spark, rows)], str(tmp_path))
    assert found(stateful.bags(got)) == {"a": {"x": 1}}
    assert {(r.aggregate_id, r.version, r.n_gaps, r.n_failed) for r in got.collect()} == {("a", 6, 1, 2), ("b", 1, 0, 0)}
    assert stateful.bags(spark.createDataFrame([], stateful.BAGS)).count() == 0


def test_order_with_a_bound(spark, tmp_path):
    root, got = str(tmp_path / "log"), []
    events = samples.event_log(spark, DIR).where("aggregate_id in ('u1', 'u2', 'u3')").cache()
    want = {(r.aggregate_id, r.sequence): (r.payload, r.timestamp) for r in events.collect()}

    def run(part):
        part.coalesce(1).write.mode("append").parquet(root)
        before = len(got)
        st.run_available(stateful.ordered(event_log.stream_log(spark, root), 1, most=15), lambda b, _: got.extend(b.collect()), str(tmp_path / "c"))
        return got[before:]

    keys = lambda rows, status: [(r.aggregate_id, r.sequence) for r in rows if r.status == status]
    first = run(events.where("sequence > 10 and aggregate_id <> 'u3'"))
    assert set(keys(first, "dead_letter")) == {k for k in want if k[0] != "u3" and k[1] > 25} and len(first) == len(keys(first, "dead_letter"))
    run(events.where("sequence <= 10 or aggregate_id = 'u3' and sequence between 13 and 20"))
    fine = keys(got, "in_order")
    assert set(fine) == {k for k in want if (k[0] != "u3" and k[1] <= 25) or k[1] <= 10} and len(fine) == len(set(fine))
    assert all(want[r.aggregate_id, r.sequence] == (r.payload, r.timestamp) for r in got)
    for a in ("u1", "u2", "u3"):
        mine = [s for k, s in fine if k == a]
        assert mine == sorted(mine)
    time.sleep(3)
    later = run(events.where("aggregate_id = 'u1' and sequence = 1 or aggregate_id = 'u2' and sequence in (25, 26)"))
    assert set(keys(later, "repeated")) == {("u1", 1), ("u2", 25)} & set(want)
    assert set(keys(later, "in_order")) == {("u2", 26)} & set(want)
    assert set(keys(later, "dead_letter")) == {k for k in want if k[0] == "u3" and 13 <= k[1] <= 20}
