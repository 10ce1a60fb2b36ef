"""Streams end where batch does."""

import time

import pytest
from ledgerfold.operators import admit, classify, fold, keys, validate, views
from ledgerfold.plans import queries
from ledgerfold.sources import event_log, samples
from ledgerfold.streaming import admission, projections
from ledgerfold.streaming import store as st
from ledgerfold.streaming.batches import Batches
from pyspark.sql import functions as F

DIR = "/root/testdata/sf0.001"
HISTORY = ["aggregate_id", "sequence", "actions", "phase", "is_latest"]
SCALARS = ["aggregate_id", "state", "current_step", "phase", "version"]


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("log"))
    log = samples.event_log(spark, DIR)
    for part in ("sequence <= 20", "sequence between 15 and 45", "sequence > 45"):  # the second repeats some of the first
        log.where(part).coalesce(1).write.mode("append").parquet(root)
    return root


def test_project_with_hooks(spark, folder, tmp_path):
    log, models = Batches(spark, str(tmp_path / "log"), st.LOG | {"steps": "aggregate_id string, sequence long"}), projections.model_batches(spark, str(tmp_path / "models"))
    feed = spark.readStream.schema(event_log.ENVELOPE).option("maxFilesPerTrigger", 1).parquet(folder)
    hook = lambda e: {"steps": e.where("event_type = 'StepProgressed'").select("aggregate_id", "sequence")}

    def both(batch, batch_id):
        st.persist_with_hooks(log, [hook])(batch, batch_id)
        projections.project(log, models)(batch_id)

    st.run_available(feed, both, str(tmp_path / "c1"))
    want = samples.event_log(spark, DIR)
    assert log.read("events").count() == want.count() and log.read("events").select("batch_id").distinct().count() > 1
    assert log.read("steps").count() == want.where("event_type = 'StepProgressed'").count()
    names = [*SCALARS, "started", "actions", "created_at", "updated_at", "shared_data"]
    assert rows(projections.journeys(models), *names) == rows(views.journey_documents(want), *names)
    assert rows(projections.workflow_history(models), *HISTORY) == rows(fold.workflow_history(want), *HISTORY)
    last = log.read("events").agg(F.max("batch_id")).first()[0]
    st.persist_with_hooks(log, [hook])(want.where("sequence > 45"), last)  # a batch that runs again gives what it gave
    assert log.read("events").count() == want.count()


def test_failed_hook_writes_nothing(spark, tmp_path):
    log = Batches(spark, str(tmp_path / "log"), st.LOG | {"bad": "x int"})

    def broken(events):
        raise RuntimeError("hook")

    late = lambda e: {"bad": e.select(F.raise_error(F.lit("in a task")).cast("int").alias("x"))}
    for hook in (broken, late):
        with pytest.raises(Exception, match="hook|in a task"):
            st.persist_with_hooks(log, [hook])(samples.event_log(spark, DIR).limit(3), 0)
        assert log.read("events").count() == 0
    with pytest.raises(ValueError):
        log.write(0, {"unknown": spark.range(1)})


def test_read_models_do_not_read_earlier_events(spark, tmp_path):
    log, models = Batches(spark, str(tmp_path / "log"), st.LOG), projections.model_batches(spark, str(tmp_path / "m"))
    everything = samples.event_log(spark, DIR).where("aggregate_id in ('u1', 'u2', 'u3', 'u4', 'u5')").persist()
    parts = ["sequence <= 9 and aggregate_id <> 'u5'", "sequence between 10 and 30 and aggregate_id <> 'u2' or sequence <= 9 and aggregate_id = 'u5'", "sequence > 30 or sequence between 10 and 30 and aggregate_id = 'u2'"]
    names = [*SCALARS, "shared_data"]
    for n, part in enumerate(parts):
        st.persist_with_hooks(log)(everything.where(part), n)
    for n in range(3):
        for _ in range(2 if n == 1 else 1):
            projections.project(log, models)(n)
        done = everything.where(" or ".join(f"({x})" for x in parts[: n + 1]))
        assert rows(projections.journeys(models), *names) == rows(views.journey_documents(done), *names)
        for f in (tmp_path / "log" / f"batch_id={n}").rglob("*.parquet"):
            f.write_bytes(b"not to be read")  # whoever reads a projected batch again fails
        if n == 1:
            models = projections.compact(models, str(tmp_path / "m2"), n)
            assert rows(projections.journeys(models), *names) == rows(views.journey_documents(done), *names)
    assert rows(projections.workflow_history(models), *HISTORY) == rows(fold.workflow_history(everything), *HISTORY)
    everything.unpersist()


def test_read_models_with_late_events(spark, tmp_path):
    log, models = Batches(spark, str(tmp_path / "log"), st.LOG), projections.model_batches(spark, str(tmp_path / "m"))
    everything = samples.event_log(spark, DIR).where("aggregate_id in ('u1', 'u2', 'u3')")
    for n, part in enumerate(("aggregate_id <> 'u1' or sequence > 12 or sequence % 3 = 0", "aggregate_id = 'u1' and sequence <= 12 and sequence % 3 > 0")):
        st.persist_with_hooks(log)(everything.where(part), n)
        projections.project(log, models)(n)
    names = [*SCALARS, "shared_data"]
    assert rows(projections.journeys(models), *names) == rows(views.journey_documents(everything), *names)
    assert rows(projections.workflow_history(models), *HISTORY) == rows(fold.workflow_history(everything), *HISTORY)


def test_fold_stream(spark, folder, tmp_path):
    got = {}

    def keep(batch, _):
        for r in batch.collect():
            got[r.aggregate_id] = r

    st.run_available(st.fold_stream(event_log.stream_log(spark, folder)), keep, str(tmp_path / "c2"), "update")
    want = samples.event_log(spark, DIR)
    assert sorted(((r.aggregate_id, r.state, r.current_step, r.phase, r.version) for r in got.values()), key=repr) == rows(fold.fold_scalars(want), *SCALARS)
    assert sum(r.n_repeated for r in got.values()) == want.where("sequence between 15 and 20").count()


def test_dedupe(spark, folder, tmp_path):
    n = []
    st.run_available(st.dedupe(event_log.stream_log(spark, folder), "10000 days"), lambda b, _: n.append(b.count()), str(tmp_path / "c3"))
    assert sum(n) == samples.event_log(spark, DIR).count()


def test_admission_of_a_stream_equals_batch(spark, tmp_path):
    commands = samples.commands(spark, DIR)
    root = str(tmp_path / "commands")
    for part in ("sequence <= 20", "sequence > 20"):
        commands.where(part).coalesce(1).write.mode("append").parquet(root)
    feed = spark.readStream.schema(commands.schema).option("maxFilesPerTrigger", 1).parquet(root)
    got = []
    st.run_available(admission.admit_stream(feed, classify.BOOKING), lambda b, _: got.extend(map(tuple, b.select("aggregate_id", "sequence", "error").collect())), str(tmp_path / "c4"))
    want = admit.admit(commands, classify.BOOKING)
    assert sorted(got, key=repr) == rows(want, "aggregate_id", "sequence", "error")


def test_admission_of_a_stream_with_data_equals_batch(spark, tmp_path):
    commands = queries._with_data(spark, DIR)
    root = str(tmp_path / "commands")
    for part in ("sequence <= 20", "sequence > 20"):
        commands.where(part).coalesce(1).write.mode("append").parquet(root)
    feed = spark.readStream.schema(commands.schema).option("maxFilesPerTrigger", 1).parquet(root)
    got = []
    stream = admission.admit_stream(feed, classify.BOOKING, validate.BOOKING)
    st.run_available(stream, lambda b, _: got.extend(map(tuple, b.select("aggregate_id", "sequence", "error", "from_step").collect())), str(tmp_path / "c4"))
    want = admit.admit_data(commands, classify.BOOKING, validate.BOOKING)
    assert sorted(got, key=repr) == rows(want, "aggregate_id", "sequence", "error", "from_step")
    events = []
    st.run_available(admit.emitted(admission.admit_stream(feed, classify.BOOKING, validate.BOOKING)), lambda b, _: events.extend(map(tuple, b.collect())), str(tmp_path / "c5"))
    assert sorted(events, key=repr) == rows(admit.emitted(want), "aggregate_id", "sequence", "n", "event_type", "person_ref", "subject_id")


PEOPLE = [
    ("a", 1, "JourneyOpened", '{"Started":{"id":"a"}}'),
    ("a", 2, "PersonCaptured", '{"PersonCaptured":{"person_ref":"p","subject_id":"s1","name":"Ann","email":"Ann@x.org","phone":null}}'),
    ("a", 3, "PersonCaptured", '{"PersonCaptured":{"person_ref":"p","subject_id":"s1","name":"Ann L","email":"AL@x.org","phone":"1"}}'),
    ("a", 4, "WorkflowEvaluated", '{"WorkflowEvaluated":{"suggested_actions":["x"],"phase":"f"}}'),
    ("b", 1, "PersonCaptured", '{"PersonCaptured":{"person_ref":"q","subject_id":"s2","name":"Bo","email":"bo@x.org","phone":null}}'),
    ("b", 2, "SubjectForgotten", '{"SubjectForgotten":{"subject_id":"s2"}}'),
    ("b", 3, "PersonCaptured", '{"PersonCaptured":{"person_ref":"r","subject_id":"s3","name":"[redacted]","email":"[redacted]","phone":null}}'),
]


def people(spark, rows=PEOPLE):
    base = [("journey", a, s, kind, "1.0", payload, "2020-01-01 00:00:00") for a, s, kind, payload in rows]
    return spark.createDataFrame(base, event_log.ENVELOPE.replace("timestamp timestamp", "timestamp string")).withColumn("timestamp", F.col("timestamp").cast("timestamp"))


def test_all_read_models_and_the_lookup_hook(spark, tmp_path):
    log, models = Batches(spark, str(tmp_path / "log"), st.LOG), projections.model_batches(spark, str(tmp_path / "models"))
    for n, part in enumerate(("sequence < 3", "sequence >= 3")):
        st.persist_with_hooks(log, [st.lookup_hook])(people(spark).where(part), n)
        projections.project(log, models)(n)
    got = rows(projections.persons(models), "aggregate_id", "person_ref", "subject_id", "name", "email", "phone", "forgotten")
    assert got == [("a", "p", "s1", "Ann L", "AL@x.org", "1", False), ("b", "q", "s2", None, None, None, True), ("b", "r", "s3", None, None, None, False)]
    assert rows(projections.workflow_history(models), *HISTORY) == [("a", 4, "x", "f", True)]
    assert rows(projections.journeys(models), "aggregate_id", "version") == [("a", 4), ("b", 3)]
    assert rows(log.read("subject_lookup"), "batch_id", "subject_id", "email_lower") == [(0, "s1", "ann@x.org"), (0, "s2", "bo@x.org"), (1, "s1", "al@x.org")]


def test_out_of_order(spark, tmp_path):
    root, got = str(tmp_path / "log"), []
    everything = samples.event_log(spark, DIR).where("aggregate_id in ('u1', 'u2', 'u3')")

    def run(part):
        part.coalesce(1).write.mode("append").parquet(root)
        before = len(got)
        st.run_available(st.ordered(event_log.stream_log(spark, root), 1), lambda b, _: got.extend(b.orderBy("aggregate_id").select("aggregate_id", "sequence", "status", "payload", "timestamp").collect()), str(tmp_path / "c"))
        return got[before:]

    assert run(everything.where("sequence > 10 and aggregate_id <> 'u3'")) == []
    run(everything.where("sequence <= 10 or aggregate_id = 'u3' and sequence > 12"))
    want = {(r.aggregate_id, r.sequence): (r.payload, r.timestamp) for r in everything.collect()}
    fine = [r for r in got if r.status == "in_order"]
    assert {(r.aggregate_id, r.sequence) for r in fine} == {k for k in want if k[0] != "u3" or k[1] <= 10}
    assert all(want[r.aggregate_id, r.sequence] == (r.payload, r.timestamp) for r in got)
    for a in ("u1", "u2", "u3"):
        assert [r.sequence for r in fine if r.aggregate_id == a] == sorted(r.sequence for r in fine if r.aggregate_id == a)
    time.sleep(3)
    later = run(everything.where("aggregate_id = 'u1' and sequence = 1"))  # 11 and 12 of u3 don't come
    assert {(r.aggregate_id, r.sequence, r.status) for r in later} == {("u1", 1, "repeated")} | {(*k, "dead_letter") for k in want if k[0] == "u3" and k[1] > 12}


def test_rewrap_by_schedule(spark, tmp_path):
    master = {"v1": "11" * 32, "v2": "22" * 32, "v3": "33" * 32}
    source, target = str(tmp_path / "keys"), str(tmp_path / "rewrapped")
    table = samples.key_table(spark, DIR, master)
    table.write.parquet(source)
    assert st.rewrap_available(spark, source, target, "v3", master).count() == table.count()
    keys.ensure_keys(spark.createDataFrame([("new",), ("new",), ("c1",), (None,)], "subject_id string"), source, "v2", master)
    made = keys.ensure_keys(spark.createDataFrame([("new",)], "subject_id string"), source, "v2", master)
    assert made.count() == table.count() + 1
    delta = st.rewrap_available(spark, source, target, "v3", master)
    assert rows(delta.groupBy("status").count(), "status", "count") == [("rewrapped", table.count() + 1)]
    after = keys.unwrap(keys.apply_rewrap(made, delta), {"v3": master["v3"]})
    assert rows(after.select("subject_id", "data_key", "status"), "subject_id", "data_key") == rows(keys.unwrap(made, master), "subject_id", "data_key")
    assert after.where("status <> 'unwrapped'").count() == 0


def test_forgetting_in_the_sequence_of_commands(spark, tmp_path):
    """A stream's verdicts and events are those of batch; slots bound after an erasure are forgotten by the next one only, on completed journeys too."""
    names = "aggregate_id string, sequence long, command string, person_ref string, subject_id string, path string, step string"
    rows_of_a = [("ForgetSubject", None, "s"), ("Start", None, None), ("ForgetSubject", None, "s"), ("CapturePerson", "p", "s"), ("CapturePerson", "p", "s"), ("ForgetSubject", None, "s"), ("ForgetSubject", None, "s"), ("CapturePerson", "p", "s"),
                 ("ForgetSubject", None, "s"), ("CapturePerson", "q", "s"), ("CapturePerson", "q", "t"), ("ForgetSubject", None, None), ("Complete", None, None), ("ForgetSubject", None, "t"), ("ForgetSubject", None, "s"), ("ForgetSubject", None, "s")]
    small = spark.createDataFrame([("a", n + 1, *r, None, None) for n, r in enumerate(rows_of_a)], names)
    got = {r.sequence: (r.error, r.forgets) for r in admit.admit(small, classify.BOOKING).where("command = 'ForgetSubject'").collect()}
    assert got == {1: ("NotFound", None), 3: (None, False), 6: (None, True), 7: (None, False), 9: (None, False), 12: (None, False), 14: (None, False), 15: (None, True), 16: (None, False)}
    assert sorted(r.sequence for r in admit.emitted(admit.admit(small, classify.BOOKING)).where("event_type = 'SubjectForgotten'").collect()) == [6, 15]
    commands = queries._forgetting(spark, DIR).select(*small.columns).unionByName(small)
    root = str(tmp_path / "commands")
    for part in ("sequence <= 11", "sequence > 11"):
        commands.where(part).coalesce(1).write.mode("append").parquet(root)
    feed = spark.readStream.schema(commands.schema).option("maxFilesPerTrigger", 1).parquet(root)
    made = []
    st.run_available(admission.admit_stream(feed, classify.BOOKING), lambda b, _: made.extend(map(tuple, b.select("aggregate_id", "sequence", "error", "forgets").collect())), str(tmp_path / "c"))
    assert sorted(made, key=repr) == rows(admit.admit(commands, classify.BOOKING), "aggregate_id", "sequence", "error", "forgets")
