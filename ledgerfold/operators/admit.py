"""Admission of commands in batch: each command of each aggregate, in order, gives events or one error code.

Guards that only look back (started, completed, a slot's first subject) are windows. An accepted capture enables later commands, so what a
slot is depends on earlier verdicts; the first capture of a slot after Start and before Complete is always accepted and binds it for good, which
makes that a window too: no sequential code runs, and an aggregate of any length is handled by a sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import documents
from .classify import INVALID, AttributeSchema, classify_changes, rejections


def admit(commands: DataFrame, schema: AttributeSchema) -> DataFrame:
    """commands (see sources.samples.commands) with error (null if accepted), slot_subject (what the command's slot is bound to), from_step and forgets (of an accepted
    ForgetSubject: does the subject have a slot that it hadn't forgotten before? Such a command is accepted on completed journeys too, and without such a slot it gives no event)."""
    order = Window.partitionBy("aggregate_id").orderBy("sequence")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    never = F.lit(False)
    c = commands.withColumn("started", F.coalesce(F.max(F.col("command") == "Start").over(before), never))
    complete = (F.col("command") == "Complete") & F.col("started")
    c = c.withColumn("completed", F.coalesce(F.max(complete).over(before), never))
    live = F.col("started") & ~F.col("completed")
    slot = Window.partitionBy("aggregate_id", "person_ref").orderBy("sequence").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bound = F.first(F.when((F.col("command") == "CapturePerson") & live, F.col("subject_id")), ignorenulls=True).over(slot)
    first = F.min(F.when((F.col("command") == "CapturePerson") & live & F.col("subject_id").isNotNull(), F.col("sequence"))).over(slot)
    c = c.withColumn("slot_subject", F.when(F.col("person_ref").isNotNull(), bound)).withColumn("binds", F.when(first == F.col("sequence"), F.col("sequence")))
    forget = (F.col("command") == "ForgetSubject") & F.col("started")
    mine = Window.partitionBy("aggregate_id", "subject_id").orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1)
    since = F.coalesce(F.max(F.when(forget, F.col("sequence"))).over(mine), F.lit(-1))
    c = c.withColumn("forgets", F.when(forget, F.coalesce(F.max("binds").over(mine) > since, never))).drop("binds")
    kind = F.when(F.col("path").isNotNull(), schema.classify(F.col("path")))
    error = (
        F.when((F.col("command") == "SetAttributes") & (kind == INVALID), "InvalidJsonPointer")  # never gets as far as a journey
        .when(F.col("command") == "Start", F.when(F.col("started"), "AlreadyStarted"))
        .when(~F.col("started"), "NotFound")
        .when(F.col("command") == "ForgetSubject", F.lit(None).cast("string"))
        .when(F.col("completed"), "AlreadyCompleted")
        .when(F.col("command") == "CapturePerson", F.when(F.col("slot_subject") != F.col("subject_id"), "PersonRefConflict"))
        .when(F.col("command") == "CapturePersonDetails", F.when(F.col("slot_subject").isNull(), "PersonNotFound"))
        .when(
            F.col("command") == "SetAttributes",
            F.when(F.col("path").isNull(), "InvalidData").when(kind == "unknown", "UnknownAttributePath").when((kind == "secret") & F.col("slot_subject").isNull(), "PersonNotFound"),
        )
    )
    c = c.withColumn("error", error)
    moved = F.when((F.col("command") == "Capture") & F.col("error").isNull(), F.col("step"))
    return c.withColumn("from_step", F.last(moved, ignorenulls=True).over(before))


def admit_change_sets(commands: DataFrame, schema: AttributeSchema) -> DataFrame:
    """SetAttributes commands with error, unknown_paths (all of them, sorted) and unbound_ref (of the first secret in path order whose slot no accepted capture has
    bound before). commands has changes, an array of (path, value), beside the columns of admit; a path that is no pointer comes first, then the guards, an empty set, unknown paths and unbound secrets."""
    key = ["aggregate_id", "sequence"]
    c = admit(commands.drop("changes"), schema)
    slots = c.where("command = 'CapturePerson' and started and not completed").select("aggregate_id", "person_ref", "subject_id", F.col("sequence").alias("captured_at"))
    sets = commands.where("command = 'SetAttributes'").select(*key, F.size("changes").alias("n"))
    changes = commands.where("command = 'SetAttributes'").select(*key, F.explode("changes").alias("x")).select(*key, "x.path", "x.value")
    refused = rejections(classify_changes(changes, slots, schema)).withColumnRenamed("error", "refusal")
    out = c.where("command = 'SetAttributes'").select(*key, "started", "completed").join(sets, key).join(refused, key, "left")
    error = F.when(F.col("refusal") == "InvalidJsonPointer", F.col("refusal")).when(~F.col("started"), "NotFound").when(F.col("completed"), "AlreadyCompleted").when(F.coalesce("n", F.lit(0)) < 1, "InvalidData").otherwise(F.col("refusal"))
    out = out.withColumn("error", error)
    return out.select(*key, "error", F.when(F.col("error") == "UnknownAttributePath", F.col("unknown_paths")).alias("unknown_paths"), F.when(F.col("error") == "PersonNotFound", F.col("unbound_ref")).alias("unbound_ref"))


def admit_data(commands: DataFrame, schema: AttributeSchema, json_schema: dict) -> DataFrame:
    """All of admit's columns with data taken into account: commands has changes (array of (path, JSON text)) and data (a Capture's JSON text) beside the columns of admit. After the
    guards and the paths, a Capture's data is validated by itself, and plaintext changes are merged with what the accepted commands before left and validated
    then: InvalidData, or InvalidJsonPointer where a path doesn't fit an array. reasons says what was wrong."""
    key = ["aggregate_id", "sequence"]
    guards = admit(commands.withColumn("path", F.lit(None).cast("string")), schema).drop("from_step")
    sets = admit_change_sets(commands.withColumn("path", F.lit(None).cast("string")), schema)
    c = guards.withColumnRenamed("error", "guard").join(sets.withColumnRenamed("error", "set_error"), key, "left")
    c = c.withColumn("error", F.when(F.col("command") == "SetAttributes", F.col("set_error")).otherwise(F.col("guard"))).drop("guard", "set_error", "path")
    plain = F.filter("changes", lambda x: schema.classify(x["path"]) == "plaintext")
    todo = c.where(F.col("error").isNull() & F.col("command").isin("Capture", "SetAttributes")).withColumn("writes", F.when(F.col("command") == "SetAttributes", plain))
    refused = documents.refusals(todo.where("command = 'Capture' or size(writes) > 0"), json_schema)
    c = c.join(refused, key, "left").withColumn("error", F.coalesce("error", "refusal")).drop("refusal")
    before = Window.partitionBy("aggregate_id").orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1)
    moved = F.when((F.col("command") == "Capture") & F.col("error").isNull(), F.col("step"))
    return c.withColumn("from_step", F.last(moved, ignorenulls=True).over(before))


def emitted(admitted: DataFrame) -> DataFrame:
    """The events of accepted commands: aggregate_id, sequence (of the command), n (place among its events), event_type, person_ref, subject_id."""
    name = lambda *types: F.array(*[F.lit(t) for t in types])
    events = (
        F.when(F.col("command") == "Start", name("JourneyOpened"))
        .when(F.col("command") == "CapturePerson", name("PersonCaptured"))
        .when(F.col("command") == "CapturePersonDetails", name("PersonDetailsUpdated"))
        .when(F.col("command") == "SetAttributes", name("AttributesSet", "WorkflowEvaluated"))
        .when(F.col("command") == "Complete", name("JourneyClosed"))
        .when(F.col("command") == "ForgetSubject", F.when(F.col("forgets"), name("SubjectForgotten")))
        .when(F.col("step").eqNullSafe(F.col("from_step")), name("JourneyModified", "WorkflowEvaluated"))
        .otherwise(name("JourneyModified", "WorkflowEvaluated", "StepProgressed"))
    )
    return admitted.where("error is null").select("aggregate_id", "sequence", F.posexplode(events).alias("n", "event_type"), "person_ref", F.coalesce("subject_id", "slot_subject").alias("subject_id"))


def error_summary(admitted: DataFrame) -> DataFrame:
    return admitted.where("error is not null").groupBy("command", "error").agg(F.count(F.lit(1)).alias("n"))


def forget_events(requests: DataFrame, slots: DataFrame) -> DataFrame:
    """One SubjectForgotten for each (aggregate, subject) with a slot that isn't forgotten yet; repeated requests give none."""
    live = slots.where("not forgotten").select("aggregate_id", "subject_id").distinct()
    return live.join(requests.select("subject_id").distinct(), "subject_id", "left_semi").select("aggregate_id", "subject_id")
