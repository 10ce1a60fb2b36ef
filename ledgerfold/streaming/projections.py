"""Read models kept up by batches of events: what a batch costs depends on the batch and the stored state, not on the log's length.

Scalars, slots and erasures of a batch are partial aggregates that merge with the stored ones (greatest and smallest sequence decide), documents go on
from stored nodes. Each batch appends a version of the journeys that it touched; the latest version of a journey counts, and compact starts a new folder with those alone.
An event that comes after a later one of its journey has been projected can't be merged into a document; such journeys, and only they, are replayed from the log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths, trees
from ..functions.cut import cut
from ..operators import fold
from ..sources import event_log
from .batches import Batches

MODELS = {
    "journeys": "aggregate_id string, complete boolean, started boolean, step struct<at: bigint, name: string>, decision struct<at: bigint, actions: array<string>, phase: string>, version long, created_at timestamp, updated_at timestamp",
    "documents": "aggregate_id string, document string",
    "nodes": "aggregate_id string, path string, value string, arrays array<string>, kind string, json string",
    "slots": "aggregate_id string, person_ref string, bound struct<at: bigint, subject_id: string>, last struct<at: bigint, name: string, email: string, phone: string>",
    "forgotten": "aggregate_id string, subject_id string",
    "decisions": "aggregate_id string, sequence long, actions string, phase string",
}


def model_batches(spark: SparkSession, root: str) -> Batches:
    return Batches(spark, root, MODELS)


def _at(condition: str, *columns) -> F.Column:
    return F.when(F.expr(condition), F.struct(F.col("sequence").alias("at"), *columns))


def states(events: DataFrame) -> DataFrame:
    """The scalars of each journey (MODELS) as far as these parsed events tell."""
    return events.select(
        "aggregate_id", (F.col("event_type") == "JourneyClosed").alias("complete"), (F.col("event_type") == "JourneyOpened").alias("started"),
        _at("event_type = 'StepProgressed'", F.col("to_step").alias("name")).alias("step"), _at("event_type = 'WorkflowEvaluated'", "actions", "phase").alias("decision"),
        F.col("sequence").alias("version"), F.col("timestamp").alias("created_at"), F.col("timestamp").alias("updated_at"),
    )


def merged_states(rows: DataFrame) -> DataFrame:
    greatest = ["complete", "started", "step", "decision", "version"]
    return rows.groupBy("aggregate_id").agg(*[F.max(c).alias(c) for c in greatest], F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"))


def merged_slots(rows: DataFrame) -> DataFrame:
    return rows.groupBy("aggregate_id", "person_ref").agg(F.min("bound").alias("bound"), F.max("last").alias("last"))


def latest(models: Batches, name: str, before: int | None = None, of: DataFrame | None = None) -> DataFrame:
    """The rows of a model in each journey's latest version; with of (aggregate_id), of these journeys. The versions are told by journeys, which each batch writes for all that it
    touched, so rows that a newer version no longer has are gone."""
    heads, rows = models.read("journeys", before), models.read(name, before)
    if of is not None:
        heads, rows = (x.join(of, "aggregate_id", "left_semi") for x in (heads, rows))
    newest = heads.groupBy("aggregate_id").agg(F.max("batch_id").alias("batch_id"))
    return rows.join(newest, ["aggregate_id", "batch_id"], "left_semi").drop("batch_id")


def project(log: Batches, models: Batches) -> Callable[[int], None]:
    """A function of the batch's number: brings all models up to the events that log has of this batch. Run again, it gives the same."""

    def run(batch_id: int) -> None:
        batch = log.read("events", batch_id + 1, batch_id).drop("batch_id")
        extent = batch.groupBy("aggregate_id").agg(F.min("sequence").alias("first"))
        before = latest(models, "journeys", batch_id, extent)
        extent = cut(extent.join(before.select("aggregate_id", F.col("version").alias("last_sequence")), "aggregate_id", "left"))
        late = extent.where("first <= last_sequence").select("aggregate_id")
        known = extent.where("first > last_sequence").select("aggregate_id", "last_sequence")
        if not late.isEmpty():  # the whole log is read for these only
            batch = batch.join(late, "aggregate_id", "left_anti").unionByName(log.read("events", batch_id + 1).drop("batch_id").join(late, "aggregate_id", "left_semi"))
        events = event_log.parse_events(batch)
        stored = lambda name: latest(models, name, batch_id, known)
        captures = events.where("event_type = 'PersonCaptured'")
        slots = captures.select("aggregate_id", "person_ref", _at("true", "subject_id").alias("bound"), _at("true", "name", "email", "phone").alias("last"))
        nodes = cut(fold.resumed_nodes(known, stored("nodes"), batch))
        models.write(
            batch_id,
            {
                "journeys": merged_states(states(events).unionByName(stored("journeys"))),
                "slots": merged_slots(slots.unionByName(stored("slots"))),
                "forgotten": events.where("event_type = 'SubjectForgotten'").select("aggregate_id", "subject_id").unionByName(stored("forgotten")).distinct(),
                "decisions": events.where("event_type = 'WorkflowEvaluated'").select("aggregate_id", "sequence", F.array_join("actions", ",").alias("actions"), "phase"),
                "nodes": nodes,
                "documents": trees.rehydrate(nodes, ["aggregate_id"]),
            },
        )

    return run


def journeys(models: Batches) -> DataFrame:
    """The rows of views.journey_documents."""
    docs = latest(models, "documents").withColumnRenamed("document", "shared_data")
    state = F.when(F.col("complete"), "Complete").otherwise("InProgress").alias("state")
    rows = latest(models, "journeys").select("aggregate_id", state, "started", F.col("step.name").alias("current_step"), "decision.phase", "decision.actions", "version", "created_at", "updated_at")
    return rows.join(docs, "aggregate_id", "left").withColumn("shared_data", F.coalesce("shared_data", F.lit("{}")))


def persons(models: Batches, key_table: DataFrame | None = None) -> DataFrame:
    """The rows of views.persons. Without a key table a subject has a key until it is forgotten anywhere."""
    slots, gone = latest(models, "slots"), latest(models, "forgotten")
    rows = slots.select("aggregate_id", "person_ref", "bound.subject_id", "last.name", "last.email", "last.phone")
    rows = rows.join(gone.withColumn("f", F.lit(True)), ["aggregate_id", "subject_id"], "left").withColumn("forgotten", F.coalesce("f", F.lit(False)))
    if key_table is None:
        rows = rows.join(gone.select("subject_id").distinct().withColumn("lost", F.lit(True)), "subject_id", "left").withColumn("has_key", F.col("lost").isNull())
    else:
        rows = rows.join(key_table.select("subject_id").distinct().withColumn("k", F.lit(True)), "subject_id", "left").withColumn("has_key", F.col("k").isNotNull())
    visible = lambda name: F.when(F.col("has_key") & (F.col(name) != "[redacted]"), F.col(name)).alias(name)
    return rows.select("aggregate_id", "person_ref", "subject_id", visible("name"), visible("email"), visible("phone"), "forgotten")


def workflow_history(models: Batches) -> DataFrame:
    """The rows of fold.workflow_history: decisions are only ever added; one that a replay of late events gave again counts once."""
    head = latest(models, "journeys").select("aggregate_id", F.col("decision.at").alias("newest"))
    rows = models.read("decisions").drop("batch_id").dropDuplicates(["aggregate_id", "sequence"]).join(head, "aggregate_id")
    return rows.select("aggregate_id", "sequence", "actions", "phase", (F.col("sequence") == F.col("newest")).alias("is_latest"))


def compact(models: Batches, root: str, upto: int) -> Batches:
    """The latest versions after batch upto as one batch of that number in a new folder, with which project goes on. The old folder is left to its retention."""
    new = Batches(models.spark, root, models.tables)
    tables = {name: latest(models, name, upto + 1) for name in models.tables if name != "decisions"}
    new.write(upto, tables | {"decisions": models.read("decisions", upto + 1).drop("batch_id").dropDuplicates(["aggregate_id", "sequence"])})
    return new
