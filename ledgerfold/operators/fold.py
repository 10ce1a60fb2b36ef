"""Replay of event logs into state: set-based folds over all aggregates at once.

A journey's bag of attributes is a long table (aggregate_id, path, value); scalars are picked by max_by, so a hot aggregate is
combined before the shuffle and never collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, trees
from ..functions.cut import cut
from ..sources.event_log import parse_events

ORDER = ["sequence", "part"]


def upcast(log: DataFrame) -> DataFrame:
    """Old and new events as one kind of row, a write: aggregate_id, sequence, part, path, value, json, op, arrays, base. Data of JourneyModified is a merge
    patch (a null outside arrays deletes, an array replaces), AttributesSet assigns (a null is a value, an object replaces), one path after the other; plaintext
    only, secrets never enter shared state."""
    few = log.where(F.col("event_type").isin("JourneyModified", "AttributesSet"))
    data = few.select("aggregate_id", "sequence", "event_type", "payload", F.expr("try_parse_json(payload)").alias("doc"))
    patch = paths.item("''", "try_variant_get(doc, '$.Modified.data', 'variant')", "0")
    assigned = paths.item("e.key", "e.value", "i", fresh="true", base="size(split(e.key, '/')) - 1")  # keys of an assignment are pointers themselves
    start = f"""case event_type when 'JourneyModified' then array({patch})
        else transform(map_entries(try_variant_get(doc, '$.AttributesSet.plaintext', 'map<string,variant>')), (e, i) -> {assigned}) end"""
    rows = paths.taken_apart(data, start, ["aggregate_id", "sequence", "event_type"], "payload")
    op = F.when(F.col("kind") == "leaf", "set").when(F.col("kind") == "null", F.when((F.col("event_type") == "JourneyModified") & (F.size("arrays") == 0), "delete").otherwise("set")).otherwise(F.col("kind"))
    return rows.select("aggregate_id", "sequence", "part", "path", "value", "json", op.alias("op"), "arrays", "base")


def resolved(log: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The writes of a log with positions in arrays made plain, and those that fail (aggregate_id, sequence, part, error)."""
    return trees.resolve_positions(cut(upcast(log)), ["aggregate_id"])


def fold_bag(log: DataFrame) -> DataFrame:
    """aggregate_id, path, value, arrays (those that the path stands in): the shared data of every journey."""
    return paths.last_writes(resolved(log)[0], ["aggregate_id"], ORDER)


def fold_documents(log: DataFrame) -> DataFrame:
    """aggregate_id and document: the shared data of every journey that has any, as JSON text."""
    return trees.rehydrate(paths.last_writes(resolved(log)[0], ["aggregate_id"], ORDER, containers=True), ["aggregate_id"])


def patch_writes(patches: DataFrame, key: list[str]) -> DataFrame:
    """Writes (key..., sequence, part, path, value, op, arrays) of merge patches: data, JSON text, of each row (key..., sequence)."""
    root = f"array({paths.item(chr(39) * 2, 'try_parse_json(data)', '0')})"
    rows = paths.taken_apart(patches, root, [*key, "sequence"], "data")
    op = F.when(F.col("kind") == "leaf", "set").when(F.col("kind") == "null", F.when(F.size("arrays") == 0, "delete").otherwise("set")).otherwise(F.col("kind"))
    return rows.select(*key, "sequence", "part", "path", "value", op.alias("op"), "arrays")


def fold_details(updates: DataFrame, secrets: DataFrame, captures: DataFrame) -> DataFrame:
    """aggregate_id, person_ref, path, value: the details of every slot. updates (aggregate_id, person_ref, sequence, data) are merge patches of PersonDetailsUpdated;
    secrets (aggregate_id, person_ref, sequence, path, value) are secret attributes, which are mirrored at their path below the slot; what comes
    before the slot's first capture (captures: aggregate_id, person_ref, sequence) is left out."""
    key = ["aggregate_id", "person_ref"]
    patch = patch_writes(updates, key)
    below = paths.strip_prefix(F.col("path"), F.concat(F.lit("/persons/"), "person_ref"))
    mirror = secrets.select(*key, "sequence", F.lit(0).alias("part"), below.alias("path"), "value", F.lit("set").alias("op"), F.lit(None).cast("array<string>").alias("arrays")).where("path is not null")
    bound = captures.groupBy(*key).agg(F.min("sequence").alias("captured_at"))
    writes = patch.unionByName(mirror).join(bound, key).where("captured_at < sequence").drop("captured_at")
    return paths.last_writes(writes, key, ORDER)


def fold_scalars(log: DataFrame) -> DataFrame:
    """State, step, latest decision, version and times of every journey, in one aggregation."""
    e = parse_events(log)
    seq = F.col("sequence")
    decision = F.when(F.col("event_type") == "WorkflowEvaluated", F.struct("actions", "phase"))
    return e.groupBy("aggregate_id").agg(
        F.when(F.max(F.col("event_type") == "JourneyClosed"), "Complete").otherwise("InProgress").alias("state"),
        F.max(F.col("event_type") == "JourneyOpened").alias("started"),
        F.max_by("to_step", F.when(F.col("event_type") == "StepProgressed", seq)).alias("current_step"),
        F.max_by(decision, F.when(decision.isNotNull(), seq)).alias("decision"),
        F.max("sequence").alias("version"), F.min("timestamp").alias("created_at"), F.max("timestamp").alias("updated_at"),
    ).select("aggregate_id", "state", "started", "current_step", F.col("decision.phase").alias("phase"), F.col("decision.actions").alias("actions"), "version", "created_at", "updated_at")


def replay(log: DataFrame) -> DataFrame:
    """fold_scalars with the bag as a sorted array of (path, value)."""
    bag = fold_bag(log).groupBy("aggregate_id").agg(F.array_sort(F.collect_list(F.struct("path", "value"))).alias("bag"))
    return fold_scalars(log).join(bag, "aggregate_id", "left")


def as_of(log: DataFrame, points: DataFrame) -> DataFrame:
    """The log up to each aggregate's sequence in points (aggregate_id, upto): replay what it gives for the state at that time."""
    return log.join(points.select("aggregate_id", "upto"), "aggregate_id").where(F.col("sequence") <= F.col("upto")).drop("upto")


def history(log: DataFrame) -> DataFrame:
    """Scalar state after each event, valid from its time to the next one's."""
    e = parse_events(log)
    past = Window.partitionBy("aggregate_id").orderBy("sequence")
    upto = past.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return e.select(
        "aggregate_id", "sequence", F.when(F.max(F.col("event_type") == "JourneyClosed").over(upto), "Complete").otherwise("InProgress").alias("state"),
        F.last("to_step", ignorenulls=True).over(upto).alias("current_step"), F.last("phase", ignorenulls=True).over(upto).alias("phase"),
        F.col("timestamp").alias("valid_from"), F.lead("timestamp").over(past).alias("valid_to"),
    )


def snapshot(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(aggregate_id, last_sequence) and what makes up each aggregate's bag (aggregate_id, path, value, arrays, kind, json; leaves and containers), to be stored."""
    last = log.groupBy("aggregate_id").agg(F.max("sequence").alias("last_sequence"))
    return last, paths.last_writes(resolved(log)[0], ["aggregate_id"], ORDER, containers=True)


def resumed_nodes(last: DataFrame, nodes: DataFrame, tail: DataFrame) -> DataFrame:
    """What makes up each aggregate's bag after a tail of events, as snapshot gives it."""
    # an object that stands because of what is below it has no row of its own, but is no array
    above = nodes.select("aggregate_id", F.explode(paths.below(F.col("path"))).alias("path")).distinct().join(nodes.select("aggregate_id", "path"), ["aggregate_id", "path"], "left_anti")
    nodes = nodes.drop("arrays").unionByName(above.withColumn("kind", F.lit("object")), allowMissingColumns=True)
    arrays = nodes.where("kind = 'array'").select("aggregate_id", F.col("path").alias("up"))
    inside = nodes.select("aggregate_id", "path", F.explode(paths.below(F.col("path"))).alias("up")).join(arrays, ["aggregate_id", "up"]).groupBy("aggregate_id", "path").agg(F.collect_list("up").alias("arrays"))  # as many as it is deep
    nodes = nodes.join(inside, ["aggregate_id", "path"], "left")
    op = F.when(F.col("kind") == "leaf", "set").otherwise(F.col("kind"))
    stored = nodes.join(last, "aggregate_id").select("aggregate_id", F.col("last_sequence").alias("sequence"), F.lit(0).alias("part"), "path", "value", "json", op.alias("op"), "arrays", F.lit(0).alias("base"))
    writes, _ = trees.resolve_positions(cut(stored.unionByName(upcast(tail))), ["aggregate_id"])
    return paths.last_writes(writes, ["aggregate_id"], ORDER, containers=True)


def resume(last: DataFrame, nodes: DataFrame, tail: DataFrame) -> DataFrame:
    """The bag after a tail of events: snapshot and tail together equal a full replay."""
    return resumed_nodes(last, nodes, tail).where("kind = 'leaf'").select("aggregate_id", "path", "value", "arrays")


def resume_documents(last: DataFrame, nodes: DataFrame, tail: DataFrame) -> DataFrame:
    """fold_documents after a tail of events."""
    return trees.rehydrate(resumed_nodes(last, nodes, tail), ["aggregate_id"])


def workflow_history(log: DataFrame) -> DataFrame:
    """All decisions, the latest of each journey flagged."""
    decisions = log.where("event_type = 'WorkflowEvaluated'")
    newest = decisions.groupBy("aggregate_id").agg(F.max("sequence").alias("newest"))
    d = parse_events(decisions).join(newest, "aggregate_id")
    return d.select("aggregate_id", "sequence", F.array_join("actions", ",").alias("actions"), "phase", (F.col("sequence") == F.col("newest")).alias("is_latest"))


def step_transitions(log: DataFrame) -> DataFrame:
    """How often journeys went from one step to another; a repeated step is no transition."""
    w = Window.partitionBy("aggregate_id").orderBy("sequence")
    steps = parse_events(log.where("event_type = 'StepProgressed'")).select("aggregate_id", "to_step", F.lag("to_step").over(w).alias("from_step"))
    return steps.where(~F.col("to_step").eqNullSafe(F.col("from_step"))).groupBy("from_step", "to_step").agg(F.count(F.lit(1)).alias("n"))


def phase_funnel(log: DataFrame) -> DataFrame:
    """Journeys whose latest decision has a phase, by phase."""
    return fold_scalars(log).groupBy("phase").agg(F.count(F.lit(1)).alias("n_journeys"))


def phase_gaps(log: DataFrame) -> DataFrame:
    """Seconds from each decision to the journey's next one, by phase."""
    w = Window.partitionBy("aggregate_id").orderBy("sequence")
    at = F.unix_micros(F.col("timestamp").cast("timestamp"))
    d = parse_events(log.where("event_type = 'WorkflowEvaluated'")).select("phase", (F.lead(at).over(w) - at).alias("gap"))
    return d.groupBy("phase").agg(F.count("gap").alias("n"), F.round(F.avg("gap") / 1e6, 3).alias("mean_seconds"))
