"""Events stored with what hooks derive from them, duplicates, order and rotation in streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import keys
from ..sources import event_log
from .batches import Batches

Hook = Callable[[DataFrame], dict[str, DataFrame]]


#: Tables of a log with the lookup hook; more hooks need more.
LOG = {"events": event_log.ENVELOPE, "subject_lookup": "subject_id string, email_lower string"}


def persist_with_hooks(log: Batches, hooks: list[Hook] = ()) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: events that earlier batches haven't got, with what the hooks make of them, as one write. An error in a hook writes nothing."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.dropDuplicates(["aggregate_type", "aggregate_id", "sequence"]).persist()
        try:
            fresh = event_log.append_conflicts(batch, log.read("events", batch_id)).where("not conflict").drop("conflict")
            tables = {"events": fresh}
            for hook in hooks:
                tables |= hook(fresh)
            log.write(batch_id, tables)
        finally:
            batch.unpersist()

    return run


def lookup_hook(events: DataFrame) -> dict[str, DataFrame]:
    """A hook: the address of each subject that the batch captures, for the same write as the events. Captures whose address is encrypted or missing give none."""
    captured = event_log.parse_events(events.where("event_type = 'PersonCaptured'")).where("email <> '[redacted]'")
    return {"subject_lookup": keys.lookup(captured)}


def dedupe(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each event once, for repeats that come within the delay."""
    return stream.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["aggregate_type", "aggregate_id", "sequence"])


FOLDED = "aggregate_id string, version long, state string, current_step string, phase string, n_repeated long, n_gaps long"


def fold_stream(stream: DataFrame) -> DataFrame:
    """The latest scalar state of each journey as its events come, kept as stream state: an event whose sequence was seen is counted as repeated and left out,
    a jump over a sequence is counted as a gap."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, frames, state):
        version, status, current, phase, repeated, gaps = state.get if state.exists else (0, "InProgress", None, None, 0, 0)
        rows = pd.concat(list(frames)).sort_values("sequence")
        for r in rows.itertuples():
            if r.sequence <= version:
                repeated += 1
                continue
            gaps += r.sequence > version + 1
            version = int(r.sequence)
            if r.event_type == "StepProgressed":
                current = r.to_step
            elif r.event_type == "WorkflowEvaluated":
                phase = r.phase
            elif r.event_type == "JourneyClosed":
                status = "Complete"
        state.update((version, status, current, phase, repeated, int(gaps)))
        yield pd.DataFrame([(key[0], version, status, current, phase, repeated, int(gaps))], columns=[c.split()[0] for c in FOLDED.split(", ")])

    parsed = event_log.parse_events(stream).select("aggregate_id", "sequence", "event_type", "to_step", "phase")
    kept = FOLDED.replace("aggregate_id string, ", "")
    return parsed.groupBy("aggregate_id").applyInPandasWithState(step, FOLDED, kept, "update", GroupStateTimeout.NoTimeout)


ORDERED = "aggregate_type string, aggregate_id string, sequence long, event_type string, event_version string, payload string, timestamp timestamp, status string"


def ordered(stream: DataFrame, wait_seconds: int = 3600) -> DataFrame:
    """Events (event_log.ENVELOPE) in the order of their sequence: one that comes before its predecessor is held as state until that is there. status: in_order, repeated
    (its sequence went out before), or dead_letter: it was held for wait_seconds after the last event of its journey had come; such events have to be
    sent again after the missing one. The watermark is on the time of arrival, so no event is too late by its own time; it moves on with batches that bring rows. Of two held events with one sequence the first stays and the other is repeated. Sequences begin with 1."""
    import json

    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    names = [c.split()[0] for c in ORDERED.split(", ")]

    def step(key, frames, state):
        expected, waiting = state.get if state.exists else (1, "{}")
        held = {int(k): v for k, v in json.loads(waiting).items()}
        if state.hasTimedOut:
            yield pd.DataFrame([(*key, s, *held[s][:3], pd.Timestamp(held[s][3]), "dead_letter") for s in sorted(held)], columns=names)
            state.update((expected, "{}"))
            return
        for frame in frames:
            out, arrived = [], int(frame["arrived_ms"].max())
            for r in frame.sort_values("sequence").itertuples():
                if r.sequence < expected or r.sequence in held:
                    out.append((*key, r.sequence, r.event_type, r.event_version, r.payload, r.timestamp, "repeated"))
                    continue
                held[int(r.sequence)] = [r.event_type, r.event_version, r.payload, str(r.timestamp)]
                while expected in held:
                    kind, version, payload, at = held.pop(expected)
                    out.append((*key, expected, kind, version, payload, pd.Timestamp(at), "in_order"))
                    expected += 1
            if out:
                yield pd.DataFrame(out, columns=names)
        state.update((expected, json.dumps(held)))
        if held:
            state.setTimeoutTimestamp(arrived + 1000 * wait_seconds)

    rows = stream.select(*names[:-1], F.current_timestamp().alias("arrived")).withWatermark("arrived", "0 seconds").withColumn("arrived_ms", F.unix_millis("arrived"))
    return rows.groupBy("aggregate_type", "aggregate_id").applyInPandasWithState(step, ORDERED, "expected long, waiting string", "append", GroupStateTimeout.EventTimeTimeout)


def rewrap_available(spark: SparkSession, source: str, target: str, current: str, master: dict[str, str]) -> DataFrame:
    """Wraps all keys at source anew that no run has seen since current became the version, and returns what was made of them in all runs, for keys.apply_rewrap.
    A schedule calls it; each version has a folder and a checkpoint of its own below target, so the first run after a rotation sweeps the whole
    table and later ones what is new."""
    made = Batches(spark, f"{target}/{current}/rows", {"rewrapped": f"{keys.KEYS}, old_kek_id string, status string"})
    feed = spark.readStream.schema(keys.KEYS).parquet(source)
    run_available(feed, lambda batch, batch_id: made.write(batch_id, {"rewrapped": keys.rewrap(batch, current, master)}), f"{target}/{current}/_checkpoint")
    return made.read("rewrapped").drop("batch_id")


def run_available(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """All that is there now, once: a schedule and not a loop of ours brings the next run."""
    q = stream.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
