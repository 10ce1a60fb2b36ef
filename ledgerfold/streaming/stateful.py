"""Streams with state by key and part: what one event touches is read and written, not the whole state of its journey.

Both operators use transformWithState and need the RocksDB state store (use_rocksdb sets it for new queries of a session; a query that was started before keeps what its checkpoint says).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import documents
from ..sources import event_log


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _text(x: Any) -> str | None:
    return x if isinstance(x, str) else None


SCALARS = "version long, state string, current_step string, phase string, n_repeated long, n_gaps long, n_failed long"
BAGS = f"aggregate_id string, {SCALARS}, changes array<struct<name:string,json:string>>"


class _Bag(StatefulProcessor):
    """Scalars as one value, the shared document as a map from its first names to JSON texts: a write reads and writes the text below its first name."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.scalars = handle.getValueState("scalars", SCALARS)
        self.bag = handle.getMapState("bag", "name string", "json string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = dict(zip(_names(SCALARS), self.scalars.get() if self.scalars.exists() else (0, "InProgress", None, None, 0, 0, 0)))
        parts: dict[str, Any] = {}  # what this batch touched, BAD where there is nothing
        for e in pd.concat(list(rows)).sort_values("sequence").itertuples():
            if e.sequence <= now["version"]:
                now["n_repeated"] += 1
                continue
            now["n_gaps"] += int(e.sequence > now["version"] + 1)
            now["version"] = int(e.sequence)
            if e.event_type == "StepProgressed":
                now["current_step"] = _text(e.to_step)
            elif e.event_type == "WorkflowEvaluated":
                now["phase"] = _text(e.phase)
            elif e.event_type == "JourneyClosed":
                now["state"] = "Complete"
            elif e.event_type:
                now["n_failed"] += self._write(parts, e.event_type, _text(e.payload))
        for name, value in parts.items():
            if value is not documents.BAD:
                self.bag.updateValue((name,), (json.dumps(value, ensure_ascii=False),))
            elif self.bag.containsKey((name,)):
                self.bag.removeKey((name,))
        self.scalars.update(tuple(now.values()))
        changes = [{"name": n, "json": None if v is documents.BAD else json.dumps(v, ensure_ascii=False)} for n, v in sorted(parts.items())]
        yield pd.DataFrame([(key[0], *now.values(), changes)], columns=["aggregate_id", *now, "changes"])

    def _part(self, parts: dict[str, Any], name: str) -> Any:
        if name not in parts:
            parts[name] = documents.parse(self.bag.getValue((name,))[0]) if self.bag.containsKey((name,)) else documents.BAD
        return parts[name]

    def _write(self, parts: dict[str, Any], kind: str, payload: str | None) -> int:
        """The writes of an event that can't be done; the others are done in parts."""
        body = documents.parse(payload)
        inner, field = ("Modified", "data") if kind == "JourneyModified" else ("AttributesSet", "plaintext")
        given = body.get(inner) if isinstance(body, dict) else None
        data = given.get(field) if isinstance(given, dict) else None
        if not isinstance(data, dict):
            return int(data is not None or body is documents.BAD)
        failed = 0
        for at, value in sorted(data.items()):
            name = at if kind == "JourneyModified" else documents.split_first(at)[0]
            try:
                there = self._part(parts, name)
                if kind == "JourneyModified":
                    new = documents.BAD if value is None else documents.merge_patch(there, value)
                else:
                    new = documents.assign({} if there is documents.BAD else {name: there}, at, value)[name]
                json.dumps(new if new is not documents.BAD else None)
                parts[name] = new
            except (documents.PointerError, RecursionError):
                failed += 1
        return failed


def fold_bags(stream: DataFrame) -> DataFrame:
    """The latest state of each journey with what changed in its document, once for each batch that has events of it: version, state, current_step, phase, n_repeated (events whose sequence was seen,
    left out), n_gaps (jumps over a sequence), n_failed (writes that fit no array, or aren't JSON) and changes: the names at the top of the document that were written, with the
    whole JSON text below (null if it is gone). bags() puts documents together from these rows. Events of a journey in one batch are taken by sequence."""
    writes = F.when(F.col("event_type").isin("JourneyModified", "AttributesSet"), F.col("payload"))
    used = ["JourneyModified", "AttributesSet", "StepProgressed", "WorkflowEvaluated", "JourneyClosed"]
    kind = F.when(F.col("event_type").isin(used), F.col("event_type"))
    parsed = event_log.parse_events(stream).select("aggregate_id", "sequence", F.coalesce(kind, F.lit("")).alias("event_type"), "to_step", "phase", writes.alias("payload"))
    return parsed.groupBy("aggregate_id").transformWithStateInPandas(_Bag(), BAGS, "Update", "None")


def bags(rows: DataFrame) -> DataFrame:
    """aggregate_id and document (JSON text) of all journeys that have one, from all rows that fold_bags ever gave: of each name, the newest counts."""
    each = rows.select("aggregate_id", "version", F.explode("changes").alias("c"))
    newest = each.groupBy("aggregate_id", F.col("c.name").alias("name")).agg(F.max_by("c.json", "version").alias("json")).where("json is not null")
    quoted = F.expr("substring(t, 2, length(t) - 2)")
    pairs = newest.withColumn("t", F.to_json(F.array("name"))).select("aggregate_id", F.concat(quoted, F.lit(":"), "json").alias("pair"))
    return pairs.groupBy("aggregate_id").agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list("pair")), ","), F.lit("}")).alias("document"))


_EVENT = "event_type string, event_version string, payload string, at_us long"
_OUT = f"aggregate_type string, aggregate_id string, sequence long, {_EVENT}, status string"
_CHUNK = 1000  # rows that leave at once


class _Order(StatefulProcessor):
    """Held events are a map by sequence: the next one is one look-up, and holding another writes one entry."""

    def __init__(self, wait_ms: int, most: int):
        self.wait_ms, self.most = wait_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "expected long, n_held long, timer long")
        self.held = handle.getMapState("held", "sequence long", _EVENT)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        expected, n_held, timer = self.now.get() if self.now.exists() else (1, 0, 0)
        arrived, out = 0, []
        for frame in rows:
            arrived = max(arrived, int(frame["arrived_ms"].max()))
            for r in frame.sort_values("sequence").itertuples():
                seq = int(r.sequence)
                event = (_text(r.event_type), _text(r.event_version), _text(r.payload), None if pd.isna(r.at_us) else int(r.at_us))
                if seq < expected or (n_held and self.held.containsKey((seq,))):
                    out.append((*key, seq, *event, "repeated"))
                elif seq > expected:
                    if n_held < self.most:
                        self.held.updateValue((seq,), event)
                        n_held += 1
                    else:
                        out.append((*key, seq, *event, "dead_letter"))
                else:
                    out.append((*key, seq, *event, "in_order"))
                    expected += 1
                    while n_held and self.held.containsKey((expected,)):
                        out.append((*key, expected, *self.held.getValue((expected,)), "in_order"))
                        self.held.removeKey((expected,))
                        expected, n_held = expected + 1, n_held - 1
                        if len(out) >= _CHUNK:
                            yield pd.DataFrame(out, columns=_names(_OUT))
                            out = []
                if len(out) >= _CHUNK:
                    yield pd.DataFrame(out, columns=_names(_OUT))
                    out = []
        if timer:
            self.handle.deleteTimer(timer)
        timer = arrived + self.wait_ms if n_held else 0
        if timer:
            self.handle.registerTimer(timer)
        self.now.update((expected, n_held, timer))
        if out:
            yield pd.DataFrame(out, columns=_names(_OUT))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        expected, _, _ = self.now.get()
        for at in self._chunks(sorted(seq for (seq,) in self.held.keys())):
            yield pd.DataFrame([(*key, seq, *self.held.getValue((seq,)), "dead_letter") for seq in at], columns=_names(_OUT))
        self.held.clear()
        self.now.update((expected, 0, 0))

    @staticmethod
    def _chunks(of: list[int]) -> Iterator[list[int]]:
        for i in range(0, len(of), _CHUNK):
            yield of[i : i + _CHUNK]


def ordered(stream: DataFrame, wait_seconds: int = 3600, most: int = 1_000_000) -> DataFrame:
    """Events (event_log.ENVELOPE) in the order of their sequence, as store.ordered gives them (in_order, repeated, dead_letter), with held events as entries of the state store: a journey's backlog isn't read or
    written anew by each batch, and only numbers of it are in memory when it is given up. An event that would be held beside ``most`` others of its journey is a dead letter at once, and has to be sent again
    as those that were held too long have. Without that bound being reached, which events are in order doesn't depend on the batches."""
    columns = ["aggregate_type", "aggregate_id", "sequence", "event_type", "event_version", "payload", F.unix_micros("timestamp").alias("at_us"), F.current_timestamp().alias("arrived")]
    rows = stream.select(*columns).withWatermark("arrived", "0 seconds").withColumn("arrived_ms", F.unix_millis("arrived"))
    out = rows.groupBy("aggregate_type", "aggregate_id").transformWithStateInPandas(_Order(1000 * wait_seconds, most), _OUT, "Append", "EventTime")
    return out.select("aggregate_type", "aggregate_id", "sequence", "event_type", "event_version", "payload", F.timestamp_micros("at_us").alias("timestamp"), "status")
