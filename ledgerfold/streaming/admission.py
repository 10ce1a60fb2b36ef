"""Admission of commands as they come: one verdict for each, from state kept per aggregate."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame

from ..operators import documents
from ..operators.classify import INVALID, AttributeSchema

VERDICTS = "aggregate_id string, sequence long, command string, error string, slot_subject string, from_step string, person_ref string, subject_id string, step string, forgets boolean"
STATE = "started boolean, completed boolean, slots string, step string, doc string"


def verdict(state: dict, c, schema: AttributeSchema, check: Callable[[Any], list[str]] | None = None) -> str | None:
    """The error of a command, or None; an accepted one changes state (started, completed, slots, gone: slots whose subject is forgotten, step, doc). With check, a command has changes (path, JSON text) and data (JSON
    text), which are validated as documents.step says."""
    slots = state["slots"]
    if c.command == "SetAttributes":
        given = [w["path"] for w in (c.changes if c.changes is not None else [])] if check else [c.path]
        if any(p is not None and schema.kind(p) == INVALID for p in given):
            return "InvalidJsonPointer"
    if c.command == "Start":
        if state["started"]:
            return "AlreadyStarted"
        state["started"] = True
        return None
    if not state["started"]:
        return "NotFound"
    if c.command == "ForgetSubject":
        state["forgets"] = {ref for ref, subject in slots.items() if subject == c.subject_id} - state["gone"]
        state["gone"] |= state["forgets"]
        return None
    if state["completed"]:
        return "AlreadyCompleted"
    if c.command == "Complete":
        state["completed"] = True
    elif c.command == "CapturePerson":
        if slots.setdefault(c.person_ref, c.subject_id) != c.subject_id:
            return "PersonRefConflict"
    elif c.command == "CapturePersonDetails" and c.person_ref not in slots:
        return "PersonNotFound"
    elif check and c.command == "SetAttributes":
        changes = [(w["path"], w["value"]) for w in (c.changes if c.changes is not None else [])]
        if not changes:
            return "InvalidData"
        kinds = {path: schema.kind(path) for path, _ in changes}
        if "unknown" in kinds.values():
            return "UnknownAttributePath"
        if any(kind == "secret" and [*path.split("/"), None, None][2] not in slots for path, kind in kinds.items()):
            return "PersonNotFound"
        if plain := [w for w in changes if kinds[w[0]] == "plaintext"]:
            state["doc"], error, _ = documents.step(state["doc"], None, plain, check)
            return error
    elif check and c.command == "Capture":
        state["doc"], error, _ = documents.step(state["doc"], c.data, None, check)
        return error
    elif c.command == "SetAttributes":
        if c.path is None:
            return "InvalidData"
        kind = schema.kind(c.path)
        if kind == "unknown":
            return "UnknownAttributePath"
        if kind == "secret" and c.person_ref not in slots:
            return "PersonNotFound"
    return None


def admit_stream(commands: DataFrame, schema: AttributeSchema, json_schema: dict | None = None) -> DataFrame:
    """commands (aggregate_id, sequence, command, person_ref, subject_id, path, step) with their verdicts; rejected ones have an error, which is the side output. Within a batch
    commands are taken in sequence; across batches in the order they come. With json_schema, commands have changes and data in place of path and the verdicts are admit_data's.
    admit.emitted turns the verdicts into the stream of accepted events."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    names = [c.split()[0] for c in VERDICTS.split(", ")]

    def step(key, frames, state):
        started, completed, slots, at, doc = state.get if state.exists else (False, False, "{}", None, "{}")
        slots = json.loads(slots)
        slots, gone = slots if isinstance(slots, list) else (slots, [])  # a stream that began before there was ForgetSubject kept slots alone
        now = {"started": started, "completed": completed, "slots": slots, "gone": set(gone), "step": at, "doc": json.loads(doc)}
        check = documents.checker(json_schema) if json_schema else None
        rows = pd.concat(list(frames)).sort_values("sequence")
        rows = rows.astype(object).where(rows.notna(), None)
        out = []
        for c in rows.itertuples():
            before = now["step"]
            error = verdict(now, c, schema, check)
            if error is None and c.command == "Capture":
                now["step"] = c.step
            out.append((key[0], int(c.sequence), c.command, error, now["slots"].get(c.person_ref) if c.person_ref else None, before, c.person_ref, c.subject_id, c.step, bool(now["forgets"]) if c.command == "ForgetSubject" and error is None else None))
        state.update((now["started"], now["completed"], json.dumps([now["slots"], sorted(now["gone"])]), now["step"], json.dumps(now["doc"])))
        yield pd.DataFrame(out, columns=names)

    few = commands.select("aggregate_id", "sequence", "command", "person_ref", "subject_id", *(["changes", "data"] if json_schema else ["path"]), "step")
    return few.groupBy("aggregate_id").applyInPandasWithState(step, VERDICTS, STATE, "append", GroupStateTimeout.NoTimeout)
