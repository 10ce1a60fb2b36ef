"""One journey's shared document, step by step: what admission needs of it. Small functions of one row; Spark deals and orders the rows."""

from __future__ import annotations

import json as js
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, trees
from ..functions.cut import cut

BAD = object()  # text that is no JSON


class PointerError(ValueError):
    """FailedToParseIndex or OutOfBounds."""


def parse(text: str | None) -> Any:
    """A JSON text; null is null. What isn't JSON (NaN and the infinities too), or is nested too deep to be read, is BAD."""
    try:
        return None if text is None else js.loads(text, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return BAD


def _refuse(name: str) -> None:
    raise ValueError(name)


def canonical(x: Any) -> str:
    """One text for equal JSON values: 1 and 1.0 are equal, 1 and "1" and true are not."""
    if isinstance(x, dict):
        return "{" + ",".join(f"{js.dumps(k)}:{canonical(v)}" for k, v in sorted(x.items())) + "}"
    if isinstance(x, list):
        return "[" + ",".join(map(canonical, x)) + "]"
    return js.dumps(int(x) if isinstance(x, float) and x.is_integer() else x)


def kind_of(x: Any) -> str:
    if x is None:
        return "null"
    if isinstance(x, bool):
        return "boolean"
    if isinstance(x, int) or (isinstance(x, float) and x.is_integer()):
        return "integer"
    return {float: "number", str: "string", list: "array", dict: "object"}[type(x)]


def checker(schema: dict) -> Callable[[Any], list[str]]:
    """What validate.validate finds ("path keyword", sorted), of one parsed document."""
    defs = schema.get("$defs", {})

    def look(s: dict, x: Any, at: str) -> Iterator[str]:
        while "$ref" in s:
            s = defs[s["$ref"].rsplit("/", 1)[1]]
        kind = kind_of(x)
        number = kind in ("integer", "number")
        wanted = s.get("type", [])
        wanted = [wanted] if isinstance(wanted, str) else wanted
        if wanted and kind not in wanted and not (number and "number" in wanted):
            yield f"{at} type"
        if "enum" in s and canonical(x) not in {canonical(e) for e in s["enum"]}:
            yield f"{at} enum"
        if number and x < s.get("minimum", x):
            yield f"{at} minimum"
        if number and x > s.get("maximum", x):
            yield f"{at} maximum"
        if kind == "string" and len(x) < s.get("minLength", 0):
            yield f"{at} minLength"
        if kind == "object":
            known = s.get("properties", {})
            yield from (f"{at} required:{name}" for name in s.get("required", []) if name not in x)
            for name in known.keys() & x.keys():
                yield from look(known[name], x[name], f"{at}/{name}")
            if s.get("additionalProperties") is False and x.keys() - known.keys():
                yield f"{at} additionalProperties"
        if kind == "array" and "items" in s:
            for i, v in enumerate(x):
                yield from look(s["items"], v, f"{at}/{i}")
        for word in ("anyOf", "oneOf"):
            if word in s:
                good = sum(not any(look(o, x, at)) for o in s[word])
                if good < 1 or (word == "oneOf" and good > 1):
                    yield f"{at} {word}"

    return lambda doc: [" json"] if doc is BAD else sorted(look(schema, doc, ""))


def _tokens(pointer: str) -> list[str]:
    return [t.replace("~1", "/").replace("~0", "~") for t in pointer.split("/")[1:]]


def split_first(pointer: str) -> tuple[str, str]:
    """(first token, decoded, and the pointer below it)."""
    first, slash, rest = pointer[1:].partition("/")
    return first.replace("~1", "/").replace("~0", "~"), slash + rest


def _built(tokens: list[str], value: Any) -> Any:
    """value below tokens that don't exist yet: 0 and - start an array."""
    for t in reversed(tokens):
        value = [value] if t in ("0", "-") else {t: value}
    return value


def assign(doc: Any, pointer: str, value: Any) -> Any:
    """doc with value at pointer. Containers on the way are changed in place; a scalar on the way is replaced."""
    tokens, node = _tokens(pointer), doc
    if not tokens:
        return value
    if not isinstance(doc, (dict, list)):
        return _built(tokens, value)
    for i, t in enumerate(tokens):
        rest = tokens[i + 1 :]
        if isinstance(node, list):
            if t != "-" and not (t.isascii() and t.isdigit() and (t == "0" or t[0] != "0")):
                raise PointerError(f"FailedToParseIndex: {t}")
            at = len(node) if t == "-" else int(t)
            if at > len(node):
                raise PointerError(f"OutOfBounds: {at}")
            if at == len(node):
                node.append(None)
            t = at
        there = node[t] if isinstance(node, list) else node.get(t)
        if not rest or not isinstance(there, (dict, list)):
            node[t] = _built(rest, value)
            return doc
        node = there
    return doc


def merge_patch(doc: Any, patch: Any) -> Any:
    """RFC 7396."""
    if not isinstance(patch, dict):
        return patch
    out = dict(doc) if isinstance(doc, dict) else {}
    for key, value in patch.items():
        if value is None:
            out.pop(key, None)
        else:
            out[key] = merge_patch(out.get(key), value)
    return out


def step(doc: Any, data: str | None, writes: list[tuple[str, str | None]] | None, check: Callable[[Any], list[str]]) -> tuple[Any, str | None, list[str]]:
    """(document afterwards, error, reasons) of one command: data is a Capture's, writes (path, JSON text; null for a Capture) are the plaintext ones of SetAttributes. A refused
    command leaves the document as it was. Data is validated by itself and then merged; writes are merged, in path order, and the result is validated. A value nested too deep to be merged is refused."""
    try:
        return _step(doc, data, writes, check)
    except RecursionError:
        return doc, "InvalidData", [" depth"]


def _step(doc, data, writes, check):
    if writes is None:
        patch = parse(data)
        reasons = check(patch)
        return (doc, "InvalidData", reasons) if reasons else (merge_patch(doc, patch), None, [])
    new = doc
    if isinstance(doc, dict):  # only what is below a written key can change
        touched = {t[0] for path, _ in writes if (t := _tokens(path)) and t[0] in doc}
        new = doc | {t: js.loads(js.dumps(doc[t])) for t in touched}
    elif isinstance(doc, list):
        new = js.loads(js.dumps(doc))
    try:
        for path, text in sorted(writes, key=lambda w: w[0]):
            value = parse(text)
            if value is BAD:
                return doc, "InvalidData", [" json"]
            new = assign(new, path, value)
    except PointerError as e:
        return doc, "InvalidJsonPointer", [str(e)]
    reasons = check(new)
    return (doc, "InvalidData", reasons) if reasons else (new, None, [])


SEGMENT = 20_000  # commands of one aggregate that one task reads in a row
_PIECE = ["aggregate_id", "segment"]


def refusals(commands: DataFrame, schema: dict, segment: int = SEGMENT) -> DataFrame:
    """aggregate_id, sequence, refusal, reasons of those that fail; see settle."""
    return settle(commands, schema, segment)[0]


def settle(commands: DataFrame, schema: dict, segment: int = SEGMENT) -> tuple[DataFrame, int]:
    """(aggregate_id, sequence, refusal, reasons) of the commands (aggregate_id, sequence, data, writes: array of (path, value), null for a Capture) that fail, and the rounds it took.

    What a command may do depends on the document that the accepted ones before it left. An aggregate's commands are cut into pieces of ``segment`` sequence numbers, each a sorted stream of its
    own with one document in memory, and pieces run side by side on a guess: that all candidates before them were accepted. The fold of what was accepted gives each piece's start
    anew, for all pieces in one go; pieces whose start is another one than they were judged from run again, until there are none. An aggregate's first piece starts from nothing, so
    piece k is settled after k rounds at the latest, and the verdicts are those of one command after the other. Mostly two or three rounds do: a refused command spoils a guess only if its writes are still there at the
    start of a later piece. A start is as large as the document; there is one a piece, not one a command.

    Sequence numbers should be dense in an aggregate, gaps make pieces small. Pointers aren't empty. Only documents of schemas of type object are cut; others are read in one piece. A start that is
    too deep to be read refuses its piece's commands (InvalidData, depth)."""
    whole = schema.get("type") != "object"
    piece = F.lit(0).cast("long") if whole else F.floor(F.col("sequence") / segment)
    todo = cut(commands.select("aggregate_id", piece.alias("segment"), "sequence", "data", "writes"))
    pieces = todo.select(*_PIECE).distinct()
    spread = cut(pieces.groupBy("aggregate_id").agg(F.min("segment").alias("first"), F.max("segment").alias("last")).where("first < last"))
    if spread.isEmpty():
        return _judged(todo, None, schema), 1
    later = cut(pieces.join(spread, "aggregate_id").where("first < segment").select(*_PIECE))
    most = spread.agg(F.max(F.col("last") - F.col("first"))).first()[0] + 1
    writes = _writes(todo.join(spread, "aggregate_id", "left_semi"))
    starts = cut(_starts(writes, later))
    found = cut(_judged(todo, starts, schema))
    spoiled, rounds = found, 1
    while True:
        # only journeys with a verdict that isn't what was assumed can have other starts now
        open_ = later.join(spoiled.select("aggregate_id").distinct(), "aggregate_id", "left_semi")
        accepted = writes.join(open_.select("aggregate_id").distinct(), "aggregate_id", "left_semi").join(found, ["aggregate_id", "sequence"], "left_anti")
        now = cut(_starts(accepted, open_))
        again = cut(now.join(starts, [*_PIECE, "document"], "left_anti"))
        if again.isEmpty():
            return found.drop("segment"), rounds
        if rounds > most:
            raise RuntimeError("starts differ between equal folds")
        starts = cut(starts.join(again, _PIECE, "left_anti").unionByName(again))
        run = _judged(todo.join(again, _PIECE, "left_semi"), again, schema)
        found = cut(found.join(again, _PIECE, "left_anti").unionByName(run))
        spoiled, rounds = again, rounds + 1


def _judged(todo: DataFrame, starts: DataFrame | None, schema: dict) -> DataFrame:
    """(aggregate_id, segment, sequence, refusal, reasons) of what fails, each piece read from its start (document; none is an empty one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        check, key, doc = checker(schema), None, {}
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for agg, seg, seq, data, writes in zip(*(b.column(c).to_pylist() for c in (*_PIECE, "sequence", "data", "writes"))):
                if (agg, seg) != key:
                    key, doc = (agg, seg), {}
                if seq is None:
                    doc = parse(data)
                    continue
                if doc is BAD:
                    error, reasons = "InvalidData", [" depth"]
                else:
                    doc, error, reasons = step(doc, data, None if writes is None else [(w["path"], w["value"]) for w in writes], check)
                if error:
                    for col, x in zip(out, (agg, seg, seq, error, reasons)):
                        col.append(x)
            types = [*(b.schema.field(c).type for c in (*_PIECE, "sequence")), pa.string(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], [*_PIECE, "sequence", "refusal", "reasons"])

    kinds = dict(todo.dtypes)
    rows = todo.select(*_PIECE, "sequence", "data", "writes")
    if starts is not None:
        rows = rows.unionByName(starts.select(*_PIECE, F.col("document").alias("data")), allowMissingColumns=True)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, as pieces are few bytes and much work: partitions wouldn't be merged well by size
    rows = rows.repartition(tasks, *_PIECE).sortWithinPartitions(*_PIECE, F.col("sequence").asc_nulls_first())
    return rows.mapInArrow(run, f"aggregate_id {kinds['aggregate_id']}, segment long, sequence {kinds['sequence']}, refusal string, reasons array<string>")


def _plain(text: str | None) -> str | None:
    """JSON text that a variant takes, where Python's reading differs (a repeated name counts last)."""
    value = parse(text)
    return text if text is None or value is BAD else js.dumps(value)


def _writes(commands: DataFrame) -> DataFrame:
    """What the commands write, node by node, as fold.upcast has it: data of a Capture is a merge patch, the others assign in path order. Data that is no object can't be accepted and writes nothing."""
    keep = ["aggregate_id", "segment", "sequence", "data", "writes"]
    odd = F.coalesce(F.expr("data is not null and try_parse_json(data) is null or exists(writes, w -> w.value is not null and try_parse_json(w.value) is null)"), F.lit(False))
    again = F.udf(lambda data, writes: (_plain(data), None if writes is None else [(w["path"], _plain(w["value"])) for w in writes]), "data string, writes array<struct<path string, value string>>")
    mended = commands.where(odd).withColumn("m", again("data", "writes")).select("aggregate_id", "segment", "sequence", "m.data", "m.writes")
    c = commands.where(~odd).select(*keep).unionByName(mended).withColumn("text", F.coalesce("data", F.expr("array_join(transform(writes, w -> w.value), ' ')")))
    c = cut(c.where("writes is not null or try_variant_get(try_parse_json(data), '$', 'map<string,variant>') is not null"))
    patch = paths.item("''", "try_parse_json(data)", "0")
    assigned = paths.item("e.path", "try_parse_json(e.value)", "i", fresh="true", base="size(split(e.path, '/')) - 1")
    by_path = "array_sort(writes, (a, b) -> case when a.path < b.path then -1 when a.path > b.path then 1 else 0 end)"
    start = f"case when writes is null then array({patch}) else transform({by_path}, (e, i) -> {assigned}) end"
    rows = paths.taken_apart(c.withColumn("patch", F.col("writes").isNull()), start, ["aggregate_id", "segment", "sequence", "patch"], "text")
    op = F.when(F.col("kind") == "leaf", "set").when(F.col("kind") == "null", F.when(F.col("patch") & (F.size("arrays") == 0), "delete").otherwise("set")).otherwise(F.col("kind"))
    return cut(rows.select("aggregate_id", "segment", "sequence", "part", "path", "value", "json", op.alias("op"), "arrays", "base"))


def _starts(writes: DataFrame, pieces: DataFrame) -> DataFrame:
    """(aggregate_id, segment, document): what the writes of earlier pieces leave at the start of each of pieces. The last write of a path in a piece stands until the next piece that writes it, so each
    start gets a path's last two writes (one that merges, one that replaces) and no more."""
    plain, _ = trees.resolve_positions(cut(writes.drop("segment")), ["aggregate_id"])
    plain = plain.join(writes.select("aggregate_id", "sequence", "segment").distinct(), ["aggregate_id", "sequence"])
    at = F.struct("sequence", "part")
    kept = plain.groupBy(*_PIECE, "path", (F.col("op") == "object").alias("merges")).agg(F.max_by(F.struct("sequence", "part", "value", "json", "op", "arrays"), at).alias("w"))
    until = F.lead("segment").over(Window.partitionBy("aggregate_id", "path", "merges").orderBy("segment"))
    last = pieces.groupBy("aggregate_id").agg(F.max("segment").alias("last"))
    kept = kept.withColumn("until", until).join(last, "aggregate_id").withColumn("until", F.coalesce("until", "last")).where("segment < until")
    seen = kept.select("aggregate_id", F.explode(F.sequence(F.col("segment") + 1, F.col("until"))).alias("segment"), "path", "w.*").join(pieces, _PIECE, "left_semi")
    nodes = paths.last_writes(seen, _PIECE, ["sequence", "part"], containers=True)
    built = trees.rehydrate(nodes, _PIECE)
    return pieces.join(built, _PIECE, "left").select(*_PIECE, F.coalesce("document", F.lit("{}")).alias("document"))


def assign_changes(rows: DataFrame, doc: str, changes: str) -> DataFrame:
    """rows with merged (JSON text of doc after its changes, an array of (path, JSON text), in path order) and pointer_error; merged is null where there is one. A null document is
    empty, text that is no JSON gives a null merged."""

    def one(text: str | None, writes: list | None) -> tuple[str | None, str | None]:
        new = {} if text is None else parse(text)
        try:
            for w in sorted(writes or [], key=lambda w: w[0]):
                value = parse(w[1])
                if new is BAD or value is BAD:
                    return None, None
                new = assign(new, w[0], value)
        except PointerError as e:
            return None, str(e)
        return (None if new is BAD else js.dumps(new, ensure_ascii=False)), None

    merged = F.udf(one, "merged string, pointer_error string", useArrow=True)
    return rows.withColumn("__m", merged(doc, changes)).select("*", "__m.merged", "__m.pointer_error").drop("__m")
