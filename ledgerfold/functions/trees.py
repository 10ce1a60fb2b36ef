"""Documents as long tables, back to JSON, and positions in arrays: what depends on the shape of the document, not on one path alone."""

from __future__ import annotations

import json as js
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cut import cut
from .paths import below


def _parts(path: Column) -> Column:
    return F.split(F.substring(path, 2, 1 << 30), "/")


def _upto(parts: Column, n: Column | int) -> Column:
    return F.when(F.lit(n) <= 0, F.lit("")).otherwise(F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/")))


@lru_cache(100_000)
def _step(path: str) -> tuple[str, str, str, tuple]:
    """Of a path: the one above, its last token decoded, this as a JSON text (written as Spark's to_json does), and where an element of this path stands: by its position, or after the numbers by its name."""
    up, _, token = path.rpartition("/")
    name = token.replace("~1", "/").replace("~0", "~")
    quoted = "".join(f"\\u{ord(c):04X}" if c < " " and c not in "\b\t\n\f\r" else js.dumps(c, ensure_ascii=False)[1:-1] for c in name)
    number = int(token) if re.fullmatch("[+-]?[0-9]{1,19}", token) else 1 << 63
    return up, name, f'"{quoted}":', (False, number, name) if -(1 << 63) <= number < 1 << 63 else (True, 0, name)


def _written(nodes: list[tuple]) -> str:
    """The JSON text of a document, of its (path, kind, json)."""
    texts, arrays, inside = {}, set(), {}
    for path, kind, text in nodes:
        if path and path[0] != "/":
            path = "/" + path[1:]
        if kind == "leaf":
            texts[path] = max(text, texts.get(path, text))
        elif kind == "array":
            arrays.add(path)
        while path:
            up = _step(path)[0]
            if up in inside:
                inside[up].add(path)
                break
            inside[up] = {path}
            path = up
    text_of = lambda x: texts[x] if x in texts else "[]" if x in arrays else "{}"
    for path in sorted(inside, key=lambda x: x.count("/"), reverse=True):
        if path in arrays:
            texts[path] = "[" + ",".join([text_of(x) for x in sorted(inside[path], key=lambda x: _step(x)[3])]) + "]"
        else:
            texts[path] = "{" + ",".join([_step(x)[2] + text_of(x) for x in sorted(inside[path], key=lambda x: _step(x)[1])]) + "}"
    return text_of("")


def rehydrate(nodes: DataFrame, key: list[str]) -> DataFrame:
    """(key..., document): JSON texts from the rows (key..., path, kind, json) of documents. kind is leaf (json is its JSON text; null is null), object or array; containers need a
    row only if they are arrays or empty. Keys are sorted; elements stand in the order of their positions.

    Rows are shuffled once, by document, and read as sorted streams; a document is one value, so its rows are all that a task holds. A row at the root ("") is the whole document. Rows of the same path count once; a
    leaf with rows below it is replaced by the container of these. A position that isn't a number sorts after the numbers."""
    json = F.when(F.col("kind") == "leaf", F.coalesce("json", F.lit("null")))
    rows = nodes.select(*key, "path", "kind", json.alias("json")).repartition(*key).sortWithinPartitions(*key)
    kinds = dict(nodes.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, types = None, [], None
        for b in batches:
            types = [*(b.schema.field(i).type for i in range(len(key))), pa.string()]
            cols = [b.column(i).to_pylist() for i in range(len(key) + 3)]
            out = []
            for here, *node in zip(zip(*cols[: len(key)]), *cols[len(key) :]):
                if here != last:
                    if held:
                        out.append((*last, _written(held)))
                    last, held = here, []
                held.append(node)
            yield documents(out, types)
        if held:
            yield documents([(*last, _written(held))], types)

    def documents(out: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * len(types), types)], [*key, "document"])

    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in key) + ", document string")


def _scan(events: DataFrame, names: list[str]) -> DataFrame:
    """What the accesses of candidates come to. events: names..., at (the candidate), sequence, part, event, token, n; one result row (names..., at, sequence, part, token, error, created, reset) where something changes."""
    keys = [*names, "at"]
    rows = events.repartition(*keys).sortWithinPartitions(*keys, "sequence", "part", F.desc("event"))
    kinds = dict(rows.dtypes)
    shape = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, "sequence", "part"]) + ", token string, error string, created boolean, reset boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kind, n = None, "gone", 0
        for b in batches:
            cols = {c: b.column(c).to_pylist() for c in [*keys, "sequence", "part", "event", "token", "n"]}
            take, out = [], []
            for i, (event, token, size) in enumerate(zip(cols["event"], cols["token"], cols["n"])):
                here = tuple(cols[c][i] for c in keys)
                if here != last:
                    last, kind, n = here, "gone", 0
                said = None
                if event == _ARRAY:
                    kind, n = "array", size
                elif event in (_OBJECT, _RESET):
                    if event == _OBJECT and kind == "array":
                        said = (None, None, False, True)
                    kind = "object"
                elif event == _GONE:
                    kind = "gone"
                elif kind == "gone":
                    kind = "array" if token in ("0", "-") else "object"
                    if kind == "array":
                        n, said = 1, ("0", None, True, False)
                elif kind == "array":
                    number = token.isascii() and token.isdigit() and (token == "0" or token[0] != "0")
                    if token != "-" and not number:
                        said = (None, f"FailedToParseIndex: {token.replace('~1', '/').replace('~0', '~')}", False, False)
                    elif token != "-" and int(token) > n:
                        said = (None, f"OutOfBounds: {int(token)}", False, False)
                    else:
                        at = n if token == "-" else int(token)
                        n, said = max(n, at + 1), (str(at), None, False, False)
                if said:
                    take.append(i)
                    out.append(said)
            found = b.select([*keys, "sequence", "part"]).take(pa.array(take, pa.int64()))
            extra = zip(*out) if out else [()] * 4
            types = (pa.string(), pa.string(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([*found.columns, *(pa.array(c, t) for c, t in zip(extra, types))], [*keys, "sequence", "part", "token", "error", "created", "reset"])

    return rows.mapInArrow(run, shape)


_ACCESS, _ARRAY, _OBJECT, _RESET, _GONE = range(5)


def resolve_positions(writes: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """writes (key..., sequence, part, path, value, json, op, arrays, base) with the positions of array elements made plain, and the writes that fail: (key..., sequence, part, error), None if there can be none.

    Assigned pointers (of base tokens) may hold positions whose meaning depends on what earlier writes left: - appends, a number is a position only in an array, 0 and - start an array where there is none. Pointers are resolved level by
    level, as the container of a level is known once those above it are. At each level, what happens to the containers in question (their length is given, they are replaced, an element is appended) is read as one sorted
    stream a container, of which only a kind and a length are kept; no group is gathered. A write that fails (FailedToParseIndex, OutOfBounds) is left out. An object merged over an array replaces it (op reset), and an array
    that an assignment starts gets a row of its own."""
    order = ["sequence", "part"]
    errors, level = None, 2
    while True:
        parts = _parts(F.col("path"))
        given = writes.where("base > 1").select(*key, *order, "base", F.slice(parts, 1, F.col("base")).alias("p")).distinct()
        at = given.where(F.col("base") >= level).select(*key, *order, F.explode(F.sequence(F.lit(level), F.col("base"))).alias("d"), "p")
        at = at.select(*key, *order, "d", F.get("p", F.col("d") - 1).alias("token"), _upto(F.col("p"), F.col("d") - 1).alias("at"))
        arrays = writes.where("op = 'array'").select(*key, F.col("path").alias("at")).distinct()
        hits = at.where("token in ('0', '-')").select(*key, "at", "d").union(at.join(arrays, [*key, "at"], "left_semi").select(*key, "at", "d"))
        d = hits.agg(F.min("d")).first()[0]
        if d is None:
            return writes, errors
        here = cut(hits.where(F.col("d") == d).drop("d").distinct())
        access = at.where(F.col("d") == d).drop("d").join(here, [*key, "at"], "left_semi").select(*key, "at", *order, F.lit(_ACCESS).alias("event"), "token", F.lit(0).alias("n"))
        values = writes.withColumn("size", F.size(parts))
        count = values.where((F.col("size") >= d) & (F.col("base") < d)).groupBy(*key, *order, _upto(parts, d - 1).alias("at")).agg(F.count_distinct(F.get(parts, F.lit(d - 1))).cast("int").alias("n"))
        own = values.where((F.col("size") == d - 1) & (F.col("base") < d)).select(*key, *order, F.col("path").alias("at"), "op").join(here, [*key, "at"], "left_semi")
        own = own.join(count, [*key, *order, "at"], "left").select(*key, "at", *order, F.expr(f"case op when 'array' then {_ARRAY} when 'object' then {_OBJECT} when 'reset' then {_RESET} else {_GONE} end").alias("event"), F.coalesce("n", F.lit(0)).alias("n"))
        above = here.select(*key, "at", F.explode(below(F.col("at"))).alias("path")).join(writes.where("op <> 'object'").select(*key, *order, "path"), [*key, "path"]).select(*key, "at", *order, F.lit(_GONE).alias("event"), F.lit(0).alias("n"))
        # of one write, what it says of the container itself counts
        reset = own.union(above).groupBy(*key, "at", *order).agg(F.min(F.struct("event", "n")).alias("x")).select(*key, "at", *order, "x.event", F.lit(None).cast("string").alias("token"), "x.n")
        change = cut(_scan(access.union(reset), key))
        touched = change.where("token is not null or error is not null").select(*key, *order, F.col("token").alias("__t"), "error")
        turned = change.where("reset").select(*key, *order, F.col("at").alias("path"), F.lit(True).alias("__r"))
        opened = change.where("created").select(*key, *order, F.col("at").alias("path"), F.lit("array").alias("op"), F.lit(None).cast("array<string>").alias("arrays"), F.lit(0).alias("base"))
        changed = writes.join(touched, [*key, *order], "left").join(turned, [*key, *order, "path"], "left")
        moved = F.when(F.col("__t").isNotNull() & (F.col("base") >= d), F.concat(_upto(parts, d - 1), F.lit("/"), F.col("__t"), F.expr(f"substring(path, length(substring_index(path, '/', {d + 1})) + 1)"))).otherwise(F.col("path"))
        failed = change.where("error is not null").select(*key, *order, "error")
        errors = failed if errors is None else errors.unionByName(failed)
        now = changed.where("error is null").withColumn("path", moved).withColumn("op", F.when(F.col("__r"), "reset").otherwise(F.col("op"))).drop("__t", "__r", "error")
        writes = cut(now.unionByName(opened, allowMissingColumns=True))
        level = d + 1
