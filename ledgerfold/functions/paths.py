"""Documents as long tables: one row for each (pointer, leaf). Pointers are RFC 6901 strings."""

from __future__ import annotations

import json as js

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cut import cut


def escape(token: Column) -> Column:
    return F.replace(F.replace(token, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def tokens(pointer: Column) -> Column:
    """The decoded tokens of a pointer; the empty pointer has none."""
    parts = F.split(F.substring(pointer, 2, 1 << 30), "/")
    decoded = F.transform(parts, lambda t: F.replace(F.replace(t, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")))
    return F.when(pointer == "", F.array().cast("array<string>")).otherwise(decoded)


def from_tokens(items: Column) -> Column:
    return F.when(F.size(items) == 0, F.lit("")).otherwise(F.concat(F.lit("/"), F.array_join(F.transform(items, escape), "/")))


def strip_prefix(pointer: Column, prefix: Column) -> Column:
    """The pointer below prefix, null if it isn't below it."""
    return F.when(F.startswith(pointer, F.concat(prefix, F.lit("/"))), F.substring(pointer, F.length(prefix) + 1, F.lit(1 << 30)))


def item(path: str, v: str, part: str, fresh: str = "false", base: str = "0") -> str:
    """SQL of a node of a document that is to be taken apart. part: its place in the order of writes; fresh: whether it replaces what it is written to; base: how many tokens of its path are a pointer that was
    assigned, 0 if none was."""
    return f"named_struct('path', {path}, 'v', {v}, 'part', cast({part} as int), 'fresh', {fresh}, 'base', cast({base} as int))"


class _Number(str):
    """A number as it is written."""


def deep_items(nodes: list | None) -> list[tuple] | None:
    """(path, leaf, kind, part, arrays, base) of all that (path, JSON text, part, arrays, base) nodes hold, however deep."""
    if nodes is None:
        return None
    out = []
    for path, text, part, arrays, base in nodes:
        todo = [(path, js.loads(text, parse_int=_Number, parse_float=_Number), arrays)]
        while todo:
            path, x, arrays = todo.pop()
            if isinstance(x, dict):
                out.append((path, None, "object", part, arrays, base))
                todo += [(f"{path}/{k.replace('~', '~0').replace('/', '~1')}", v, arrays) for k, v in x.items()]
            elif isinstance(x, list):
                out.append((path, None, "array", part, arrays, base))
                todo += [(f"{path}/{i}", v, [*arrays, path]) for i, v in enumerate(x)]
            else:
                # of a variant's numbers, only doubles end in .0
                leaf = str(x) + "E0" * x.endswith(".0") if isinstance(x, _Number) else js.dumps(x)
                out.append((path, leaf, "null" if x is None else "leaf", part, arrays, base))
    return out


_DEEP = "array<struct<path string, leaf string, kind string, part int, arrays array<string>, base int>>"


_OPENED = "array<struct<path:string,kind:string,arrays:array<string>>>"


def _level(rows: str, keep: str, containers: bool) -> str:
    """SQL of rows (SQL of a relation) whose variant holds others replaced by one row for each of these; of rows that hold none, all stay."""
    cols = [keep, "if(e.pos is null, r.__path, concat(r.__path, '/', coalesce(replace(replace(e.key, '~', '~0'), '/', '~1'), string(e.pos)))) as __path", "if(e.pos is null, r.__v, e.value) as __v", "r.__part", "r.__base"]
    if containers:
        kind = "case when e.key is null then 'array' when r.__fresh then 'reset' else 'object' end"
        cols += [
            f"case when e.pos is null then r.__opened when e.pos = 0 then concat(r.__opened, array(struct(r.__path as path, {kind} as kind, r.__arrays as arrays))) else cast(array() as {_OPENED}) end as __opened",
            "if(e.pos is not null and e.key is null, concat(r.__arrays, array(r.__path)), r.__arrays) as __arrays", "r.__fresh and e.pos is null as __fresh",
        ]
    return f"(select {', '.join(c for c in cols if c)} from {rows} as r, lateral variant_explode_outer(r.__v) as e)"


def taken_apart(df: DataFrame, start: str, keep: list[str], text: str, depth: int = 8, containers: bool = True) -> DataFrame:
    """(keep..., path, value, json, kind, part, arrays, base): the items that start (SQL of an array of items, made of the JSON text) holds, at any depth, as rows. value is a leaf as text, json its JSON text. Without containers: leaves only, without arrays.

    A level is one variant_explode of the rows so far; the first row of a container brings the container's own. There are as many levels as the texts have brackets, ``depth`` at most. Only if some text goes deeper, these texts and no others go through deep_items."""
    brackets = F.coalesce(F.length(text) - F.length(F.translate(text, "{[", "")), F.lit(0))
    most = df.agg(F.max(brackets)).first()[0] or 0
    none = F.array().cast("array<string>")

    def levels(few: DataFrame) -> DataFrame:
        given = few.select(*keep, F.explode(F.expr(start)).alias("__c"))
        more = [F.col("__c.fresh").alias("__fresh"), none.alias("__arrays"), F.array().cast(_OPENED).alias("__opened")] if containers else []
        given = given.select(*keep, *[F.col(f"__c.{c}").alias(f"__{c}") for c in ("path", "v", "part", "base")], *more)
        sql = "{given}"
        for _ in range(min(depth, most)):
            sql = _level(sql, ", ".join(f"r.`{c}`" for c in keep), containers)
        rows = given.sparkSession.sql(f"select * from {sql} as r", given=given)
        rows = rows.withColumn("__json", F.to_json("__v"))
        nothing = F.col("__v").isNull() | F.is_variant_null("__v")
        end = F.when(nothing, "null").when(~F.substring("__json", 1, 1).isin("{", "["), "leaf")
        if not containers:
            return rows.withColumn("__kind", end.when(F.col("__json").isin("{}", "[]"), "none"))
        empty = F.when(F.col("__json") == "[]", "array").when(F.col("__json") == "{}", F.when(F.col("__fresh"), "reset").otherwise("object"))
        return rows.withColumn("__kind", F.coalesce(end, empty))

    def done(rows: DataFrame) -> DataFrame:
        at = lambda c: F.when(F.col("__kind") == "leaf", c)
        own = [F.col("__path").alias("path"), at(F.col("__v").cast("string")).alias("value"), at(F.col("__json")).alias("json"), F.col("__kind").alias("kind")]
        if not containers:
            flat = rows.where("__kind in ('leaf', 'null')").select(*keep, *own, F.col("__part").alias("part"), F.col("__base").alias("base"))
        else:
            last = F.struct(*own, F.col("__arrays").alias("arrays"))
            opened = F.transform("__opened", lambda o: F.struct(o["path"].alias("path"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("json"), o["kind"].alias("kind"), o["arrays"].alias("arrays")))
            every = F.when((F.size("__opened") == 0) & F.col("__kind").isNotNull(), F.array(last)).when(F.col("__kind").isNull(), opened).otherwise(F.concat(opened, F.array(last)))
            flat = rows.select(*keep, F.explode(every).alias("__x"), "__part", "__base").select(*keep, "__x.path", "__x.value", "__x.json", "__x.kind", F.col("__part").alias("part"), "__x.arrays", F.col("__base").alias("base"))
        return flat.where("path <> ''")

    many = levels(df.where(brackets > depth)).where("__kind is null")
    if most <= depth or many.isEmpty():
        return done(levels(df))
    rest = F.array(F.struct(F.col("__path").alias("path"), F.col("__json").alias("text"), F.col("__part").alias("part"), (F.col("__arrays") if containers else none).alias("arrays"), F.col("__base").alias("base")))
    found = many.select(*keep, F.explode(F.udf(lambda nodes: deep_items(nodes), _DEEP)(rest)).alias("c")).select(*keep, "c.*")
    found = found.select(*keep, "path", F.expr("cast(try_parse_json(leaf) as string)").alias("value"), F.expr("to_json(try_parse_json(leaf))").alias("json"), "kind", "part", *(["arrays"] if containers else []), "base")
    return done(levels(df)).unionByName(found.where("path <> ''" if containers else "path <> '' and kind in ('leaf', 'null')"))


def _root(json: str) -> str:
    return f"array({item(chr(39) * 2, f'try_parse_json({json})', '0')})"


def flatten(df: DataFrame, json: str, keep: list[str], depth: int = 8) -> DataFrame:
    """(keep..., path, value, is_null): the leaves of a JSON text column, at any depth. Null leaves stay; a root scalar and empty objects or
    arrays vanish."""
    rows = taken_apart(df, _root(json), keep, json, depth, containers=False)
    return rows.select(*keep, "path", "value", (F.col("kind") == "null").alias("is_null"))


def flatten_nodes(df: DataFrame, json: str, keep: list[str], depth: int = 8) -> DataFrame:
    """(keep..., path, kind, json): leaves and containers of a JSON text column, at any depth, as trees.rehydrate reads them; without the root."""
    rows = taken_apart(df, _root(json), keep, json, depth)
    return rows.select(*keep, "path", F.expr("case when kind in ('leaf', 'null') then 'leaf' else kind end").alias("kind"), F.expr("case when kind = 'null' then 'null' else json end").alias("json"))


def normalize_changes(commands: DataFrame, json: str, keep: list[str]) -> DataFrame:
    """(keep..., path, value) of the bodies of SetAttributes commands: {"changes": {pointer: value}} as it is, anything else as the nested form of it. A body is
    canonical if changes is its only key."""
    c = commands.withColumn("__c", F.coalesce(F.expr(f"map_keys(try_variant_get(try_parse_json({json}), '$', 'map<string,variant>')) = array('changes')"), F.lit(False)))
    nested = flatten(c.where(~F.col("__c")), json, keep).select(*keep, "path", "value")
    item = F.explode(F.expr(f"try_variant_get(try_parse_json({json}), '$.changes', 'map<string,variant>')"))
    return nested.unionByName(c.where("__c").select(*keep, item.alias("path", "__v")).select(*keep, "path", F.expr("cast(__v as string)").alias("value")))


def ancestors(pointer: Column) -> Column:
    """The pointers strictly above, the root left out."""
    parts = F.split(F.substring(pointer, 2, 1 << 30), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/")))


def below(pointer: Column) -> Column:
    """ancestors, for pointers of one token or none too, which have none."""
    return F.when(F.instr(F.substring(pointer, 2, 1 << 30), "/") > 0, ancestors(pointer)).otherwise(F.array().cast("array<string>"))


def last_writes(writes: DataFrame, key: list[str], order: list[str], containers: bool = False) -> DataFrame:
    """Of rows (key..., path, value, op, order...) what stands after all of them in order, with arrays (null if writes don't have it). op is set (a value), delete,
    reset or array (a node replaced), or object (a node merged into: it replaces a value or an array, whose elements name it in arrays).

    A write replaces what stood at its path, above it (a scalar that has to become an object) and below it. Rows that stand
    are found by two aggregations and one join on (key, path): no group is collected. Positions in arrays are taken as they are written (see trees.resolve_positions). With containers, the
    rows of objects and arrays that stand are there too, with kind (leaf, object or array) and json."""
    for name, kind in (("arrays", "array<string>"), ("json", "string")):
        if name not in writes.columns:
            writes = writes.withColumn(name, F.lit(None).cast(kind))
    at, merges = F.struct(*order), F.col("op") == "object"
    latest = writes.groupBy(*key, "path").agg(F.max_by(F.struct("value", "json", "op", "arrays"), at).alias("w"), F.max(at).alias("ord"), F.max(F.when(~merges, at)).alias("replaced"), F.max(F.when(merges, at)).alias("merged"))
    latest = cut(latest.select(*key, "path", "w.value", "w.json", "w.op", "w.arrays", "ord", "replaced", "merged"))  # read by four branches
    deep = latest.where(F.instr(F.substring("path", 2, 1 << 30), "/") > 0)
    below = deep.select(*key, F.col("path").alias("low"), F.col("ord").alias("low_ord"), F.col("arrays").alias("low_arrays"), F.explode(ancestors(F.col("path"))).alias("path"))
    pairs = below.join(latest.select(*key, "path", "ord", "replaced", "merged"), [*key, "path"])
    dead_low = pairs.where((F.col("replaced") > F.col("low_ord")) | (F.array_contains("low_arrays", F.col("path")) & (F.col("merged") > F.col("low_ord")))).select(*key, F.col("low").alias("path"))
    dead_high = pairs.where(F.col("low_ord") > F.col("ord")).select(*key, "path")
    leaves = latest.where("op = 'set'").join(dead_low.unionByName(dead_high).distinct(), [*key, "path"], "left_anti")
    if not containers:
        return leaves.select(*key, "path", "value", "arrays")
    kind = F.expr("case op when 'set' then 'leaf' when 'array' then 'array' else 'object' end").alias("kind")
    nodes = latest.where("op not in ('set', 'delete')").join(dead_low.distinct(), [*key, "path"], "left_anti")
    return leaves.unionByName(nodes).select(*key, "path", "value", "arrays", kind, "json")


def last_values(writes: DataFrame, key: list[str], order: list[str], wanted: dict[str, str]) -> DataFrame:
    """(key..., columns of wanted): the values that last_writes leaves at a few known paths (column -> path), null where nothing stands; a row for each key of writes.

    What can invalidate a path is known too: writes at it, above it and below it, so all is one aggregation by key and no path is joined with its ancestors."""
    at, merges = F.struct(*order), F.col("op") == "object"
    if "arrays" not in writes.columns:
        writes = writes.withColumn("arrays", F.lit(None).cast("array<string>"))
    tokens_of = {p: p.split("/")[1:] for p in wanted.values()}
    above = {p: ["/" + "/".join(t[:n]) for n in range(1, len(t))] for p, t in tokens_of.items()}
    ups = sorted({a for x in above.values() for a in x})
    path = F.col("path")
    aggs = []
    for n, a in enumerate(ups):
        aggs += [F.max(F.when((path == a) & ~merges, at)).alias(f"__r{n}"), F.max(F.when((path == a) & merges, at)).alias(f"__m{n}")]
    for n, p in enumerate(wanted.values()):
        here = F.when(path == p, F.struct(at.alias("at"), F.col("op").alias("op"), F.col("value").alias("value"), F.col("arrays").alias("arrays")))
        aggs += [F.max_by(here, F.when(path == p, at)).alias(f"__w{n}"), F.max(F.when(F.startswith(path, F.lit(p + "/")), at)).alias(f"__b{n}")]
    found = writes.groupBy(*key).agg(*aggs)
    out = []
    for n, (column, p) in enumerate(wanted.items()):
        w = F.col(f"__w{n}")
        later = lambda c: F.coalesce(F.col(c) > w["at"], F.lit(False))  # noqa: B023, E731
        dead = later(f"__b{n}")
        for a in above[p]:
            k = ups.index(a)
            dead |= later(f"__r{k}") | (F.coalesce(F.array_contains(w["arrays"], a), F.lit(False)) & later(f"__m{k}"))
        out.append(F.when((w["op"] == "set") & ~dead, w["value"]).alias(column))
    return found.select(*key, *out)


def shallow(path: Column) -> Column:
    """The first segment, at which a shallow merge replaces."""
    return F.concat(F.lit("/"), F.split(F.substring(path, 2, 1 << 30), "/")[0])


def shallow_merge(writes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Last writer wins for each first segment as a whole; nulls are stored. Rows of one order are one write."""
    top = writes.withColumn("top", shallow(F.col("path"))).withColumn("ord", F.struct(*order))
    last = top.groupBy(*key, "top").agg(F.max("ord").alias("ord"))
    return top.where("op = 'set'").join(last, [*key, "top", "ord"]).select(*key, "path", "value")
