"""Rule models as data: expression nodes and decision tables, written in the cell language of decision tables, become Catalyst expressions.

A cell is put into Spark SQL token by token (Spark's own parser knows precedence), so nothing is interpreted row by row. What a model may say: strings, numbers, lists, paths of attributes (an
attribute that the rows don't have is null), == and != (null is a value for both), comparisons, and, or, not (&&, ||, !), in, ??, c ? a : b, arithmetic, and the functions of _CALLS; date() counts
days, weekday() counts from Sunday = 0, now() is the column as_of, # is an element inside all, some, map, filter and one. A cell below an input with a field may leave the field out: 'x', < 3, > 1 && <= 2,
in [..], [1..5], (1..5], != x, alternatives by commas, $ for the field itself; an empty cell holds for all. Types should fit: a text isn't compared with a number, but number(text) is.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r"""\s*(?:(?P<text>'[^']*'|"[^"]*")|(?P<number>\d+(?:\.\d+)?)|(?P<path>[#$]?\.?[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*|[#$])|(?P<op>\.\.|\?\?|==|!=|<=|>=|&&|\|\||[-+*/%<>!?:,()\[\]]))""")
_WORDS = {"and": "and", "or": "or", "not": "not", "in": "in", "true": "true", "false": "false", "null": "null"}
_OPS = {"==": "<=>", "!=": "is distinct from", "&&": "and", "||": "or", "!": "not"}
_DAY = "date_from_unix_date"
_CALLS = {
    "date": lambda x: f"unix_date(try_cast({x} as date))", "number": lambda x: f"try_cast({x} as double)", "string": lambda x: f"cast({x} as string)", "values": lambda x: f"map_values({x})", "keys": lambda x: f"map_keys({x})",
    "year": lambda x: f"year({_DAY}({x}))", "month": lambda x: f"month({_DAY}({x}))", "day": lambda x: f"day({_DAY}({x}))", "weekday": lambda x: f"(dayofweek({_DAY}({x})) - 1)", "exists": lambda x: f"({x} is not null)",
    "upper": lambda x: f"upper({x})", "lower": lambda x: f"lower({x})", "abs": lambda x: f"abs({x})", "floor": lambda x: f"floor({x})", "ceil": lambda x: f"ceil({x})", "round": lambda *x: f"round({', '.join(x)})",
    "contains": lambda a, b: f"contains({a}, {b})", "startsWith": lambda a, b: f"startswith({a}, {b})", "endsWith": lambda a, b: f"endswith({a}, {b})", "sum": lambda x: f"aggregate({x}, 0D, (s, v) -> s + v)", "min": lambda x: f"array_min({x})", "max": lambda x: f"array_max({x})",
}
_EACH = {"all": "forall", "some": "exists", "map": "transform", "filter": "filter"}


class ModelError(ValueError):
    """A model that can't be read: a cell, a cycle of columns, a node of another kind."""


Tokens = list[tuple[str, str]]


def tokens(cell: str) -> Tokens:
    found, at, cell = [], 0, cell.strip()
    while at < len(cell):
        m = _TOKEN.match(cell, at)
        if not m:
            raise ModelError(f"{cell!r} at {at}")
        found.append((m.lastgroup, m.group(m.lastgroup)))
        at = m.end()
    return found


def references(cell: str) -> set[str]:
    """The paths that a cell reads."""
    t = tokens(cell)
    return {v for i, (k, v) in enumerate(t) if k == "path" and v not in _WORDS and v[0] not in "#$." and t[i + 1 : i + 2] != [("op", "(")]}


def _split(t: Tokens, *at: str) -> list[Tokens]:
    """t cut at the operators or words in at that stand outside all brackets."""
    parts, depth = [[]], 0
    for token in t:
        depth += (token[1] in "([" and token[0] == "op") - (token[1] in ")]" and token[0] == "op")
        if depth == 0 and token[0] != "text" and token[1] in at:
            parts.append([])
        else:
            parts[-1].append(token)
    return parts


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


class Cells:
    """Cells over the columns of rows, as SQL text."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def value(self, cell: Any) -> str:
        """The SQL of a whole expression; a text in quotes that holds quotes is that text."""
        cell = {True: "true", False: "false", None: "null"}.get(cell, cell) if isinstance(cell, bool) or cell is None else str(cell)
        try:
            t = tokens(cell)
            if any(a[0] == "text" and b[0] in ("text", "number") or a[0] == "text" and b[0] == "path" and b[1] not in _WORDS for a, b in zip(t, t[1:])):
                raise ModelError(cell)
        except ModelError:
            if len(cell) > 1 and cell[0] in "'\"" and cell[0] == cell[-1]:
                return _quoted(cell[1:-1])
            raise
        return self._sql(t, None)

    def condition(self, cell: Any, field: str | None) -> str:
        """The SQL of a condition, of a field if there is one."""
        if cell is None or str(cell).strip() in ("", "-"):
            return "true"
        if not field:
            return self.value(cell)
        t = tokens(str(cell).lower() if isinstance(cell, bool) else str(cell))
        left = self._path(field, None)
        if ("path", "$") in t:
            return self._sql([("sql", left) if x == ("path", "$") else x for x in t], None)
        alternatives = []
        for part in _split(t, ",", "or", "||"):
            alternatives.append(" and ".join(self._clause(left, c) for c in _split(part, "and", "&&")))
        return " or ".join(f"({a})" for a in alternatives)

    def _clause(self, left: str, t: Tokens) -> str:
        words = [v for _, v in t]
        if words[:1] == ["in"] or words[:2] == ["not", "in"]:
            no = words[0] == "not"
            return f"{'not ' if no else ''}coalesce({self._sql([('sql', left), *t[no:]], None)}, false)"
        if t and t[0][0] == "op" and (t[0][1] in _OPS or t[0][1] in "<=>=") and t[0][1] != "!":
            return f"({self._sql([('sql', left), *t], None)})"
        ends = self._interval(t)
        if ends:
            low, high = ends
            return f"({left} {'>=' if words[0] == '[' else '>'} {low} and {left} {'<=' if words[-1] == ']' else '<'} {high})"
        return f"({self._sql([('sql', left), ('op', '=='), *t], None)})"

    def _interval(self, t: Tokens) -> tuple[str, str] | None:
        if len(t) < 5 or t[0] not in (("op", "["), ("op", "(")) or t[-1] not in (("op", "]"), ("op", ")")):
            return None
        ends = _split(t[1:-1], "..")
        return (self._sql(ends[0], None), self._sql(ends[1], None)) if len(ends) == 2 else None

    def _path(self, path: str, element: str | None) -> str:
        """A path as SQL; null if the rows have no such attribute."""
        names = path.split(".")
        if names[0] == "#":
            if element is None:
                raise ModelError("# outside all, some, map and filter")
            return ".".join([element, *(f"`{n}`" for n in names[1:])])
        kind: Any = self.rows.schema
        for n in names:
            if isinstance(kind, T.MapType):
                kind = kind.valueType
            elif isinstance(kind, T.StructType) and n in kind.names:
                kind = kind[n].dataType
            else:
                return "null"
        return ".".join(f"`{n}`" for n in names)

    def _sql(self, t: Tokens, element: str | None) -> str:
        if not t:
            raise ModelError("an empty expression")
        if (t[-1][0] == "op" and t[-1][1] not in ")]") or t[-1] in [("path", w) for w in ("and", "or", "not", "in")]:
            raise ModelError(f"nothing after {t[-1][1]}")
        cut = _split(t, "?")
        if len(cut) > 1:
            rest = t[len(cut[0]) + 1 :]
            depth = seen = 0
            for i, (k, v) in enumerate(rest):
                depth += (k == "op" and v in "([") - (k == "op" and v in ")]")
                seen += k == "op" and v == "?" and depth == 0
                if k == "op" and v == ":" and depth == 0:
                    if seen == 0:
                        return f"case when {self._sql(cut[0], element)} then {self._sql(rest[:i], element)} else {self._sql(rest[i + 1 :], element)} end"
                    seen -= 1
            raise ModelError("? without :")
        out: list[str] = []
        i = 0
        while i < len(t):
            kind, v = t[i]
            if kind == "op" and v in ("==", "!=") and t[i + 1 : i + 2] == [("path", "null")]:  # maps can't be compared, but can be null
                out.append("is null" if v == "==" else "is not null")
                i += 2
            elif kind == "op" and v == "??":
                right, i = self._operand(t, i + 1, element)
                out[-1:] = [f"coalesce({out[-1]}, {right})"]
            elif (kind == "op" and v not in "([") or (kind == "path" and v in ("and", "or", "not", "in")):
                if v in ("..", ",", ":", ")", "]"):
                    raise ModelError(f"{v} out of place")
                out.append(_OPS.get(v, v))
                i += 1
            elif out and out[-1] == "in" and (kind, v) == ("op", "["):
                end = self._close(t, i)
                ends = self._interval(t[i : end + 1])
                if ends:
                    out[-1:] = [f"between {ends[0]} and {ends[1]}"]
                else:
                    out.append("(" + ", ".join(self._sql(p, element) for p in _split(t[i + 1 : end], ",") if p or end > i + 1) + ")" if end > i + 1 else "(null)")
                i = end + 1
            else:
                x, i = self._operand(t, i, element)
                out.append(x)
        return " ".join(out)

    def _close(self, t: Tokens, at: int) -> int:
        depth = 0
        for i in range(at, len(t)):
            depth += (t[i][0] == "op" and t[i][1] in "([") - (t[i][0] == "op" and t[i][1] in ")]")
            if depth == 0:
                return i
        raise ModelError("a bracket that isn't closed")

    def _operand(self, t: Tokens, i: int, element: str | None) -> tuple[str, int]:
        if i >= len(t):
            raise ModelError("an operand is missing")
        kind, v = t[i]
        if kind == "sql":
            return v, i + 1
        if kind == "text":
            return _quoted(v[1:-1]), i + 1
        if kind == "number":
            return (v + "D" if "." in v else v), i + 1
        if kind == "path" and v in ("true", "false", "null"):
            return v, i + 1
        if kind == "path" and t[i + 1 : i + 2] == [("op", "(")]:
            end = self._close(t, i + 1)
            out, i = self._call(v, _split(t[i + 2 : end], ",") if end > i + 2 else [], element), end + 1
            while i < len(t) and t[i][0] == "path" and t[i][1][0] == ".":
                for name in t[i][1][1:].split("."):
                    out = _CALLS[name](out) if name in ("year", "month", "day") else f"{out}.`{name}`"
                i += 1
            return out, i
        if kind == "path":
            return self._path(v, element), i + 1
        if v in "([":
            end = self._close(t, i)
            inner = t[i + 1 : end]
            if v == "(":
                return f"({self._sql(inner, element)})", end + 1
            return "array(" + (", ".join(self._sql(p, element) for p in _split(inner, ",")) if inner else "") + ")", end + 1
        raise ModelError(f"{v} where a value should be")

    def _call(self, name: str, args: list[Tokens], element: str | None) -> str:
        if name == "now" and not args:
            if "as_of" not in self.rows.columns:
                raise ModelError("now() needs a column as_of")
            return "`as_of`"
        if name in _EACH or name == "one":
            inner = "x" if element is None else element + "x"
            over, body = self._sql(args[0], element), self._sql(args[1], inner)
            return f"(size(filter({over}, {inner} -> {body})) = 1)" if name == "one" else f"{_EACH[name]}({over}, {inner} -> {body})"
        if name == "len":
            x = self._sql(args[0], element)
            kind = T.StringType() if element else self.rows.select(F.expr(x)).schema[0].dataType
            return f"size({x})" if isinstance(kind, (T.ArrayType, T.MapType)) else f"length({x})"
        if name not in _CALLS:
            raise ModelError(f"no function {name}")
        return _CALLS[name](*(self._sql(a, element) for a in args))


@dataclass(frozen=True)
class Node:
    name: str
    kind: str
    content: dict


def load_model(text: str) -> dict[str, Node]:
    """The expression nodes and decision tables of a model's JSON text, by name, in the order of its edges (a node comes after those that lead to it). Nodes of other kinds are left out."""
    model = json.loads(text)
    nodes = {n["id"]: n for n in model["nodes"]}
    before = {i: {e["sourceId"] for e in model.get("edges", []) if e["targetId"] == i} for i in nodes}
    kinds = {"expressionNode": "expression", "decisionTableNode": "table"}
    return {nodes[i]["name"]: Node(nodes[i]["name"], kinds[nodes[i]["type"]], nodes[i]["content"]) for layer in layers(before) for i in layer if nodes[i]["type"] in kinds}


def layers(needs: dict[str, set[str]]) -> list[list[str]]:
    """Names in layers, each needing earlier layers only; ModelError for a cycle."""
    left, out = dict(needs), []
    while left:
        ready = [n for n, wants in left.items() if not (wants & left.keys()) - {n}]
        if not ready:
            raise ModelError("a cycle of " + ", ".join(sorted(left)))
        out.append(ready)
        left = {n: w for n, w in left.items() if n not in ready}
    return out


def _covers(a: str, b: str) -> bool:
    return a == b or a.startswith(b + ".") or b.startswith(a + ".")


def expression_node(rows: DataFrame, content: dict) -> DataFrame:
    """rows with the columns of an expression node ({"expressions": [{"key", "value"}], "passThrough"}); a dotted key is a field of a struct. A key that reads another one of the node comes after it, whatever
    their order; what reads itself reads the input. One projection a layer."""
    given = {e["key"]: str(e["value"]) for e in content["expressions"]}
    needs = {k: {o for o in given if o != k and any(_covers(r, o) for r in references(v))} for k, v in given.items()}
    for layer in layers(needs):
        cells = Cells(rows)
        rows = _placed(rows, {k: F.expr(cells.value(given[k])) for k in layer})
    return rows if content.get("passThrough", True) else rows.select(*dict.fromkeys(k.split(".")[0] for k in given))


def _placed(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    tree: dict = {}
    for key, value in values.items():
        *above, name = key.split(".")
        at = tree
        for a in above:
            at = at.setdefault(a, {})
            if not isinstance(at, dict):
                raise ModelError(f"{key} is below a value")
        at[name] = value

    def built(node: Any, there: Column | None, kind: Any) -> Column:
        if isinstance(node, Column):
            return node
        known = kind.names if isinstance(kind, T.StructType) else []
        kept = [there.getField(n).alias(n) for n in known if n not in node]
        return F.struct(*kept, *[built(x, there.getField(n) if n in known else None, kind[n].dataType if n in known else None).alias(n) for n, x in node.items()])

    return rows.withColumns({n: built(x, F.col(f"`{n}`") if n in rows.columns else None, rows.schema[n].dataType if n in rows.columns else None) for n, x in tree.items()})


def decision(rows: DataFrame, content: dict) -> Column:
    """A decision table ({"hitPolicy", "inputs", "outputs", "rules"}) over rows: a struct of the outputs of the first rule that holds (null if none does), or an array of those of all rules that hold, in their order."""
    cells, inputs, outputs = Cells(rows), content["inputs"], content["outputs"]
    rules = []
    for r in content["rules"]:
        conditions = [cells.condition(r.get(i["id"]), i.get("field")) for i in inputs]
        values = [cells.value(r.get(o["id"]) if r.get(o["id"]) != "" else None) for o in outputs]
        rules.append((F.expr(" and ".join(f"({c})" for c in conditions if c != "true") or "true"), values))
    kinds = [rows.select(F.coalesce(*[F.expr(v[i]) for _, v in rules])).schema[0].dataType for i in range(len(outputs))] if rules else [T.StringType() for _ in outputs]
    line = lambda values: F.struct(*[F.expr(v).cast(k).alias(o["field"]) for v, k, o in zip(values, kinds, outputs)])
    shape = T.StructType([T.StructField(o["field"], k) for o, k in zip(outputs, kinds)])
    if content.get("hitPolicy", "first") == "collect":
        return F.filter(F.array(*[F.when(c, line(v)) for c, v in rules]), lambda x: x.isNotNull()) if rules else F.array().cast(T.ArrayType(shape))
    out = F.lit(None).cast(shape)
    for c, values in reversed(rules):
        out = F.when(c, line(values)).otherwise(out)
    return out


def evaluate(rows: DataFrame, node: Node, name: str = "decision") -> DataFrame:
    """rows with what a node adds: its columns, or the column name with a table's outputs."""
    return expression_node(rows, node.content) if node.kind == "expression" else rows.withColumn(name, decision(rows, node.content))
