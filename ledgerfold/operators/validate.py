"""Validation of JSON documents and of steps, compiled once to columns."""

from __future__ import annotations

import json as js
import re
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import documents

_KINDS = {"string": "STRING", "boolean": "BOOLEAN"}


def _is(kind: str, schema: Column, value: Column | None = None) -> Column:
    """Whether a variant's kind (and value, for integers: 1.0 and 1e0 are such) is of a JSON Schema type."""
    if kind == "null":
        return schema.isin("VOID", "NULL")
    if kind == "object":
        return F.startswith(schema, F.lit("OBJECT"))
    if kind == "array":
        return F.startswith(schema, F.lit("ARRAY"))
    if kind == "integer":
        whole = schema.isin("BIGINT", "TINYINT", "SMALLINT", "INT") | schema.rlike(r"^DECIMAL\(\d+,0\)$")
        if value is None:
            return whole
        number = F.try_variant_get(value, "$", "double")
        return whole | (_is("number", schema) & F.coalesce(number == F.floor(number), F.lit(False)))
    if kind == "number":
        return schema.isin("BIGINT", "TINYINT", "SMALLINT", "INT", "DOUBLE", "FLOAT") | F.startswith(schema, F.lit("DECIMAL"))
    return schema == _KINDS[kind]


def _in_enum(entries: list, kind: Column, value: Column) -> Column:
    """Whether a variant equals one of the entries, as JSON values: by kind, numbers by their value."""
    ok = F.lit(False)
    of = lambda test: [x for x in entries if test(x)]
    if strings := of(lambda x: isinstance(x, str)):
        ok = ok | (_is("string", kind) & F.try_variant_get(value, "$", "string").isin(*strings))
    if numbers := of(lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)):
        ok = ok | (_is("number", kind) & F.try_variant_get(value, "$", "double").isin(*map(float, numbers)))
    if flags := of(lambda x: isinstance(x, bool)):
        ok = ok | (_is("boolean", kind) & F.try_variant_get(value, "$", "boolean").isin(*flags))
    if None in entries:
        ok = ok | _is("null", kind)
    for x in of(lambda x: isinstance(x, (dict, list))):
        ok = ok | (F.to_json(value) == F.to_json(F.parse_json(F.lit(js.dumps(x)))))
    return F.coalesce(ok, F.lit(False))


def _refers_to_itself(schema: dict) -> bool:
    """Whether following the references of a schema comes back to one that is being followed."""
    defs = schema.get("$defs", {})

    def walk(node: object, above: tuple[str, ...]) -> bool:
        if isinstance(node, list):
            return any(walk(x, above) for x in node)
        if not isinstance(node, dict):
            return False
        if isinstance(ref := node.get("$ref"), str):
            return ref in above or walk(defs[ref.rsplit("/", 1)[1]], (*above, ref))
        return any(walk(x, above) for k, x in node.items() if k not in ("$defs", "enum"))

    return walk(schema, ())


def compile_schema(schema: dict, column: str = "doc", defs: dict | None = None, at: str = "") -> Column:
    """An array of "path keyword" for all that is wrong with the variant column: type, properties, required, enum, minimum, maximum, minLength,
    items, anyOf, oneOf, $ref and additionalProperties (false); other keywords are annotations."""
    defs = defs or schema.get("$defs", {})

    def check(s: dict, value: Column, path: Column, depth: int) -> Column:
        if "$ref" in s:
            return check(defs[s["$ref"].rsplit("/", 1)[1]], value, path, depth)
        kind = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
        out: list[Column] = []
        fail = lambda bad, word: F.when(F.coalesce(bad, F.lit(False)), F.array(F.concat_ws(" ", path, F.lit(word)))).otherwise(F.array().cast("array<string>"))
        if "type" in s:
            kinds = s["type"] if isinstance(s["type"], list) else [s["type"]]
            ok = F.lit(False)
            for k in kinds:
                ok = ok | _is(k, kind, value)
            out.append(fail(~ok, "type"))
        if "enum" in s:
            out.append(fail(~_in_enum(s["enum"], kind, value), "enum"))
        number = F.try_variant_get(value, "$", "double")
        if "minimum" in s:
            out.append(fail(_is("number", kind) & (number < s["minimum"]), "minimum"))
        if "maximum" in s:
            out.append(fail(_is("number", kind) & (number > s["maximum"]), "maximum"))
        if "minLength" in s:
            out.append(fail(_is("string", kind) & (F.length(F.try_variant_get(value, "$", "string")) < s["minLength"]), "minLength"))
        is_object = _is("object", kind)
        fields = F.try_variant_get(value, "$", "map<string,variant>")
        for name in s.get("required", []):
            out.append(fail(is_object & ~F.coalesce(F.map_contains_key(fields, name), F.lit(False)), f"required:{name}"))
        for name, sub in s.get("properties", {}).items():
            child = F.try_variant_get(value, f"$.{name}", "variant")
            inner = check(sub, child, F.concat(path, F.lit(f"/{name}")), depth + 1)
            out.append(F.when(is_object & F.coalesce(F.map_contains_key(fields, name), F.lit(False)), inner).otherwise(F.array().cast("array<string>")))
        if s.get("additionalProperties") is False:
            extra = F.size(F.array_except(F.map_keys(fields), F.array(*[F.lit(n) for n in s.get("properties", {})]).cast("array<string>"))) > 0
            out.append(fail(is_object & extra, "additionalProperties"))
        if "items" in s:
            items = F.try_variant_get(value, "$", "array<variant>")
            per = F.transform(items, lambda v, i: check(s["items"], v, F.concat(path, F.lit("/"), i.cast("string")), depth + 1))
            out.append(F.when(_is("array", kind), F.flatten(per)).otherwise(F.array().cast("array<string>")))
        for word, least in (("anyOf", None), ("oneOf", 1)):
            if word in s:
                good = sum((F.when(F.size(check(x, value, path, depth + 1)) == 0, 1).otherwise(0) for x in s[word]), F.lit(0))
                out.append(fail(good < 1 if least is None else good != 1, word))
        return F.concat(*out) if out else F.array().cast("array<string>")

    return check(schema, F.col(column), F.lit(at), 0)


@dataclass
class _Node:
    """A node of the schema that every document is asked for by name: its schema, its pointer, and its number."""

    schema: dict
    path: str
    number: int
    parent: int
    name: str
    depth: int


def _named_nodes(schema: dict, defs: dict) -> list[_Node]:
    """The root and what properties lead to, with references followed; what is inside items, anyOf and oneOf isn't named."""
    out = [_Node(schema, "", 0, -1, "", 0)]
    for node in out:
        while "$ref" in node.schema:
            node.schema = defs[node.schema["$ref"].rsplit("/", 1)[1]]
        if node.depth >= 32:
            raise ValueError(f"{node.path}: the schema refers to itself")
        for name, sub in node.schema.get("properties", {}).items():
            out.append(_Node(sub, f"{node.path}/{name}", len(out), node.number, name, node.depth + 1))
    return out


def validate(docs: DataFrame, json: str, schema: dict) -> DataFrame:
    """docs with errors (sorted) and valid; text that is no JSON has the error "json".

    Each named node is taken out of its parent once, as a column, and so is its kind; a keyword is one condition on these columns. A schema that refers to itself has no such finite form: then each text is
    looked through by documents.checker, in Arrow batches; one too deep for that has the error "depth"."""
    if _refers_to_itself(schema):

        def look(text: str | None) -> list[str]:
            try:
                return documents.checker(schema)(documents.BAD if text is None else documents.parse(text))
            except RecursionError:
                return [" depth"]

        errors = F.udf(look, "array<string>", useArrow=True)(F.col(json))
        return docs.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0)
    defs = schema.get("$defs", {})
    nodes = _named_nodes(schema, defs)
    v = docs.withColumn("__v0", F.expr(f"try_parse_json({json})"))
    for depth in range(max(n.depth for n in nodes) + 1):
        if depth:
            v = v.withColumns({f"__v{n.number}": F.try_variant_get(f"__v{n.parent}", f"$.{n.name}", "variant") for n in nodes if n.depth == depth})
        v = v.withColumns({f"__k{n.number}": F.substring_index(F.schema_of_variant(f"__v{n.number}"), "<", 1) for n in nodes if n.depth == depth})
    found, rest = [], []
    for n in nodes:
        s, value, kind = n.schema, F.col(f"__v{n.number}"), F.col(f"__k{n.number}")
        there = kind.isNotNull()  # a key that is missing has no kind
        fail = lambda bad, word: found.append(F.when(there & bad, F.lit(f"{n.path} {word}")))  # noqa: B023, E731
        if "type" in s:
            kinds = s["type"] if isinstance(s["type"], list) else [s["type"]]
            fail(~reduce(or_, [_is(k, kind, value) for k in kinds]), "type")
        if "enum" in s:
            fail(~_in_enum(s["enum"], kind, value), "enum")
        for word, over in (("minimum", lambda x, y: x < y), ("maximum", lambda x, y: x > y)):
            if word in s:
                fail(_is("number", kind) & over(F.try_variant_get(value, "$", "double"), s[word]), word)
        if "minLength" in s:
            fail(_is("string", kind) & (F.length(F.try_variant_get(value, "$", "string")) < s["minLength"]), "minLength")
        named = {m.name: m.number for m in nodes if m.parent == n.number}
        for name in s.get("required", []):
            missing = F.col(f"__k{named[name]}").isNull() if name in named else F.try_variant_get(value, f"$.{name}", "variant").isNull()
            fail(_is("object", kind) & missing, f"required:{name}")
        other = {k: s[k] for k in ("additionalProperties", "items", "anyOf", "oneOf") if k in s}
        if other:
            names = {"properties": dict.fromkeys(s.get("properties", {}), {})} if "additionalProperties" in other else {}
            rest.append(F.when(there, compile_schema(other | names, f"__v{n.number}", defs, n.path)))
    errors = F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
    for more in rest:
        errors = F.concat(errors, F.coalesce(more, F.array().cast("array<string>")))
    errors = F.when(F.col("__v0").isNull(), F.array(F.lit(" json"))).otherwise(F.array_sort(errors))
    out = v.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0)
    return out.select(*docs.columns, "errors", "valid")


_NULLABLE = lambda kind: {"type": [kind, "null"]}
#: The part of the booking schema that the sample documents have.
BOOKING = {
    "type": "object",
    "properties": {
        "search": {
            "type": "object",
            "required": ["tripType", "origin", "destination", "departureDate", "passengers"],
            "properties": {
                "tripType": {"type": "string", "enum": ["one-way", "round-trip", "multi-city"]},
                "origin": {"type": "string"},
                "destination": {"type": "string"},
                "departureDate": {"type": "string"},
                "returnDate": _NULLABLE("string"),
                "passengers": {"$ref": "#/$defs/Passengers"},
            },
        },
        "booking": {"type": "object", "properties": {"selectedOutboundFlight": _NULLABLE("string"), "selectedReturnFlight": _NULLABLE("string"), "paymentStatus": _NULLABLE("string")}},
    },
    "$defs": {"Passengers": {"type": "object", "required": ["adults", "children"], "properties": {k: {"type": "integer", "minimum": 0} for k in ("adults", "children", "infants")}}},
}

# Rules by step as (step, field, condition that has to hold, message).
STEP_RULES = [
    ("search_criteria", "origin", "origin is not null and length(origin) = 3", "Valid origin airport code required"),
    ("search_criteria", "destination", "destination is not null and length(destination) = 3", "Valid destination airport code required"),
    ("search_criteria", "departureDate", "departure_date is not null and departure_date > as_of", "Departure date must be in the future"),
    ("search_criteria", "passengers", "passengers > 0 and passengers <= 9", "Number of passengers must be between 1 and 9"),
    ("search_criteria", "returnDate", "trip_type <> 'round-trip' or (return_date is not null and return_date > departure_date)", "Return date must be after departure date"),
    ("outbound_flight_selection", "selectedOutboundFlight", "outbound is not null", "Please select an outbound flight"),
    ("return_flight_selection", "selectedReturnFlight", "return_flight is not null", "Please select a return flight"),
    ("passenger_details", "passengers", "details is not null and forall(details, d -> d.first_name is not null and d.last_name is not null and d.birth is not null and d.document is not null)", "Complete passenger details required for all travelers"),
    ("passenger_details", "passengerNames", "details is null or forall(details, d -> length(d.first_name) > 1 and length(d.last_name) > 1)", "Passenger names must be at least 2 characters"),
    ("passenger_details", "passengerAges", "details is null or forall(details, d -> year(as_of) - year(d.birth) between 0 and 120)", "Invalid passenger birth dates"),
    ("payment", "paymentMethod", "payment_type is not null", "Valid payment method required"),
    ("payment", "cardNumber", "payment_type <> 'credit_card' or (card_number is not null and length(card_number) >= 13)", "Valid card number required"),
    ("payment", "expiryDate", "payment_type <> 'credit_card' or (expiry is not null and to_date(concat(expiry, '-01')) > as_of)", "Card expiry date must be in the future"),
    ("payment", "billingAddress", "street is not null and city is not null and country is not null", "Complete billing address required"),
    ("booking_summary", "termsAccepted", "terms_accepted = true", "You must accept terms and conditions"),
]

STEP_INPUTS = frozenset("origin destination departure_date return_date trip_type as_of passengers outbound return_flight details payment_type card_number expiry street city country terms_accepted".split())


def validate_steps(rows: DataFrame, step: str = "step") -> DataFrame:
    """rows with validated (fields that a rule of the row's step looked at), failures (messages) and is_valid. Rules whose columns are missing are left out."""
    known = set(rows.columns)
    usable = [r for r in STEP_RULES if {w for w in re.findall(r"[a-z_]+", r[2]) if w in STEP_INPUTS} <= known]
    checked = F.array(*[F.when(F.col(step) == name, F.struct(F.lit(label).alias("field"), F.coalesce(F.expr(condition), F.lit(False)).alias("ok"), F.lit(message).alias("message"))) for name, label, condition, message in usable])
    mine = F.filter(checked, lambda r: r.isNotNull())
    out = rows.withColumn("__r", mine)
    bad = F.filter("__r", lambda r: ~r["ok"])
    return out.withColumn("validated", F.transform("__r", lambda r: r["field"])).withColumn("failures", F.transform(bad, lambda r: r["message"])).withColumn("is_valid", F.size("failures") == 0).drop("__r")
