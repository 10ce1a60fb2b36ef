"""Classification of attribute paths as plaintext, secret or unknown, and change sets split by it."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths

#: What a JSON pointer looks like, whole.
POINTER = r"^(/([^~/]|~[01])*)*\z"
INVALID = "invalid"


@dataclass(frozen=True)
class AttributeSchema:
    """Exact paths, then patterns of three segments (/namespace/ref/name), then plaintext prefixes; the rest is unknown unless permissive."""

    prefixes: tuple[str, ...] = ()
    namespaces: dict[str, dict[str, tuple[str, ...]]] = field(default_factory=dict)  # namespace -> plaintext / secret names
    exact: dict[str, str] = field(default_factory=dict)
    permissive: bool = False

    @classmethod
    def load(cls, spec: dict | None) -> AttributeSchema:
        """From its JSON form; without a file everything is plaintext."""
        if spec is None:
            return cls(permissive=True)
        spaces = {n: {"plaintext": tuple(v.get("plaintext", ())), "secret": tuple(v.get("secret", ()))} for n, v in spec.get("namespace_patterns", {}).items()}
        return cls(tuple(spec.get("plaintext_prefixes", ())), spaces, dict(spec.get("exact", {})), bool(spec.get("permissive", False)))

    def classify(self, path: Column) -> Column:
        """plaintext, secret, unknown or, of what is no JSON pointer, invalid. Tokens are compared decoded."""
        seg = paths.tokens(path)
        out = F.lit("plaintext" if self.permissive else "unknown")
        if self.prefixes:
            out = F.when(F.get(seg, F.lit(0)).isin(*self.prefixes), "plaintext").otherwise(out)
        for name, kinds in reversed(self.namespaces.items()):
            here = (F.size(seg) == 3) & (F.get(seg, F.lit(0)) == name)
            for kind in ("secret", "plaintext"):
                if kinds[kind]:
                    out = F.when(here & F.get(seg, F.lit(2)).isin(*kinds[kind]), kind).otherwise(out)
        for exact, kind in self.exact.items():
            out = F.when(path == exact, kind).otherwise(out)
        return F.when(F.coalesce(~path.rlike(POINTER), F.lit(False)), INVALID).otherwise(out)

    def kind(self, path: str) -> str:
        """The same for one path, for stateful streams."""
        if not re.fullmatch(POINTER[1:-2], path, re.DOTALL):
            return INVALID
        seg = [t.replace("~1", "/").replace("~0", "~") for t in path.split("/")[1:]] or [""]
        if path in self.exact:
            return self.exact[path]
        if len(seg) == 3 and seg[0] in self.namespaces:
            for kind in ("plaintext", "secret"):
                if seg[2] in self.namespaces[seg[0]][kind]:
                    return kind
        return "plaintext" if seg[0] in self.prefixes or self.permissive else "unknown"


#: The schema of the booking example.
BOOKING = AttributeSchema(
    prefixes=("search", "searchResults", "booking"),
    namespaces={"persons": {"plaintext": ("passengerType",), "secret": ("dateOfBirth", "firstName", "lastName", "nationality", "passportNumber")}},
)


def subject_slot(path: Column) -> Column:
    """The slot that owns a secret path, /namespace/ref."""
    seg = F.split(F.substring(path, 2, 1 << 30), "/")
    return F.concat(F.lit("/"), F.get(seg, F.lit(0)), F.lit("/"), F.get(seg, F.lit(1)))


def classify_changes(changes: DataFrame, slots: DataFrame, schema: AttributeSchema) -> DataFrame:
    """changes (aggregate_id, sequence, path, value) with bucket and subject_id. A secret whose slot no earlier capture in slots (aggregate_id, person_ref,
    subject_id, captured_at) has bound is unbound."""
    c = changes.withColumn("class", schema.classify(F.col("path"))).withColumn("person_ref", F.get(paths.tokens(F.col("path")), F.lit(1)))
    bound = slots.groupBy("aggregate_id", "person_ref").agg(F.min("captured_at").alias("captured_at"), F.min_by("subject_id", "captured_at").alias("subject_id"))
    c = c.join(bound, ["aggregate_id", "person_ref"], "left")
    known = F.coalesce(F.col("captured_at") < F.col("sequence"), F.lit(False))
    bucket = F.when(F.col("class") != "secret", F.col("class")).when(known, "secret").otherwise("unbound")
    return c.select("aggregate_id", "sequence", "path", "value", "person_ref", bucket.alias("bucket"), F.when(bucket == "secret", F.col("subject_id")).alias("subject_id"))


def rejections(classified: DataFrame) -> DataFrame:
    """Commands that can't be accepted: a path that is no JSON pointer, all unknown paths, or the slot of the first unbound secret in path order."""
    out = classified.groupBy("aggregate_id", "sequence").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("bucket") == "unknown", F.col("path")))), ",").alias("unknown_paths"),
        F.min_by("person_ref", F.when(F.col("bucket") == "unbound", F.col("path"))).alias("unbound_ref"), F.max(F.col("bucket") == INVALID).alias("invalid"),
    )
    error = F.when(F.col("invalid"), "InvalidJsonPointer").when(F.col("unknown_paths") != "", "UnknownAttributePath").when(F.col("unbound_ref").isNotNull(), "PersonNotFound")
    return out.select("aggregate_id", "sequence", error.alias("error"), "unknown_paths", "unbound_ref").where("error is not null")


def secret_partitions(classified: DataFrame) -> DataFrame:
    """One row for each subject of a change set: label (the last ref in order that the subject has there) and its changes as a sorted JSON map."""
    entry = F.struct("path", "value")
    return (
        classified.where("bucket = 'secret'")
        .groupBy("aggregate_id", "sequence", "subject_id")
        .agg(F.max("person_ref").alias("label"), F.to_json(F.map_from_entries(F.array_sort(F.collect_set(entry)))).alias("changes"))
    )


def undeclared(stored: DataFrame, schema: AttributeSchema) -> DataFrame:
    return stored.select("path").distinct().where(schema.classify(F.col("path")) == "unknown")


def inventory(stored: DataFrame, schema: AttributeSchema) -> DataFrame:
    """Stored attributes by class and first segment."""
    prefix = F.split(F.substring("path", 2, 1 << 30), "/")[0]
    return stored.groupBy(schema.classify(F.col("path")).alias("class"), prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
