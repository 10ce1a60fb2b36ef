"""Commands as rows, from JSON lines: an object whose one key is the command's name, {"Name": {...}}; an empty body starts a new journey."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = ("Start", "Capture", "SetAttributes", "CapturePerson", "CapturePersonDetails", "Complete", "ForgetSubject")


def parse_commands(bodies: DataFrame) -> DataFrame:
    """bodies (aggregate_id, sequence, body, time, uri, user_agent) with command, its arguments as JSON text, and metadata as a map. A missing aggregate_id is made
    up: write the result before using it twice. What isn't a known command has a null one."""
    doc = F.expr("try_parse_json(body)")
    name = F.when(F.coalesce(F.trim("body"), F.lit("")) == "", "Start").otherwise(F.coalesce(F.expr("map_keys(try_variant_get(doc, '$', 'map<string,variant>'))[0]"), F.expr("try_variant_get(doc, '$', 'string')")))
    c = bodies.withColumn("doc", doc).withColumn("name", name)
    args = F.expr("to_json(map_values(try_variant_get(doc, '$', 'map<string,variant>'))[0])")
    return c.select(
        F.coalesce("aggregate_id", F.uuid()).alias("aggregate_id"), "sequence", F.when(F.col("name").isin(*NAMES), F.col("name")).alias("command"), args.alias("arguments"),
        F.map_filter(F.create_map(F.lit("time"), F.col("time"), F.lit("uri"), F.col("uri"), F.lit("User-Agent"), F.col("user_agent")), lambda k, v: v.isNotNull()).alias("metadata"),
    )


def command_source(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    schema = "aggregate_id string, sequence long, body string, time string, uri string, user_agent string"
    return parse_commands((spark.readStream if streaming else spark.read).schema(schema).json(path))
