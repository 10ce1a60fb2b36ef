"""The event log: envelope, scans and typed events.

Columns: aggregate_type, aggregate_id, sequence, event_type, event_version, payload (JSON text), timestamp. Payloads are externally tagged,
``{"Tag": {...}}``, or the bare string of a tag without fields.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENVELOPE = "aggregate_type string, aggregate_id string, sequence long, event_type string, event_version string, payload string, timestamp timestamp"
#: event_type -> tag of the payload, where they differ
TAGS = {"JourneyOpened": "Started", "JourneyModified": "Modified", "JourneyClosed": "Completed"}


def scan_event_log(log: DataFrame, aggregate_type: str = "journey") -> DataFrame:
    return log.where(F.col("aggregate_type") == aggregate_type)


def read_log(spark: SparkSession, path: str, aggregate_type: str = "journey", fmt: str = "parquet") -> DataFrame:
    return scan_event_log(spark.read.schema(ENVELOPE).format(fmt).load(path), aggregate_type)


def uuid_ranges(n: int, column: str = '"aggregate_id"') -> list[str]:
    """n conditions (1 to 65536) that split ids which begin with random hexadecimal digits, as UUIDs do, into equal ranges; every row, whatever its id, meets one."""
    if not 1 <= n <= 65536:
        raise ValueError("1 to 65536 ranges")
    bounds = [f"'{k * 65536 // n:04x}'" for k in range(1, n)]
    lower = [f"{column} >= {x}" for x in bounds]
    upper = [f"{column} < {x}" for x in bounds]
    if n == 1:
        return ["1 = 1"]
    return [f"{upper[0]} or {column} is null", *[f"{x} and {y}" for x, y in zip(lower, upper[1:])], lower[-1]]


def read_log_jdbc(spark: SparkSession, url: str, table: str = "events", aggregate_type: str = "journey", conditions: list[str] | None = None, **options: str) -> DataFrame:
    """The log from a relational table, one task for each condition (SQL of the database; together they have to hold each row once), by default 64 ranges of UUIDs.
    The type filter and the columns asked for are pushed down."""
    rows = spark.read.jdbc(url, table, predicates=conditions or uuid_ranges(64), properties=options)
    return scan_event_log(rows.withColumn("payload", F.col("payload").cast("string")), aggregate_type).select(*[c.split()[0] for c in ENVELOPE.split(", ")])


def write_bucketed(log: DataFrame, table: str, buckets: int, rows_per_file: int = 5_000_000, mode: str = "overwrite") -> DataFrame:
    """The log as a catalog table in buckets by aggregate_id: a scan of one aggregate reads one bucket, and groups, windows and joins by aggregate_id need no
    shuffle. A task writes one bucket's events of one span of sequences, so an aggregate with a third of all events is many tasks' work and many files."""
    bucket = F.pmod(F.hash("aggregate_id"), F.lit(buckets))
    span = F.floor(F.col("sequence") / rows_per_file)
    spread = log.repartition(buckets, bucket, span).sortWithinPartitions("aggregate_id", "sequence")
    spread.write.format("parquet").mode(mode).bucketBy(buckets, "aggregate_id").sortBy("aggregate_id", "sequence").saveAsTable(table)
    return log.sparkSession.table(table)


def stream_log(spark: SparkSession, path: str, aggregate_type: str = "journey", fmt: str = "parquet") -> DataFrame:
    return scan_event_log(spark.readStream.schema(ENVELOPE).format(fmt).load(path), aggregate_type)


def scan_aggregate(log: DataFrame, aggregate_id: str) -> DataFrame:
    return log.where(F.col("aggregate_id") == aggregate_id).orderBy("sequence")


def tail_after(log: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Events after each aggregate's snapshot (aggregate_id, last_sequence); all events of those without one."""
    joined = log.join(snapshots.select("aggregate_id", "last_sequence"), "aggregate_id", "left")
    return joined.where(F.col("sequence") > F.coalesce("last_sequence", F.lit(0))).drop("last_sequence")


def tail_last(log: DataFrame, n: int) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("aggregate_id").orderBy(F.desc("sequence")))
    return log.withColumn("r", r).where(F.col("r") <= n).drop("r")


def parse_events(log: DataFrame) -> DataFrame:
    """The envelope with typed columns of each event: step, data (JSON of a patch), from_step, to_step, actions, phase (null in version 1.0), is_completed,
    person_ref, subject_id, name, email, phone, plaintext (JSON of the attributes set) and partitions (JSON of the secret ones)."""
    get = lambda tag, field, kind: F.expr(f"try_variant_get(doc, '$.{tag}.{field}', '{kind}')")
    doc = log.withColumn("doc", F.expr("try_parse_json(payload)"))
    return doc.select(
        *log.columns,
        get("Started", "id", "string").alias("started_id"),
        get("Modified", "step", "string").alias("step"),
        F.coalesce(*[F.to_json(get(tag, "data", "variant")) for tag in ("Modified", "PersonDetailsUpdated")]).alias("data"),
        get("StepProgressed", "from_step", "string").alias("from_step"),
        get("StepProgressed", "to_step", "string").alias("to_step"),
        F.expr("cast(try_variant_get(doc, '$.WorkflowEvaluated.suggested_actions', 'array<string>') as array<string>)").alias("actions"),
        get("WorkflowEvaluated", "phase", "string").alias("phase"),
        (F.expr("try_variant_get(doc, '$', 'string')") == "Completed").alias("is_completed"),
        F.coalesce(*[get(tag, "person_ref", "string") for tag in ("PersonCaptured", "PersonDetailsUpdated")]).alias("person_ref"),
        F.coalesce(*[get(tag, "subject_id", "string") for tag in ("PersonCaptured", "PersonDetailsUpdated", "SubjectForgotten")]).alias("subject_id"),
        *[get("PersonCaptured", name, "string").alias(name) for name in ("name", "email", "phone")],
        F.to_json(get("AttributesSet", "plaintext", "variant")).alias("plaintext"),
        F.to_json(get("AttributesSet", "secret_partitions", "variant")).alias("partitions"),
    )


def event_catalogue(log: DataFrame) -> DataFrame:
    return log.groupBy("event_type", "event_version").count().withColumnRenamed("count", "n")


def sequence_gaps(log: DataFrame) -> DataFrame:
    """Events whose sequence is negative, repeated or not the successor of the one before."""
    w = Window.partitionBy("aggregate_id").orderBy("sequence")
    before = F.lag("sequence").over(w)
    kind = F.when(F.col("sequence") < 0, "negative").when(F.col("sequence") == before, "duplicate").when(F.col("sequence") != F.coalesce(before, F.lit(0)) + 1, "gap")
    return log.select("aggregate_id", "sequence", kind.alias("problem")).where("problem is not null")


def append_conflicts(batch: DataFrame, log: DataFrame) -> DataFrame:
    """The batch with conflict: its key is in the log, or comes more than once in the batch."""
    key = ["aggregate_type", "aggregate_id", "sequence"]
    twice = F.count(F.lit(1)).over(Window.partitionBy(*key)) > 1
    known = log.select(*key).distinct().withColumn("known", F.lit(True))
    return batch.withColumn("twice", twice).join(known, key, "left").withColumn("conflict", F.col("twice") | F.coalesce("known", F.lit(False))).drop("twice", "known")


def audit_feed(log: DataFrame) -> DataFrame:
    """One readable line per event; feed it the redacted log."""
    return log.select(F.concat_ws("-", "aggregate_id", "sequence").alias("event"), F.concat_ws(" ", "event_type", "payload").alias("line"))
