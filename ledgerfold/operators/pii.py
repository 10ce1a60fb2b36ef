"""Personal data inside events: extraction, encryption per subject, decryption, redaction.

A partition is what one event says of one subject under one label: (aggregate_id, sequence, subject_id, label, payload). Encrypted, it has nonce and
ciphertext, sealed by AES-256-GCM under the subject's data key and bound to its place by ``id:sequence:subject:label``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REDACTED = "[redacted]"
#: What stands for a value whose key is gone, by declared type.
REDACTIONS = {"string": REDACTED, "option": None, "json": "{}", "list": "[]", "date": "0000-01-01"}


def redaction_default(kind: str):
    return REDACTIONS[kind]


@dataclass(frozen=True)
class Codec:
    """Which fields of an event type are personal: the subject's column, and secret columns with their declared type."""

    event_type: str
    subject: str
    secret: dict[str, str]
    label: str = "default"

    def __post_init__(self):
        if not self.secret:
            raise ValueError(f"{self.event_type}: at least one secret field is needed")
        if self.subject in self.secret:
            raise ValueError(f"{self.event_type}: the subject can't be secret")
        for kind in self.secret.values():
            redaction_default(kind)

    def extract(self, log: DataFrame) -> DataFrame:
        """A secret of its own is stored bare, several as an object."""
        names = list(self.secret)
        payload = F.to_json(F.struct(*names)) if len(names) > 1 else F.col(names[0]).cast("string")
        rows = log.where((F.col("event_type") == self.event_type) & F.col(self.subject).isNotNull())
        return rows.select("aggregate_id", "sequence", F.col(self.subject).alias("subject_id"), F.lit(self.label).alias("label"), payload.alias("payload")).where("payload is not null")

    def restore(self, name: str):
        """The field from a decrypted payload, its redaction where the key is gone."""
        value = F.get_json_object("payload", f"$.{name}") if len(self.secret) > 1 else F.col("payload")
        return F.when(F.col("status") == "decrypted", value).otherwise(F.lit(redaction_default(self.secret[name])))


PERSON = Codec("PersonCaptured", "subject_id", {"name": "string", "email": "string", "phone": "option"})


def slots(log: DataFrame) -> DataFrame:
    """The subject that each slot is bound to: of its first capture."""
    first = log.where("event_type = 'PersonCaptured'").groupBy("aggregate_id", "person_ref")
    return first.agg(F.min_by("subject_id", "sequence").alias("subject_id"), F.min("sequence").alias("captured_at"))


def _of_slots(log: DataFrame, columns: dict[str, str], name: str) -> DataFrame:
    """Captures and the secrets of AttributesSet events, one row for each: (aggregate_id, sequence, person_ref, subject_id, capture, payload, bound, captured_at), bound being the subject of the slot's first capture; null for captures.
    It is known before events are exploded: one window by aggregate_id, without payloads. The log is read once; a log that is partitioned by aggregate_id isn't shuffled."""
    captured = F.col("event_type") == "PersonCaptured"
    first = lambda ref: F.min(F.when(captured & (F.col("person_ref") == ref), F.struct("sequence", "subject_id"))).over(Window.partitionBy("aggregate_id"))
    rows = log.where(captured | (F.col("event_type") == "AttributesSet")).select("aggregate_id", "sequence", "person_ref", "subject_id", *PERSON.secret, *columns.values(), captured.alias("capture"), *[first(ref).alias(f"__{n}") for n, ref in enumerate(columns)])
    text, number = F.lit(None).cast("string"), F.lit(None).cast("long")
    own = F.struct(F.col("person_ref").alias("ref"), text.alias("json"), text.alias("bound"), number.alias("captured_at"))
    json = lambda ref, col: F.when(F.col(col).isNotNull(), F.to_json(F.create_map(F.lit(f"/persons/{ref}/{name}"), F.col(col))))
    secrets = [F.struct(F.lit(ref).alias("ref"), json(ref, col).alias("json"), F.col(f"__{n}.subject_id").alias("bound"), F.col(f"__{n}.sequence").cast("long").alias("captured_at")) for n, (ref, col) in enumerate(columns.items())]
    rows = rows.withColumn("x", F.explode(F.when(F.col("capture"), F.array(own)).otherwise(F.array(*secrets)))).where("capture or x.json is not null")
    payload = F.when(F.col("capture"), F.to_json(F.struct(*PERSON.secret))).otherwise(F.col("x.json"))
    return rows.select("aggregate_id", "sequence", F.col("x.ref").alias("person_ref"), "subject_id", "capture", payload.alias("payload"), "x.bound", "x.captured_at")


def attribute_partitions(log: DataFrame, columns: dict[str, str], name: str) -> DataFrame:
    """Partitions of AttributesSet events: columns maps a slot to the column with its secret, name is the attribute. Empty ones are left out; a slot that isn't
    bound yet gives none."""
    return _of_slots(log, columns, name).where("not capture and captured_at < sequence").select("aggregate_id", "sequence", F.col("bound").alias("subject_id"), F.col("person_ref").alias("label"), "payload")


def details_partitions(log: DataFrame) -> DataFrame:
    """Partitions of PersonDetailsUpdated events (aggregate_id, sequence, event_type, subject_id, data): the patch as it is, under the label default. No data, or a JSON null, gives none."""
    rows = log.where("event_type = 'PersonDetailsUpdated' and subject_id is not null and data is not null and trim(data) <> 'null'")
    return rows.select("aggregate_id", "sequence", "subject_id", F.lit("default").alias("label"), F.col("data").alias("payload"))


def details_read(decrypted: DataFrame) -> DataFrame:
    """Patches back, or the redaction of a document."""
    data = F.when(F.col("status") == "decrypted", F.col("payload")).otherwise(F.lit(redaction_default("json")))
    return decrypted.select("aggregate_id", "sequence", "subject_id", data.alias("data"), "status")


def extract_partitions(log: DataFrame) -> DataFrame:
    rows = _of_slots(log, {"lead": "passport_lead", "agent": "passport_agent"}, "passportNumber").where("if(capture, subject_id is not null, captured_at < sequence)")
    return rows.select("aggregate_id", "sequence", F.expr("if(capture, subject_id, bound)").alias("subject_id"), F.expr(f"if(capture, '{PERSON.label}', person_ref)").alias("label"), "payload")


def clear(log: DataFrame) -> DataFrame:
    """The log without what its partitions hold."""
    gone = [*PERSON.secret, "passport_lead", "passport_agent"]
    return log.select(*[F.lit(None).cast(t).alias(c) if c in gone else F.col(c) for c, t in log.dtypes])


AAD = "concat_ws(':', aggregate_id, sequence, subject_id, label)"


def encrypt(partitions: DataFrame, keys: DataFrame) -> DataFrame:
    """keys: subject_id, data_key. A nonce is drawn in each evaluation: write the result before using it twice."""
    sealed = partitions.join(keys.select("subject_id", "data_key"), "subject_id").withColumn("sealed", F.expr(f"aes_encrypt(payload, data_key, 'GCM', 'DEFAULT', '', {AAD})"))
    return sealed.select("aggregate_id", "sequence", "subject_id", "label", F.expr("substring(sealed, 1, 12)").alias("nonce"), F.expr("substring(sealed, 13)").alias("ciphertext"))


def decrypt(sealed: DataFrame, keys: DataFrame, strict: bool = False) -> DataFrame:
    """Partitions with payload and status: decrypted, redacted (no key: the subject was erased) or failed (the key or the place is wrong, for instance
    a new key after an erasure). strict raises on the last."""
    opened = F.expr(f"try_aes_decrypt(concat(nonce, ciphertext), data_key, 'GCM', 'DEFAULT', {AAD})").cast("string")
    out = sealed.join(keys.select("subject_id", "data_key"), "subject_id", "left").withColumn("payload", opened)
    status = F.when(F.col("data_key").isNull(), "redacted").when(F.col("payload").isNull(), F.raise_error("a partition can't be decrypted") if strict else "failed").otherwise("decrypted")
    return out.select("aggregate_id", "sequence", "subject_id", "label", "payload", status.alias("status"))


def decrypt_legacy(sealed: DataFrame, keys: DataFrame) -> DataFrame:
    """The older form: one ciphertext an event, label default, bound to ``id:sequence`` only."""
    opened = F.expr("try_aes_decrypt(concat(nonce, ciphertext), data_key, 'GCM', 'DEFAULT', concat_ws(':', aggregate_id, sequence))").cast("string")
    out = sealed.join(keys.select("subject_id", "data_key"), "subject_id", "left").withColumn("payload", opened)
    status = F.when(F.col("data_key").isNull(), "redacted").when(F.col("payload").isNull(), "failed").otherwise("decrypted")
    return out.select("aggregate_id", "sequence", "subject_id", F.lit("default").alias("label"), "payload", status.alias("status"))


def encrypt_legacy(partitions: DataFrame, keys: DataFrame) -> DataFrame:
    sealed = partitions.join(keys.select("subject_id", "data_key"), "subject_id").withColumn("sealed", F.expr("aes_encrypt(payload, data_key, 'GCM', 'DEFAULT', '', concat_ws(':', aggregate_id, sequence))"))
    return sealed.select("aggregate_id", "sequence", "subject_id", F.expr("substring(sealed, 1, 12)").alias("nonce"), F.expr("substring(sealed, 13)").alias("ciphertext"))


def persons_read(decrypted: DataFrame) -> DataFrame:
    """Captures with their fields back, or redactions."""
    return decrypted.where("label = 'default'").select("aggregate_id", "sequence", "subject_id", *[PERSON.restore(n).alias(n) for n in PERSON.secret], "status")


def attributes_read(decrypted: DataFrame) -> DataFrame:
    """Secret attributes as rows (aggregate_id, sequence, label, path, value); a redacted partition has the one path /redacted."""
    good = F.from_json("payload", "map<string,string>")
    entries = F.when(F.col("status") == "decrypted", good).otherwise(F.create_map(F.lit("/redacted"), F.lit("true")))
    return decrypted.where("label <> 'default'").select("aggregate_id", "sequence", "label", F.explode(entries).alias("path", "value"))


def integrity(decrypted: DataFrame) -> DataFrame:
    return decrypted.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
