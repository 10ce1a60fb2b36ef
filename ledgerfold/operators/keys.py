"""Keys of data subjects: wrapping, rotation, erasure, subject ids.

A key table has subject_id, key_id, kek_id and wrapped_key. Data keys are wrapped by AES-256-GCM under the master key that
kek_id names, bound to key_id. Master keys come as a dictionary of hexadecimal text and enter plans as a joined column, not a literal.
"""

from __future__ import annotations

import hashlib
import secrets

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = "subject_id string, key_id string, kek_id string, wrapped_key binary"


def masters(df: DataFrame, master: dict[str, str]) -> DataFrame:
    rows = df.sparkSession.createDataFrame([(k, bytearray.fromhex(v)) for k, v in master.items()], "kek_id string, master binary")
    return F.broadcast(rows)  # a handful of key versions


def wrap(rows: DataFrame, master: dict[str, str]) -> DataFrame:
    """rows (subject_id, key_id, kek_id, data_key) to a key table."""
    sealed = F.expr("aes_encrypt(data_key, master, 'GCM', 'DEFAULT', '', key_id)")
    return rows.join(masters(rows, master), "kek_id").select("subject_id", "key_id", "kek_id", sealed.alias("wrapped_key"))


def unwrap(keys: DataFrame, master: dict[str, str]) -> DataFrame:
    """The key table with data_key and status: unwrapped, unknown_version or failed."""
    opened = F.expr("try_aes_decrypt(wrapped_key, master, 'GCM', 'DEFAULT', key_id)")
    out = keys.join(masters(keys, master), "kek_id", "left").withColumn("data_key", opened)
    status = F.when(F.col("master").isNull(), "unknown_version").when(F.col("data_key").isNull(), "failed").otherwise("unwrapped")
    return out.withColumn("status", status).drop("master")


def stale(keys: DataFrame, current: str) -> DataFrame:
    return keys.where(F.col("kek_id") != current)


def rewrap(keys: DataFrame, current: str, master: dict[str, str]) -> DataFrame:
    """All keys under the current version, with status: rewrapped, already_current, unknown_version or failed (left as they were)."""
    old = keys.withColumnRenamed("wrapped_key", "old_key")
    opened = unwrap(keys, master).withColumn("own", F.col("kek_id"))
    todo = (F.col("own") != current) & (F.col("status") == "unwrapped")
    new_master = masters(keys, {current: master[current]}).withColumnRenamed("kek_id", "current")
    out = opened.withColumn("current", F.lit(current)).join(new_master, "current")
    sealed = F.expr("aes_encrypt(data_key, master, 'GCM', 'DEFAULT', '', key_id)")
    status = F.when(F.col("own") == current, "already_current").when(F.col("status") == "unwrapped", "rewrapped").otherwise(F.col("status"))
    return out.select("subject_id", "key_id", F.when(todo, F.lit(current)).otherwise(F.col("own")).alias("kek_id"), F.when(todo, sealed).otherwise(F.col("wrapped_key")).alias("wrapped_key"), F.col("own").alias("old_kek_id"), status.alias("status"))


def apply_rewrap(keys: DataFrame, delta: DataFrame) -> DataFrame:
    """Compare and swap: a rewrapped key replaces the one that still has the version it was read with; erased ones don't come back."""
    d = delta.where("status = 'rewrapped'").select("subject_id", F.col("old_kek_id").alias("kek_id"), F.col("kek_id").alias("new_kek"), F.col("wrapped_key").alias("new_key"))
    out = keys.join(d, ["subject_id", "kek_id"], "left")
    return out.select("subject_id", "key_id", F.coalesce("new_kek", "kek_id").alias("kek_id"), F.coalesce("new_key", "wrapped_key").alias("wrapped_key"))


def usage(keys: DataFrame) -> DataFrame:
    return keys.groupBy("kek_id").agg(F.count(F.lit(1)).alias("n"))


def unknown_versions(keys: DataFrame, known: list[str]) -> DataFrame:
    return keys.select("kek_id").distinct().where(~F.col("kek_id").isin(*known))


def backfill_version(keys: DataFrame, default: str = "legacy:v1") -> DataFrame:
    return keys.withColumn("kek_id", F.coalesce("kek_id", F.lit(default)))


def missing_subjects(subjects: DataFrame, keys: DataFrame) -> DataFrame:
    """Subjects that need a key. Make keys for them in a step that writes them once: random columns are evaluated anew by each use."""
    return subjects.select("subject_id").where("subject_id is not null").distinct().join(keys.select("subject_id"), "subject_id", "left_anti")


def ensure_keys(subjects: DataFrame, path: str, current: str, master: dict[str, str]) -> DataFrame:
    """The key table at path with a key for every subject, one each: those that lack one get a random key, appended before anyone reads it, so that
    all uses see the same. Run again it adds nothing; one writer at a time. Keys come from the operating system's generator on the executors."""
    @F.pandas_udf("binary")
    def drawn(ids: pd.Series) -> pd.Series:
        return pd.Series([secrets.token_bytes(32) for _ in ids])

    spark = subjects.sparkSession
    stored = spark.read.schema(KEYS).parquet(path)
    new = missing_subjects(subjects, stored).select("subject_id", F.expr("uuid()").alias("key_id"), F.lit(current).alias("kek_id"))
    new = new.withColumn("data_key", drawn.asNondeterministic()("subject_id"))
    wrap(new, master).write.mode("append").parquet(path)
    return spark.read.schema(KEYS).parquet(path)


def shred(keys: DataFrame, requests: DataFrame) -> DataFrame:
    """The key table without the erased subjects; what was encrypted under their keys can't be read again once old versions are purged."""
    return keys.join(requests.select("subject_id").distinct(), "subject_id", "left_anti")


def erase(log: DataFrame, keys: DataFrame, index: DataFrame, requests: DataFrame, journeys: DataFrame) -> dict[str, DataFrame]:
    """All that an erasure of subjects changes: keys and lookup without them, and the SubjectForgotten events to append, one for each journey that knows the
    subject (journeys: subject_id, aggregate_id) and hasn't forgotten it, numbered on from its last event. Write keys and lookup first: without events the
    data is gone all the same, and a second run appends what is missing and nothing twice."""
    wanted = requests.select("subject_id").where("subject_id is not null").distinct()
    known = journeys.join(wanted, "subject_id", "left_semi").select("aggregate_id", "subject_id", F.lit(True).alias("known"), F.lit(None).cast("long").alias("last"))
    forgot = F.when(F.col("event_type") == "SubjectForgotten", F.col("subject_id"))
    rows = log.select("aggregate_id", forgot.alias("subject_id"), F.lit(False).alias("known"), F.col("sequence").cast("long").alias("last")).unionByName(known)
    # one row for each subject of a journey, and one of its other events; a subject that both know is forgotten already
    pairs = rows.groupBy("aggregate_id", "subject_id").agg(F.every("known").alias("todo"), F.max("last").alias("last"))
    mine = Window.partitionBy("aggregate_id")
    pairs = pairs.withColumn("last", F.max("last").over(mine)).where("todo and last is not null and aggregate_id is not null")
    place = F.row_number().over(mine.orderBy("subject_id"))  # the subjects of one journey
    events = pairs.select("aggregate_id", (F.col("last") + place).alias("sequence"), F.lit("SubjectForgotten").alias("event_type"), "subject_id")
    return {"keys": shred(keys, wanted), "lookup": delete_lookup(index, wanted), "events": events}


def purge_old_versions(spark, root: str, keep: str) -> list[str]:
    """Deletes all versions of a key table below root but one, on whatever file system holds it; returns what went. Snapshots and backups of the store are out of reach."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName() != keep]
    for p in gone:
        fs.delete(p, True)
    return sorted(p.getName() for p in gone)


def subject_id(email: Column, namespace_key: bytes) -> Column:
    """HMAC-SHA-256 of the normalised address, as a UUID of version 5: the same person gets the same id everywhere."""
    key = namespace_key if len(namespace_key) <= 64 else hashlib.sha256(namespace_key).digest()
    key = key.ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ pad for b in key).hex())) for pad in (0x36, 0x5C))
    mac = F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.lower(F.trim(email)).cast("binary")), 256))), 256)
    variant = F.lower(F.hex(F.conv(F.substring(mac, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(mac, 1, 8), F.substring(mac, 9, 4), F.concat(F.lit("5"), F.substring(mac, 14, 3)), F.concat(variant, F.substring(mac, 18, 3)), F.substring(mac, 21, 12))


def delete_lookup(index: DataFrame, erased: DataFrame) -> DataFrame:
    """The lookup without the addresses of erased subjects."""
    return index.join(erased.select("subject_id").distinct(), "subject_id", "left_anti")


def erase_by_email(log: DataFrame, keys: DataFrame, index: DataFrame, emails: DataFrame, journeys: DataFrame) -> dict[str, DataFrame]:
    """What erase gives for all subjects that have one of the addresses, whatever the case. Take emails again only from a request: the lookup no longer has them."""
    return erase(log, keys, index, subjects_by_email(index, emails), journeys)


def linkage(persons: DataFrame) -> DataFrame:
    """Addresses that several subjects have, which an erasure by one id would not cover."""
    return persons.where("email is not null").groupBy(F.lower("email").alias("email")).agg(F.countDistinct("subject_id").alias("n_subjects")).where("n_subjects > 1")


def addresses(persons: DataFrame) -> DataFrame:
    """Subjects that were captured with several addresses, any of which leads to their erasure."""
    return persons.where("subject_id is not null and email is not null").groupBy("subject_id").agg(F.countDistinct(F.lower("email")).alias("n_emails")).where("n_emails > 1")


def nonce_reuse(sealed: DataFrame) -> DataFrame:
    return sealed.groupBy("subject_id", "nonce").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def lookup(captures: DataFrame, erased: DataFrame | None = None) -> DataFrame:
    """subject_id and email_lower: the address of each subject's last capture."""
    good = captures.where("subject_id is not null and email is not null")
    out = good.groupBy("subject_id").agg(F.max_by(F.lower("email"), F.struct("timestamp", "aggregate_id", "sequence")).alias("email_lower"))
    return out if erased is None else delete_lookup(out, erased)


def backfill_lookup(persons: DataFrame, existing: DataFrame) -> DataFrame:
    """One address for each live subject that the index lacks: of the first journey and slot."""
    r = F.row_number().over(Window.partitionBy("subject_id").orderBy("aggregate_id", "person_ref"))
    first = persons.where("not forgotten and email is not null").withColumn("r", r).where("r = 1").select("subject_id", F.lower("email").alias("email_lower"))
    return first.join(existing.select("subject_id"), "subject_id", "left_anti")


def subjects_by_email(index: DataFrame, emails: DataFrame) -> DataFrame:
    return index.join(emails.select(F.lower("email").alias("email_lower")).distinct(), "email_lower", "left_semi").select("subject_id")
