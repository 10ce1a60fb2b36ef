"""Read models and the queries on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fold


def journeys(log: DataFrame) -> DataFrame:
    """One row per journey: state, step, phase, version, times and the number of attributes. Secrets are not part of shared data."""
    size = fold.fold_bag(log).groupBy("aggregate_id").agg(F.count(F.lit(1)).alias("bag_size"))
    return fold.fold_scalars(log).join(size, "aggregate_id", "left").withColumn("bag_size", F.coalesce("bag_size", F.lit(0)))


def journey_documents(log: DataFrame) -> DataFrame:
    """One row per journey: state, step, latest decision, version, times and shared_data, the document as JSON text ({} where nothing is stored)."""
    docs = fold.fold_documents(log).withColumnRenamed("document", "shared_data")
    return fold.fold_scalars(log).join(docs, "aggregate_id", "left").withColumn("shared_data", F.coalesce("shared_data", F.lit("{}")))


def persons(log: DataFrame, keys: DataFrame, forgets: DataFrame | None = None) -> DataFrame:
    """One row per slot: the last capture's name, email and phone, the first one's subject. A slot is forgotten once its subject was (forgets: aggregate_id, subject_id);
    it has no identity if its subject has no key, even if captured again."""
    captures = log.where("event_type = 'PersonCaptured'")
    out = captures.groupBy("aggregate_id", "person_ref").agg(F.min_by("subject_id", "sequence").alias("subject_id"), F.max_by(F.struct("name", "email", "phone"), "sequence").alias("p"))
    alive = keys.select("subject_id").distinct().withColumn("has_key", F.lit(True))
    out = out.join(alive, "subject_id", "left").withColumn("has_key", F.coalesce("has_key", F.lit(False)))
    if forgets is None:
        out = out.withColumn("forgotten", ~F.col("has_key"))
    else:
        out = out.join(forgets.select("aggregate_id", "subject_id").distinct().withColumn("f", F.lit(True)), ["aggregate_id", "subject_id"], "left").withColumn("forgotten", F.coalesce("f", F.lit(False)))
    visible = lambda name: F.when(F.col("has_key") & (F.col(f"p.{name}") != "[redacted]"), F.col(f"p.{name}")).alias(name)
    return out.select("aggregate_id", "person_ref", "subject_id", visible("name"), visible("email"), visible("phone"), "forgotten")


def load_all(views: DataFrame, people: DataFrame) -> DataFrame:
    """All journeys with their persons as an array ordered by slot."""
    person = F.struct("person_ref", "subject_id", "name", "email", "phone", "forgotten")
    grouped = people.groupBy("aggregate_id").agg(F.array_sort(F.collect_list(person)).alias("persons"))
    return views.join(grouped, "aggregate_id", "left")


def load(views: DataFrame, people: DataFrame, aggregate_id: str) -> DataFrame:
    here = F.col("aggregate_id") == aggregate_id
    return load_all(views.where(here), people.where(here))


def page(views: DataFrame, number: int, size: int = 100) -> DataFrame:
    """Page number, from 0, newest first. To walk through all of a large table use page_after, which reads no row twice."""
    return views.orderBy(F.desc("created_at"), "aggregate_id").offset(number * size).limit(size)


def page_after(views: DataFrame, created_at, aggregate_id: str, size: int = 100) -> DataFrame:
    later = (F.col("created_at") < created_at) | ((F.col("created_at") == created_at) & (F.col("aggregate_id") > aggregate_id))
    return views.where(later).orderBy(F.desc("created_at"), "aggregate_id").limit(size)


def find_by_email(people: DataFrame, emails: DataFrame) -> DataFrame:
    """Journeys with a slot, not forgotten, of one of the addresses, whatever the case."""
    wanted = emails.select(F.lower("email").alias("e")).distinct()
    return people.where("not forgotten").join(wanted, F.lower("email") == F.col("e"), "left_semi").select("aggregate_id").distinct()


def subject_journeys(log: DataFrame, partitions: DataFrame | None = None) -> DataFrame:
    """(subject_id, aggregate_id) pairs, from captures and from partitions, without decryption: to be stored by subject_id. Partitions that pii takes from the same log need not be given: each has the subject of a capture of its journey."""
    captured = log.where("event_type = 'PersonCaptured' and subject_id is not null").select("subject_id", "aggregate_id")
    return (captured if partitions is None else captured.unionByName(partitions.select("subject_id", "aggregate_id"))).distinct()


def survival(decrypted: DataFrame) -> DataFrame:
    """Partitions of each subject by what can still be read of them."""
    return decrypted.groupBy("subject_id").agg(F.count_if(F.col("status") == "decrypted").alias("n_kept"), F.count_if(F.col("status") == "redacted").alias("n_redacted"))
