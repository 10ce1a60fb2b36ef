"""Where a log lies: buckets by aggregate, and ranges of a relational table."""

import pytest
from ledgerfold.operators import fold
from ledgerfold.sources import event_log, samples

DIR = "/root/testdata/sf0.001"


def plan(df):
    return df.sparkSession._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def bucketed(spark):
    log = samples.event_log(spark, DIR).select(*[c.split()[0] for c in event_log.ENVELOPE.split(", ")])
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield log, event_log.write_bucketed(log, "bucketed_log", 8, rows_per_file=40)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    spark.sql("drop table bucketed_log")


def test_one_aggregate_reads_one_bucket(spark, bucketed):
    log, table = bucketed
    assert rows(table) == rows(log)
    one, auto = event_log.scan_aggregate(table, "u8"), "spark.sql.sources.bucketing.autoBucketedScan.enabled"
    assert rows(one) == rows(event_log.scan_aggregate(log, "u8"))
    spark.conf.set(auto, False)  # the plan names buckets only then; pruned they are in any case
    assert "SelectedBucketsCount: 1 out of 8" in plan(event_log.scan_aggregate(spark.table("bucketed_log"), "u8"))
    spark.conf.unset(auto)


def test_operators_by_aggregate_do_not_shuffle(spark, bucketed):
    log, table = bucketed
    snaps = lambda e: e.where("sequence <= 7").groupBy("aggregate_id").agg({"sequence": "max"}).withColumnRenamed("max(sequence)", "last_sequence")
    for operator in (fold.fold_scalars, event_log.sequence_gaps, fold.history, lambda e: event_log.tail_after(e, snaps(e)), fold.workflow_history, lambda e: event_log.tail_last(e, 3)):
        got = operator(table)
        assert "Exchange" not in plan(got), plan(got)
        assert rows(got) == rows(operator(log))


def test_relational_log_in_ranges(spark):
    url, driver = "jdbc:derby:memory:ranges;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    ids = [f"{k * 2654435761 % 2**32:08x}-0000" for k in range(200)] + ["", "zebra", "FFFF", "ffff-1"]
    made = spark.createDataFrame([("journey" if k % 5 else "other", x, 1, "JourneyOpened", "1.0", '{"Started":{"id":"x"}}', None) for k, x in enumerate(ids)], event_log.ENVELOPE)
    types = "aggregate_type varchar(20), aggregate_id varchar(40), event_type varchar(40), event_version varchar(9), payload varchar(200)"
    made.coalesce(1).write.option("createTableColumnTypes", types).jdbc(url, "events", mode="overwrite", properties={"driver": driver})
    for n in (1, 2, 16):
        got = event_log.read_log_jdbc(spark, url, conditions=event_log.uuid_ranges(n), driver=driver)
        assert got.rdd.getNumPartitions() == n and "EqualTo(aggregate_type,journey)" in plan(got)
        assert rows(got) == rows(made.where("aggregate_type = 'journey'"))
    for n in (0, 65537):
        with pytest.raises(ValueError):
            event_log.uuid_ranges(n)
    bounds = event_log.uuid_ranges(1000, "c")
    assert len(bounds) == 1000 and all(x.split()[-1] == y.split()[2] for x, y in zip(bounds[1:], bounds[2:]))
