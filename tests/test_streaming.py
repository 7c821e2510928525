"""Streams fed in several batches give the answers of the whole table."""

import pytest
from pyspark.sql import functions as F

from litlake.operators.telemetry import METRICS
from litlake.sources.records import read_records
from litlake.streaming import jobs

SCHEMA = "ts timestamp, namespace string, entity string, key string, kind string, payload string, provider string, metric string"


@pytest.fixture
def feed(spark, tmp_path):
    """Three files, read one per batch."""
    hours = [[0.0, 0.05, 1.0], [1.02, 30.0, 30.1], [0.5, 800.0, 801.0]]
    for batch in hours:
        data = [
            ("2024-01-01 00:00:00", h, "arxiv", "papers", f"k{i % 2}", "put" if i != 1 else "negative", f'{{"h":{h}}}', "p", METRICS[i])
            for i, h in enumerate(batch)
        ]
        df = spark.createDataFrame(data, "t string, h double, namespace string, entity string, key string, kind string, payload string, provider string, metric string")
        df = df.withColumn("ts", (F.col("t").cast("timestamp").cast("double") + F.col("h") * 3600).cast("timestamp"))
        df.select(*(c.split(" ")[0] for c in SCHEMA.split(", "))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return (
        spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")),
        spark.read.schema(SCHEMA).parquet(str(tmp_path / "in")),
    )


def drain(stream, mode, tmp_path):
    out = str(tmp_path / "out")
    run = (
        stream.writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}"))
        .outputMode(mode)
        .option("checkpointLocation", str(tmp_path / "progress"))
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return stream.sparkSession.read.parquet(out)


def test_counters_over_batches(spark, feed, tmp_path):
    live, whole = feed
    rows = drain(jobs.stream_counters(live, "1 hour", "40 days"), "update", tmp_path)
    got = rows.groupBy("window_start", "provider").agg(*(F.max(m).alias(m) for m in METRICS))
    want = whole.groupBy(F.date_trunc("hour", "ts").alias("window_start"), "provider").agg(
        *(F.count(F.when(F.col("metric") == m, 1)).alias(m) for m in METRICS)
    )
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_repeats_join_the_first_request(spark, feed, tmp_path):
    live, whole = feed
    rows = drain(jobs.coalesce_requests(live, "40 days"), "append", tmp_path)
    got = sorted((r.kind, r.key) for r in rows.select("kind", "key").collect())
    assert got == sorted((r.kind, r.key) for r in whole.select("kind", "key").distinct().collect())


def test_ingest_keeps_the_newest(spark, feed, tmp_path):
    live, whole = feed
    puts = live.withColumn("stored_at", F.col("ts").cast("timestamp_ntz"))
    jobs.ingest_stream(puts, str(tmp_path / "store"), str(tmp_path / "progress"), 2).awaitTermination()
    good, _ = read_records(spark, str(tmp_path / "store"))
    want = whole.groupBy("key").agg(F.max("ts").cast("timestamp_ntz").alias("t"))
    assert {r.key: r.stored_at for r in good.collect()} == {r.key: r.t for r in want.collect()}


def test_ttl_state_over_batches(spark, feed, tmp_path):
    live, whole = feed
    rows = drain(jobs.ttl_state(live.withColumnRenamed("ts", "at"), "60 days"), "update", tmp_path)
    got = rows.groupBy("key").agg(F.max("stored_at").alias("s"), F.max("expires_at").alias("e"))
    put = F.when(F.col("kind") == "put", F.col("ts"))
    negative = F.when(F.col("kind") == "negative", F.col("ts") + F.expr("interval 1 hour"))
    want = whole.groupBy("key").agg(F.max(put).alias("s"), F.max(negative).alias("e"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_ttl_state_after_a_restart(spark, tmp_path):
    """State comes back from the checkpoint; timers clear it; namespaces without a limit keep theirs."""
    kinds = "namespace string, entity string, key string, at timestamp, kind string"
    rows = [
        [("arxiv", "p", "a", "2024-01-01 00:00:00", "put"), ("manual", "p", "m", "2024-01-01 00:00:00", "put")],
        [("arxiv", "p", "n", "2024-01-02 00:00:00", "negative"), ("arxiv", "p", "a", "2023-12-31 23:00:00", "put")],
        [("arxiv", "p", "late", "2024-03-01 00:00:00", "put")],
        [("arxiv", "p", "late", "2024-03-02 00:00:00", "put")],
    ]
    out = tmp_path / "out"

    def drained(batch):
        spark.createDataFrame(batch, "namespace string, entity string, key string, t string, kind string").selectExpr(
            "namespace", "entity", "key", "CAST(t AS timestamp) AS at", "kind"
        ).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        live = spark.readStream.schema(kinds).parquet(str(tmp_path / "in"))
        before = len(list(out.glob("batch=*"))) if out.exists() else 0
        drain(jobs.ttl_state(live, "1 hour", 1), "update", tmp_path)
        assert len(list(out.glob("batch=*"))) > before
        return spark.read.parquet(str(out))

    found = None
    for batch in rows:  # every turn is a new query on the same checkpoint
        found = drained(batch)
    assert {r.key for r in found.where("not fresh").collect()} == {"a", "n"}

    def statuses(now):
        at = F.lit(now).cast("timestamp")
        return {r.key: r.status for r in jobs.ttl_status(found, at).collect()}

    assert statuses("2024-01-02 00:30:00") == {"a": "hit", "m": "hit", "n": "negative", "late": "hit"}
    assert statuses("2024-03-02 00:00:00") == {"a": "miss", "m": "hit", "n": "miss", "late": "hit"}


def test_a_hot_key_is_spread(spark, tmp_path):
    """Most requests ask for one key: it passes once, and its rows are dealt over many tasks."""
    rows = spark.range(6000).selectExpr(
        "timestamp_micros(1700000000000000 + id * 1000) AS ts", "'get' AS kind",
        "IF(id % 10 < 6, 'hot', CONCAT('k', id % 50)) AS key",
    )
    rows.write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = drain(jobs.coalesce_requests(live, "10 minutes"), "append", tmp_path)
    expected = sorted(r.key for r in rows.select("key").distinct().collect())
    assert sorted(r.key for r in got.collect()) == expected
    dealt = rows.where("key = 'hot'").selectExpr(f"pmod(xxhash64(ts), {jobs.SALTS}) AS salt").groupBy("salt").count()
    assert dealt.agg(F.max("count")).first()[0] < 3600 / jobs.SALTS * 1.5


def test_ttl_state_keeps_many_keys_in_a_part(spark, tmp_path):
    """Keys share a part's state; those without an age limit keep their exact times beside "not found" entries."""
    rows = spark.range(1500).selectExpr(
        "IF(id % 3 = 0, 'manual', 'arxiv') AS namespace", "'p' AS entity", "IF(id % 7 = 0, NULL, concat('k', id)) AS key",
        "timestamp_micros(1700000000000001 + id) AS at", "IF(id % 2 = 0, 'put', 'negative') AS kind",
    )
    rows.write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = drain(jobs.ttl_state(live, "1 hour", 1, 2), "update", tmp_path)
    at = F.when(F.col("kind") == "put", F.col("at"))
    want = rows.groupBy("namespace", "key").agg(F.max(at).alias("s"))
    assert sorted(map(tuple, got.select("namespace", "key", "stored_at").collect()), key=repr) == sorted(
        map(tuple, want.collect()), key=repr
    )
