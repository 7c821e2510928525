"""Counter, error, retry, pacing and streaming queries over the request log."""

from __future__ import annotations

from pyspark.sql import functions as F

from litlake.operators import telemetry as op
from litlake.operators.metadata import tag_errors
from litlake.plans import sql, views
from litlake.plans.registry import query
from litlake.session import scratch_path
from litlake.sources.records import read_records
from litlake.streaming import jobs

_COUNTS = ", ".join(f"count(*) FILTER (WHERE metric = '{m}') AS {m}" for m in op.METRICS)


@query(
    "counters_snapshot",
    sql.with_(sql.LOG, body=f"SELECT provider, {_COUNTS} FROM log GROUP BY provider"),
)
def counters_snapshot(spark, sf_dir):
    return op.counters_snapshot(views.log(spark, sf_dir))


@query(
    "in_flight",
    sql.with_(
        sql.LOG,
        body="""SELECT provider, CAST(sum(CASE phase WHEN 'start' THEN 1 WHEN 'finish' THEN -1 ELSE 0 END) AS BIGINT) AS in_flight
FROM log WHERE ts <= TIMESTAMP '2024-01-15' GROUP BY provider""",
    ),
)
def in_flight(spark, sf_dir):
    return op.in_flight(views.log(spark, sf_dir), "2024-01-15 00:00:00")


ERRORS = """errors AS (
  SELECT *, CASE WHEN failure = 'timeout' THEN provider || ' request timed out. Transient — retry.'
    WHEN failure = 'network' THEN provider || ' network error: ' || body
    WHEN status = 429 THEN provider || ' rate limit (HTTP 429). Transient — wait and retry.'
    WHEN status BETWEEN 500 AND 599 THEN provider || ' server error (HTTP ' || status || '). Transient — retry.'
    WHEN status >= 400 THEN provider || ' HTTP ' || status || ': ' || body[1:200] END AS error,
    CASE WHEN failure IS NULL AND status = 429 AND retry_after > 0 THEN retry_after END AS retry_after_seconds
  FROM log)"""


@query(
    "classify_errors",
    sql.with_(
        sql.LOG,
        ERRORS,
        body="SELECT request_id, provider, status, failure, error, retry_after_seconds FROM errors",
    ),
)
def classify_errors(spark, sf_dir):
    return op.classify_errors(views.log(spark, sf_dir)).select(
        "request_id", "provider", "status", "failure", "error", "retry_after_seconds"
    )


@query(
    "tag_errors",
    sql.with_(
        sql.LOG,
        ERRORS,
        body="""SELECT request_id, error, CASE WHEN failure = 'timeout' THEN 'Try later.'
  WHEN error IS NOT NULL THEN 'Retry or refine the request.' END AS suggestion FROM errors""",
    ),
)
def tagged_errors(spark, sf_dir):
    errors = op.classify_errors(views.log(spark, sf_dir)).select(
        "request_id",
        "error",
        F.lit("/store/x.json").alias("path"),
        F.when(F.col("failure") == "timeout", "Try later.").alias("suggestion"),
    )
    return tag_errors(errors, "Retry or refine the request.")


@query(
    "retry_delay",
    sql.with_(
        sql.LOG,
        body="""SELECT request_id, retryable, CASE WHEN NOT retryable THEN NULL WHEN failure IS NOT NULL THEN 3.0
  ELSE least(greatest(CASE WHEN retry_after > 0 THEN retry_after ELSE 0 END, 3.0), 90.0) END AS delay
FROM (SELECT *, failure IS NOT NULL OR status IN (408, 425, 429, 500, 502, 503, 504) AS retryable FROM log)""",
    ),
)
def retry_delay(spark, sf_dir):
    return op.retry_delay(views.log(spark, sf_dir), backoff=3.0).select(
        "request_id", "retryable", "delay"
    )


@query(
    "pace_requests",
    sql.with_(
        sql.LOG,
        """arrivals AS (
  SELECT request_id, provider, epoch_us(ts) // 60000000 AS arrival,
    row_number() OVER (PARTITION BY provider ORDER BY epoch_us(ts) // 60000000, request_id) - 1 AS i FROM log)""",
        body="""SELECT request_id, provider, arrival, start, start - arrival AS wait FROM (
  SELECT *, i * 20 + max(arrival - i * 20) OVER (PARTITION BY provider ORDER BY i) AS start FROM arrivals)""",
    ),
)
def pace_requests(spark, sf_dir):
    """Minutes since the epoch, one start per provider every 20 minutes."""
    day = F.datediff(F.col("ts"), F.lit("1970-01-01").cast("date")).cast("long") * 1440
    minute = day + F.hour("ts") * 60 + F.minute("ts")
    arrivals = views.log(spark, sf_dir).select("request_id", "provider", minute.alias("arrival"))
    return op.pace_requests(arrivals, 20)


def _stream(spark, sf_dir):
    """The events table as a file stream, renamed to the log columns."""
    schema = views.table(spark, sf_dir, "events").schema
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf_dir)
    )


def _drain(stream, mode: str, spark, label: str):
    """Run to the end of the input into Parquet and read the result back."""
    out = scratch_path(spark, label)

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/data/batch={number}")

    run = (
        stream.writeStream.foreachBatch(keep)
        .outputMode(mode)
        .option("checkpointLocation", f"{out}/progress")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return spark.read.parquet(f"{out}/data")


def _live_log(spark, sf_dir):
    metric = F.lit(None).cast("string")
    for event, name in views.METRIC_OF_EVENT.items():
        metric = F.when(F.col("event_type") == event, F.lit(name)).otherwise(metric)
    return _stream(spark, sf_dir).select(
        F.col("ts").cast("timestamp").alias("ts"),
        views._pick(views.NAMESPACES, F.col("user_id") % 7).alias("provider"),
        metric.alias("metric"),
    )


@query(
    "stream_counters",
    sql.with_(
        sql.LOG,
        body=f"""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, provider, {_COUNTS}
FROM log GROUP BY 1, 2""",
    ),
)
def stream_counters(spark, sf_dir):
    counted = jobs.stream_counters(_live_log(spark, sf_dir), "1 day", "1 day")
    rows = _drain(counted, "update", spark, "counters")
    day = F.date_format("window_start", "yyyy-MM-dd").alias("day")
    return rows.groupBy(day, "provider").agg(*(F.max(m).alias(m) for m in op.METRICS))


@query(
    "coalesce_requests",
    sql.with_(sql.STORE, body="SELECT DISTINCT event_type AS kind, key FROM store_events"),
)
def coalesce_requests(spark, sf_dir):
    stream = _stream(spark, sf_dir).select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("kind"),
        F.concat_ws("-", "user_id", F.get_json_object("props", "$.k")).alias("key"),
    )
    rows = _drain(jobs.coalesce_requests(stream, "40 days"), "append", spark, "coalesced")
    return rows.select("kind", "key")


@query(
    "ingest_stream",
    sql.with_(
        sql.STORE,
        body="""SELECT namespace, entity, key, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS stored_at
FROM store_events GROUP BY namespace, entity, key""",
    ),
)
def ingest_stream(spark, sf_dir):
    root = scratch_path(spark, "ingested")
    puts = _stream(spark, sf_dir).select(
        views._pick(views.NAMESPACES, F.col("user_id") % 7).alias("namespace"),
        F.lit("papers").alias("entity"),
        F.concat_ws("-", "user_id", F.get_json_object("props", "$.k")).alias("key"),
        F.col("props").alias("payload"),
        F.col("ts").alias("stored_at"),
    )
    jobs.ingest_stream(puts, f"{root}/store", f"{root}/progress", 2).awaitTermination()
    good, _ = read_records(spark, f"{root}/store")
    return good.select(
        "namespace",
        "entity",
        "key",
        F.date_format("stored_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("stored_at"),
    )


@query(
    "ttl_state",
    sql.with_(
        sql.STORE.replace(
            "ts + INTERVAL 24 HOUR",
            "ts + CASE WHEN namespace IN ('arxiv', 'biorxiv') THEN INTERVAL 1 HOUR ELSE INTERVAL 24 HOUR END",
        ),
        body="SELECT namespace, entity, key, status FROM answered",
    ),
)
def ttl_state(spark, sf_dir):
    kind = F.col("event_type")
    feed = (
        _stream(spark, sf_dir)
        .where(kind.isin("view", "click", "error"))
        .select(
            views._pick(views.NAMESPACES, F.col("user_id") % 7).alias("namespace"),
            F.lit("papers").alias("entity"),
            F.concat_ws("-", "user_id", F.get_json_object("props", "$.k")).alias("key"),
            F.col("ts").cast("timestamp").alias("at"),
            F.when(kind == "error", "negative").otherwise("put").alias("kind"),
        )
    )
    rows = _drain(jobs.ttl_state(feed, "30 days"), "update", spark, "ttl")
    return jobs.ttl_status(rows, F.lit(views.NOW).cast("timestamp_ntz").cast("timestamp"))
