"""Record-store queries over the event-derived store."""

from __future__ import annotations

from pyspark.sql import functions as F

from litlake.operators import records as op
from litlake.plans import sql, views
from litlake.plans.registry import query
from litlake.session import scratch_path
from litlake.sources import records as store

KEY = ["namespace", "entity", "key"]
BUCKETS = 2  # a small store; big ones use the default
FMT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _time(name: str):
    return F.date_format(name, FMT).alias(name)


def _time_sql(c: str, name: str | None = None) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f') AS {name or c}"


@query(
    "ttl_lookup",
    sql.with_(
        sql.STORE,
        body=f"""SELECT event_id AS request_id, e.namespace, e.entity, e.key,
  {_time_sql('stored_at')}, {_time_sql('expires_at')}, coalesce(status, 'miss') AS status
FROM store_events e LEFT JOIN answered a USING (namespace, entity, key)""",
    ),
)
def ttl_lookup(spark, sf_dir):
    answered = op.ttl_lookup(
        views.requests(spark, sf_dir),
        views.records(spark, sf_dir),
        views.negatives(spark, sf_dir),
        views.NOW,
    )
    return answered.select(
        "request_id", *KEY, _time("stored_at"), _time("expires_at"), "status"
    )


def _dropped(spark, sf_dir):
    """Keys to invalidate: everything that was ever purchased."""
    return views.store_events(spark, sf_dir).where("event_type = 'purchase'")


DROPPED = """dropped AS (SELECT DISTINCT namespace, entity, key FROM store_events WHERE event_type = 'purchase')"""


@query(
    "invalidate",
    sql.with_(
        sql.STORE,
        DROPPED,
        body=f"""SELECT 'record' AS kind, namespace, entity, key, {_time_sql('stored_at', 'at')}
FROM records ANTI JOIN dropped USING (namespace, entity, key)
UNION ALL SELECT 'negative', namespace, entity, key, {_time_sql('expires_at', 'at')}
FROM negatives ANTI JOIN dropped USING (namespace, entity, key)""",
    ),
)
def invalidate(spark, sf_dir):
    kept, negatives = op.invalidate(
        views.records(spark, sf_dir), views.negatives(spark, sf_dir), _dropped(spark, sf_dir)
    )
    shape = lambda df, kind, at: df.select(
        F.lit(kind).alias("kind"), *KEY, F.date_format(at, FMT).alias("at")
    )
    return shape(kept, "record", "stored_at").unionByName(
        shape(negatives, "negative", "expires_at")
    )


@query(
    "record_negatives",
    sql.with_(
        sql.STORE,
        body=f"""SELECT namespace, entity, key, 'No record found for: ' || key AS error,
  {_time_sql("TIMESTAMP '2024-01-31' + CASE WHEN namespace IN ('arxiv', 'biorxiv') THEN INTERVAL 1 HOUR ELSE INTERVAL 24 HOUR END", 'expires_at')}
FROM (SELECT DISTINCT namespace, entity, key FROM store_events) ANTI JOIN records USING (namespace, entity, key)""",
    ),
)
def record_negatives(spark, sf_dir):
    made = op.record_negatives(
        views.requests(spark, sf_dir), views.records(spark, sf_dir), views.NOW
    )
    return made.select(*KEY, "error", _time("expires_at"))


@query(
    "returned_requested",
    sql.with_(
        sql.STORE,
        body=f"""SELECT namespace, entity, key, {_time_sql('stored_at')}
FROM records SEMI JOIN (SELECT * FROM store_events WHERE event_type = 'error') USING (namespace, entity, key)""",
    ),
)
def returned_requested(spark, sf_dir):
    asked = views.store_events(spark, sf_dir).where("event_type = 'error'")
    return op.returned_requested(asked, views.records(spark, sf_dir)).select(
        *KEY, _time("stored_at")
    )


@query(
    "insert_if_absent",
    sql.with_(
        sql.STORE,
        """fresh AS (
  SELECT namespace, entity, key, ts AS stored_at FROM store_events
  WHERE event_type NOT IN ('view', 'click')
  QUALIFY row_number() OVER (PARTITION BY namespace, entity, key ORDER BY event_id) = 1)""",
        body=f"""SELECT namespace, entity, key, {_time_sql('stored_at')} FROM records
UNION ALL SELECT namespace, entity, key, {_time_sql('stored_at')}
FROM fresh ANTI JOIN records USING (namespace, entity, key)""",
    ),
)
def insert_if_absent(spark, sf_dir):
    hits = (
        views.store_events(spark, sf_dir)
        .where(~F.col("event_type").isin("view", "click"))
        .select(*KEY, F.col("ts").alias("stored_at"), F.col("event_id").alias("pos"))
    )
    return op.insert_if_absent(views.records(spark, sf_dir), hits).select(*KEY, _time("stored_at"))


@query(
    "plan_batches",
    sql.with_(
        sql.IDS,
        """keyed AS (
  SELECT lower(regexp_replace(raw, '^(https?://(dx\\.)?doi\\.org/|doi:)', '')) AS key, min(pos) AS pos
  FROM ids GROUP BY 1),
stored AS (
  SELECT '10.1234/o' || l_orderkey AS key, max(l_shipdate) AS stored_at FROM lineitem GROUP BY 1),
missing AS (
  SELECT key, row_number() OVER (ORDER BY pos) - 1 AS n FROM keyed
  ANTI JOIN (SELECT * FROM stored WHERE stored_at + INTERVAL 30 DAY >= TIMESTAMP '1998-06-01') USING (key))""",
        body="""SELECT n // 50 AS batch, count(*) AS batch_size, string_agg(key, '|' ORDER BY n) AS keys
FROM missing GROUP BY 1""",
    ),
)
def plan_batches(spark, sf_dir):
    stored = (
        views.table(spark, sf_dir, "lineitem")
        .groupBy(F.concat(F.lit("10.1234/o"), F.col("l_orderkey")).alias("key"))
        .agg(F.max("l_shipdate").alias("stored_at"))
        .withColumn("expires_at", F.lit(None).cast("timestamp_ntz"))
    )
    batches = op.plan_batches(views.ids(spark, sf_dir), stored, "1998-06-01 00:00:00")
    return batches.withColumn("keys", F.array_join("keys", "|"))


def _puts(spark, sf_dir, *events: str):
    """Store entries; every error event wrote a payload that is cut short."""
    e = views.store_events(spark, sf_dir).where(F.col("event_type").isin(*events))
    payload = F.when(
        F.col("event_type") == "error", F.concat(F.lit('{"id": '), F.col("event_id"))
    ).otherwise(F.concat(F.lit('{"id": '), F.col("event_id"), F.lit("}")))
    return e.select(*KEY, payload.alias("payload"), F.col("ts").alias("stored_at"))


LATEST = """latest AS (
  SELECT namespace, entity, key, event_id, event_type, ts FROM store_events
  QUALIFY row_number() OVER (PARTITION BY namespace, entity, key ORDER BY ts DESC) = 1)"""


def _two_batches(spark, sf_dir) -> str:
    root = scratch_path(spark, "store")
    store.upsert_records(_puts(spark, sf_dir, "view", "click", "signup"), root, BUCKETS)
    store.upsert_records(_puts(spark, sf_dir, "purchase", "error"), root, BUCKETS)
    return root


@query(
    "upsert_records",
    sql.with_(
        sql.STORE,
        LATEST,
        body=f"""SELECT namespace, entity, key,
  '{{"id": ' || event_id || CASE WHEN event_type = 'error' THEN '' ELSE '}}' END AS payload, {_time_sql('ts', 'stored_at')}
FROM latest""",
    ),
)
def upsert_records(spark, sf_dir):
    rows = store.judged_records(spark, _two_batches(spark, sf_dir))
    return rows.select(*KEY, "payload", _time("stored_at"))


@query(
    "append_records",
    sql.with_(
        sql.STORE,
        LATEST,
        body=f"""SELECT namespace, entity, key, {_time_sql('ts', 'stored_at')} FROM latest
WHERE event_type <> 'error'""",
    ),
)
def append_records(spark, sf_dir):
    """Two appended batches, folded together and read."""
    root = scratch_path(spark, "store")
    store.append_records(_puts(spark, sf_dir, "view", "click", "signup"), root, 1, BUCKETS)
    store.append_records(_puts(spark, sf_dir, "purchase", "error"), root, 2, BUCKETS)
    store.compact_records(spark, root)
    good, _ = store.read_records(spark, root)
    return good.select(*KEY, _time("stored_at"))


@query(
    "read_records",
    sql.with_(
        sql.STORE,
        LATEST,
        body="""SELECT namespace, entity, key, event_type = 'error' AS quarantined FROM latest
WHERE namespace = 'crossref'""",
    ),
)
def read_records(spark, sf_dir):
    rows = store.judged_records(spark, _two_batches(spark, sf_dir), "crossref", "papers")
    return rows.select(*KEY, "quarantined")
