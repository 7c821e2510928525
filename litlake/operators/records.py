"""Record store operators: lookups with age limits, negatives, warm-up, batching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litlake.functions.identifiers import canonical_doi
from litlake.operators.spread import first_per_key, match_keys, keyed_join, with_ordinal

KEY = ["namespace", "entity", "key"]

# How long an entry stays fresh, in seconds, per namespace.
DAY = 86400
TTL_SECONDS = {
    "openalex": 30 * DAY,
    "crossref": 30 * DAY,
    "wikipedia": 30 * DAY,
    "arxiv": 14 * DAY,
    "biorxiv": 7 * DAY,
    "opencitations": 7 * DAY,
}
# Lifetime of a "not found" entry, in seconds.
NEGATIVE_TTL_SECONDS = DAY
NEGATIVE_TTL_BY_NAMESPACE = {"arxiv": 3600, "biorxiv": 3600}
BATCH_SIZE = 50


def seconds(c: Column) -> Column:
    zero = F.lit(0)
    return F.make_dt_interval(zero, zero, zero, c.cast("decimal(18,6)"))


def _per_namespace(values: dict[str, int], default: int | None) -> Column:
    out = F.lit(default).cast("long")
    for name, value in values.items():
        out = F.when(F.col("namespace") == name, F.lit(value).cast("long")).otherwise(out)
    return out


def ttl_seconds() -> Column:
    """Age limit of a row's namespace; null means entries never get stale."""
    return _per_namespace(TTL_SECONDS, None)


def _entry_key() -> Column:
    return F.concat_ws("\x00", *KEY)


def store_state(records: DataFrame, negatives: DataFrame) -> DataFrame:
    """Latest ``stored_at`` and ``expires_at`` per key, in one partial aggregate."""
    when_type = dict(records.dtypes)["stored_at"]
    both = records.select(*KEY, "stored_at", F.lit(None).cast(when_type).alias("expires_at")).unionByName(
        negatives.select(*KEY, F.lit(None).cast(when_type).alias("stored_at"), "expires_at")
    )
    return both.groupBy(*KEY).agg(
        F.max("stored_at").alias("stored_at"), F.max("expires_at").alias("expires_at")
    )


def status_at(now: Column, ttl: Column) -> Column:
    """``hit`` / ``negative`` / ``miss`` from ``stored_at`` and ``expires_at``.

    An age equal to the limit is still fresh; a fresh entry beats a negative.
    """
    fresh = F.col("stored_at").isNotNull() & (
        ttl.isNull() | (F.col("stored_at") + seconds(ttl) >= now)
    )
    return (
        F.when(fresh, F.lit("hit"))
        .when(F.col("expires_at") >= now, F.lit("negative"))
        .otherwise(F.lit("miss"))
    )


def ttl_lookup(
    requests: DataFrame,
    records: DataFrame,
    negatives: DataFrame,
    now: str,
    ttl: Column | None = None,
    force: bool = False,
) -> DataFrame:
    """Add ``stored_at, expires_at, status`` to every request; with ``force`` all are misses.

    ``request_id`` identifies a request row; popular keys are salted.
    """
    state = store_state(records, negatives)
    when_type = dict(state.dtypes)["stored_at"]
    joined = keyed_join(
        requests.withColumn("_key", _entry_key()),
        state.select(_entry_key().alias("_key"), "stored_at", "expires_at"),
        "_key",
        "left",
        spread=["request_id"],
    )
    status = status_at(F.lit(now).cast(when_type), ttl_seconds() if ttl is None else ttl)
    status = F.lit("miss") if force else status
    return joined.select(*requests.columns, "stored_at", "expires_at", status.alias("status"))


def invalidate(
    records: DataFrame, negatives: DataFrame, keys: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Remove both halves of the given keys; unknown keys are ignored."""
    return match_keys(records, keys, KEY, "left_anti"), match_keys(negatives, keys, KEY, "left_anti")


def record_negatives(requested: DataFrame, returned: DataFrame, now: str) -> DataFrame:
    """Negative entries for keys that were asked for and did not come back."""
    missing = requested.select(*KEY).distinct().join(returned.select(*KEY), KEY, "left_anti")
    life = _per_namespace(NEGATIVE_TTL_BY_NAMESPACE, NEGATIVE_TTL_SECONDS)
    return missing.select(
        *KEY,
        F.concat(F.lit("No record found for: "), F.col("key")).alias("error"),
        (F.lit(now).cast("timestamp_ntz") + seconds(life)).alias("expires_at"),
    )


def returned_requested(requested: DataFrame, returned: DataFrame) -> DataFrame:
    """Rows that came back and were asked for; unrequested rows are ignored."""
    return returned.join(requested.select(*KEY).distinct(), KEY, "left_semi")


def insert_if_absent(records: DataFrame, new: DataFrame) -> DataFrame:
    """Store plus those new rows whose key is not stored yet.

    Rows without a key are skipped; among new rows with one key the first by
    ``pos`` wins.
    """
    fresh = first_per_key(new.where(F.col("key").isNotNull()), KEY, [F.col("pos").asc()])
    added = fresh.join(records.select(*KEY), KEY, "left_anti")
    return records.unionByName(added.select(*records.columns))


def first_seen(df: DataFrame, key: str, position: str = "pos") -> DataFrame:
    """Ordered de-duplication: the earliest row of every key."""
    return first_per_key(df, [key], [F.col(position).asc()])


def plan_batches(
    requests: DataFrame,
    state: DataFrame,
    now: str,
    ttl: Column | None = None,
    size: int = BATCH_SIZE,
    raw: str = "raw",
    force: bool = False,
) -> DataFrame:
    """Chunk the keys that must be fetched, in first-request order.

    ``requests(pos, raw)`` are canonicalised and de-duplicated, keys answered
    by ``state(key, stored_at, expires_at)`` are dropped, the rest is numbered
    without a global sort in one task and cut into batches of ``size``. With
    ``force`` no key counts as answered.
    """
    keyed = first_seen(requests.select("pos", canonical_doi(F.col(raw)).alias("key")), "key")
    limit = F.lit(TTL_SECONDS["openalex"]) if ttl is None else ttl
    when_type = dict(state.dtypes)["stored_at"]
    answered = state.where(status_at(F.lit(now).cast(when_type), limit) != "miss")
    missing = keyed if force else keyed.join(answered.select("key"), "key", "left_anti")
    numbered = with_ordinal(missing, ["pos"])
    return (
        numbered.groupBy(F.floor(F.col("ordinal") / size).alias("batch"))
        .agg(
            F.count(F.lit(1)).alias("batch_size"),
            F.array_sort(F.collect_list(F.struct("ordinal", "key"))).alias("_rows"),
        )
        .select("batch", "batch_size", F.transform("_rows", lambda r: r["key"]).alias("keys"))
    )
