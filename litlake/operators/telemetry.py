"""Provider counters, error classes, retry delays and request pacing over logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from litlake.operators.spread import in_pieces

# Counter names and the statuses worth another try.
METRICS = (
    "cache_hits",
    "cache_misses",
    "negative_hits",
    "http_calls",
    "http_retries",
    "backpressure_refusals",
)
RETRYABLE = (408, 425, 429, 500, 502, 503, 504)
BODY_CHARS = 200
CAP_FACTOR = 30


def metric_counts() -> list[Column]:
    """Every counter of a log as an aggregate; a stale read counts as a miss."""
    metric = F.when(F.col("metric") == "stale", F.lit("cache_misses")).otherwise(F.col("metric"))
    return [F.count(F.when(metric == m, 1)).alias(m) for m in METRICS]


def counters_snapshot(log: DataFrame) -> DataFrame:
    """One row per provider with every counter."""
    return log.groupBy("provider").agg(*metric_counts())


def in_flight(log: DataFrame, at: str) -> DataFrame:
    """Requests started and not finished per provider at a point in time."""
    delta = F.when(F.col("phase") == "start", 1).when(F.col("phase") == "finish", -1).otherwise(0)
    return (
        log.where(F.col("ts") <= F.lit(at).cast(dict(log.dtypes)["ts"]))
        .groupBy("provider")
        .agg(F.sum(delta).alias("in_flight"))
    )


def retry_after_seconds(raw: Column) -> Column:
    """Numeric header value above zero, else null; date forms are not read."""
    number = F.trim(raw).rlike(r"^[+]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$")
    value = F.when(number, F.trim(raw).try_cast("double"))
    return F.when((value > 0) & ~F.isnan(value), value)


def classify_errors(log: DataFrame, body_chars: int = BODY_CHARS) -> DataFrame:
    """Error text per request outcome.

    ``log(provider, status, retry_after, body, failure)``; ``failure`` is
    ``timeout``, ``network`` or null. Successes have no error.
    """
    # Message texts that clients of the log read.
    status, provider = F.col("status"), F.col("provider")
    say = lambda *parts: F.concat(provider, *parts)
    code, body = status.cast("string"), F.coalesce("body", F.lit(""))
    error = (
        F.when(F.col("failure") == "timeout", say(F.lit(" request timed out. Transient — retry.")))
        .when(F.col("failure") == "network", say(F.lit(" network error: "), body))
        .when(status == 429, say(F.lit(" rate limit (HTTP 429). Transient — wait and retry.")))
        .when(
            status.between(500, 599),
            say(F.lit(" server error (HTTP "), code, F.lit("). Transient — retry.")),
        )
        .when(
            status >= 400,
            say(F.lit(" HTTP "), code, F.lit(": "), F.substr(body, F.lit(1), F.lit(body_chars))),
        )
    )
    return log.select(
        "*",
        error.alias("error"),
        F.when(
            F.col("failure").isNull() & (status == 429), retry_after_seconds(F.col("retry_after"))
        ).alias("retry_after_seconds"),
    )


def retry_delay(log: DataFrame, backoff: float = 1.0) -> DataFrame:
    """Whether an outcome is worth another try, and the wait before it."""
    transport = F.col("failure").isNotNull()
    retryable = transport | F.coalesce(F.col("status").isin(*RETRYABLE), F.lit(False))
    asked = F.coalesce(retry_after_seconds(F.col("retry_after")), F.lit(0.0))
    wait = F.when(transport, F.lit(backoff)).otherwise(
        F.least(F.greatest(asked, F.lit(backoff)), F.lit(CAP_FACTOR * backoff))
    )
    return log.select("*", retryable.alias("retryable"), F.when(retryable, wait).alias("delay"))


def pace_requests(log: DataFrame, gap: float, arrival: str = "arrival", tie: str = "request_id") -> DataFrame:
    """Earliest start of every request with a minimum gap between starts per provider.

    ``start_i = max(arrival_i, start_{i-1} + gap)`` unrolls to
    ``i*gap + max_{j<=i}(arrival_j - j*gap)``. The running index and maximum
    are taken in two levels, inside range pieces and over the pieces' totals,
    so a busy provider is not one task's work. ``arrival`` is in seconds.
    """
    pieces = in_pieces(log, ["provider", arrival, tie])
    group = ["provider", "_piece"]
    within = W.partitionBy(*group).orderBy(arrival, tie)
    slack = F.col(arrival) - F.col("_j") * gap
    local = pieces.withColumn("_j", F.row_number().over(within) - 1).withColumn(
        "_peak", F.max(slack).over(within.rowsBetween(W.unboundedPreceding, 0))
    )
    earlier = W.partitionBy("provider").orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    totals = (
        local.groupBy(*group)
        .agg(F.count(F.lit(1)).alias("_n"), F.max("_peak").alias("_m"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .withColumn("_m", F.col("_m") - F.col("_before") * gap)
        .select(*group, "_before", F.max("_m").over(earlier).alias("_prior"))
    )
    index = F.col("_before") + F.col("_j")
    peak = F.greatest(F.col("_prior"), F.col("_peak") - F.col("_before") * gap)
    start = index * gap + peak
    return (
        local.join(totals, group)
        .withColumn("start", start)
        .withColumn("wait", F.col("start") - F.col(arrival))
        .drop("_piece", "_j", "_peak", "_before", "_prior")
    )
