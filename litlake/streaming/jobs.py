"""Structured Streaming jobs over provider logs and record feeds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from litlake.operators.records import (
    NEGATIVE_TTL_BY_NAMESPACE,
    NEGATIVE_TTL_SECONDS,
    _per_namespace,
    status_at,
    ttl_seconds,
)
from litlake.operators.telemetry import METRICS, metric_counts
from litlake.sources.records import BUCKETS, append_records


def stream_counters(log: DataFrame, window: str = "1 hour", watermark: str = "1 day") -> DataFrame:
    """Provider counters per tumbling window on a live log.

    Counts combine map-side before the shuffle, so a busy provider sends one
    row per task and window. Closed windows leave the state with the watermark.
    """
    return (
        log.withWatermark("ts", watermark)
        .groupBy(F.window("ts", window).alias("w"), "provider")
        .agg(*metric_counts())
        .select(F.col("w.start").alias("window_start"), "provider", *METRICS)
    )


#: Parts that the requests of one key are dealt to before they meet.
SALTS = 16
#: Pieces of a horizon in which a part passes one request on.
PIECES = 8


def coalesce_requests(stream: DataFrame, horizon: str = "10 minutes", salts: int = SALTS) -> DataFrame:
    """One request per (kind, key) within the horizon; repeats join the first.

    Two steps, each with its own state. A key's requests are dealt over ``salts`` tasks, which pass on one
    per piece of the horizon; what passes, at most ``salts`` rows per key and piece, meets by key. So
    a key with most of the rows is not one task's work. A request that is the first one
    after a horizon has ended, in the piece in which it ended, may join those before.
    Only the key columns and the time are shuffled and kept as state.
    """
    length = F.expr(f"CAST(INTERVAL {horizon} AS INTERVAL DAY TO SECOND)")
    whole = F.unix_micros(F.lit("1970-01-01").cast("timestamp") + length)
    micros = F.greatest(whole / PIECES, F.lit(1))
    piece = F.floor(F.unix_micros("ts") / micros)
    return (
        stream.select("ts", "kind", "key")
        .withWatermark("ts", horizon)
        .withColumns({"_salt": F.pmod(F.xxhash64("ts"), F.lit(salts)), "_piece": piece})
        .dropDuplicatesWithinWatermark(["kind", "key", "_salt", "_piece"])
        .select("ts", "kind", "key")
        .dropDuplicatesWithinWatermark(["kind", "key"])
    )


def ingest_stream(
    records: DataFrame,
    root: str,
    checkpoint: str,
    buckets: int = BUCKETS,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Continuous put into the record store, newest entry wins.

    Batches are appended, so their cost follows their own size. A batch that is
    replayed after a failure adds the same entries, which readers see once;
    ``compact_records`` folds the batches together now and then. ``trigger`` is
    that of the stream, by default everything there is and then an end.
    """
    return (
        records.writeStream.foreachBatch(
            lambda batch, number: append_records(batch, root, number + 1, buckets)
        )
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def ttl_status(state: DataFrame, now: Column) -> DataFrame:
    """``hit``, ``negative`` or ``miss`` per key, from rows of ``ttl_state``.

    A key's rows only grow, so their maxima are its newest state; the maxima combine
    before the shuffle.
    """
    newest = state.groupBy("namespace", "entity", "key").agg(
        F.max("stored_at").alias("stored_at"), F.max("expires_at").alias("expires_at")
    )
    return newest.select(
        "namespace", "entity", "key", status_at(now, ttl_seconds()).alias("status")
    )


#: Stand for "never" and for "no such entry" among times in microseconds; the latter is also numpy's NaT.
NEVER = (1 << 63) - 1
NONE = -(1 << 63)

#: States that all keys are dealt to. One holds many keys, so that a call of Python serves many.
PARTS = 256

_FRESHNESS = (
    "namespace string, entity string, key string, salt int, stored_at timestamp, expires_at timestamp, fresh boolean"
)
_NAMES = ["namespace", "entity", "key", "salt"]
_TIMES = ["stored", "stale", "expires"]


class Freshness(StatefulProcessor):
    """Newest entry and newest "not found" of the keys of one part, each until both are stale.

    State and input times are microseconds. A part's keys lie in one value as lists of equal length. An
    event-time timer stands at the moment at which the first of them becomes stale; when it fires, all that
    are stale by then go. Entries of namespaces without an age limit set no timer and stay.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        lists = "namespace array<string>, entity array<string>, key array<string>, salt array<int>"
        self.state = handle.getValueState(
            "newest", f"{lists}, stored array<long>, stale array<long>, expires array<long>"
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self._known()
        seen = _newest([batch[_NAMES + _TIMES] for batch in rows])
        newest = _newest([known.assign(seen=False), seen.assign(seen=True)])
        self._keep(newest, _first_due(known))
        yield _shown(newest[newest["seen"]], True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = self._known()
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        stale = _due(known) <= now
        if stale.any():
            self._keep(known[~stale], None)
            yield _shown(known[stale], False)

    def close(self) -> None:
        pass

    def _known(self) -> pd.DataFrame:
        columns = self.state.get() or ([],) * len(_NAMES + _TIMES)
        known = pd.DataFrame(dict(zip(_NAMES + _TIMES, columns)))
        return known.astype({"salt": "int32", **{c: "int64" for c in _TIMES}})

    def _keep(self, newest: pd.DataFrame, timer: int | None) -> None:
        """Store the keys; ``timer`` is the one that stands, if any."""
        if newest.empty:
            self.state.clear()
        else:
            names = newest[_NAMES].astype(object)
            lists = names.where(names.notna(), None)
            self.state.update(tuple(c.tolist() for c in (*(lists[n] for n in _NAMES), *(newest[t] for t in _TIMES))))
        due = _first_due(newest)
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)


def _newest(parts: list[pd.DataFrame]) -> pd.DataFrame:
    """The maxima of each key."""
    return pd.concat(parts).groupby(_NAMES, dropna=False, sort=False, as_index=False).max()


def _due(newest: pd.DataFrame) -> pd.Series:
    """The millisecond after which a key is stale, NEVER without an age limit."""
    end = newest[["stale", "expires"]].max(axis=1).clip(lower=0)
    return (end // 1000 + 1).mask(end == NEVER, NEVER)


def _first_due(newest: pd.DataFrame) -> int | None:
    due = _due(newest)
    due = due[due != NEVER]
    return None if due.empty else int(due.min())


def _shown(newest: pd.DataFrame, fresh: bool) -> pd.DataFrame:
    def utc(c: str) -> pd.Series:
        return pd.Series(newest[c].to_numpy("int64").view("datetime64[us]")).dt.tz_localize("UTC")

    shown = newest[_NAMES].reset_index(drop=True)
    return shown.assign(stored_at=utc("stored"), expires_at=utc("expires"), fresh=fresh)


def ttl_state(
    feed: DataFrame, lateness: str = "1 day", salts: int = SALTS, parts: int = PARTS
) -> DataFrame:
    """Freshness per key from a feed of ``put`` and ``negative`` entries, as keyed state.

    ``feed(namespace, entity, key, at, kind)``. Every change gives a row with the newest times of the
    key; a row with ``fresh`` false says that the watermark, which trails by ``lateness``, has passed the
    key's last age limit and its state is gone. Keys of namespaces without an age limit stay.
    ``ttl_status`` turns rows into answers. A key's entries are dealt over ``salts``
    salts, so one that is written all the time is not one task's work, and keys and salts over ``parts``
    states: a batch reads and writes those that it has entries for. ``parts`` belongs to the checkpoint. Needs
    the state store that holds timers, which is set here for streams started later in the session.
    """
    spark = feed.sparkSession
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    life = _per_namespace(NEGATIVE_TTL_BY_NAMESPACE, NEGATIVE_TTL_SECONDS)
    put, negative = F.col("kind") == "put", F.col("kind") == "negative"
    at = F.unix_micros("at")
    million = F.lit(1_000_000)
    none = F.lit(NONE)
    dealt = feed.withWatermark("at", lateness).select(
        "namespace",
        "entity",
        "key",
        F.pmod(F.xxhash64("at"), F.lit(salts)).cast("int").alias("salt"),
        "at",
        F.coalesce(F.when(put, at), none).alias("stored"),
        F.coalesce(F.when(put & at.isNotNull(), F.coalesce(at + ttl_seconds() * million, F.lit(NEVER))), none).alias(
            "stale"
        ),
        F.coalesce(F.when(negative, at + life * million), none).alias("expires"),
    )
    part = F.pmod(F.xxhash64(*_NAMES), F.lit(parts)).cast("int")
    return (
        dealt.withColumn("part", part)
        .groupBy("part")
        .transformWithStateInPandas(Freshness(), _FRESHNESS, "Update", "EventTime")
    )
