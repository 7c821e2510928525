import random

from pyspark.sql import functions as F

from litlake.operators import records as op
from litlake.sources import records as store

NOW = "2024-02-01 00:00:00"
KEYED = "namespace string, entity string, key string"


def rows(spark, schema, *data):
    df = spark.createDataFrame(list(data), schema.replace("timestamp_ntz", "string"))
    for part in schema.split(", "):
        name, kind = part.split(" ")
        if kind == "timestamp_ntz":
            df = df.withColumn(name, F.col(name).cast(kind))
    return df


def recs(spark, *data):
    return rows(spark, KEYED + ", stored_at timestamp_ntz", *data)


def negs(spark, *data):
    return rows(spark, KEYED + ", expires_at timestamp_ntz", *data)


def test_ttl_boundaries(spark):
    a = ("arxiv", "papers")  # fourteen days
    records = recs(
        spark,
        (*a, "edge", "2024-01-18 00:00:00"),
        (*a, "stale", "2024-01-17 23:59:59"),
        (*a, "stale-negative", "2024-01-01 00:00:00"),
        (*a, "both", "2024-01-31 00:00:00"),
        ("acl_anthology", "papers", "old", "2001-01-01 00:00:00"),
    )
    negatives = negs(
        spark,
        (*a, "both", "2024-03-01 00:00:00"),
        (*a, "stale-negative", "2024-02-01 00:00:00"),
        (*a, "expired", "2024-01-31 23:59:59"),
        (*a, "no-expiry", None),
    )
    keys = ["edge", "stale", "stale-negative", "both", "expired", "no-expiry", "unknown"]
    asked = rows(
        spark,
        "request_id bigint, " + KEYED,
        *((i, *a, k) for i, k in enumerate(keys)),
        (99, "acl_anthology", "papers", "old"),
        (100, *a, "edge"),
    )
    got = {r.request_id: r.status for r in op.ttl_lookup(asked, records, negatives, NOW).collect()}
    want = ["hit", "miss", "negative", "hit", "miss", "miss", "miss"]
    assert got == {**dict(enumerate(want)), 99: "hit", 100: "hit"}


def test_invalidate_is_idempotent(spark):
    records = recs(spark, ("n", "e", "a", NOW), ("n", "e", "b", NOW))
    negatives = negs(spark, ("n", "e", "a", NOW))
    drop = rows(spark, KEYED, ("n", "e", "a"), ("n", "e", "zzz"), ("n", "e", "a"))
    for _ in range(2):
        records, negatives = op.invalidate(records, negatives, drop)
    assert [r.key for r in records.collect()] == ["b"]
    assert negatives.count() == 0


def test_negatives_only_for_requested_misses(spark):
    asked = rows(spark, KEYED, ("arxiv", "p", "a"), ("arxiv", "p", "b"), ("openalex", "p", "c"), ("openalex", "p", "c"))
    back = rows(spark, KEYED, ("arxiv", "p", "a"), ("arxiv", "p", "extra"))
    got = {r.key: str(r.expires_at) for r in op.record_negatives(asked, back, NOW).collect()}
    assert got == {"b": "2024-02-01 01:00:00", "c": "2024-02-02 00:00:00"}
    assert [r.key for r in op.returned_requested(asked, back).collect()] == ["a"]


def test_insert_if_absent_keeps_the_stored_row(spark):
    records = recs(spark, ("n", "e", "a", "2020-01-01 00:00:00"))
    new = rows(
        spark,
        KEYED + ", stored_at timestamp_ntz, pos bigint",
        ("n", "e", "a", NOW, 0), ("n", "e", "b", NOW, 2), ("n", "e", "b", "2024-01-01 00:00:00", 1), ("n", "e", None, NOW, 3),
    )
    got = {r.key: str(r.stored_at) for r in op.insert_if_absent(records, new).collect()}
    assert got == {"a": "2020-01-01 00:00:00", "b": "2024-01-01 00:00:00"}


def test_plan_batches_keeps_first_request_order(spark):
    rng = random.Random(1)
    raw = [f"https://doi.org/10.1234/X{rng.randint(0, 150)}" for _ in range(400)]
    asked = spark.createDataFrame(list(enumerate(raw)), "pos bigint, raw string")
    state = rows(
        spark,
        "key string, stored_at timestamp_ntz, expires_at timestamp_ntz",
        ("10.1234/x1", NOW, None), ("10.1234/x2", None, "2024-03-01 00:00:00"), ("10.1234/x3", "2020-01-01 00:00:00", None),
    )
    seen = dict.fromkeys(r.removeprefix("https://doi.org/").lower() for r in raw)
    want = [k for k in seen if k not in ("10.1234/x1", "10.1234/x2")]
    batches = sorted(op.plan_batches(asked, state, NOW, size=50).collect(), key=lambda r: r.batch)
    assert [k for b in batches for k in b["keys"]] == want
    assert [b.batch_size for b in batches[:-1]] == [50] * (len(batches) - 1)


def test_store_round_trip(spark, tmp_path):
    root = str(tmp_path / "store")
    schema = "namespace string, entity string, key string, payload string, stored_at timestamp_ntz"
    put = lambda *data: store.upsert_records(rows(spark, schema, *data), root, 4)
    put(("n", "e", "a", '{"v":1}', "2024-01-01 00:00:00"), ("m", "e", "x", '{"v":9}', NOW))
    put(("n", "e", "a", '{"v":2}', NOW), ("n", "e", "b", '{"v"', NOW))
    put(("n", "e", "a", '{"v":0}', "2023-01-01 00:00:00"))
    good, bad = store.read_records(spark, root)
    assert {(r.namespace, r.key, r.payload) for r in good.collect()} == {("n", "a", '{"v":2}'), ("m", "x", '{"v":9}')}
    assert [r.key for r in bad.collect()] == ["b"]
    only, _ = store.read_records(spark, root, "m", "e")
    assert [r.key for r in only.collect()] == ["x"]


def test_append_then_compact(spark, tmp_path):
    root = str(tmp_path / "store")
    schema = "namespace string, entity string, key string, payload string, stored_at timestamp_ntz"
    add = lambda seq, *data: store.append_records(rows(spark, schema, *data), root, seq, 2)
    add(1, ("n", "e", "a", "1", NOW), ("n", "e", "b", "1", NOW))
    add(2, ("n", "e", "a", "2", NOW), ("n", "e", "b", "2", "2020-01-01 00:00:00"))
    add(2, ("n", "e", "a", "2", NOW), ("n", "e", "b", "2", "2020-01-01 00:00:00"))  # replay
    see = lambda: {r.key: r.payload for r in store.read_records(spark, root)[0].collect()}
    assert see() == {"a": "2", "b": "1"}
    store.compact_records(spark, root)
    assert see() == {"a": "2", "b": "1"} and spark.read.parquet(root).count() == 2
    add(1, ("n", "e", "a", "3", NOW))
    assert see()["a"] == "3"


def test_reading_an_absent_store_is_empty(spark, tmp_path):
    good, bad = store.read_records(spark, str(tmp_path / "none"))
    assert good.count() == 0 and bad.count() == 0
