"""Skewed inputs: one key holds a third or more of the rows."""

import io
import random
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from litlake.operators import spread
from litlake.operators.telemetry import pace_requests
from tests.compare import DATA


def skewed(spark, n=3000):
    rng = random.Random(11)
    data = [(i, "hot" if i % 3 == 0 else None if i % 50 == 1 else f"k{rng.randint(0, 400)}") for i in range(n)]
    return spark.createDataFrame(data, "id long, key string"), data


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
@pytest.mark.parametrize("hot", [(), ("hot",)])
def test_keyed_join_equals_plain_join(spark, how, hot):
    df, _ = skewed(spark)
    one = spark.createDataFrame([("hot", 1), ("k1", 2), ("k1", 3), ("zz", 4), (None, 5)], "key string, v int")
    salted = spread.keyed_join(df, one, "key", how, spread=["id"], hot=hot)
    plain = df.join(one, "key", how)
    order = lambda d: sorted(map(tuple, d.select(*plain.columns).collect()), key=repr)
    assert order(salted) == order(plain)


def test_keyed_join_splits_a_known_hot_key(spark):
    df, _ = skewed(spark)
    one = spark.createDataFrame([("hot", 1)], "key string, v int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = spread.keyed_join(df, one, "key", "inner", spread=["id"], hot=["hot"])
        sizes = joined.groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) > 4 and max(r["count"] for r in sizes) < 600


def test_ordinal_over_all_rows_and_within_keys(spark):
    df, data = skewed(spark)
    got = {r.id: r.ordinal for r in spread.with_ordinal(df, ["id"]).collect()}
    assert got == {i: i for i, _ in data}
    keyed = df.where("key is not null")
    place = {r.id: r.ordinal for r in spread.with_ordinal(keyed, ["id"], ["key"]).collect()}
    seen: dict[str, int] = {}
    for i, key in data:
        if key is not None:
            assert place[i] == seen.get(key, 0)
            seen[key] = seen.get(key, 0) + 1


def test_pieces_split_the_hot_key(spark):
    df, _ = skewed(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pieces = spread.in_pieces(df.where("key = 'hot'"), ["key", "id"])
        assert pieces.select("_piece").distinct().count() > 4
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_pacing_equals_the_sequential_rule(spark):
    rng = random.Random(2)
    data = [(i, "hot" if i % 3 else f"p{i % 4}", float(rng.randint(0, 900))) for i in range(600)]
    df = spark.createDataFrame(data, "request_id long, provider string, arrival double")
    got = {r.request_id: (r.start, r.wait) for r in pace_requests(df, 2.5).collect()}
    last: dict[str, float] = {}
    for i, provider, arrival in sorted(data, key=lambda r: (r[1], r[2], r[0])):
        start = max(arrival, last.get(provider, -1e9) + 2.5)
        last[provider] = start
        assert got[i] == pytest.approx((start, start - arrival))


def test_pages(spark):
    df, data = skewed(spark)
    df = df.where("key is not null")
    size = sum(1 for _, k in data if k == "hot")
    for page in (1, 3, size // 7 + 1, 500):
        r = spread.paginate(df, ["key"], [F.col("id")], page, 7, ["id"]).where("key = 'hot'").first()
        want = [i for i, k in data if k == "hot"][(page - 1) * 7 : page * 7]
        assert [x.id for x in r["items"]] == want
        assert (r.total, r.has_more) == (size, page * 7 < size)


def test_match_keys_both_ways(spark):
    df, _ = skewed(spark)
    keys = spark.createDataFrame([("hot",), ("hot",), ("k5",)], "key string")
    semi = spread.match_keys(df, keys, ["key"], "left_semi").count()
    anti = spread.match_keys(df, keys, ["key"], "left_anti").count()
    assert semi == df.where("key in ('hot', 'k5')").count()
    assert semi + anti == df.count()


def test_null_keys_stay_out_of_the_join(spark):
    df, _ = skewed(spark)
    sparse = df.withColumn("key", F.when(F.col("id") % 10 < 3, F.col("key")))
    one = spark.createDataFrame([("hot", 1), (None, 5)], "key string, v int")
    joined = spread.keyed_join(sparse, one, "key")
    assert "isnotnull(key" in plan_of(joined) and joined.count() == sparse.count()
    assert joined.where("key is null and v is not null").count() == 0


def test_deep_pages_number_a_hot_key_in_pieces(spark):
    rows = spark.range(3000).select(F.lit("hot").alias("key"), (F.col("id") * 7 % 3000).alias("n"))
    (got,) = spread.page_items(rows, ["key"], [F.col("n")], 21, 100, ["n"]).collect()
    assert [x.n for x in got["items"]] == list(range(2000, 2100))


def plan_of(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", ["references_page", "latest_version", "first_seen", "bm25_batch"])
def test_group_limits_run_before_the_shuffle(spark, name):
    plan = plan_of(entry.queries()[name](spark, f"{DATA}/sf0.001"))
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.mark.parametrize(
    "name", ["bm25_top_k", "bm25_search", "parse_sections", "batch_metadata", "reference_counts", "enrich_references"]
)
def test_plans_hold_no_cross_join(spark, name):
    plan = plan_of(entry.queries()[name](spark, f"{DATA}/sf0.001"))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["parse_sections", "find_in_documents", "term_index"])
def test_document_work_needs_no_key_shuffle(spark, name):
    assert "hashpartitioning" not in plan_of(entry.queries()[name](spark, f"{DATA}/sf0.001"))


def test_only_needed_columns_are_read(spark):
    plan = plan_of(entry.queries()["citation_counts"](spark, f"{DATA}/sf0.001"))
    assert "ReadSchema: struct<l_partkey:bigint>" in plan
