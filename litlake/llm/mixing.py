"""Mixing sources to target weights by Sainte-Laguë apportionment.

Documents are dealt by a seeded hash to shards of their source, and stand there
in the order of that hash. A shard's words are cut into equal blocks. Blocks of
the mix go to shards by highest quotients, target / (2 * seats + 1), which gives
each shard an integer quota; whole rounds of a shard and then a seeded run of its
blocks fill the quota.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from litlake.llm.common import only, written
from litlake.operators.spread import with_ordinal

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
BLOCK_WORDS = 256
SHARD_WORDS = 1_000_000
SEED = 17
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hash(seed: int, *parts: Column) -> Column:
    """md5 of the seed and the parts as hexadecimal text; null parts read 'null'."""
    texts = [F.coalesce(p.cast("string"), F.lit("null")) for p in parts]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *texts))


def _number(hexadecimal: Column) -> Column:
    return F.conv(F.substring(hexadecimal, 1, 8), 16, 10).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS
) -> DataFrame:
    """Per source: source_key, source_size, target, from rows of (source, source_key, size).

    Sources by code point, null last, take the weights in turn and share all
    sizes. A target stops at ``most`` times its source's size; what is over is
    shared by weight among the others, until none is above.
    """
    sources = sizes.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    sources = with_ordinal(sources, ["source_key"], name="place")
    cycle = F.element_at(F.array(*map(F.lit, weights)), F.pmod("place", F.lit(len(weights))).cast("int") + 1)
    sources = written(sources.withColumn("weight", cycle), "sources")
    cap = most * F.col("source_size")
    total, share = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    level, seen = (total or 0) / (share or 1), None
    while True:
        over = cap < F.lit(level) * F.col("weight")
        fixed, free, n = sources.agg(
            F.coalesce(F.sum(F.when(over, cap)), F.lit(0)),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)),
            F.count(F.when(over, 1)),
        ).first()
        if n == seen or not free:
            break
        level, seen = (total - fixed) / free, n
    target = F.least(cap.cast("double"), F.lit(float(level)) * F.col("weight"))
    return sources.select("source_key", "source_size", target.alias("target"))


def apportion(cells: DataFrame, block: int) -> DataFrame:
    """``cells`` with ``quota``: blocks of ``block`` words by highest quotients.

    Rounding target / block gives each cell its seats at the divisor ``block``;
    the few seats that this leaves or overdraws are settled by ranking the next
    quotients. A cell's next seats are listed only as far as they can be reached.
    """
    base = F.floor(F.col("target") / block + 0.5).cast("long")
    cells = written(cells.withColumn("base", base), "cells")
    total, seats, n = cells.agg(F.sum("target"), F.sum("base"), F.count(F.lit(1))).first()
    missing = round((total or 0) / block) - (seats or 0)
    if not missing:
        return cells.withColumnRenamed("base", "quota")
    reach = F.ceil(F.col("target") * (abs(missing) + n) / F.lit(float(total))) + 1
    key = ["source_key", "shard"]
    if missing > 0:
        steps = F.sequence(F.lit(0).cast("long"), reach.cast("long"))
        tried = cells.select(*key, "target", "base", F.explode(steps).alias("step"))
        quotient = F.col("target") / (2 * (F.col("base") + F.col("step")) + 1)
        order = [quotient.desc(), *key, "step"]
    else:
        steps = F.sequence(F.lit(1).cast("long"), reach.cast("long"))
        tried = cells.select(*key, "target", "base", F.explode(steps).alias("step"))
        tried = tried.where("step <= base")
        quotient = F.col("target") / (2 * (F.col("base") - F.col("step")) + 1)
        order = [quotient.asc(), *key, "step"]
    won = tried.orderBy(*order).limit(abs(missing)).groupBy(*key).agg(F.count(F.lit(1)).alias("more"))
    sign = 1 if missing > 0 else -1
    quota = F.col("base") + sign * F.coalesce("more", F.lit(0))
    return cells.join(won, key, "left").withColumn("quota", quota).drop("base", "more")


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST_REPEATS,
    block: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken.

    Every row gives one row. Null and empty texts have size 0 and take nothing;
    null is a source of its own, behind all others. Equal rows may take different
    numbers of words, the same ones in every run as a whole. An empty table gives
    an empty result. No source or document is held by one task: the largest unit
    is a shard of about ``shard_words`` words.
    """
    rows = only(docs, doc_id="long", text="string", source="string")
    # '0' before every name and '1' for null put null last, by code point else.
    key = F.coalesce(F.concat(F.lit("0"), "source"), F.lit("1"))
    rows = rows.select("doc_id", key.alias("source_key"), word_count(F.col("text")).alias("size"))
    rows = written(rows, "sizes")
    sources = source_targets(rows, weights, most)
    place = _hash(seed, F.col("doc_id"))
    shards = F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1))
    dealt = rows.join(sources, "source_key").select(
        "*", place.alias("place"), F.pmod(_number(place), shards).alias("shard")
    )
    cells = dealt.groupBy("source_key", "shard").agg(
        F.sum("size").alias("cell_size"),
        F.first("source_size").alias("of"),
        F.first("target").alias("all"),
    )
    share = F.when(F.col("of") > 0, F.col("all") * F.col("cell_size") / F.col("of")).otherwise(0.0)
    cells = apportion(
        cells.select("source_key", "shard", "cell_size", share.alias("target")), block
    ).drop("target")
    blocks = F.greatest(F.ceil(F.col("cell_size") / block), F.lit(1))
    quota = F.least("quota", most * blocks)
    first = F.pmod(_number(_hash(seed, F.col("source_key"), F.col("shard"))), blocks)
    cells = cells.select(
        "source_key",
        "shard",
        "cell_size",
        F.floor(quota / blocks).alias("rounds"),
        (first * block).alias("begin"),
        ((first + F.pmod(quota, blocks)) * block).alias("end"),
        (blocks * block).alias("around"),
    )
    line = W.partitionBy("source_key", "shard").orderBy("place", "doc_id", "size")
    upto = F.sum("size").over(line.rowsBetween(W.unboundedPreceding, 0))
    placed = dealt.withColumn("upto", upto).withColumn("from", F.col("upto") - F.col("size"))
    joined = placed.join(cells, ["source_key", "shard"])
    run = _overlap(F.col("begin"), F.col("end")) + _overlap(F.lit(0), F.col("end") - F.col("around"))
    taken = F.col("rounds") * F.col("size") + run
    return joined.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def _overlap(begin: Column, end: Column) -> Column:
    """Words that a document's stretch ``from .. upto`` shares with ``begin .. end``."""
    inside = F.least(F.col("upto"), end) - F.greatest(F.col("from"), begin)
    return F.greatest(inside, F.lit(0))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: how many words of each document the mix takes."""
    return mix(docs)
