"""Building blocks that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from litlake.session import pin

SALTS = 32
# Rows per key up to which Spark turns a row number filter into a limit before the shuffle.
GROUP_LIMIT = 1000


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in ``order`` (which should be total).

    ``row_number() = 1`` is turned into a group limit that runs before the
    shuffle, so a hot key sends one row per map task, not all its rows.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def first_n_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str
) -> DataFrame:
    """The first ``n`` rows per key with their 1-based rank, limited before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def page_items(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    page: int,
    page_size: int,
    columns: Sequence[str],
) -> DataFrame:
    """The rows of one page per key as an ordered array ``items``.

    Up to GROUP_LIMIT rows deep, a group limit lets at most ``page * page_size``
    rows per key and map task reach the shuffle. Deeper pages number the rows of
    a key in range pieces, so that no task sorts a whole hot key. Keys without
    rows on the page are absent. ``order`` should be total.
    """
    start, end = (page - 1) * page_size, page * page_size
    if end <= GROUP_LIMIT:
        rows = first_n_per_key(df, keys, order, end, "_rank")
    else:
        names = [f"_order{i}" for i in range(len(order))]
        placed = df.withColumns(dict(zip(names, order, strict=True)))
        numbered = with_ordinal(placed, names, keys, "_rank").withColumn("_rank", F.col("_rank") + 1)
        rows = numbered.where(F.col("_rank") <= end).drop(*names)
    rows = rows.where(F.col("_rank") > start)
    return (
        rows.groupBy(*keys)
        .agg(
            F.sort_array(
                F.collect_list(F.struct("_rank", F.struct(*columns).alias("item")))
            ).alias("_rows")
        )
        .select(*keys, F.transform("_rows", lambda r: r["item"]).alias("items"))
    )


def page_columns(
    df: DataFrame, columns: Sequence[str], page: int, page_size: int
) -> dict[str, Column]:
    """Page columns beside ``total`` and ``items``; a page past the end is an empty list."""
    empty = F.array().cast(_array_of(df, columns))
    return {
        "page": F.lit(page),
        "page_size": F.lit(page_size),
        "has_more": F.coalesce(F.col("total") > page * page_size, F.lit(False)),
        "items": F.coalesce("items", empty),
    }


def paginate(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    page: int,
    page_size: int,
    columns: Sequence[str],
) -> DataFrame:
    """One page per key: ``total, page, page_size, has_more, items``.

    Totals are a partially aggregated count of all rows of a key.
    """
    totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    items = page_items(df, keys, order, page, page_size, columns)
    shown = page_columns(df, columns, page, page_size)
    return totals.join(items, list(keys), "left").select(
        *keys, "total", *(c.alias(n) for n, c in shown.items())
    )


def _array_of(df: DataFrame, columns: Sequence[str]) -> str:
    return f"array<{df.select(*columns).schema.simpleString()}>"


def in_pieces(df: DataFrame, order: Sequence[str], label: str = "pieces") -> DataFrame:
    """Range-partition on ``order`` and pin the result with its ``_piece`` number.

    Rows of piece *i* all sort before rows of piece *i+1*. A hot key is spread
    over many pieces because the later sort columns take part in the split.
    """
    ranged = df.repartitionByRange(*order).withColumn("_piece", F.spark_partition_id())
    return pin(ranged, label)


#: Hash buckets in which rows are counted to find heavy keys.
WEIGHT_BUCKETS = 4096
#: A bucket is heavy from more than this part of all rows on, but never up to LIGHT_ROWS.
HEAVY_PART = 512
LIGHT_ROWS = 1000


def by_weight(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose keys are few each, and those that share a hash bucket with a heavy key, if any.

    No key of the first part has more rows than a heavy bucket starts with, so one task
    can sort it. Rows are counted per bucket, not per key: the count shuffles at most
    WEIGHT_BUCKETS rows a task, and the list of heavy buckets stays below HEAVY_PART.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(WEIGHT_BUCKETS))
    sizes = df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).collect()
    limit = max(LIGHT_ROWS, sum(r["n"] for r in sizes) // HEAVY_PART)
    heavy = [r["bucket"] for r in sizes if r["n"] > limit]
    if not heavy:
        return df, None
    return df.where(~bucket.isin(heavy)), df.where(bucket.isin(heavy))


def with_ordinal(
    df: DataFrame, order: Sequence[str], keys: Sequence[str] = (), name: str = "ordinal"
) -> DataFrame:
    """0-based position of every row in ``order``, globally or within ``keys``.

    Keys of few rows are numbered whole, in one shuffle. All rows, or those of heavy
    keys, are numbered in range pieces, so that no task sorts more than one piece.
    """
    if not keys:
        return _ordinal_in_pieces(df, order, keys, name)
    light, heavy = by_weight(df, keys)
    numbered = _ordinal_of_light(light, order, keys, name)
    if heavy is None:
        return numbered
    return numbered.unionByName(_ordinal_in_pieces(heavy, order, keys, name))


def _ordinal_of_light(
    df: DataFrame, order: Sequence[str], keys: Sequence[str], name: str
) -> DataFrame:
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn(name, place.cast("long"))


def _ordinal_in_pieces(
    df: DataFrame, order: Sequence[str], keys: Sequence[str], name: str
) -> DataFrame:
    """Two levels: position inside a piece, plus the number of rows in earlier pieces."""
    pieces = in_pieces(df, [*keys, *order])
    group = [*keys, "_piece"]
    sizes = pieces.groupBy(*group).agg(F.count(F.lit(1)).alias("_size"))
    earlier = W.orderBy("_piece") if not keys else W.partitionBy(*keys).orderBy("_piece")
    before = F.sum("_size").over(earlier.rowsBetween(W.unboundedPreceding, 0)) - F.col("_size")
    # Only the first key of a piece has rows in earlier ones: at most one row per piece is left.
    offsets = sizes.select(F.struct(*group).alias("_group"), before.alias("_before")).where("_before > 0")
    local = F.row_number().over(W.partitionBy(*group).orderBy(*order)) - 1
    # Structs, so that null keys find theirs.
    return (
        pieces.withColumn("_local", local)
        .join(F.broadcast(offsets), F.struct(*group) == F.col("_group"), "left")
        .withColumn(name, F.coalesce("_before", F.lit(0)) + F.col("_local"))
        .drop("_piece", "_local", "_group", "_before")
    )


#: Places of one clustering block of ``store_ordinals``.
ORDINAL_BLOCK = 50


def store_ordinals(
    df: DataFrame, path: str, keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """``df`` with the 0-based ``ordinal`` of each row within its key, written clustered by place.

    A file holds a range of keys, and in it the rows of one block of places lie together,
    ordered by key, so a page of all keys or of one key is a range per file that the scan
    skips everything else for. Rows are dealt by ranges of whole keys once, for their
    numbers and their files alike; rows of heavy keys are dealt again by place.
    """
    block = F.floor(F.col("ordinal") / ORDINAL_BLOCK).alias("ordinal_block")
    clustered = ["ordinal_block", *keys, "ordinal"]
    light, heavy = by_weight(df, keys)
    numbered = _ordinal_of_light(light.repartitionByRange(*keys), order, keys, "ordinal")
    stored = numbered.select("*", block).sortWithinPartitions(*clustered)
    if heavy is not None:
        pieces = _ordinal_in_pieces(heavy, order, keys, "ordinal").select("*", block)
        stored = stored.unionByName(pieces.repartitionByRange(*clustered).sortWithinPartitions(*clustered))
    stored.write.mode("overwrite").option("parquet.block.size", str(16 << 20)).parquet(path)
    return df.sparkSession.read.parquet(path)


def stored_page_items(
    stored: DataFrame, keys: Sequence[str], page: int, page_size: int, columns: Sequence[str]
) -> DataFrame:
    """``page_items`` of a table of ``store_ordinals``: no row outside the page is read twice or ranked."""
    start, end = (page - 1) * page_size, page * page_size
    block, place = F.col("ordinal_block"), F.col("ordinal")
    rows = stored.where((block >= start // ORDINAL_BLOCK) & (block <= (end - 1) // ORDINAL_BLOCK))
    rows = rows.where((place >= start) & (place < end))
    item = F.struct("ordinal", F.struct(*columns).alias("item"))
    return (
        rows.groupBy(*keys)
        .agg(F.sort_array(F.collect_list(item)).alias("_rows"))
        .select(*keys, F.transform("_rows", lambda r: r["item"]).alias("items"))
    )


def at_least_one(name: str, n: int) -> int:
    """A size as the caller gave it; below one is an error."""
    if n < 1:
        raise ValueError(f"{name} must be at least 1, not {n}")
    return n


def match_keys(df: DataFrame, keys: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """``left_semi`` or ``left_anti`` join of wide rows against a list of keys.

    Adaptive execution broadcasts a key list that turns out small, and splits
    skewed partitions otherwise.
    """
    return df.join(keys.select(*on).distinct(), list(on), how)


def keyed_join(
    many: DataFrame,
    one: DataFrame,
    key: str,
    how: str = "left",
    *,
    spread: Sequence[str] = (),
    hot: Sequence = (),
    salts: int = SALTS,
) -> DataFrame:
    """Equi-join of many rows with at most a few rows per key.

    Rows of ``many`` without a key don't enter the shuffle: a left or anti join
    passes them through beside it. Skewed keys are split by adaptive execution; keys
    named in ``hot``, from stored statistics, are dealt over ``salts`` tasks by
    the hash of the columns ``spread``, and their rows of ``one`` are copied
    once per salt. No job runs to plan the join.
    """
    keyed = many.where(F.col(key).isNotNull())
    one = one.where(F.col(key).isNotNull())
    if hot:
        is_hot = F.col(key).isin(*hot)
        salt = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
        copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1)))
        keyed = keyed.withColumn("_salt", F.when(is_hot, salt).otherwise(F.lit(0)))
        one = one.withColumn("_salt", F.explode(F.coalesce(copies, F.array(F.lit(0)))))
        joined = keyed.join(one, [key, "_salt"], how).drop("_salt")
    else:
        joined = keyed.join(one, key, how)
    if how not in ("left", "left_anti"):
        return joined
    rest = many.where(F.col(key).isNull())
    return joined.unionByName(rest, allowMissingColumns=True)
