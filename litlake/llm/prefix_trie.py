"""Prefix trie of conversations by van Emde Boas recursion.

Sequences of turns are cut at half depth again and again, all pieces of one length in
one job. A cut prefix gets a name; the upper halves are the trie above the cut, the
lower halves a forest whose roots are the cut prefixes' names. Equal pieces below one name
are one row with a count, so copies collapse before they are cut further. Pieces of a single
turn are the trie's nodes. Totals go the other way: the totals of each forest are
grafted on the path to its root, along the pieces kept from the way down, one job per
halving; no node meets all its ancestors.

A turn's name is two 64-bit hashes of its place, role and text; a prefix's name is the
exclusive or of its turns' names, so names of pieces combine in any order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from litlake.llm.common import only, written
from litlake.operators.spread import with_ordinal

#: Longest piece that is one row; longer conversations are chains of such pieces.
PIECE = 1 << 16
#: Bytes of conversation ids that are hashed at a time.
RUN_BYTES = 1 << 16
#: A conversation of a family starts with turns of the family's first one: sizes of both.
FAMILY, HEADS = 5, 9

_KEY = ["depth", "n1", "n2"]


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place from 0, c1, c2, n_bytes): turns in order, their contents as two hashes.

    Null turns come first; equal turns go by role, then text (its first 64 characters,
    then its hashes). Null roles and texts are empty. Rows without conv_id belong to no conversation
    and are left out. A conversation is numbered in range pieces, however long it is.
    """
    rows = only(conversations, conv_id="long", turn="long", role="string", text="string")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = rows.where("conv_id is not null").select(
        "conv_id",
        "turn",
        role.alias("role"),
        F.substring(text, 1, 64).alias("head"),
        F.xxhash64(F.lit(1), role, text).alias("c1"),
        F.xxhash64(F.lit(2), role, text).alias("c2"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )
    placed = with_ordinal(rows, ["turn", "role", "head", "c1", "c2"], ["conv_id"], "place")
    placed = placed.select("conv_id", F.col("place").cast("long").alias("place"), "c1", "c2", "n_bytes")
    return written(placed, "turns")


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of families' shared heads and own tails, and (conv_id) of all conversations.

    Conversation c takes the first h turns of conversation c - c mod FAMILY (the remainder
    never negative), then its own turns after its first h; h is crc32(c) mod HEADS.
    """
    c = F.col("conv_id")
    members = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    h = F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(HEADS))
    members = members.select("conv_id", "n", h.alias("h"), (c - F.pmod(c, F.lit(FAMILY))).alias("base"))
    firsts = members.where(c == F.col("base")).select("base", F.col("n").alias("base_n"))
    members = members.join(firsts, "base", "left").select(
        "conv_id", "h", "base", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken")
    )
    members = written(members, "members")
    is_base = F.pmod(c, F.lit(FAMILY)) == 0
    heads = turns.where(is_base & (F.col("place") < HEADS - 1)).withColumnRenamed("conv_id", "base")
    heads = heads.join(members.select("conv_id", "base", "h"), "base").where("place < h")
    tails = turns.join(members.select("conv_id", "h", "taken"), "conv_id").where("place >= h")
    tails = tails.withColumn("place", F.expr("taken + place - h"))
    names = ["conv_id", "place", "c1", "c2", "n_bytes"]
    return heads.select(*names).unionByName(tails.select(*names)), members.select("conv_id")


def _xor(items: Column, field: str) -> Column:
    return F.aggregate(items, F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x[field]))


def _pieces(turns: DataFrame) -> DataFrame:
    """Per conversation and PIECE turns: lo, its place; r1, r2, the name before it; items; x1, x2; size."""
    turn = F.struct(
        "place",
        F.xxhash64("place", "c1", "c2").alias("h1"),
        F.xxhash64("c2", "place", "c1").alias("h2"),
        "n_bytes",
    )
    lo = (F.col("place") - F.pmod("place", F.lit(PIECE))).alias("lo")
    pieces = turns.select("conv_id", lo, turn.alias("item")).groupBy("conv_id", "lo").agg(
        F.array_sort(F.collect_list("item")).alias("items"),
        F.bit_xor("item.h1").alias("x1"),
        F.bit_xor("item.h2").alias("x2"),
    )
    pieces = pieces.withColumn("items", F.transform("items", lambda x: x.dropFields("place")))
    pieces = written(pieces.withColumn("size", F.size("items")), "pieces")
    if not pieces.agg(F.coalesce(F.max("lo"), F.lit(0))).first()[0]:
        return pieces.withColumns({"r1": F.lit(0).cast("long"), "r2": F.lit(0).cast("long")})
    before = W.partitionBy("conv_id").orderBy("lo").rowsBetween(W.unboundedPreceding, -1)
    name = {r: F.coalesce(F.bit_xor(x).over(before), F.lit(0)) for r, x in (("r1", "x1"), ("r2", "x2"))}
    return written(pieces.withColumns(name), "pieces")


def _distinct(pieces: DataFrame) -> DataFrame:
    return pieces.groupBy("lo", "r1", "r2", "size", "x1", "x2").agg(
        F.first("items").alias("items"), F.sum("n").alias("n"), F.min("least").alias("least")
    )


def _cut(pieces: DataFrame, half: int) -> DataFrame:
    """Pieces longer than ``half`` as their upper and their lower part."""
    upper, lower = F.slice("items", 1, half), F.slice("items", half + 1, half)
    u1, u2 = _xor(upper, "h1"), _xor(upper, "h2")

    def part(lo, r1, r2, items, x1, x2):
        fields = {"lo": lo, "r1": r1, "r2": r2, "items": items, "x1": x1, "x2": x2}
        return F.struct(*(v.alias(k) for k, v in fields.items()))

    c = F.col
    long_ones = pieces.where(c("size") > half).withColumns({"u1": u1, "u2": u2})
    above = part(c("lo"), c("r1"), c("r2"), upper, c("u1"), c("u2"))
    below = part(
        c("lo") + half,
        c("r1").bitwiseXOR(c("u1")),
        c("r2").bitwiseXOR(c("u2")),
        lower,
        c("x1").bitwiseXOR(c("u1")),
        c("x2").bitwiseXOR(c("u2")),
    )
    halves = long_ones.select(F.explode(F.array(above, below)).alias("p"), "n", "least").select("p.*", "n", "least")
    halves = halves.withColumn("size", F.size("items"))
    return halves.unionByName(pieces.where(c("size") <= half).select(halves.columns))


def _levels(pieces: DataFrame) -> dict[int, DataFrame]:
    """The distinct pieces of at most 1, 2, 4, ... turns; every level is cut from the next longer one."""
    longest = pieces.agg(F.coalesce(F.max("size"), F.lit(1))).first()[0]
    step = 1 << (longest - 1).bit_length()
    entering = pieces.select(
        "lo", "r1", "r2", "items", "x1", "x2", "size", F.lit(1).cast("long").alias("n"), F.col("conv_id").alias("least")
    )
    levels, above = {}, None
    while step:
        # A piece enters at its own length: short ones don't pass through the longer levels.
        own = entering.where((F.col("size") <= step) & (F.col("size") > step // 2))
        level = own if above is None else own.unionByName(above)
        levels[step] = written(_distinct(level), f"level-{step}")
        above = _cut(levels[step], step // 2)
        step //= 2
    return levels


def _place_of_use(depth: Column) -> Column:
    """The largest power of two, at most PIECE, that divides depth - 1: the level that grafts a node; 0 below the root."""
    d = depth - 1
    return F.when(d == 0, 0).otherwise(F.least(d.bitwiseAND(-d), F.lit(PIECE)))


def _by_use(rows: DataFrame, label: str) -> DataFrame:
    """Written with the level that grafts each node, which a scan can be filtered by."""
    return written(rows.withColumn("use", _place_of_use(F.col("depth")).cast("long")), label)


def _grafts(level: DataFrame, below: DataFrame, step: int) -> DataFrame:
    """Totals of forests, given per child in ``below``, on every node of the paths to their roots."""
    forest = below.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("n1"), F.col("p2").alias("n2"))
    forest = forest.agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    c = F.col
    paths = level.where(c("size") == step).select(
        (c("lo") + step).alias("depth"),
        c("r1").bitwiseXOR(c("x1")).alias("n1"),
        c("r2").bitwiseXOR(c("x2")).alias("n2"),
        "lo",
        "r1",
        "r2",
        "items",
    )
    found = paths.join(forest, _KEY).select("lo", "r1", "r2", "items", "n_leaves", "saved")
    first = F.struct(c("r1").alias("a"), c("r2").alias("b"), F.array(F.struct("r1", "r2")).alias("all"))

    def further(s, x):
        a, b = s["a"].bitwiseXOR(x["h1"]), s["b"].bitwiseXOR(x["h2"])
        grown = F.concat(s["all"], F.array(F.struct(a.alias("r1"), b.alias("r2"))))
        return F.struct(a.alias("a"), b.alias("b"), grown.alias("all"))

    if step == 1:
        names = F.array(
            F.struct("r1", "r2"),
            F.struct(
                c("r1").bitwiseXOR(c("items")[0]["h1"]).alias("r1"), c("r2").bitwiseXOR(c("items")[0]["h2"]).alias("r2")
            ),
        )
    else:
        names = F.aggregate("items", first, further)["all"]
    places = F.sequence(F.lit(1), F.lit(step))
    return found.select("lo", names.alias("names"), "n_leaves", "saved").select(
        F.explode(places).alias("i"), "lo", "names", "n_leaves", "saved"
    ).select(
        (c("lo") + c("i")).alias("depth"),
        F.get("names", c("i"))["r1"].alias("n1"),
        F.get("names", c("i"))["r2"].alias("n2"),
        F.get("names", c("i") - 1)["r1"].alias("p1"),
        F.get("names", c("i") - 1)["r2"].alias("p2"),
        "n_leaves",
        "saved",
    )


def _ends(pieces: DataFrame, members: DataFrame) -> DataFrame:
    """(depth, n1, n2, conv_id): the node at which each conversation ends, the root for turnless ones."""
    last = pieces.groupBy("conv_id").agg(
        F.sum("size").cast("long").alias("depth"), F.bit_xor("x1").alias("n1"), F.bit_xor("x2").alias("n2")
    )
    ends = members.join(last, "conv_id", "left").select(
        *(F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in _KEY), "conv_id"
    )
    return written(ends, "ends")


def ends_digests(ends: DataFrame) -> DataFrame:
    """(depth, n1, n2, ends_sha256) over the ids of a node in order, comma-joined.

    Ranges of ids become runs of text in parallel; the runs of a node are then hashed as a
    stream. A node with very many ends sends runs to one task, not ids.
    """
    kinds = "depth long, n1 long, n2 long"

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, size, out = None, [], 0, []

        def flush():
            if ids:
                out.append((*key, int(ids[0]), ",".join(ids)))

        for batch in batches:
            for *node, conv_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if node != key or size >= RUN_BYTES:
                    flush()
                    key, ids, size = node, [], 0
                ids.append(str(conv_id))
                size += len(ids[-1]) + 1
            if out:
                columns = [pa.array(c) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, [*_KEY, "first", "run"])
                out.clear()
        flush()
        if out:
            columns = [pa.array(c) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, [*_KEY, "first", "run"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for *node, run in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if node != key:
                    if state is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = node, hashlib.sha256(run.encode())
                else:
                    state.update(b"," + run.encode())
            if out:
                columns = [pa.array(c) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, [*_KEY, "ends_sha256"])
        if state is not None:
            columns = [pa.array([c]) for c in (*key, state.hexdigest())]
            yield pa.RecordBatch.from_arrays(columns, [*_KEY, "ends_sha256"])

    order = [*_KEY, "conv_id"]
    text = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    text = text.mapInArrow(runs, f"{kinds}, first long, run string")
    streams = text.repartition(*_KEY).sortWithinPartitions(*_KEY, "first").select(*_KEY, "run")
    return streams.mapInArrow(hashed, f"{kinds}, ends_sha256 string")


def trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """Per node of the trie of ``turns`` (conv_id, place, c1, c2, n_bytes): its place and totals.

    ``members`` (conv_id) names all conversations, those without turns too. Columns: conv_id (the
    smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. Without conversations there is no root and the result is empty.
    """
    spark = turns.sparkSession
    pieces = _pieces(turns)
    levels = _levels(pieces)
    c = F.col
    nodes = levels[1].select(
        (c("lo") + 1).alias("depth"),
        c("r1").bitwiseXOR(c("x1")).alias("n1"),
        c("r2").bitwiseXOR(c("x2")).alias("n2"),
        c("r1").alias("p1"),
        c("r2").alias("p2"),
        "n",
        "least",
        ((c("n") - 1) * c("items")[0]["n_bytes"]).alias("saved"),
    )
    children = nodes.groupBy((c("depth") - 1).alias("depth"), c("p1").alias("n1"), c("p2").alias("n2"))
    children = children.agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, _KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = nodes.withColumn("n_leaves", F.when(c("n_children") == 0, 1).otherwise(0).cast("long"))
    nodes = _by_use(nodes, "nodes")
    names = [*_KEY, "p1", "p2", "n_leaves", "saved"]
    totals = [nodes]

    def graft(step: int, below, lo) -> None:
        rows = [t.where(F.col("use") == step).select(*names) for t in totals]
        forest = rows[0]
        for more in rows[1:]:
            forest = forest.unionByName(more)
        totals.append(_by_use(_grafts(levels[step].where(lo), forest.where(below), step), f"grafts-{step}"))

    for step in sorted(levels)[:-1]:
        graft(step, F.lit(True), F.pmod("lo", F.lit(2 * step)) == 0)
    if PIECE in levels:
        deepest = pieces.agg(F.max("lo")).first()[0]
        for lo in range(deepest, 0, -PIECE):
            graft(PIECE, c("depth") == lo + 1, c("lo") == lo - PIECE)
    summed = nodes.select(*names)
    for more in totals[1:]:
        summed = summed.unionByName(more.select(*names))
    summed = summed.groupBy(*_KEY).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    kept = nodes.select(*_KEY, "p1", "p2", "n", "least", "n_children")
    below = written(kept.join(summed, _KEY), "totals")
    top = below.where("depth = 1").agg(
        F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved")
    ).first()
    whole = members.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least")).first()
    # The root: two small rows of sums.
    values = dict.fromkeys(_KEY, 0) | {"p1": None, "p2": None, "n": whole.n, "least": whole.least}
    values |= {"n_children": top.n_children, "n_leaves": top.n_leaves or 1, "saved": top.saved or 0}
    root = spark.range(1 if whole.n else 0).select(*(F.lit(v).cast("long").alias(k) for k, v in values.items()))
    every = root.unionByName(below)
    every = every.join(ends_digests(_ends(pieces, members)), _KEY, "left")
    parents = root.unionByName(below).select(
        (c("depth") + 1).alias("depth"), c("n1").alias("p1"), c("n2").alias("p2"), c("least").alias("parent_conv_id")
    )
    none = hashlib.sha256(b"").hexdigest()
    return every.join(parents, ["depth", "p1", "p2"], "left").select(
        c("least").alias("conv_id"),
        "depth",
        "parent_conv_id",
        c("n").alias("n_convs"),
        "n_children",
        "n_leaves",
        c("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as rebuilt from their families.

    Rows without conv_id are left out; repeated rows are turns of their own.
    """
    turns, members = rebuilt_turns(ordered_turns(conversations))
    return trie(turns, members)
