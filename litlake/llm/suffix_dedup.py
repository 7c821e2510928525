"""Exact removal of repeated byte strings by blockwise suffix sorting.

Every window of LENGTH bytes has an anchor: the least of its byte grams, by a
hash, the leftmost of equals. Equal windows have equal anchors at equal offsets,
so the suffixes that start equal windows are in one bucket, that of the anchor's
hash, and a bucket of which there is one piece of text can't repeat anything.
The windows of one anchor are a contiguous stretch, kept as one piece of text.

Buckets are put in order one block after the other, and a block's memory is its
own text: suffixes are ordered by their first bytes, and ties by the ranks of a
difference cover of positions, ranked beforehand. For any two suffixes there is
an offset below the period at which both stand on the cover. Pieces are laid out
with their anchors on one residue, so that nearly all ties have that offset in
common. Neighbours in that order which agree in LENGTH bytes are repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litlake.llm.common import only, unused, utf8, written

LENGTH = 200
GRAM = 24
#: Windows looked at together; memory for a long text follows this, not its length.
STRIDE = 1 << 18
#: Text of one block of buckets.
BLOCK_BYTES = 2_000_000
#: Pieces of one bucket up to which it is sorted in one block; larger ones go by whole windows.
MANY = 20_000
#: A perfect difference set. Every residue is a difference of two of them.
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)

_MULT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_WIDE = np.uint64((1 << 64) - (1 << 20))


def _words(data: bytes | np.ndarray, big: bool = False) -> np.ndarray:
    """The 8 bytes at each position, as a number."""
    n = max(0, len(data) - 7)
    return np.ndarray((n,), ">u8" if big else "<u8", data, strides=(1,)).astype(np.uint64)


def _gram_hashes(data: bytes) -> np.ndarray:
    w = _words(data)
    n = len(data) - GRAM + 1
    h = w[:n] * _MULT[0] + w[8 : 8 + n] * _MULT[1] + w[16 : 16 + n] * _MULT[2]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def pieces(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first window, number of windows and anchor offset of each piece of ``data``.

    Windows ``first .. first + count - 1`` have their anchor at ``first + offset``.
    """
    total = len(data) - LENGTH + 1
    wide = LENGTH - GRAM + 1
    out = []
    for start in range(0, max(0, total), STRIDE):
        part = data[start : start + STRIDE + LENGTH - 1]
        h = _gram_hashes(part)
        n = len(h) - wide + 1
        ranked = (h & _WIDE) | np.arange(len(h), dtype=np.uint64)
        # Least of each window: the least to its right in one block and to its left in the next.
        padded = np.full(-(-len(h) // wide) * wide, ~np.uint64(0))
        padded[: len(h)] = ranked
        blocks = padded.reshape(-1, wide)
        left = np.minimum.accumulate(blocks, 1).ravel()
        right = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
        least = np.minimum(right[:n], left[wide - 1 : wide - 1 + n])
        at = (least & ~_WIDE).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        count = np.diff(np.r_[first, n])
        out.append((h[at[first]].view(np.int64), first + start, count, at[first] - first))
    if not out:
        return (np.zeros(0, np.int64),) * 4
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def _key(docs: DataFrame, text: Column, doc_id: Column) -> list[Column]:
    """The id and 64 bits of a hash of the text, and of whether there is an id.

    Rows with equal ids and texts share a key, and are repeats of each other anyway.
    """
    return [
        F.coalesce(doc_id.cast("long"), F.lit(0).cast("long")).alias("d"),
        F.xxhash64(doc_id.isNull(), text).alias("th"),
    ]


def _all_pieces(texts: DataFrame) -> DataFrame:
    """(h, cd, d, th, place) of every piece; cd is a digest of its bytes and offset.

    ``place`` packs first window, number of windows less one, and anchor offset.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = utf8(batch.column("text")[i].as_py())
                h, first, count, offset = pieces(data)
                if not len(h):
                    continue
                digest = [
                    xxhash.xxh3_64_intdigest(data[a : a + n + LENGTH - 1], seed=o)
                    for a, n, o in zip(first.tolist(), count.tolist(), offset.tolist(), strict=True)
                ]
                place = first << 16 | (count - 1) << 8 | offset
                same = [pa.repeat(batch.column(c)[i], len(h)) for c in ("d", "th")]
                cd = np.array(digest, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), pa.array(cd), *same, pa.array(place)],
                    ["h", "cd", "d", "th", "place"],
                )

    def merged(batches):
        held, n = [], 0
        for batch in rows(batches):
            held.append(batch)
            n += batch.num_rows
            if n >= 20_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return texts.mapInArrow(merged, "h long, cd long, d long, th long, place long")


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks of tuples of ranks, from 0, equal ones alike."""
    key = keys[0].astype(np.int64)
    for other in keys[1:]:
        key = key * (int(other.max(initial=0)) + 1) + other
    return np.unique(key, return_inverse=True)[1].astype(np.int64)


def repeated_windows(parts: list[bytes], counts: list[int], offsets: list[int]) -> list[np.ndarray]:
    """For each piece, which of its windows occur in another piece (or elsewhere in it)."""
    starts, end = [], 0
    for part, offset in zip(parts, offsets, strict=True):
        start = end + (-(end + offset)) % PERIOD
        starts.append(start)
        end = start + len(part)
    text = np.zeros(end + LENGTH + 64, np.uint8)
    for start, part in zip(starts, parts, strict=True):
        text[start : start + len(part)] = np.frombuffer(part, np.uint8)
    n = end + LENGTH
    by8 = np.unique(_words(text, big=True), return_inverse=True)[1].astype(np.int64)
    by8 = np.concatenate([by8, np.zeros(n + 64 - len(by8), np.int64)])
    by16 = _dense(by8[: n + 32], by8[8 : n + 40])
    by32 = _dense(by16[:n], by16[16 : n + 16])
    by32 = np.concatenate([by32, np.zeros(LENGTH + 64, np.int64)])
    suffixes = np.concatenate([s + np.arange(c) for s, c in zip(starts, counts, strict=True)])
    # Ranks of the cover, to the depth at which two windows are equal or not.
    residue = np.arange(end + PERIOD) % PERIOD
    needed = np.zeros(end + 2 * PERIOD, np.int8)
    np.add.at(needed, np.array(starts), 1)
    np.add.at(needed, np.array(starts) + np.array(counts) + PERIOD, -1)
    cover = np.flatnonzero(np.isin(residue, COVER) & (np.cumsum(needed)[: len(residue)] > 0))
    rank = by32[cover]
    for step in range(32, LENGTH + PERIOD, 32):
        rank = _dense(rank, by32[np.minimum(cover + step, len(by32) - 1)])
    on_cover = np.full(len(residue), -1, np.int64)
    on_cover[cover] = rank
    to_cover = np.array([min((c - r) % PERIOD for c in COVER) for r in range(PERIOD)])
    first = by32[suffixes]
    tie = on_cover[suffixes + to_cover[suffixes % PERIOD]]
    order = np.lexsort((tie, first))
    order = _settled(order, first, suffixes, on_cover)
    here, following = suffixes[order[:-1]], suffixes[order[1:]]
    same = np.ones(len(here), bool)
    for step in [*range(0, LENGTH - 32, 32), LENGTH - 32]:
        same &= by32[here + step] == by32[following + step]
    found = np.zeros(len(suffixes), bool)
    found[order[:-1][same]] = True
    found[order[1:][same]] = True
    return np.split(found, np.cumsum(counts)[:-1])


def _settled(order, first, suffixes, on_cover) -> np.ndarray:
    """Put right the runs of equal first bytes whose suffixes stand on several residues."""
    run = np.flatnonzero(np.r_[True, first[order[1:]] != first[order[:-1]]])
    residues = suffixes[order] % PERIOD
    mixed = np.flatnonzero(np.minimum.reduceat(residues, run) != np.maximum.reduceat(residues, run))
    stops = np.r_[run[1:], len(order)]
    shift = {
        (a, b): next(k for k in range(PERIOD) if (a + k) % PERIOD in COVER and (b + k) % PERIOD in COVER)
        for a in range(PERIOD)
        for b in range(PERIOD)
    } if len(mixed) else {}

    def compare(i, j):
        a, b = int(suffixes[i]), int(suffixes[j])
        k = shift[a % PERIOD, b % PERIOD]
        return int(on_cover[a + k]) - int(on_cover[b + k])

    for m in mixed:
        here = slice(run[m], stops[m])
        order[here] = sorted(order[here].tolist(), key=cmp_to_key(compare))
    return order


RANGES = "d long, th long, first long, windows long"


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.r_[0, mask.astype(np.int8), 0]))
    return list(zip(edges[::2].tolist(), (edges[1::2] - edges[::2]).tolist(), strict=True))


def _sorted_blocks(contexts: DataFrame) -> DataFrame:
    """Repeated ranges of the pieces that occur once, from whole buckets sorted block by block."""

    def ranges(held) -> pa.RecordBatch:
        marks = repeated_windows([r[3] for r in held], [r[4] for r in held], [r[5] for r in held])
        out = [
            (d, th, first + a, n)
            for (d, th, first, _, _, _, once), mask in zip(held, marks, strict=True)
            if once
            for a, n in _runs(mask)
        ]
        columns = list(zip(*out, strict=True)) if out else [(), (), (), ()]
        kinds = (pa.int64(),) * 4
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            ["d", "th", "first", "windows"],
        )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["h"] != last and size >= BLOCK_BYTES:
                    yield ranges(held)
                    held, size = [], 0
                last = r["h"]
                place = r["place"]
                held.append(
                    (r["d"], r["th"], place >> 16, r["bytes"], (place >> 8 & 255) + 1, place & 255, r["once"])
                )
                size += len(r["bytes"]) + PERIOD
        if held:
            yield ranges(held)

    wanted = contexts.select("h", "d", "th", "place", "bytes", "once")
    return wanted.repartition("h").sortWithinPartitions("h").mapInArrow(rows, RANGES)


def _by_windows(contexts: DataFrame) -> DataFrame:
    """The same for buckets of very many pieces, by a 128-bit digest of each window.

    A window's digest is a bucket of equal suffixes; counts combine before the shuffle.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                data, first, count = r["bytes"], r["place"] >> 16, (r["place"] >> 8 & 255) + 1
                both = [xxhash.xxh3_128_intdigest(data[i : i + LENGTH]) for i in range(count)]
                one = np.array([b & (1 << 64) - 1 for b in both], np.uint64).view(np.int64)
                two = np.array([b >> 64 for b in both], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(one),
                        pa.array(two),
                        pa.array([r["d"]] * count, pa.int64()),
                        pa.array([r["th"]] * count, pa.int64()),
                        pa.array(np.arange(first, first + count)),
                        pa.array([r["once"]] * count, pa.bool_()),
                    ],
                    ["w1", "w2", "d", "th", "first", "once"],
                )

    schema = "w1 long, w2 long, d long, th long, first long, once boolean"
    windows = contexts.mapInArrow(rows, schema)
    often = windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    found = windows.where("once").join(often, ["w1", "w2"], "left_semi")
    return found.select("d", "th", "first", F.lit(1).cast("long").alias("windows"))


def _contexts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of the wanted pieces (h, d, th, place, once, hot), cut from their documents."""
    asked = wanted.groupBy("d", "th").agg(
        F.collect_set(F.struct("h", "place", "once", "hot")).alias("asked")
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                data = utf8(batch.column("text")[r].as_py())
                asked = batch.column("asked")[r].as_py()
                cut = [
                    data[x["place"] >> 16 : (x["place"] >> 16) + (x["place"] >> 8 & 255) + LENGTH]
                    for x in asked
                ]
                same = [pa.repeat(batch.column(c)[r], len(cut)) for c in ("d", "th")]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x["h"] for x in asked], pa.int64()),
                        *same,
                        pa.array([x["place"] for x in asked], pa.int64()),
                        pa.array(cut, pa.binary()),
                        pa.array([x["once"] for x in asked], pa.bool_()),
                        pa.array([x["hot"] for x in asked], pa.bool_()),
                    ],
                    ["h", "d", "th", "place", "bytes", "once", "hot"],
                )

    schema = "h long, d long, th long, place long, bytes binary, once boolean, hot boolean"
    return texts.join(asked, ["d", "th"]).mapInArrow(rows, schema)


def repeated_ranges(texts: DataFrame, many: int = MANY) -> DataFrame:
    """Ranges of windows of ``texts`` (d, th, text) that start anywhere else too."""
    all_pieces = _all_pieces(texts)
    buckets = all_pieces.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # A bucket of one piece is left behind here, and with it most of the text.
    shared = written(all_pieces.join(buckets.select("h"), "h", "left_semi"), "pieces")
    own = F.xxhash64("d", "th", "place")
    kinds = shared.groupBy("h", "cd").agg(F.count(F.lit(1)).alias("n"), F.min(own).alias("first_of"))
    different = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("m"))
    kinds = written(kinds.join(different, "h"), "kinds")
    told = shared.join(kinds, ["h", "cd"])
    first, count = F.shiftright("place", 16), F.shiftright("place", 8).bitwiseAND(F.lit(255)) + 1
    whole = told.where("n > 1").select("d", "th", first.alias("first"), count.alias("windows"))
    wanted = told.where((F.col("m") > 1) & (own == F.col("first_of"))).select(
        "h", "d", "th", "place", (F.col("n") == 1).alias("once"), (F.col("m") > many).alias("hot")
    )
    # Where every kind of a bucket repeats, no piece is in question.
    open_ = wanted.where("once").select("h").distinct()
    cut = written(_contexts(texts, wanted.join(open_, "h", "left_semi")), "contexts")
    found = _sorted_blocks(cut.where("not hot")).union(_by_windows(cut.where("hot")))
    return whole.select("d", "th", "first", "windows").union(found)


def _merged(ranges: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal byte runs covered by ranges of windows."""
    out: list[tuple[int, int]] = []
    for r in sorted(ranges or (), key=lambda r: r["first"]):
        a, b = r["first"], r["first"] + r["windows"] - 1 + LENGTH
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def removed_spans(docs: DataFrame, name: str, many: int = MANY) -> DataFrame:
    """``docs`` with a column ``name``: the repeated windows of its text, null if none."""
    text = docs["text"].cast("string")
    doc_id = docs["doc_id"]
    d, th = unused(docs, "d"), unused(docs, "th")
    key = _key(docs, text, doc_id)
    texts = docs.select(*key, text.alias("text"))
    ranges = repeated_ranges(texts, many)
    spans = ranges.groupBy("d", "th").agg(
        F.collect_set(F.struct("first", "windows")).alias(name)
    )
    spans = spans.select(F.col("d").alias(d), F.col("th").alias(th), name)
    own = docs.select("*", key[0].alias(d), key[1].alias(th))
    return own.join(spans, [d, th], "left").drop(d, th)


SPANS = "array<struct<first:bigint,windows:bigint>>"


def repeated_bytes(docs: DataFrame, many: int = MANY) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Every row gives one row and is one more occurrence of its text, repeated ids
    included. Null and empty texts have no bytes; texts of under LENGTH bytes lose
    none. Matches never cross documents. An empty table gives an empty result.
    """
    texts = only(docs, doc_id="long", text="string")
    spanned = removed_spans(texts, "spans", many)
    kind = "struct<n_bytes:long,n_removed:long,n_spans:long,kept_sha256:string>"
    arrow = pa.struct(
        [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    )

    def digest(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, spans in pairs:
            out = []
            for text, of in zip(texts, spans, strict=True):
                data, runs = utf8(text.as_py()), _merged(of.as_py())
                kept, last = hashlib.sha256(), 0
                for a, b in runs:
                    kept.update(data[last:a])
                    last = b
                kept.update(data[last:])
                removed = sum(b - a for a, b in runs)
                out.append(dict(zip(arrow.names, (len(data), removed, len(runs), kept.hexdigest()), strict=True)))
            yield pa.array(out, arrow)

    digest.__annotations__ = _kept.__annotations__
    found = F.arrow_udf(digest, kind)(F.col("text"), F.col("spans"))
    return spanned.select("doc_id", found.alias("found")).select("doc_id", "found.*")


def _kept(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, spans in pairs:
        out = []
        for text, of in zip(texts, spans, strict=True):
            runs = _merged(of.as_py())
            if not runs:
                out.append(text.as_py())
                continue
            data, last, kept = utf8(text.as_py()), 0, []
            for a, b in runs:
                kept.append(data[last:a])
                last = b
            out.append(b"".join([*kept, data[last:]]).decode("utf-8", "ignore"))
        yield pa.array(out, pa.string())


_kept.__annotations__ = {
    "pairs": Iterator[tuple[pa.Array, pa.Array]],
    "return": Iterator[pa.Array],
}


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: ``docs`` with repeated strings cut out of ``text``; ``n_chars`` follows.

    Bytes of a character that a cut splits go with it. A text without repeats is unchanged.
    """
    name = unused(docs, "spans")
    spanned = removed_spans(docs, name)
    kept = F.arrow_udf(_kept, "string")(F.col("text").cast("string"), F.col(name))
    spanned = spanned.withColumn("text", kept)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = F.when(F.col(name).isNotNull(), F.length("text")).otherwise(F.col("n_chars"))
        spanned = spanned.withColumn("n_chars", changed.cast(kind))
    return spanned.select(*docs.columns)
