"""Benchmark decontamination: test n-grams in a broadcast hash set, verified where they hit.

The set holds every window of benchmark words. It is broadcast only up to
``INDEX_BYTES`` of benchmark text; a larger benchmark is dealt into parts of at
most that size, each part scans the documents once, and the hits are united.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litlake.llm.common import LOWER, only, table, unused, utf8, written

WINDOW = 13
INDEX_BYTES = 16_000_000
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Multiplier of the rolling window hash; hits are verified word by word.
BASE = np.uint64(0x9E3779B97F4A7C15)

HITS = "struct<n_words:long,starts:array<int>,ends:array<int>,items:array<string>>"
HITS_ARROW = pa.struct(
    [
        ("n_words", pa.int64()),
        ("starts", pa.list_(pa.int32())),
        ("ends", pa.list_(pa.int32())),
        ("items", pa.list_(pa.string())),
    ]
)


def words(text: str | None) -> list[bytes]:
    return WORD.findall(utf8(text).translate(LOWER))


class WindowIndex:
    """The windows of benchmark items: hash set by window length, and the windows themselves."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        self.items: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in items:
            codes = [self.ids.setdefault(w, len(self.ids) + 1) for w in words(text)]
            size = min(window, len(codes))
            for i in range(len(codes) - size + 1 if size else 0):
                self.items[tuple(codes[i : i + size])].add(item)
        by_size = defaultdict(list)
        for key in self.items:
            by_size[len(key)].append(key)
        self.hashes = {m: np.unique(_rolled(np.array(k, np.uint64))) for m, k in by_size.items()}

    def find(self, found: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which of the words stand inside an occurrence of a window, and the items they hit."""
        get = self.ids.get
        codes = np.array([get(w, 0) for w in found], np.uint64)
        hit = np.zeros(len(codes) + 1, np.int64)
        items: set[str] = set()
        known = np.concatenate([[0], np.cumsum(codes > 0)])
        for size, hashes in self.hashes.items():
            if size > len(codes):
                continue
            at = np.flatnonzero(known[size:] - known[:-size] == size)
            if not len(at):
                continue
            rolled = _rolled(codes[at[:, None] + np.arange(size)])
            spot = np.minimum(np.searchsorted(hashes, rolled), len(hashes) - 1)
            for i in at[hashes[spot] == rolled]:
                of = self.items.get(tuple(codes[i : i + size].tolist()))
                if of:
                    items |= of
                    hit[i] += 1
                    hit[i + size] -= 1
        return np.cumsum(hit)[:-1] > 0, items


def _rolled(rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1]):
        out = out * BASE + rows[:, k]
    return out


def _spans(mask: np.ndarray) -> tuple[list[int], list[int]]:
    edges = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()


def hits_column(spark: SparkSession, items: list[tuple[str, str | None]], text: Column) -> Column:
    """Words, hit spans (in words) and hit items of a text column, against these items."""
    shared = spark.sparkContext.broadcast(items)

    def find(batches):
        index = WindowIndex(shared.value)
        for texts in batches:
            out = []
            for t in texts:
                found = words(t.as_py())
                mask, of = index.find(found)
                starts, ends = _spans(mask)
                out.append((len(found), starts, ends, sorted(of)))
            rows = [dict(zip(("n_words", "starts", "ends", "items"), r, strict=True)) for r in out]
            yield pa.array(rows, HITS_ARROW)

    find.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(find, HITS)(text)


def _parts(benchmark: DataFrame, most: int) -> tuple[int, Iterator[list[tuple[str, str | None]]]]:
    """Number of parts of about ``most`` bytes at most, and the parts, fetched one at a time.

    Repeated rows count once; a small benchmark is one part.
    """
    rows = only(benchmark, item_id="string", text="string").where(F.length("text") > 0)
    rows = rows.select(F.coalesce("item_id", F.lit("")).alias("item_id"), "text").distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(2 * total / most)) if total > most else 1

    def fetched() -> Iterator[list[tuple[str, str | None]]]:
        for part in range(parts):
            own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
            yield [(r.item_id, r.text) for r in own.collect()]

    return parts, fetched()


def _merged(results: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Unite spans and items that several parts found in one document."""
    for rows in results:
        out = []
        for found in rows.to_pylist():
            mask = np.zeros(max((h["n_words"] for h in found), default=0), bool)
            for h in found:
                for a, b in zip(h["starts"], h["ends"], strict=True):
                    mask[a:b] = True
            starts, ends = _spans(mask)
            items = sorted({i for h in found for i in h["items"]})
            out.append({"n_words": len(mask), "starts": starts, "ends": ends, "items": items})
        yield pa.array(out, HITS_ARROW)


_merged.__annotations__ = {"results": Iterator[pa.Array], "return": Iterator[pa.Array]}


def with_hits(
    docs: DataFrame, benchmark: DataFrame, name: str, index_bytes: int = INDEX_BYTES
) -> DataFrame:
    """``docs`` with a column ``name`` of type HITS.

    A benchmark over the bound is scanned part by part: a part's hits are written before
    the next part is fetched, so the driver holds one part. Hits of a document are united by
    the text's two hashes and joined to the documents.
    """
    spark = docs.sparkSession
    n_parts, parts = _parts(benchmark, index_bytes)
    text = docs["text"].cast("string")
    if n_parts == 1:
        return docs.withColumn(name, hits_column(spark, next(parts), text))
    key = [F.xxhash64(text), F.crc32(text.cast("binary"))]
    found = None
    for items in parts:
        part = docs.select(
            key[0].alias("_k1"), key[1].alias("_k2"), hits_column(spark, items, text).alias("_h")
        )
        part = written(part, "hits")
        found = part if found is None else found.unionByName(part)
    united = (
        found.dropDuplicates()
        .groupBy("_k1", "_k2")
        .agg(F.arrow_udf(_merged, HITS)(F.collect_list("_h")).alias(name))
    )
    joined = docs.join(united, (key[0].eqNullSafe(united._k1)) & key[1].eqNullSafe(united._k2))
    return joined.select(*(docs[c] for c in docs.columns), united[name])


def _contaminated(hits: Column) -> Column:
    n_hit = _n_hit(hits)
    return (n_hit > 0) & (20 * n_hit >= hits["n_words"])


def _n_hit(hits: Column) -> Column:
    lengths = F.zip_with(hits["ends"], hits["starts"], lambda b, a: (b - a).cast("long"))
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda s, x: s + x)


def contamination(
    docs: DataFrame, benchmark: DataFrame, index_bytes: int = INDEX_BYTES
) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Every row gives one row, repeated ids included. Null and empty texts have no
    words and no hits. Benchmark rows without words have no window; repeated item
    ids are one item; a null item id is the empty string. Without benchmark rows
    nothing is hit.
    """
    texts = only(docs, doc_id="long", text="string")
    found = with_hits(texts, benchmark, "hits", index_bytes)
    hits = F.col("hits")
    return found.select(
        "doc_id",
        hits["n_words"].alias("n_words"),
        _n_hit(hits).alias("n_hit"),
        F.size(hits["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(hits["items"]), ","), 256).alias("items_sha256"),
        _contaminated(hits).alias("contaminated"),
    )


def _cut(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, hits in pairs:
        out = []
        for text, found in zip(texts.to_pylist(), hits.to_pylist(), strict=True):
            if text is None or not found["starts"]:
                out.append(text)
                continue
            data = utf8(text)
            places = [m.span() for m in WORD.finditer(data.translate(LOWER))]
            kept, last = [], 0
            for a, b in zip(found["starts"], found["ends"], strict=True):
                kept.append(data[last : places[a][0]])
                last = places[b - 1][1]
            out.append(b"".join([*kept, data[last:]]).decode("utf-8", "replace"))
        yield pa.array(out, pa.string())


_cut.__annotations__ = {
    "pairs": Iterator[tuple[pa.Array, pa.Array]],
    "return": Iterator[pa.Array],
}


def remove_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with the words that benchmark windows hit cut out of their texts."""
    hits = unused(docs, "hits")
    found = with_hits(docs, benchmark, hits)
    cut = F.arrow_udf(_cut, "string")(F.col("text").cast("string"), F.col(hits))
    return found.withColumn("text", cut).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: ``docs`` without contaminated documents; all others stay as they are."""
    hits = unused(docs, "hits")
    found = with_hits(docs, table(spark, sf_dir, "benchmark"), hits)
    return found.where(~_contaminated(F.col(hits))).select(*docs.columns)
