"""URL filters as Bloom filter cascades: exact over a known universe of keys, without joins.

Level 0 encodes the listed keys. Level 1 encodes the keys of the universe that
level 0 takes in falsely, level 2 the listed keys that level 1 takes in, and so
on until a level takes in nothing falsely. A key is listed if the first level
that rejects it is an odd one. The answer is exact for every key of the universe.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litlake.llm.common import only, written

BITS_PER_KEY = 10
HASHES = 5
#: Bits that one level may have; more listed keys than this allows are an error, not a silent cut.
MAX_BITS = 1 << 28
MAX_LEVELS = 64


@dataclass(frozen=True)
class Level:
    bits: int
    words: np.ndarray


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def holds(self, key: str) -> bool:
        data = key.encode("utf-8", "surrogatepass")
        for n, level in enumerate(self.levels):
            at = _positions(data, n, level.bits)
            if not all(level.words[p >> 6] >> np.uint64(p & 63) & np.uint64(1) for p in at):
                return n % 2 == 1
        return len(self.levels) % 2 == 1


def _positions(data: bytes, level: int, bits: int) -> list[int]:
    both = xxhash.xxh3_128_intdigest(data, seed=level)
    one, two = both & 0xFFFFFFFFFFFFFFFF, both >> 64 | 1
    return [(one + i * two) % bits for i in range(HASHES)]


def _level(keys: DataFrame, n: int, count: int) -> Level:
    """The filter of level ``n`` over ``keys``: bits set per task, united by word."""
    bits = max(64, 64 * math.ceil(count * BITS_PER_KEY / 64))
    if bits > MAX_BITS:
        raise ValueError(f"{count} keys exceed {MAX_BITS} bits; split the list by key")

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[int, int] = {}
        for batch in batches:
            for key in batch.column(0).to_pylist():
                for p in _positions(key.encode("utf-8", "surrogatepass"), n, bits):
                    words[p >> 6] = words.get(p >> 6, 0) | 1 << (p & 63)
        values = np.array(list(words.values()), np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(words), pa.int64()), pa.array(values, pa.int64())], ["word", "bits"]
        )

    rows = keys.mapInArrow(set_bits, "word long, bits long").groupBy("word")
    out = np.zeros(bits // 64, np.uint64)
    for row in rows.agg(F.bit_or("bits").alias("bits")).toLocalIterator():
        out[row.word] = np.array([row.bits], np.int64).view(np.uint64)[0]
    return Level(bits, out)


def _passing(keys: DataFrame, level: Level, n: int) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(level)

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bits = shared.value.words, shared.value.bits
        for batch in batches:
            found = [
                all(
                    words[p >> 6] >> np.uint64(p & 63) & np.uint64(1)
                    for p in _positions(k.encode("utf-8", "surrogatepass"), n, bits)
                )
                for k in batch.column(0).to_pylist()
            ]
            yield batch.filter(pa.array(found, pa.bool_()))

    return keys.mapInArrow(passing, "key string")


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """A cascade over ``universe`` (``key``) for the keys of ``listed`` (``key``).

    Null keys are left out, repeated ones count once; an empty list gives a
    cascade that holds nothing. Listed keys outside the universe are held too.
    """
    inside = written(listed.select("key").where("key is not null").distinct(), "listed")
    outside = universe.select("key").where("key is not null").distinct()
    outside = outside.join(inside, "key", "left_anti")
    levels: list[Level] = []
    while (count := inside.count()) and len(levels) < MAX_LEVELS:
        level = _level(inside, len(levels), count)
        taken = written(_passing(outside, level, len(levels)), f"level{len(levels)}")
        levels.append(level)
        inside, outside = taken, inside
    if len(levels) == MAX_LEVELS:
        raise ValueError("the cascade didn't end")
    return Cascade(tuple(levels))


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def key(self) -> str:
        return self.host + self.path


UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://``, lower-cased; path up to ``?`` or ``#``. Empty without ``://``."""
    at = F.instr(url, "://")
    tail = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.coalesce(F.regexp_extract(tail, r"^[^/?#]*", 0), F.lit(""))
    path = F.coalesce(F.regexp_extract(tail, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    path = F.when(path.startswith("/"), path).otherwise(F.lit(""))
    return F.translate(host, UPPER, SMALL), path


def rule_keys(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Every key under which a rule could be listed for a url, longest first.

    Only as many labels and as long paths as some rule has are tried, so the
    number of keys doesn't follow the length of a url.
    """
    labels = sorted({r.host.count(".") + 1 for r in rules}, reverse=True)
    lengths = sorted({len(r.path) for r in rules}, reverse=True)
    keys = []
    for n in labels:
        count = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
        suffix = F.substring_index(host, ".", -n)
        for m in lengths:
            fits = (count >= n) & (F.length(path) >= m)
            keys.append(F.when(fits, F.concat(suffix, F.substring(path, 1, m))))
    return F.reverse(F.sort_array(F.transform(F.array_compact(F.array(*keys)), _sized)))["key"]


def _sized(key: Column) -> Column:
    return F.struct(F.length(key).alias("size"), key.alias("key"))


def host_words(host: Column) -> Column:
    return F.split(host, r"[.\-]")


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule], bad_words: Sequence[str], default: str = "allow"
) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict.

    A rule fits its host, all subdomains, and paths that start with its path; the
    longest rule wins. Other urls are blocked if their host is listed, i.e. one of
    its words is in ``bad_words``, else get ``default``. Rules and hosts are looked
    up in cascades over all keys of ``pages``. A null url has empty host and path.
    """
    spark = pages.sparkSession
    rows = only(pages, page_id="long", url="string")
    host, path = host_and_path(F.col("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("keys", rule_keys(F.col("host"), F.col("path"), rules))
    keys = rows.select(F.explode("keys").alias("key")).distinct()
    hosts = rows.select(F.col("host").alias("key")).distinct()
    listed_hosts = hosts.where(F.arrays_overlap(host_words(F.col("key")), F.array(*map(F.lit, bad_words))))
    cascades = {
        verdict: build_cascade(
            spark.createDataFrame([(r.key,) for r in rules if r.verdict == verdict], "key string"),
            keys,
        )
        for verdict in ("allow", "block")
    }
    shared = spark.sparkContext.broadcast((cascades, build_cascade(listed_hosts, hosts)))

    def judged(batches):
        by_rule, by_host = shared.value
        known: dict[str, str | None] = {}
        for hosts, keys in batches:
            out = []
            for host, tried in zip(hosts.to_pylist(), keys.to_pylist(), strict=True):
                rule = verdict = None
                for key in tried:
                    if key not in known:
                        known[key] = next((v for v, c in by_rule.items() if c.holds(key)), None)
                    if known[key]:
                        rule, verdict = key, known[key]
                        break
                if len(known) > 100_000:
                    known.clear()
                if rule is None:
                    verdict = "block" if by_host.holds(host) else default
                out.append({"rule": rule, "verdict": verdict})
            yield pa.array(out, pa.struct([("rule", pa.string()), ("verdict", pa.string())]))

    pair = tuple[pa.Array, pa.Array]
    judged.__annotations__ = {"batches": Iterator[pair], "return": Iterator[pa.Array]}
    verdict = F.arrow_udf(judged, "struct<rule:string,verdict:string>")(F.col("host"), F.col("keys"))
    rows = rows.withColumn("judged", verdict)
    return rows.select("page_id", "host", "path", "judged.rule", "judged.verdict")
