"""Stored search index: immutable segments under versions that are switched in one step.

A segment holds the documents of one ``add_documents`` call: their texts and term lists
sorted by name, and postings in blocks of up to RANGE neighbouring documents, bucketed by
block, so that scoring a block needs no shuffle. Beside them lie document frequencies and sizes
per namespace; removals add the same statistics with a minus sign. A version is one
small file that lists segments and removals. Readers keep the version they opened.

A block carries the largest count and the shortest document of its postings. Both
bound what its documents can score, whatever the statistics of the version, and
blocks below the k-th best score of a query aren't opened.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litlake.functions import text as tx
from litlake.functions.identifiers import stem
from litlake.operators.search import describe_texts, idf, query_terms, term_score
from litlake.operators.sections import DOC
from litlake.operators.spread import at_least_one, first_n_per_key
from litlake.session import pin
from litlake.sources.buckets import read_bucketed, write_bucketed

#: Neighbouring documents of one block.
RANGE = 256
#: Blocks per query that are scored first, for a k-th score to prune the others by.
SEEDS = 4
#: Rows of (query, term) that may be broadcast; more of them join by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Scores add up as whole trillionths, so that the order of adding never matters.
UNIT = 1e12

_TERMS = "namespace string, term string, df long"
_SIZES = "namespace string, n_docs long, sum_len long"
_REMOVED = "segment string, doc long"


@dataclass(frozen=True)
class Segment:
    name: str
    buckets: int


@dataclass(frozen=True)
class Index:
    """One version of the index at ``path``; ``sizes`` is (n_docs, summed length) by namespace."""

    spark: SparkSession
    path: str
    version: int
    segments: tuple[Segment, ...]
    removals: tuple[str, ...]
    sizes: dict[str, tuple[int, int]]

    def docs(self, segment: Segment) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/segments/{segment.name}/docs")

    def blocks(self, segment: Segment) -> DataFrame:
        path = f"{self.path}/segments/{segment.name}/postings"
        return read_bucketed(self.spark, path, "block", segment.buckets)

    def _parts(self, table: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/segments/{s.name}/{table}" for s in self.segments]
        paths += [f"{self.path}/removals/{r}/{table}" for r in self.removals]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def frequencies(self, namespace: str | None = None) -> DataFrame:
        """``term, df`` over all segments less what was removed."""
        found = self._parts("terms", _TERMS)
        if namespace:
            found = found.where(F.col("namespace") == namespace)
        return found.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def removed(self, segment: Segment) -> DataFrame | None:
        """``doc`` of the segment's removed documents; None where nothing was ever removed."""
        if not self.removals:
            return None
        paths = [f"{self.path}/removals/{r}/docs" for r in self.removals]
        found = self.spark.read.schema(_REMOVED).parquet(*paths)
        return found.where(F.col("segment") == segment.name).select("doc")

    def size(self, namespace: str | None = None) -> tuple[int, float]:
        """``n_docs`` and ``avgdl`` of a namespace or of all."""
        kept = [v for k, v in self.sizes.items() if namespace in (None, "", k)]
        n, total = sum(v[0] for v in kept), sum(v[1] for v in kept)
        return n, total / n if n else 0.0


def files_at(spark: SparkSession, path: str):
    """The JVM, ``path`` and its file system."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, path: str) -> list[int]:
    _, place, files = files_at(spark, f"{path}/versions")
    if not files.exists(place):
        return []
    names = [s.getPath().getName() for s in files.listStatus(place)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def _publish(spark: SparkSession, path: str, version: int, segments, removals, sizes) -> Index:
    """Write the file of ``version``; a version that another writer took is an error."""
    listed = {
        "segments": [[s.name, s.buckets] for s in segments],
        "removals": list(removals),
        "sizes": sizes,
    }
    jvm, target, files = files_at(spark, f"{path}/versions/{version:09d}.json")
    draft = jvm.org.apache.hadoop.fs.Path(f"{path}/versions/_{uuid.uuid4().hex}")
    out = files.create(draft, False)
    out.write(bytearray(json.dumps(listed).encode()))
    out.close()
    if files.exists(target) or not files.rename(draft, target):
        files.delete(draft, False)
        raise ValueError(f"version {version} of {path} exists: another writer was faster")
    return Index(spark, path, version, tuple(segments), tuple(removals), sizes)


def open_index(spark: SparkSession, path: str, version: int | None = None) -> Index:
    """The newest or a given version; an index without versions is empty."""
    known = _versions(spark, path)
    if version is None and not known:
        return Index(spark, path, 0, (), (), {})
    version = known[-1] if version is None else version
    _, place, files = files_at(spark, f"{path}/versions/{version:09d}.json")
    stream = files.open(place)
    listed = json.loads(bytes(stream.readAllBytes()).decode())
    stream.close()
    segments = tuple(Segment(n, b) for n, b in listed["segments"])
    sizes = {k: tuple(v) for k, v in listed["sizes"].items()}
    return Index(spark, path, version, segments, tuple(listed["removals"]), sizes)


def _summed(index: Index, paths: list[str], keep_old: bool = True) -> dict[str, tuple[int, int]]:
    """Sizes by namespace after adding those stored at ``paths``."""
    rows = index.spark.read.schema(_SIZES).parquet(*paths).collect()
    total = dict(index.sizes) if keep_old else {}
    for r in rows:
        n, length = total.get(r.namespace, (0, 0))
        total[r.namespace] = (n + r.n_docs, length + r.sum_len)
    return total


def _store_segment(
    spark: SparkSession,
    path: str,
    docs: DataFrame,
    buckets: int,
    listed: Callable[[DataFrame], DataFrame] = lambda placed: placed,
) -> Segment:
    """Write a segment of ``docs`` (namespace, canonical_id, markdown, doc_len, terms).

    ``listed`` adds what ``docs`` lacks. It runs on placed rows: finding the ranges reads ``docs`` a first time.
    """
    segment = Segment(uuid.uuid4().hex, buckets)
    root = f"{path}/segments/{segment.name}"
    key = stem(F.col("canonical_id"))
    placed = docs.withColumn("_stem", key).repartitionByRange(buckets, "namespace", "_stem")
    placed = placed.sortWithinPartitions("namespace", "_stem").drop("_stem")
    # Numbers follow the order of names. Small row groups: a search fetches few texts.
    listed(placed).select(F.monotonically_increasing_id().alias("doc"), "*").write.option(
        "parquet.block.size", str(8 << 20)
    ).parquet(f"{root}/docs")
    stored = spark.read.parquet(f"{root}/docs")
    one = stored.select(
        "namespace", "doc", F.expr(f"doc div {RANGE}").alias("block"), "doc_len", F.inline("terms")
    )
    # Dealt by block before grouping: one shuffle serves the groups and the buckets.
    slot = F.struct((F.col("doc") % RANGE).cast("int").alias("slot"), "tf", "doc_len")
    blocks = (
        one.repartition(buckets, "block")
        .groupBy("block", "term", "namespace")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max("tf").alias("max_tf"),
            F.min("doc_len").alias("min_len"),
            F.sort_array(F.collect_list(slot)).alias("postings"),
        )
    )
    written = write_bucketed(blocks, f"{root}/postings", "block", buckets, ["term", "block"])
    frequencies = written.groupBy("namespace", "term").agg(F.sum("n").alias("df"))
    frequencies.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{root}/terms")
    sizes = stored.where("doc_len > 0").groupBy("namespace")
    sizes.agg(F.count(F.lit(1)).alias("n_docs"), F.sum("doc_len").alias("sum_len")).coalesce(
        1
    ).write.parquet(f"{root}/sizes")
    return segment


def _listed(corpus: DataFrame) -> DataFrame:
    """Texts with their length in terms and their counted terms; without terms the list is empty."""
    counted = tx.let(
        tx.tokens(F.coalesce("markdown", F.lit(""))),
        lambda t: F.struct(F.size(t).alias("doc_len"), tx.term_counts(t).alias("terms")),
    )
    return corpus.select(*DOC, "markdown", counted.alias("_c")).select(
        *DOC, "markdown", "_c.doc_len", "_c.terms"
    )


def _buckets(spark: SparkSession, buckets: int | None) -> int:
    return buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))


def add_documents(
    spark: SparkSession, path: str, corpus: DataFrame, buckets: int | None = None
) -> Index:
    """A new version with ``corpus`` (namespace, canonical_id, markdown) as one more segment.

    Nothing stored before is read or rewritten. A document that the index has already
    is replaced: its older copy is removed in the same version.
    """
    index = open_index(spark, path)
    texts = corpus.select(*DOC, "markdown")
    segment = _store_segment(spark, path, texts, _buckets(spark, buckets), _listed)
    removals = list(index.removals)
    paths = [f"{path}/segments/{segment.name}/sizes"]
    if index.segments:  # a removal is looked for only where something is stored
        keys = spark.read.parquet(f"{path}/segments/{segment.name}/docs").select(*DOC).distinct()
        removal = _store_removal(index, keys)
        if removal:
            removals.append(removal)
            paths.append(f"{path}/removals/{removal}/sizes")
    sizes = _summed(index, paths)
    return _publish(spark, path, index.version + 1, [*index.segments, segment], removals, sizes)


def remove_documents(spark: SparkSession, path: str, keys: DataFrame) -> Index:
    """A new version without the documents of ``keys`` (namespace, canonical_id)."""
    index = open_index(spark, path)
    removal = _store_removal(index, keys.select(*DOC).distinct())
    if not removal:
        return index
    sizes = _summed(index, [f"{path}/removals/{removal}/sizes"])
    return _publish(
        spark, path, index.version + 1, index.segments, [*index.removals, removal], sizes
    )


def _live(index: Index, segment: Segment) -> DataFrame:
    docs, removed = index.docs(segment), index.removed(segment)
    return docs if removed is None else docs.join(removed, "doc", "left_anti")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _store_removal(index: Index, keys: DataFrame) -> str | None:
    """Write the documents that ``keys`` names, with their statistics negated; None without any."""
    if not index.segments:
        return None
    name = uuid.uuid4().hex
    root = f"{index.path}/removals/{name}"
    gone = _union(
        [
            _live(index, s)
            .select("doc", *DOC, "doc_len", "terms")
            .join(keys, DOC, "left_semi")
            .select(F.lit(s.name).alias("segment"), "doc", "namespace", "doc_len", "terms")
            for s in index.segments
        ]
    )
    gone = pin(gone, "removed")
    if gone.isEmpty():
        return None
    gone.select("segment", "doc").write.parquet(f"{root}/docs")
    terms = gone.select("namespace", F.inline("terms")).groupBy("namespace", "term")
    terms.agg((-F.count(F.lit(1))).alias("df")).write.parquet(f"{root}/terms")
    sizes = gone.where("doc_len > 0").groupBy("namespace")
    sizes.agg((-F.count(F.lit(1))).alias("n_docs"), (-F.sum("doc_len")).alias("sum_len")).coalesce(
        1
    ).write.parquet(f"{root}/sizes")
    return name


def merge_segments(spark: SparkSession, path: str, buckets: int | None = None) -> Index:
    """A new version with one segment of all live documents; texts aren't tokenised again.

    Older versions stay readable: their segments aren't touched.
    """
    index = open_index(spark, path)
    if len(index.segments) < 2 and not index.removals:
        return index
    live = _union([_live(index, s).drop("doc") for s in index.segments])
    segment = _store_segment(spark, path, live, _buckets(spark, buckets))
    sizes = _summed(index, [f"{path}/segments/{segment.name}/sizes"], keep_old=False)
    return _publish(spark, path, index.version + 1, [segment], [], sizes)


def _trillionths(score: Column) -> Column:
    return F.round(score * UNIT).cast("long")


def _in_segment(
    index: Index, segment: Segment, asked: Callable[[DataFrame], DataFrame], namespace, avgdl
):
    """Blocks of the asked terms with what they can score at most, and a function that scores some.

    ``asked`` adds ``query_id`` and ``idf`` to blocks by their term.
    """
    blocks = index.blocks(segment)
    if namespace:
        blocks = blocks.where(F.col("namespace") == namespace)
    hit = asked(blocks)
    length = F.lit(avgdl)
    bound = F.ceil(term_score(F.col("idf"), F.col("max_tf"), F.col("min_len"), length) * UNIT) + 1

    def scored(keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
        part = _trillionths(term_score(F.col("idf"), F.col("tf"), F.col("doc_len"), length))
        docs = (
            keep(hit)
            .select("query_id", "block", "idf", F.inline("postings"))
            .groupBy("query_id", "block", "slot")
            .agg(F.sum(part).alias("points"))
            .select("query_id", (F.col("block") * RANGE + F.col("slot")).alias("doc"), "points")
        )
        removed = index.removed(segment)
        return docs if removed is None else docs.join(removed, "doc", "left_anti")

    return hit.groupBy("query_id", "block").agg(F.sum(bound).alias("bound")), scored


def _top_by_number(
    index: Index, asked, top_k: int, namespace: str | None, prune: bool
) -> DataFrame:
    """``query_id, segment, doc, points``: the best documents per query and segment."""
    _, avgdl = index.size(namespace)
    parts = {s: _in_segment(index, s, asked, namespace, avgdl) for s in index.segments}
    order = [F.col("points").desc(), F.col("doc").asc()]

    def best(segment: Segment, found: DataFrame) -> DataFrame:
        top = first_n_per_key(found, ["query_id"], order, top_k, "_rank").drop("_rank")
        return top.withColumn("segment", F.lit(segment.name))

    if not prune:
        return _union([best(s, scored(lambda hit: hit)) for s, (_, scored) in parts.items()])
    # Blocks that may hold the best are scored first; their k-th score rules most others out.
    bounds = {s: pin(bound, "bounds") for s, (bound, _) in parts.items()}
    every = _union([b.withColumn("segment", F.lit(s.name)) for s, b in bounds.items()])
    by_bound = [F.col("bound").desc(), F.col("segment"), F.col("block")]
    seeds = pin(first_n_per_key(every, ["query_id"], by_bound, SEEDS, "_rank"), "seeds")

    def only(rows: DataFrame, segment: Segment) -> DataFrame:
        return rows.where(F.col("segment") == segment.name).select("query_id", "block")

    def within(keys: DataFrame):
        return lambda hit: hit.join(keys, ["query_id", "block"], "left_semi")

    first = _union([best(s, parts[s][1](within(only(seeds, s)))) for s in parts])
    kth = first_n_per_key(first, ["query_id"], order, top_k, "_rank").where(F.col("_rank") == top_k)
    kth = pin(kth.select("query_id", F.col("points").alias("least")), "kth")
    live = every.join(kth, "query_id", "left").where("least is null or bound >= least")
    live = pin(live.select("query_id", "segment", "block"), "live")
    return _union([best(s, parts[s][1](within(only(live, s)))) for s in parts])


def _named(index: Index, top: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of ``top`` (segment, doc, ...) with columns of their documents."""
    return _union(
        [
            index.docs(s)
            .select("doc", *columns)
            .join(top.where(F.col("segment") == s.name).drop("segment"), "doc")
            for s in index.segments
        ]
    )


def search_batch(
    index: Index,
    queries: DataFrame,
    top_k: int = 10,
    namespace: str | None = None,
    prune: bool = True,
) -> DataFrame:
    """Many queries (query_id, query) at once: ``query_id, rank, namespace, canonical_id, score``.

    Blocks are scored where they lie; per query and task at most ``top_k`` documents move.
    """
    at_least_one("top_k", top_k)
    spark = index.spark
    asked = queries.select(
        "query_id", F.explode(F.array_distinct(tx.tokens(F.col("query")))).alias("term")
    ).distinct()
    n_docs, _ = index.size(namespace)
    weights = index.frequencies(namespace).select(
        "term", idf(F.lit(n_docs), F.col("df")).alias("idf")
    )
    asked = pin(asked.join(weights, "term"), "asked")
    if not index.segments:
        schema = f"{queries.select('query_id').schema.simpleString()[7:-1].replace(':', ' ')}"
        return spark.createDataFrame(
            [], f"{schema}, rank int, namespace string, canonical_id string, score double"
        )
    small = asked.count() <= BROADCAST_ROWS
    terms = F.broadcast(asked) if small else asked
    top = _top_by_number(index, lambda blocks: blocks.join(terms, "term"), top_k, namespace, prune)
    named = _named(index, pin(top, "top"), DOC)
    order = [F.col("points").desc(), F.col("namespace"), stem(F.col("canonical_id"))]
    ranked = first_n_per_key(named, ["query_id"], order, top_k, "rank")
    return ranked.select("query_id", "rank", *DOC, (F.col("points") / UNIT).alias("score"))


def search_hits(
    index: Index, query: str, top_k: int = 10, namespace: str | None = None, prune: bool = False
) -> list[tuple[str, int, int]]:
    """(segment, doc, trillionths) of the best documents of one query, at most ``top_k`` per segment."""
    at_least_one("top_k", top_k)
    terms = query_terms(query)
    if not terms or not index.segments:
        return []
    n_docs, _ = index.size(namespace)
    found = index.frequencies(namespace).where(F.col("term").isin(*terms))
    weights = found.select("term", idf(F.lit(n_docs), F.col("df")).alias("idf")).collect()
    if not weights:
        return []
    known = F.create_map(*(F.lit(x) for w in weights for x in (w.term, w.idf)))

    def asked(blocks: DataFrame) -> DataFrame:
        mine = blocks.where(F.col("term").isin(*(w.term for w in weights)))
        return mine.withColumns({"query_id": F.lit(0), "idf": known[F.col("term")]})

    top = _top_by_number(index, asked, top_k, namespace, prune)
    return [(r.segment, r.doc, r.points) for r in top.where("points > 0").collect()]


def _fetched(index: Index, hits: list[tuple[str, int, int]], columns: list[str]) -> DataFrame | None:
    """Documents of the hits: their numbers go to the scan, which skips all other row groups."""
    parts = []
    for s in index.segments:
        points = {doc: p for name, doc, p in hits if name == s.name}
        if points:
            score = F.create_map(*(F.lit(x) for kv in points.items() for x in kv))
            rows = index.docs(s).where(F.col("doc").isin(*points)).select("doc", *columns)
            parts.append(rows.withColumn("score", score[F.col("doc")] / UNIT))
    return _union(parts) if parts else None


def search_index(
    index: Index, query: str, top_k: int = 10, namespace: str | None = None, prune: bool = False
) -> DataFrame:
    """Top documents of one query: ``namespace, canonical_id, score``."""
    found = _fetched(index, search_hits(index, query, top_k, namespace, prune), DOC)
    if found is None:
        return index.spark.createDataFrame([], "namespace string, canonical_id string, score double")
    order = [F.col("score").desc(), F.col("namespace"), stem(F.col("canonical_id"))]
    return found.select(*DOC, "score").orderBy(*order).limit(top_k)


def search_described(
    index: Index, query: str, top_k: int = 10, namespace: str | None = None, prune: bool = False
) -> DataFrame:
    """Hits with score, title, snippet, section and size, from the texts in the index."""
    found = _fetched(index, search_hits(index, query, top_k, namespace, prune), [*DOC, "markdown"])
    if found is None:
        empty = "namespace string, canonical_id string, score double, markdown string"
        found = index.spark.createDataFrame([], empty)
    order = [F.col("score").desc(), F.col("namespace"), stem(F.col("canonical_id"))]
    best = found.select(*DOC, "score", "markdown").orderBy(*order).limit(top_k)
    return describe_texts(pin(best, "hits"), query)
