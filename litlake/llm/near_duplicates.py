"""N-gram Jaccard join by parity sketches.

A document is the set of its word shingles, one 64-bit hash each. Two sets with
similarity t or more differ in at most d = (1 - t) / (1 + t) of their summed sizes.
Per size band, a sketch has more than d parts; a shingle flips one bit of one part, so a
shingle in which two sets differ changes one part, and similar sets agree in
all bits of at least parts - d parts. Parts are the join keys.

Parts that no shingle flipped are alike in all sets, so they are no keys: a set with
fewer of them than parts - d agrees with each similar set in another part as well. A set with more
deals its shingles anew, with another hash, and so does any set that it agrees with
in such parts only; few sets do so twice.

Pairs that meet are tested by their sizes and by the Hamming distance of two short sketches, which
is at most the number of shingles in which the sets differ, before any text moves. Equal sets
are one node from the start. Shared parts with few nodes give pairs to test; the nodes of one with
many are tested in blocks, and only as many pairs as join them come out. What is joined is a cluster, dealt in blocks of nodes to tasks that
compare sketches, then the sets themselves, and return a spanning forest of the links, never
all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litlake.llm.common import LOWER, if_small, only, unused, utf8, written
from litlake.llm.components import components

SHINGLE = 5
SIMILARITY = Fraction(8, 10)
#: Ratio of the largest to the smallest set size of a band.
BAND = 1.5
#: Bits of one part of a sketch; a part is kept as a hash of the bits that are set.
PART_BITS = 1 << 20
#: Times that a set is dealt anew before empty parts are keys after all.
DEALS = 8
#: Least bits of the sketch that two sets are compared by; larger sets have more.
SKETCH_BITS = 1024
#: Nodes that may share a part and still be listed as pairs.
FEW = 16
#: Shingles that one block of nodes may hold, two blocks being one task's work.
BLOCK_SHINGLES = 500_000
#: Nodes of a block where sketches alone are compared.
BLOCK_NODES = 4096
#: One document in so many is looked at to find hot parts; they are only dealt differently.
SAMPLE, HOT_SHARE = 64, 0.002
#: Entries of a per-task memory of what was seen; it only saves repeated rows.
REMEMBER = 200_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int, cache: _WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; shorter texts are one shingle."""
    words = utf8(text).translate(LOWER).split()  # at 0x20 and 0x09 to 0x0D, as bytes do
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        whole = xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))
        return np.array([whole], np.uint64)
    if len(cache) > REMEMBER:
        cache.clear()
    codes = np.array(list(map(cache.__getitem__, words)), np.uint64)
    n = len(words) - size + 1
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
    out = np.sort(_mixed(out))
    return out[np.r_[True, out[1:] != out[:-1]]]


def node_of(tokens: np.ndarray) -> int:
    """A 64-bit name of the set; equal sets have equal names."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).astype(np.int64))


class Bands:
    """Size bands, and how many parts the sketches of a band have."""

    def __init__(self, similarity: Fraction = SIMILARITY):
        self.t = similarity
        self.edges = [1]
        while self.edges[-1] < 1 << 40:
            self.edges.append(max(self.edges[-1] + 1, int(self.edges[-1] * BAND)))
        self._parts: dict[int, int] = {}

    def of(self, n: int) -> range:
        """The band of a set of ``n``, and all in which a larger partner may stand."""
        own, last = np.searchsorted(self.edges, [n, n * self.t.denominator // self.t.numerator], side="right")
        return range(int(own) - 1, int(last))

    def apart(self, band: int) -> int:
        """How many shingles two similar sets of a band may differ in."""
        return int((1 - self.t) / (1 + self.t) * 2 * (self.edges[band + 1] - 1))

    def parts(self, band: int) -> int:
        """More parts than ``apart``, and so many more that a set seldom has as many empty ones."""
        if band not in self._parts:
            least = self.apart(band) + 1
            smallest = float(self.edges[band] * self.t)
            self._parts[band] = least
            for parts in range(least, 2 * least + 1):
                empty = parts * np.exp(-smallest / parts)
                if empty + 2 * np.sqrt(empty) < parts - least + 1:
                    self._parts[band] = parts
                    break
        return self._parts[band]


def sketch_bits(n: int) -> int:
    """Bits of the sketch of a set of ``n``: a power of two, at least ``n``."""
    return max(SKETCH_BITS, 1 << max(n - 1, 0).bit_length())


def sketch(tokens: np.ndarray, bits: int | None = None) -> np.ndarray:
    """Parity bits of a set, as 64-bit words."""
    bits = bits or sketch_bits(len(tokens))
    odd = np.bincount((tokens % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def folded(words: np.ndarray, width: int) -> np.ndarray:
    """A sketch with fewer bits of the same set: halves laid over one another."""
    while len(words) > width:
        half = len(words) // 2
        words = words[:half] ^ words[half:]
    return words


def most_apart(sizes: np.ndarray | int, t: Fraction) -> np.ndarray:
    """How many shingles two similar sets of these summed sizes may differ in."""
    return sizes * (t.denominator - t.numerator) // (t.denominator + t.numerator)


def _part_values(tokens: np.ndarray, parts: int) -> np.ndarray:
    """Per part a hash of its odd bits, 0 without any; ``tokens`` are sorted, and so are their parts."""
    part = (tokens >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
    bits = _mixed(tokens % np.uint64(PART_BITS) + np.uint64(1))  # a bit hit twice cancels out
    start = np.searchsorted(part, np.arange(parts, dtype=np.uint64))
    values = np.bitwise_xor.reduceat(bits, np.minimum(start, len(bits) - 1))
    values[np.r_[start[1:], len(bits)] == start] = 0
    return values


def part_keys(tokens: np.ndarray, bands: Bands) -> np.ndarray:
    """Join keys of a set: one per part of its sketch that isn't empty, in each of its bands."""
    keys = []
    for band in bands.of(len(tokens)):
        parts = bands.parts(band)
        surely = parts - bands.apart(band)
        place = np.arange(parts, dtype=np.uint64) + np.uint64(band << 40)
        dealt = tokens
        for deal in range(DEALS):
            values = _part_values(dealt, parts)
            some = values != 0
            last = parts - some.sum() < surely
            if not last and deal == DEALS - 1:
                some[:] = True
            keys.append(_mixed(_mixed(values[some]) + place[some] + np.uint64(deal << 56)))
            if last:
                break
            dealt = np.sort(_mixed(tokens + np.uint64(deal + 1)))
    return np.unique(np.concatenate(keys)).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, t: Fraction) -> bool:
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return t.denominator * both >= t.numerator * (len(a) + len(b) - both)


def _nodes(texts: DataFrame, size: int) -> DataFrame:
    """Per row: doc_id, text_hash, n_shingles, node and sketch (null without words)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _WordHashes()
        for batch in batches:
            n, node, bits = [], [], []
            for text in batch.column("text"):
                tokens = shingles(text.as_py(), size, cache)
                n.append(len(tokens))
                node.append(node_of(tokens) if len(tokens) else None)
                bits.append(sketch(tokens).tobytes() if len(tokens) else None)
            columns = [pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), *columns],
                ["doc_id", "text_hash", "n_shingles", "node", "sketch"],
            )

    kinds = "doc_id long, text_hash long, n_shingles long, node long, sketch binary"
    return texts.mapInArrow(rows, kinds)


def _keys(texts: DataFrame, size: int, t: Fraction, hot: frozenset[int], salts: int) -> DataFrame:
    """(key, salt, node, hot) of every set; a set that the task has just seen is left out.

    Hot keys are spread over ``salts`` salts by node, all others have salt 0.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, bands, seen = _WordHashes(), Bands(t), set()
        heavy = np.array(sorted(hot), np.int64)
        for batch in batches:
            keys, nodes = [], []
            for text in batch.column("text"):
                tokens = shingles(text.as_py(), size, cache)
                if not len(tokens) or (node := node_of(tokens)) in seen:
                    continue
                if len(seen) > REMEMBER:
                    seen.clear()
                seen.add(node)
                keys.append(part_keys(tokens, bands))
                nodes.append(np.full(len(keys[-1]), node, np.int64))
            if keys:
                key, node = np.concatenate(keys), np.concatenate(nodes)
                listed = np.isin(key, heavy)
                salt = np.where(listed, node % salts, 0)
                for i in range(0, len(key), 100_000):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x[i : i + 100_000]) for x in (key, salt, node, listed)],
                        ["key", "salt", "node", "hot"],
                    )

    return texts.mapInArrow(rows, "key long, salt long, node long, hot boolean")


def _shared(keys: DataFrame) -> DataFrame:
    """Rows (key, u, v): pairs of a key with few nodes (key null); else its members, v null.

    Rows of a key and salt arrive together and in order. No more than FEW of them are
    held at a time: a longer run goes through row by row.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        held: list[int] = []
        last: tuple[int, int] | None = None
        many = False
        out: list[tuple[int | None, int, int | None]] = []

        def flush(key):
            nonlocal many, held
            if not many and key is not None:
                for i, v in enumerate(held):
                    for u in held[:i]:
                        if (u, v) not in seen:
                            seen.add((u, v))
                            out.append((None, u, v))
                if len(seen) > REMEMBER:
                    seen.clear()
            held, many = [], False

        def emit():
            k, u, v = zip(*out, strict=True)
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in (k, u, v)], ["key", "u", "v"]
            )

        for batch in batches:
            key, salt, node, hot = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (salt[1:] != salt[:-1]) | (node[1:] != node[:-1])
            at = np.flatnonzero(fresh)
            key, salt, node, hot = key[at], salt[at], node[at], hot[at]
            same = np.zeros(len(key), bool)
            same[1:] = (key[1:] == key[:-1]) & (salt[1:] == salt[:-1])
            # Runs of one row inside a batch have no partner; only the first and last may go on.
            alone = ~same & ~np.r_[same[1:], True] & ~hot
            alone[:1] = False
            for i in np.flatnonzero(~alone):
                here = (int(key[i]), int(salt[i]))
                if here != last:
                    flush(last)
                    last, many = here, bool(hot[i])
                v = int(node[i])
                if many:
                    out.append((here[0], v, None))
                elif not held or held[-1] != v:
                    held.append(v)
                    if len(held) > FEW:
                        out.extend((here[0], u, None) for u in held)
                        many, held = True, []
                if len(out) >= 50_000:
                    yield emit()
            if len(alone) and alone[-1]:
                flush(last)
                last = None
        flush(last)
        if out:
            yield emit()

    return keys.mapInArrow(rows, "key long, u long, v long")


def _named_texts(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(node, text) of the named nodes, one row each.

    ``names`` has (doc_id, text_hash, node, copies): a row of the node, and how often
    the table repeats it. Texts travel, not shingles: they are smaller, and compress.
    """
    doc, text_hash = unused(texts, "named_id"), unused(texts, "named_hash")
    names = names.withColumnsRenamed({"doc_id": doc, "text_hash": text_hash})
    same = (F.col("text_hash") == F.col(text_hash)) & F.col("doc_id").eqNullSafe(F.col(doc))
    found = texts.join(names, same).select("node", "text", "copies")
    repeated = found.where("copies > 1").groupBy("node").agg(F.first("text").alias("text"))
    return found.where("copies = 1").select("node", "text").unionByName(repeated)


def _near(pairs: DataFrame, known: DataFrame, t: Fraction) -> DataFrame:
    """The pairs whose sizes and sketches allow the similarity ``t``."""
    sides = [known.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "uv"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nu, nv = (batch.column(c).to_numpy() for c in ("nu", "nv"))
            ok = t.denominator * np.minimum(nu, nv) >= t.numerator * np.maximum(nu, nv)
            most = most_apart(nu + nv, t)
            su, sv = batch.column("su"), batch.column("sv")
            for i in np.flatnonzero(ok):
                a, b = np.frombuffer(su[i].as_buffer(), np.uint64), np.frombuffer(sv[i].as_buffer(), np.uint64)
                width = min(len(a), len(b))
                ok[i] = np.bitwise_count(folded(a, width) ^ folded(b, width)).sum() <= most[i]
            yield batch.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(sides[0], "u").join(sides[1], "v").mapInArrow(rows, "u long, v long")


def forest(nodes: list[int], sets: list[np.ndarray], split: int, t: Fraction) -> list[tuple[int, int]]:
    """Links that join all similar sets, none within a component already joined.

    The first ``split`` sets are one block, the others a second one; with no second
    block all pairs of the first count, else those across. Short sketches bound how far two
    sets differ before the sets are compared.
    """
    component = np.arange(len(sets))
    sizes = np.array([len(s) for s in sets])
    bits = sketch_bits(int(sizes.min()))
    flat = np.array([sketch(s, bits) for s in sets])
    links = []
    across = split < len(sets)
    for i in range(split):
        others = np.arange(split if across else i + 1, len(sets))
        others = others[component[others] != component[i]]
        # Sizes alone rule most pairs out, then the sketches.
        small, large = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
        others = others[t.denominator * small >= t.numerator * large]
        if not len(others):
            continue
        apart = np.bitwise_count(flat[others] ^ flat[i]).sum(1)
        near = apart <= most_apart(sizes[others] + sizes[i], t)
        others, apart = others[near], apart[near]
        for j in others[np.argsort(apart, kind="stable")]:
            if component[j] != component[i] and similar(sets[i], sets[int(j)], t):
                component[component == component[j]] = component[i]
                links.append((nodes[i], nodes[int(j)]))
    return links


def _dealt(members: DataFrame, weight: str, most: int) -> DataFrame:
    """``members`` (key, node, ...) in blocks of about ``most`` weight, one row per pair of blocks.

    The columns one, two and block are added: all pairs of a key meet in some (key, one, two).
    """
    counts = members.groupBy("key").agg(F.ceil(F.sum(weight) / most).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int")
    dealt = members.join(counts, "key").withColumn("block", block)
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = {"one": F.least("block", "with"), "two": F.greatest("block", "with")}
    return dealt.withColumns(pair).drop("with", "blocks")


def near_forest(nodes: np.ndarray, sizes: np.ndarray, bits: np.ndarray, split: int, t: Fraction) -> list[tuple[int, int]]:
    """Pairs that join all nodes whose sizes and sketches allow the similarity ``t``.

    As in ``forest``, the first ``split`` nodes meet the others, or one another if there are none.
    """
    component = np.arange(len(nodes))
    across, found = split < len(nodes), []
    for i in range(split):
        others = np.arange(split if across else i + 1, len(nodes))
        others = others[component[others] != component[i]]
        small, large = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
        others = others[t.denominator * small >= t.numerator * large]
        apart = np.bitwise_count(bits[others] ^ bits[i]).sum(1)
        for j in others[apart <= most_apart(sizes[others] + sizes[i], t)]:
            if component[j] != component[i]:
                component[component == component[j]] = component[i]
                found.append((int(nodes[i]), int(nodes[j])))
    return found


def _near_in_parts(members: DataFrame, known: DataFrame, t: Fraction) -> DataFrame:
    """(u, v) that join the nodes of each shared part that sizes and sketches allow to be similar.

    Many texts may hold a part because they share a passage; sketches tell them apart, so
    that no text moves for it.
    """
    sketched = members.join(known.select("node", "n", "sketch"), "node").withColumn("one_each", F.lit(1))
    dealt = _dealt(sketched, "one_each", BLOCK_NODES).drop("one_each")
    dealt = dealt.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two", "block", "node")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def pairs(run: pa.Table) -> list[tuple[int, int]]:
            block = run.column("block").to_numpy()
            same = run.column("one")[0] == run.column("two")[0]
            split = len(block) if same else int((block == block[0]).sum())
            if not same and split == len(block):
                return []
            found = [np.frombuffer(x, np.uint64) for x in run.column("sketch").to_pylist()]
            width = min(map(len, found))  # nodes of one part are of like sizes
            bits = np.array([folded(x, width) for x in found])
            return near_forest(run.column("node").to_numpy(), run.column("n").to_numpy(), bits, split, t)

        for batch in batches:
            found: list[tuple[int, int]] = []
            place = [batch.column(c).to_numpy() for c in ("key", "one", "two")]
            new = np.any([x[1:] != x[:-1] for x in place], axis=0)
            starts = [0, *(np.flatnonzero(new) + 1).tolist()]
            for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                here = tuple(int(x[a]) for x in place)
                if here != last and held:
                    found += pairs(pa.Table.from_batches(held))
                    held = []
                last = here
                held.append(batch.slice(a, b - a))
            if found:
                u, v = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
        if held and (found := pairs(pa.Table.from_batches(held))):
            u, v = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return dealt.mapInArrow(rows, "u long, v long")


def _cluster_links(edges: DataFrame, known: DataFrame, named: DataFrame, size: int, t: Fraction) -> DataFrame:
    """Links between the nodes that ``edges`` (u, v) join, cluster by cluster and block by block.

    Nodes that are joined directly or through others are one cluster: a text travels once with
    its cluster, not with each of its pairs.
    """
    clusters = components(edges)
    members = clusters.select(F.col("component").alias("key"), F.col("vertex").alias("node"))
    members = written(members.join(known.select("node", "n"), "node"), "clusters")
    dealt = _dealt(members, "n", BLOCK_SHINGLES).drop("n").join(named, "node")

    def links(group: pa.Table) -> pa.Table:
        same = group.column("one")[0].as_py() == group.column("two")[0].as_py()
        rows = group.sort_by([("block", "ascending"), ("node", "ascending")])
        nodes = rows.column("node").to_pylist()
        cache = _WordHashes()
        sets = [shingles(x.as_py(), size, cache) for x in rows.column("text")]
        first = rows.column("block")[0].as_py()
        split = len(nodes) if same else sum(b == first for b in rows.column("block").to_pylist())
        lone = not same and split == len(nodes)
        found = [] if lone else forest(nodes, sets, split, t)
        u, v = zip(*found, strict=True) if found else ((), ())
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return dealt.groupBy("key", "one", "two").applyInArrow(links, "u long, v long")


def _hot_keys(texts: DataFrame, size: int, t: Fraction) -> frozenset[int]:
    """Parts that more than HOT_SHARE of a sample of documents hold; at most parts / share many."""
    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    counts = _keys(sample, size, t, frozenset(), 1).groupBy("key").agg(
        F.count_distinct("node").alias("n")
    )
    total = sample.count()
    found = counts.where(F.col("n") >= max(50, HOT_SHARE * total)).select("key").limit(20_000)
    return frozenset(r.key for r in found.collect())


def duplicate_groups(
    docs: DataFrame, size: int = SHINGLE, similarity: Fraction = SIMILARITY, salts: int = 64
) -> DataFrame:
    """Per document: doc_id, text_hash, n_shingles, node, component, component_id.

    Every row gives one row, repeated ids included. Null and empty texts and texts
    of white space have no shingles and no links: their component is their own id.
    Equal sets link. A null id never names a component; a component of null ids
    alone has null. An empty table gives an empty result.
    """
    texts = only(docs, doc_id="long", text="string").withColumn("text_hash", F.xxhash64("text"))
    rows = written(_nodes(texts, size), "nodes")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "copies")
    known = rows.where("node is not null").groupBy("node", "doc_id", "text_hash").agg(
        F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")
    )
    known = known.groupBy("node").agg(
        F.min(row).alias("row"), F.first("n").alias("n"), F.first("sketch").alias("sketch")
    )
    known = written(known.select("node", "n", "sketch", "row.doc_id", "row.text_hash", "row.copies"), "known")
    hot = _hot_keys(texts, size, similarity)
    keys = _keys(texts, size, similarity, hot, salts)
    dealt = keys.repartition("key", "salt").sortWithinPartitions("key", "salt", "node")
    shared = written(_shared(dealt), "shared")
    pairs = shared.where("key is null").select("u", "v").distinct()
    pairs = written(_near(pairs, known, similarity), "pairs")
    members = shared.where("key is not null").select("key", F.col("u").alias("node")).distinct()
    members = written(members, "members")
    edges = written(pairs.unionByName(_near_in_parts(members, known, similarity)), "candidates")
    wanted = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    names = known.select("doc_id", "text_hash", "node", "copies").join(wanted, "node", "left_semi")
    named = written(_named_texts(texts, if_small(names)), "named")
    links = _cluster_links(edges, known, named, size, similarity)
    labels = components(written(links, "links"))
    groups = known.join(labels, known["node"] == labels["vertex"], "left").select(
        "node", F.col("doc_id").alias("least"), F.coalesce("component", "node").alias("component")
    )
    least = groups.groupBy("component").agg(F.min("least").alias("component_id"))
    by_node = groups.join(least, "component").select("node", "component", "component_id")
    columns = ["doc_id", "text_hash", "n_shingles", "node"]
    lone = rows.where("node is null").select(
        *columns, F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id")
    )
    linked = rows.where("node is not null").join(by_node, "node")
    return lone.unionByName(linked.select(*columns, "component", "component_id"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component one row stays, that with its smallest id.

    Where several texts of a component carry that id, that with the smallest hash stays; of repeated
    rows one stays. Rows without an id stay only where no row of their component has
    one. Documents without words stay.
    """
    groups = written(duplicate_groups(docs), "groups")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    texts = groups.where("component is not null").groupBy("component", "doc_id", "text_hash")
    texts = written(texts.agg(F.count(F.lit(1)).alias("copies")), "texts")
    first = texts.groupBy("component").agg(F.min(row).alias("first"))
    doc, text_hash, own = unused(docs, "dropped_id"), unused(docs, "dropped_hash"), unused(docs, "own_hash")
    dropped = texts.join(first, "component").where(row != F.col("first"))
    dropped = if_small(dropped.select(F.col("doc_id").alias(doc), F.col("text_hash").alias(text_hash)))
    hashed = docs.withColumn(own, F.xxhash64(docs["text"].cast("string")))
    same = (F.col(own) == F.col(text_hash)) & hashed["doc_id"].cast("long").eqNullSafe(F.col(doc))
    left = hashed.join(dropped, same, "left_anti").drop(own)
    repeated = not texts.where("copies > 1").isEmpty()
    return left.dropDuplicates(["doc_id", "text"]) if repeated else left
