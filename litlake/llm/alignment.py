"""Alignment of two tokenizers over a corpus by inverted pair bitmaps.

Tokens of a text by tokenizer A (bytes) and B (pieces) link where their bytes overlap. A task
numbers its documents in blocks. Per pair of ids and block it keeps a compressed bitmap of
the documents that link the pair, and one plane per binary digit of how much more often
than once a document does. Bitmaps of different blocks hold different documents, so the
union over the corpus is all of them, and sums of their bit counts are the numbers of
documents and of links. The bitmaps are postings too: a pair's count goes back along them
to its documents, block by block. What is shuffled is bitmaps, never one row per link.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litlake.llm.common import only, written
from litlake.llm.tokens import Remembered, piece_model, tokenizer

VOCABULARY_A = "byte_bpe_50k.json"
VOCABULARY_B = "piece_bpe_32k.model"
#: Documents of a block, and different (document, pair) entries after which a block ends.
BLOCK_DOCS, BLOCK_ENTRIES = 1 << 16, 1_000_000
#: Documents up to which a bitmap is stored as sorted 16-bit places.
SPARSE = 4096
#: Words that a worker remembers.
REMEMBER = 250_000

_DOC = "block long, place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_BITS = "pair long, plane int, n int, places binary"


@cache
def byte_level() -> dict[str, int]:
    """Byte of every character that byte-level vocabularies are written in.

    Printable characters of Latin-1 stand for themselves, the other bytes for the
    characters from 256 on.
    """
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def bytes_of_a(name: str) -> list[bytes]:
    model, place = tokenizer(name, True), byte_level()
    size = model.get_vocab_size()
    return [bytes(place.get(c, 0x3F) for c in model.id_to_token(i)) for i in range(size)]


@cache
def bytes_of_b(name: str) -> list[bytes]:
    model = piece_model(name)
    return [
        bytes([int(model.id_to_piece(i)[3:-1], 16)])
        if model.is_byte(i)
        else model.id_to_piece(i).replace("▁", " ").encode()
        for i in range(model.get_piece_size())
    ]


#: A word's alignment: tokens of A, of B, groups, the groups as text, one ``a << 16 | b`` per link.
Word = tuple[int, int, int, bytes, bytes]


@cache
def aligner(name_a: str = VOCABULARY_A, name_b: str = VOCABULARY_B) -> Remembered:
    """Alignments of words; False for one that a tokenizer doesn't give back byte by byte.

    Both tokenizers cut at the single spaces between words, so both end tokens there and
    neither groups nor links go across. Words without white space at their ends go through
    the tokenizers many at a time. A worker keeps what it remembers for later tasks.
    """
    model_a, model_b = tokenizer(name_a, True), piece_model(name_b)
    bytes_a, bytes_b = bytes_of_a(name_a), bytes_of_b(name_b)
    sizes = [np.array([len(x) for x in of]) for of in (bytes_a, bytes_b)]

    def together(ws: list[str], a: list[int], b: list[int]) -> list[Word] | None:
        """Words that follow one another with a space before each; None if bytes or ends don't fit."""
        whole = "".join([f" {w}" for w in ws]).encode()
        if b"".join([bytes_a[i] for i in a]) != whole or b"".join([bytes_b[i] for i in b]) != whole:
            return None
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        ends_a, ends_b = np.cumsum(sizes[0][a]), np.cumsum(sizes[1][b])
        last = np.cumsum([len(w.encode()) + 1 for w in ws])
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        stops = [np.searchsorted(e, last) for e in (ends_a, ends_b, common)]
        if (common[stops[2]] != last).any():
            return None
        ends = np.union1d(ends_a, ends_b)
        # Between two neighbouring ends lie one token of A and one of B: a link.
        links = a[np.searchsorted(ends_a, ends)] << 16 | b[np.searchsorted(ends_b, ends)]
        raw = links.astype("<u4").tobytes()
        text_a, text_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        to_a = (np.searchsorted(ends_a, common) + 1).tolist()
        to_b = (np.searchsorted(ends_b, common) + 1).tolist()
        groups, i, j = [], 0, 0
        for p, q in zip(to_a, to_b, strict=True):
            one = p - i == 1 == q - j
            groups.append(
                f"{text_a[i]}|{text_b[j]}" if one else f"{','.join(text_a[i:p])}|{','.join(text_b[j:q])}"
            )
            i, j = p, q
        at = [(s + 1).tolist() for s in (*stops, np.searchsorted(ends, last))]
        out, before = [], (0, 0, 0, 0)
        for to in zip(*at, strict=True):
            n_a, n_b, n_groups = (x - y for x, y in zip(to[:3], before, strict=False))
            own = ";".join(groups[before[2] : to[2]]).encode()
            out.append((n_a, n_b, n_groups, own, raw[4 * before[3] : 4 * to[3]]))
            before = to
        return out

    def encoded(texts: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids of each text with a space before it."""
        of_a = model_a.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)
        yield from zip((e.ids for e in of_a), model_b.encode(texts, num_threads=1), strict=True)

    def align(ws: list[str]) -> list[Word | bool]:
        plain = [w for w in ws if w and not w[0].isspace() and not w[-1].isspace()]
        found: dict[str, Word | bool] = {}
        for i in range(0, len(plain), 2000):
            some = plain[i : i + 2000]
            runs = [some[k : k + 100] for k in range(0, len(some), 100)]
            for run, ids in zip(runs, encoded([" ".join(r) for r in runs]), strict=True):
                found.update(zip(run, together(run, *ids) or (), strict=False))
        rest = [w for w in ws if w not in found]
        for w, ids in zip(rest, encoded(rest), strict=True):
            found[w] = (together([w], *ids) or [False])[0]
        return [found[w] for w in ws]

    return Remembered(align, remember=REMEMBER)


class Block:
    """Documents of one task, gathered until the block is written."""

    def __init__(self, number: int):
        self.number = number
        self.docs: list[tuple] = []
        self.pairs: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.entries = 0

    def add(self, doc_id: int | None, parts: list[Word | bool]) -> None:
        place = len(self.docs)
        n_a = n_b = n_groups = 0
        digest, links = "", b""
        if parts and False not in parts:
            ns_a, ns_b, ns_groups, groups, pairs = zip(*parts, strict=True)
            n_a, n_b, n_groups = sum(ns_a), sum(ns_b), sum(ns_groups)
            digest, links = hashlib.sha256(b";".join(groups)).hexdigest(), b"".join(pairs)
        links = np.frombuffer(links, "<u4")
        self.docs.append((self.number, place, doc_id, n_a, n_b, n_groups, len(links), digest))
        pairs, times = np.unique(links, return_counts=True)
        self.pairs.append(pairs)
        self.times.append(times)
        self.entries += len(pairs)

    def full(self, entries: int) -> bool:
        return len(self.docs) >= BLOCK_DOCS or self.entries >= entries

    def batches(self) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32()] + [pa.int64()] * 5 + [pa.string()]
        bits = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        names = [c.split()[0] for c in f"{_DOC}, {_BITS}".split(", ")]
        docs = [pa.array(c, k) for c, k in zip(zip(*self.docs, strict=True), kinds, strict=True)]
        none = [pa.nulls(len(self.docs), k) for k in bits]
        yield pa.RecordBatch.from_arrays(docs + none, names)
        places = np.repeat(np.arange(len(self.docs), dtype="<u2"), [len(p) for p in self.pairs])
        pairs, more = np.concatenate(self.pairs), np.concatenate(self.times) - 1
        order = np.argsort(pairs, kind="stable")
        pairs, places, more = pairs[order], places[order], more[order]
        for plane in range(1 + int(more.max(initial=0)).bit_length()):
            # Plane 0 is the documents, plane k the digit 2^(k - 1) of the links beyond the first.
            held = more >= 0 if plane == 0 else more >> (plane - 1) & 1 == 1
            for pair, n, bits_of in bitmaps(pairs[held], places[held]):
                block = pa.array(np.full(len(pair), self.number))
                level = pa.array(np.full(len(pair), plane, np.int32))
                empty = [pa.nulls(len(pair), k) for k in kinds[1:]]
                yield pa.RecordBatch.from_arrays([block, *empty, pair, level, n, bits_of], names)


def bitmaps(pairs: np.ndarray, places: np.ndarray) -> Iterator[tuple[pa.Array, pa.Array, pa.Array]]:
    """Per pair the number and the bitmap of its ``places``; both arrays are in order of pair, place.

    A bitmap is the sorted 16-bit places themselves, or 65,536 bits where more than
    SPARSE are set.
    """
    if not len(pairs):
        return
    first = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]])
    counts = np.diff(np.r_[first, len(pairs)])
    few = counts <= SPARSE
    kept = places[np.repeat(few, counts)]
    ends = np.r_[0, np.cumsum(counts[few])]
    names, sizes = pairs[first[few]].astype(np.int64), counts[few].astype(np.int32)
    for i in range(0, len(names), 50_000):
        j = min(i + 50_000, len(names))
        part = kept[ends[i] : ends[j]].tobytes()
        offsets = ((ends[i : j + 1] - ends[i]) * 2).astype(np.int32)
        held = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(offsets), pa.py_buffer(part)])
        yield pa.array(names[i:j]), pa.array(sizes[i:j]), held
    for at in np.flatnonzero(~few):
        bits = np.zeros(BLOCK_DOCS, np.uint8)
        bits[places[first[at] : first[at] + counts[at]]] = 1
        dense = np.packbits(bits, bitorder="little").tobytes()
        yield pa.array([int(pairs[first[at]])]), pa.array([int(counts[at])], pa.int32()), pa.array([dense])


def places_of(n: np.ndarray, held: pa.ChunkedArray) -> np.ndarray:
    """The places of many bitmaps one after another; ``n`` is how many each has."""
    out, run = [], []
    for count, bits in zip(n.tolist(), held, strict=True):
        if count <= SPARSE:
            run.append(bits.as_buffer())
            continue
        out += [np.frombuffer(b"".join(run), "<u2"), _set_bits(bits.as_py())]
        run = []
    return np.concatenate([*out, np.frombuffer(b"".join(run), "<u2")]).astype(np.int64)


def _set_bits(bits: bytes) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little"))


def postings(
    docs: DataFrame,
    name_a: str = VOCABULARY_A,
    name_b: str = VOCABULARY_B,
    entries: int = BLOCK_ENTRIES,
) -> DataFrame:
    """One row per document (pair null), and one per pair, block and plane, written once."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(name_a, name_b)
        number = TaskContext.get().partitionId() << 32
        block = Block(number)
        for batch in batches:
            texts = [t.as_py() for t in batch.column("text")]
            parts = align.texts([t or "" for t in texts])
            for doc_id, text, found in zip(batch.column("doc_id").to_pylist(), texts, parts, strict=True):
                block.add(doc_id, found if text else [])
                if block.full(entries):
                    yield from block.batches()
                    number += 1
                    block = Block(number)
        if block.docs:
            yield from block.batches()

    texts = only(docs, doc_id="long", text="string")
    return written(texts.mapInArrow(rows, f"{_DOC}, {_BITS}"), "postings")


def _weight() -> Column:
    return F.when(F.col("plane") == 0, 1).otherwise(F.expr("shiftleft(1L, plane - 1)"))


def pair_counts(found: DataFrame) -> DataFrame:
    """Per linked pair of ids: pair, a_id, b_id, n_docs, n_links, from the bit counts of its bitmaps."""
    counts = found.where("pair is not null").groupBy("pair").agg(
        F.sum(F.when(F.col("plane") == 0, F.col("n"))).alias("n_docs"),
        F.sum(F.col("n") * _weight()).alias("n_links"),
    )
    return counts.select(
        "pair", F.expr("pair >> 16").alias("a_id"), F.expr("pair & 65535").alias("b_id"), "n_docs", "n_links"
    )


def align(
    docs: DataFrame,
    name_a: str = VOCABULARY_A,
    name_b: str = VOCABULARY_B,
    entries: int = BLOCK_ENTRIES,
) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null and empty texts, and those that a tokenizer doesn't give back byte by byte,
    have zeros and an empty ``groups_sha256``. Every row counts, repeated rows and
    ids and null ids included. An empty table gives an empty result.
    """
    found = postings(docs, name_a, name_b, entries)
    counts = written(pair_counts(found), "pairs")
    # At most one row per id of B.
    best = counts.groupBy("b_id").agg(F.max("n_links").alias("most"))
    scores = counts.join(F.broadcast(best), "b_id").select(
        "pair", "n_links", (F.col("n_links") == F.col("most")).alias("best")
    )
    bits = found.where("pair is not null").select("block", "pair", "plane", "n", "places")
    # The pairs grow with the corpus: one plan at every size, nothing to broadcast.
    scored = bits.join(scores.hint("merge"), "pair").select(F.col("block").alias("home"), "plane", "n", "places", "n_links", "best")
    rows = found.where("pair is null").select(*(c.split()[0] for c in _DOC.split(", ")))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def returned(docs: pa.Table, bits: pa.Table) -> pa.Table:
        size = max(docs.column("place").to_pylist()) + 1
        n_best, count_sum = np.zeros(size, np.int64), np.zeros(size, np.int64)
        if len(bits):
            n, plane, count = (bits.column(c).to_numpy() for c in ("n", "plane", "n_links"))
            places = places_of(n, bits.column("places"))
            weight = np.where(plane == 0, 1, np.int64(1) << np.maximum(plane - 1, 0).astype(np.int64))
            best = bits.column("best").to_numpy()
            np.add.at(count_sum, places, np.repeat(weight * count, n))
            np.add.at(n_best, places, np.repeat(np.where(best, weight, 0), n))
        at = docs.column("place").to_numpy()
        own = [docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
        return pa.table(
            [*own, pa.array(n_best[at]), pa.array(count_sum[at]), docs.column("groups_sha256")], names=names
        )

    kinds = ", ".join(f"{c} long" for c in names[:-1])
    return rows.groupBy("block").cogroup(scored.groupBy("home")).applyInArrow(
        returned, f"{kinds}, groups_sha256 string"
    )
