"""Packing of documents into sequences of a fixed number of tokens.

Documents longer than a sequence give whole sequences where they are read; what is
left of each, shorter than a sequence, goes to a random group. A group, bounded in
tokens, is packed on its own by first-fit decreasing: the first bin with room is found
in a tournament tree of bin capacities. Gaps that remain are filled with pieces cut from
the emptiest bins, and the group's last bin is cut into lengths that need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litlake.llm.common import only, written
from litlake.llm.tokens import Remembered, is_lean, lean_tokenizer, lower_words, tokenizer

VOCABULARY = "word_bpe_49k.json"
#: The id that ends every document.
END = 2
LENGTH = 4096
#: Tokens of one group, on average; one task holds a group.
GROUP_TOKENS = 1 << 20
#: Gaps of fewer tokens stay padding: no document is cut for them.
LEAST_CUT = 16
SEED = 17
#: A word that is one token, and in no other word.
MARK = "~"
#: Words that a worker remembers.
REMEMBER = 400_000

_PIECES = (
    "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
)
_NAMES = [c.split()[0] for c in _PIECES.split(", ")]


class Bins:
    """Bins of equal size; ``first(n)`` is the first one with room for ``n``.

    A tournament tree holds in each node the largest room below it, so that a search
    goes down one path. Bins are opened in order, because an unused one is a full room.
    """

    def __init__(self, size: int, most: int):
        self.leaves = 1 << max(most - 1, 0).bit_length()
        self.room = [size] * (2 * self.leaves)

    def first(self, n: int) -> int:
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < n:
                at += 1
        return at - self.leaves

    def take(self, index: int, n: int) -> None:
        room, at = self.room, index + self.leaves
        room[at] -= n
        while at > 1:
            at //= 2
            most = max(room[2 * at], room[2 * at + 1])
            if room[at] == most:
                break
            room[at] = most


Cut = tuple[int, int, int]  # item, first token, tokens


def first_fit_decreasing(lengths: list[int], size: int) -> list[list[Cut]]:
    """Bins of whole items, longest first, each in the first bin with room; none is over ``size``."""
    # Two bins are never both at most half full, so fewer than these are used.
    bins = Bins(size, 2 * sum(lengths) // size + 2)
    out: list[list[Cut]] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at = bins.first(lengths[i])
        bins.take(at, lengths[i])
        if at == len(out):
            out.append([])
        out[at].append((i, 0, lengths[i]))
    return out


def _moved(donor: list[Cut], n: int) -> list[Cut]:
    """Take ``n`` tokens off the end of ``donor``; one item at most is cut."""
    out = []
    while n:
        item, start, length = donor.pop()
        if length > n:
            donor.append((item, start, length - n))
            start, length = start + length - n, n
        out.append((item, start, length))
        n -= length
    return out


def without_gaps(bins: list[list[Cut]], size: int, least: int = LEAST_CUT) -> list[list[Cut]]:
    """The bins with gaps of ``least`` or more filled from the emptiest bins.

    The one bin that stays open is cut into powers of two, which take no padding.
    """
    level = lambda b: sum(n for _, _, n in b)
    full = [b for b in bins if size - level(b) < least]
    open_ = sorted((b for b in bins if size - level(b) >= least), key=level, reverse=True)
    levels = [level(b) for b in open_]
    first, last = 0, len(open_) - 1
    while first < last:
        n = min(size - levels[first], levels[last])
        open_[first].extend(_moved(open_[last], n))
        levels[first] += n
        levels[last] -= n
        if not levels[last]:
            last -= 1
        if size - levels[first] < least:
            full.append(open_[first])
            first += 1
    for rest in open_[first : last + 1]:
        left = level(rest)
        while left:
            n = 1 << (left.bit_length() - 1)
            full.append(_moved(rest, n))
            left -= n
    return full


def _kind(vocabulary: str) -> np.dtype:
    """The narrowest type that holds the ids."""
    return np.dtype("<u2" if tokenizer(vocabulary, False).get_vocab_size() <= 1 << 16 else "<u4")


def _wide(ids: bytes, n: int) -> bytes:
    """``n`` ids as little-endian 32 bits."""
    return np.frombuffer(ids, f"<u{len(ids) // n}").astype("<u4").tobytes()


@cache
def _encoder(vocabulary: str) -> Remembered:
    """Ids of words, in the narrowest type. A worker keeps what it remembers for later tasks."""
    model, lean, kind = tokenizer(vocabulary, False), lean_tokenizer(vocabulary), _kind(vocabulary)
    mark = model.encode(MARK, add_special_tokens=False).ids
    if len(mark) != 1:
        raise ValueError(f"{MARK} must be one token")

    def together(ws: list[bytes], texts: list[str], with_model) -> Iterator[tuple[bytes, bytes]]:
        # Many words go in one call, with a mark between them that is a token of its own.
        for i in range(0, len(ws), 2000):
            runs = [(ws[k : k + 100], texts[k : k + 100]) for k in range(i, min(i + 2000, len(ws)), 100)]
            joined = [f" {MARK} ".join(run) for _, run in runs]
            found = with_model.encode_batch_fast(joined, add_special_tokens=False)
            for (run, _), e in zip(runs, found, strict=True):
                ids = np.array(e.ids, kind)
                at, raw, size = np.flatnonzero(ids == mark[0]), ids.tobytes(), kind.itemsize
                ends = [*(size * at).tolist(), len(raw)]
                starts = [0, *(size * at + size).tolist()]
                yield from zip(run, (raw[k:n] for k, n in zip(starts, ends, strict=True)), strict=True)

    def encode(ws: list[bytes]) -> list[bytes]:
        texts = {w: w.decode() for w in ws}
        found = {}
        plain = [w for w in ws if is_lean(texts[w])]
        found.update(together(plain, [texts[w] for w in plain], lean))
        rest = [w for w in ws if w not in found and MARK.encode() not in w and b"<|" not in w]
        found.update(together(rest, [texts[w] for w in rest], model))
        odd = [w for w in ws if w not in found]
        for w, e in zip(odd, model.encode_batch_fast([texts[w] for w in odd], add_special_tokens=False), strict=True):
            found[w] = np.array(e.ids, kind).tobytes()
        return [found[w] for w in ws]

    return Remembered(encode, lower_words, REMEMBER)


def _batch(rows: list[tuple], extra: dict[str, pa.DataType]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 6 + [pa.binary()] + list(extra.values())
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, [*_NAMES, *extra])


def tokenised(docs: DataFrame, vocabulary: str, length: int) -> DataFrame:
    """Pieces of whole texts: full ones with a sequence of their own, the rest with a random ``draw``.

    Ids of the rest, which move, are in the narrowest type that holds them.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, kind = _encoder(vocabulary), _kind(vocabulary)
        end, size = np.array([END], kind).tobytes(), kind.itemsize
        task, n_rows, n_full = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            texts = [t.as_py() or "" for t in batch.column("text")]
            out, held = [], 0
            for name, parts in zip(names, encoder.texts(texts), strict=True):
                parts.append(end)
                ids = b"".join(parts)
                total = len(ids) // size
                for start in range(0, total - length + 1, length):
                    piece = _wide(ids[size * start : size * (start + length)], length)
                    # Odd numbers: those of groups are even.
                    sequence = 2 * (task << 36 | n_full) + 1
                    n_full += 1
                    out.append((name, start, length, total, sequence, 0, piece, None))
                if rest := total % length:
                    draw = xxhash.xxh3_64_intdigest(n_rows.to_bytes(8) + task.to_bytes(8), seed=SEED) >> 1
                    out.append((name, total - rest, rest, total, None, None, ids[size * (total - rest) :], draw))
                n_rows += 1
                held += len(ids)
                if held > 1 << 22:
                    yield _batch(out, {"draw": pa.int64()})
                    out, held = [], 0
            yield _batch(out, {"draw": pa.int64()})

    return only(docs, doc_id="long", text="string").mapInArrow(rows, f"{_PIECES}, draw long")


def pack(
    docs: DataFrame,
    length: int = LENGTH,
    group_tokens: int = GROUP_TOKENS,
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """Per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian 32 bits).

    A document is its token ids and END, so null and empty texts are END alone. Every
    row is packed, repeated rows and ids and null ids included; nothing is dropped. An empty
    table gives no pieces. Rows are dealt to groups by task and place in it, not by
    their contents, so copies spread evenly.
    """
    pieces = written(tokenised(docs, vocabulary, length), "pieces")
    rest = pieces.where("sequence_id is null")
    total = rest.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    groups = max(ceil(total / group_tokens), 1)

    def packed(group: pa.Table) -> pa.Table:
        group = group.sort_by("draw")
        lengths = group.column("length").to_pylist()
        columns = [group.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens")]
        ids, name = group.column("ids"), group.column("group")[0].as_py()
        rows = []
        for number, cuts in enumerate(without_gaps(first_fit_decreasing(lengths, length), length)):
            offset = 0
            for item, first, n in cuts:
                doc_id, start, total = (c[item] for c in columns)
                own = ids[item].as_py()
                size = len(own) // lengths[item]
                piece = _wide(own[size * first : size * (first + n)], n)
                rows.append((doc_id, start + first, n, total, 2 * (name << 24 | number), offset, piece))
                offset += n
        return pa.Table.from_batches([_batch(rows, {})])

    dealt = rest.withColumn("group", F.pmod(F.col("draw"), F.lit(groups)))
    dealt = dealt.groupBy("group").applyInArrow(packed, _PIECES)
    return pieces.where("sequence_id is not null").drop("draw").unionByName(dealt)


def packed_pieces(docs: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pack(docs).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
