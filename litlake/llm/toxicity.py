"""Toxicity by compression distance.

Two zstandard dictionaries, one of toxic and one of ordinary text, compress each
window of a document. A window that the toxic dictionary shortens by more than a
threshold counts; a calibrated curve turns a document's windows into a score.

Toxic documents are mostly ordinary prose. The toxic dictionary is therefore
trained on those pieces of toxic documents that toxic text holds much more often,
in different surroundings (a passage copied many times has one surrounding), and
both dictionaries share the same body of ordinary text, so that only the piece
that differs can make a difference.
"""

from __future__ import annotations

import random
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litlake.llm import compression as zc
from litlake.llm.common import LOWER, only, utf8

#: Labelled documents that a class may give to training, each with its whole text.
MAX_DOCS = {1: 4000, 0: 6000}
#: No further document of a class is taken once its texts have so many bytes.
SAMPLE_BYTES = 32 << 20
WINDOW = 64
#: Bytes a window must save to count, one threshold each.
GAINS = (1, 2, 3, 4, 5, 6, 8, 10)
FEATURES = 3 * len(GAINS) + 1
GRAM = 4
SHARED_BYTES = 16384
TOXIC_BYTES = 2048
#: A gram is toxic if this many different surroundings of it were seen ...
LEAST_SEEN = 40
#: ... and its share of toxic documents is so many times that of ordinary ones.
LEAST_RATIO = 10.0
FOLDS = 4
#: Pieces of the dictionary that may repeat one gram.
MOST_REPEATS = 1


@dataclass(frozen=True)
class ToxicityModel:
    toxic: bytes
    ordinary: bytes
    intercept: float
    slope: np.ndarray

    def coders(self):
        return zc.coder(self.ordinary), zc.coder(self.toxic)


def normal(text: str | None) -> bytes:
    return utf8(text).translate(LOWER)


def _features(data: bytes, ordinary, toxic) -> tuple[float, ...]:
    """How many windows gain so many bytes, in number and as a share; zeros without windows."""
    gain = zc.gains(zc.windows(data, WINDOW), ordinary, toxic)
    if not len(gain):
        return (0.0,) * FEATURES
    over = np.array([(gain >= g).sum() for g in GAINS], float)
    share = over / len(gain)
    return (*np.sqrt(share), *np.log1p(over), *share, float(np.log(len(gain))))


def _codes(data: bytes, size: int, pad: int = 0) -> np.ndarray:
    """A number for each run of ``size`` bytes of ``data`` with ``pad`` bytes on either side."""
    x = np.frombuffer(bytes(pad) + data + bytes(pad), np.uint8).astype(np.uint64)
    wide = size + 2 * pad
    n = len(x) - wide + 1
    out = np.zeros(max(0, n), np.uint64)
    for k in range(wide if n > 0 else 0):
        out = out * np.uint64(0x100000001B3) + x[k : k + n] + np.uint64(1)
    return out


def _toxic_grams(toxic: list[bytes], ordinary: list[bytes]) -> np.ndarray:
    """Codes of the grams that many more toxic texts hold, in differing surroundings."""
    least = max(3, min(LEAST_SEEN, len(toxic) // 100))
    each = [np.unique(_codes(data, GRAM)) for data in toxic]
    grams, held = np.unique(np.concatenate(each), return_counts=True)
    del each
    grams, held = grams[held >= least], held[held >= least]
    if not len(grams):
        return grams
    common = _held(ordinary, grams)
    ratio = (held / len(toxic)) / ((common + 1) / len(ordinary))
    grams = grams[ratio >= LEAST_RATIO]
    places = [np.zeros((0, 2), np.uint64)]
    for data in toxic:
        code = _codes(data, GRAM)
        kept = np.isin(code, grams)
        places.append(np.stack([code[kept], _codes(data, GRAM, 6)[kept]], 1))
    differing = np.unique(np.concatenate(places), axis=0)[:, 0]
    codes, surroundings = np.unique(differing, return_counts=True)
    return codes[surroundings >= least]


def _held(texts: list[bytes], grams: np.ndarray) -> np.ndarray:
    """For each of the (sorted) grams, the number of texts that hold it."""
    count = np.zeros(len(grams), np.int64)
    for data in texts:
        own = np.unique(_codes(data, GRAM))
        at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
        count[at[grams[at] == own]] += 1
    return count


def _pieces(data: bytes, grams: np.ndarray) -> list[bytes]:
    """Runs of ``data`` covered by ``grams``, with a byte on either side."""
    hit = np.flatnonzero(np.isin(_codes(data, GRAM), grams))
    if not len(hit):
        return []
    cut = np.flatnonzero(np.diff(hit) > GRAM)
    starts, ends = hit[np.r_[0, cut + 1]], hit[np.r_[cut, len(hit) - 1]] + GRAM
    return [data[max(0, a - 1) : b + 1] for a, b in zip(starts, ends, strict=True)]


def _dictionaries(toxic: list[bytes], ordinary: list[bytes], seed: int) -> tuple[bytes, bytes]:
    rng = random.Random(seed)
    grams = _toxic_grams(toxic, ordinary)
    toxic_codes = set(grams.tolist())
    pieces = Counter(p for data in toxic for p in _pieces(data, grams))
    covered: Counter[int] = Counter()
    chosen, room = [], TOXIC_BYTES
    for piece in sorted(pieces, key=lambda p: (-pieces[p], p)):
        held = [g for g in _codes(piece, GRAM).tolist() if g in toxic_codes]
        if len(piece) <= room and any(covered[g] < MOST_REPEATS for g in held):
            covered.update(held)
            chosen.append(piece)
            room -= len(piece)
    # zstandard reaches the end of a dictionary at the least cost: the most frequent go last.
    own = b"".join(reversed(chosen))
    cuts = []
    for d in ordinary:
        starts = range(0, len(d), 64)
        cuts += [d[i : i + 64] for i in rng.sample(starts, min(10, len(starts)))]
    rng.shuffle(cuts)
    body = b"".join(cuts)
    shared, rest = body[:SHARED_BYTES], body[SHARED_BYTES:]
    return shared + own, shared + rest[: len(own)]


def _fold(texts: list[bytes], fold: int) -> tuple[list[bytes], list[bytes]]:
    """Texts outside a fold, and inside it; a lone text is on both sides."""
    outside = [t for i, t in enumerate(texts) if i % FOLDS != fold]
    return outside or texts, texts[fold::FOLDS]


def train(
    toxic: list[bytes], ordinary: list[bytes], share: float | None = None, seed: int = 7
) -> ToxicityModel:
    """Dictionaries from all given texts; the curve from texts that its own dictionaries never saw.

    Each class is cut in FOLDS. Dictionaries of all folds but one score that one, and
    the curve is fitted to all; then the dictionaries are built anew from everything.
    ``share`` is that of toxic texts among the labelled ones, if the sample's differs;
    the fit is weighted so. With a class missing, the curve is flat.
    """
    if not toxic or not ordinary:
        flat = 0.999 if toxic else 0.001
        return ToxicityModel(b"", b"", float(np.log(flat / (1 - flat))), np.zeros(FEATURES))
    rows, labels = [], []
    for fold in range(FOLDS):
        seen, unseen = zip(*(_fold(texts, fold) for texts in (toxic, ordinary)), strict=True)
        d_toxic, d_ordinary = _dictionaries(*seen, seed)
        coders = zc.coder(d_ordinary), zc.coder(d_toxic)
        for label, texts in zip((1, 0), unseen, strict=True):
            rows += [_features(data, *coders) for data in texts]
            labels += [label] * len(texts)
    y = np.array(labels, float)
    share = y.mean() if share is None else share
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    intercept, slope = zc.fit_logistic(np.array(rows), y, weight)
    d_toxic, d_ordinary = _dictionaries(toxic, ordinary, seed)
    return ToxicityModel(d_toxic, d_ordinary, intercept, slope)


def training_sample(
    docs: DataFrame, labels: DataFrame, label: str, use: Column, max_docs: dict[int, int]
) -> dict[int, list[str]]:
    """Distinct whole texts of labelled documents by class, a bounded sample by hash of the id.

    ``use`` is a condition on doc_id. Labels choose at most ``max_docs`` ids of a
    class. Their texts come to the driver in the order of the hash until a class
    has ``SAMPLE_BYTES``, the last one whole too, at most twice ``max_docs`` where
    ids repeat. This bounds the rows that are fitted, never a text.
    """
    texts = only(docs, doc_id="long", text="string").where(F.length("text") > 0)
    texts = texts.withColumn("key", F.xxhash64("text"))
    marks = only(labels, doc_id="long", **{label: "int"}).where(F.col(label).isin(0, 1) & use)
    marks = marks.groupBy("doc_id").agg(F.max(label).alias("mark"))
    order = F.xxhash64("doc_id"), "doc_id"
    out: dict[int, list[str]] = {}
    for mark, most in max_docs.items():
        ids = marks.where(F.col("mark") == mark).orderBy(*order).select("doc_id").limit(most)
        sizes = texts.join(F.broadcast(ids), "doc_id", "left_semi")
        sizes = sizes.select("doc_id", "key", F.octet_length("text").alias("size")).distinct()
        chosen, total = [], 0
        for r in sizes.orderBy(*order, "key", "size").limit(2 * most).collect():
            if total >= SAMPLE_BYTES:
                break
            chosen.append((r.doc_id, r.key))
            total += r.size
        named = docs.sparkSession.createDataFrame(chosen, "doc_id long, key long")
        rows = texts.join(F.broadcast(named), ["doc_id", "key"], "left_semi")
        found = rows.groupBy("doc_id", "key").agg(F.first("text").alias("text")).collect()
        out[mark] = sorted({r.text for r in found})
        random.Random(mark).shuffle(out[mark])
    return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, use: Column) -> ToxicityModel:
    """A model of ``labels.toxic``, learnt from rows of ``docs`` for which ``use`` holds."""
    sample = training_sample(docs, labels, "toxic", use, MAX_DOCS)
    marks = only(labels, doc_id="long", toxic="int").where(F.col("toxic").isin(0, 1) & use)
    share = marks.agg(F.avg("toxic")).first()[0]
    return train([normal(t) for t in sample[1]], [normal(t) for t in sample[0]], share)


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` and ``score``, from the whole text.

    Null and empty texts have no windows and get the curve's value at zero
    features. Texts of any length are read in windows; memory follows one text.
    """
    texts = docs.select(*keep, docs["text"].cast("string").alias("_text"))
    schema = docs.select(*keep, F.lit(0.0).alias("score")).schema

    def scored(batches):
        ordinary, toxic = model.coders()
        for batch in batches:
            found = [_features(normal(t.as_py()), ordinary, toxic) for t in batch.column("_text")]
            score = zc.logistic(np.array(found).reshape(-1, FEATURES), model.intercept, model.slope)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(score)], names=[*keep, "score"]
            )

    return texts.mapInArrow(scored, schema)


def held_out(column: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; false for a null id."""
    crc = F.crc32(F.col(column).cast("string").cast("binary"))
    return F.coalesce(F.pmod(crc, F.lit(modulus)) == remainder, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted.

    Every row of ``docs`` gives one row, repeated ids included; a null or empty
    text is scored as a text without windows. Without labelled rows the score is
    flat. Columns other than doc_id and text are ignored.
    """
    model = fit_toxicity(docs, labels, ~held_out("doc_id", 5, 0))
    scored = score_toxicity(only(docs, doc_id="long", text="string"), model, ["doc_id"])
    return scored.select(
        "doc_id",
        held_out("doc_id", 5, 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
