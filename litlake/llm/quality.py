"""Quality by compression: dictionaries of good and bad text, and one calibrated difference.

A text is compressed window by window under a zstandard dictionary trained on
good text and one trained on bad text. The difference of the two sizes, divided
by the length of the text, goes through a logistic curve that was fitted on
labelled texts which the dictionaries it used had not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litlake.llm import compression as zc
from litlake.llm.common import only, table, unused, utf8
from litlake.llm.toxicity import held_out, training_sample

#: Labelled documents that a class may give to training (their bytes in all: toxicity.SAMPLE_BYTES).
MAX_DOCS = {1: 2500, 0: 2500}
WINDOW = 512
DICTIONARY_BYTES = 32768
#: Parameters of zstandard's dictionary builder (segment and match length), fixed for repeatable training.
SEGMENT, MATCH = 64, 8
#: Texts at least this likely to be good are kept.
THRESHOLD = 0.7


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    intercept: float
    slope: np.ndarray

    def coders(self):
        return _coder(self.good), _coder(self.bad)


def _coder(dictionary: bytes) -> zstandard.ZstdCompressor:
    if len(dictionary) < 8:
        return zc.coder(b"")
    content = zstandard.ZstdCompressionDict(dictionary)  # trained or, for lack of text, plain
    content.precompute_compress(level=zc.LEVEL)
    return zstandard.ZstdCompressor(
        level=zc.LEVEL,
        dict_data=content,
        write_content_size=False,
        write_checksum=False,
        write_dict_id=False,
    )


def _dictionary(texts: list[bytes]) -> bytes:
    """A dictionary trained on all windows of the texts, smaller where there is little text.

    Too few windows to train on (some kilobytes in all) are the dictionary themselves.
    """
    parts = [p for t in texts for p in zc.windows(t, WINDOW)]
    size = min(DICTIONARY_BYTES, max(1024, sum(map(len, parts)) // 8))
    try:
        return zstandard.train_dictionary(size, parts, k=SEGMENT, d=MATCH).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)


def _features(data: bytes, good, bad) -> tuple[float, float]:
    parts = zc.windows(data, WINDOW)
    if not parts:
        return (0.0, 0.0)
    sizes = np.array([(len(bad.compress(p)), len(good.compress(p)), len(p)) for p in parts], float)
    to_bad, to_good, plain = sizes.sum(0)
    return ((to_bad - to_good) / plain, to_good / plain)


def train(good: list[bytes], bad: list[bytes]) -> QualityModel:
    """Dictionaries of both classes; the curve is fitted across two halves of the texts.

    With a class missing the curve is flat at the class that is there.
    """
    if not good or not bad:
        flat = 0.999 if good else 0.001
        return QualityModel(b"", b"", float(np.log(flat / (1 - flat))), np.zeros(2))
    rows, labels = [], []
    for half in (0, 1):
        coders = [_coder(_dictionary(texts[half::2])) for texts in (good, bad)]
        for label, texts in ((1, good[1 - half :: 2]), (0, bad[1 - half :: 2])):
            rows += [_features(t, *coders) for t in texts]
            labels += [label] * len(texts[:])
    intercept, slope = zc.fit_logistic(np.array(rows), np.array(labels, float))
    return QualityModel(_dictionary(good), _dictionary(bad), intercept, slope)


def fit_quality(docs: DataFrame, labels: DataFrame, use: Column) -> QualityModel:
    """A model of ``labels.quality``, learnt from rows of ``docs`` for which ``use`` holds."""
    sample = training_sample(docs, labels, "quality", use, MAX_DOCS)
    return train([utf8(t) for t in sample[1]], [utf8(t) for t in sample[0]])


def score_column(model: QualityModel, text: Column) -> Column:
    """The model's score of a text column, 0 to 1; null and empty texts have zero features."""
    weights = (model.intercept, model.slope)
    dictionaries = (model.good, model.bad)

    def scores(batches):
        good, bad = map(_coder, dictionaries)
        for texts in batches:
            found = [_features(utf8(t), good, bad) for t in texts.to_pylist()]
            yield pa.array(zc.logistic(np.array(found).reshape(-1, 2), *weights))

    scores.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(scores, "double")(text.cast("string"))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted.

    Every row gives one row, repeated ids included. Null and empty texts get the
    curve's value at zero features. Without labelled rows the score is flat.
    """
    model = fit_quality(docs, labels, ~held_out("doc_id", 4, 2))
    texts = only(docs, doc_id="long", text="string")
    scored = texts.select("doc_id", score_column(model, texts["text"]).alias("score"))
    return scored.select(
        "doc_id",
        held_out("doc_id", 4, 2).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: ``docs`` without the rows that ``quality`` rejects.

    Without labelled texts of both classes nothing is known of any row: all stay.
    """
    model = fit_quality(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id", 4, 2))
    if not (model.good and model.bad):
        return docs
    score = unused(docs, "score")
    scored = docs.withColumn(score, score_column(model, docs["text"]))
    return scored.where(F.col(score) >= THRESHOLD).select(*docs.columns)
