"""Compression classifier for text quality.

Two Zstandard dictionaries are trained, one on good and one on bad labelled
texts. A text is cut into blocks, each block is compressed with either
dictionary, and the normalised difference of the two sizes, with the
compression ratio, goes through a logistic calibration fitted on labelled
texts that neither dictionary has seen.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, temporary, written

#: predicted is 1 from this score on.
ACCEPT = 0.7
#: Bounds of the labelled sample that reaches the driver: rows of each class, bytes of each text.
SAMPLE_ROWS, SAMPLE_BYTES = 1200, 16_384
DICT_BYTES, BLOCK, LEVEL = 65_536, 2048, 3


@dataclass(frozen=True)
class QualityModel:
    """good, bad: the dictionaries (None: no labelled text of that class); weights: the calibration."""

    good: bytes | None
    bad: bytes | None
    weights: tuple[float, ...]

    @property
    def fitted(self) -> bool:
        return self.good is not None and self.bad is not None

    def scorer(self):
        if not self.fitted:
            return lambda text: _sigmoid(self.weights[0])
        size = _sizer(self.good, self.bad)
        return lambda text: _sigmoid(float(np.dot(_features(*size(text)), self.weights)))


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _sizer(good: bytes, bad: bytes):
    made = []
    for raw in (good, bad):
        d = zstandard.ZstdCompressionDict(raw)
        d.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False).compress)
    to_good, to_bad = made
    alone = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False).compress
    frame = len(to_good(b""))  # what a block costs besides its content

    def size(text: bytes) -> tuple[int, int, int, int]:
        blocks = [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]
        return len(text), *(sum(len(small(b)) - frame + 1 for b in blocks) for small in (to_good, to_bad, alone))

    return size


def _features(n: int, good: int, bad: int, alone: int) -> np.ndarray:
    """Bias, normalised difference, its square with sign, and how far the text compresses by itself.

    The last two tell repeated text: no dictionary is needed to make it small.
    """
    if not n:
        return np.array([1.0, 0, 0, 0, 0])
    d = (bad - good) / (bad + good)
    ratio = min(1.0, alone / n)
    return np.array([1.0, 10 * d, 100 * d * abs(d), 3 * ratio, 10 * max(0.0, 0.25 - ratio)])


def _calibrate(x: np.ndarray, y: np.ndarray, prior: float, ridge: float = 0.05) -> tuple[float, ...]:
    """Logistic regression by Newton steps; the classes weigh as in all labels, prior being the share of 1."""
    weight = np.where(y == 1, prior / (y == 1).sum(), (1 - prior) / (y == 0).sum()) * len(y)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(map(float, w))


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; of very few texts, their own bytes."""
    parts = [t[i : i + BLOCK] for t in texts for i in range(0, len(t), BLOCK)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, parts).as_bytes()
    except zstandard.ZstdError:
        raw = b"".join(parts)[-DICT_BYTES:]
        return raw if len(raw) >= 8 else raw.ljust(8)


def fit(documents: DataFrame, labels: DataFrame, *, rows: int = SAMPLE_ROWS, max_bytes: int = SAMPLE_BYTES) -> QualityModel:
    """Fit on a bounded sample: per class the `rows` labelled texts whose ids hash lowest, of those at hand.

    labels: doc_id and quality, already without what is held out; documents:
    doc_id and text. Labels with a null id, another quality than 0 or 1, or
    two qualities are not used, nor are texts that are empty or over
    `max_bytes`. Of an id with several texts each is one; equal rows are one.
    The sample is drawn after the join, so labels of documents that are not
    here take no places. At most 2 * rows * max_bytes bytes reach the driver.
    Without texts of both classes the model is not fitted.
    """
    usable = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
        .groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("q"), F.max("quality").alias("r")).where("q = r").select("id", "q")
    )
    short = documents.where((F.octet_length("text") > 0) & (F.octet_length("text") <= max_bytes) & F.col("doc_id").isNotNull())
    with temporary(documents.sparkSession):
        # Ids and hashes of texts only.
        have = short.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h")).groupBy("id", "h").agg(F.lit(1).alias("one"))
        known = written(have.join(usable, "id").select("id", "h", "q", F.xxhash64(F.col("id").cast("string"), F.lit("quality")).alias("o")), "quality-known")
        pick = [known.where(F.col("q") == q).orderBy("o", "id", "h").limit(rows) for q in (0, 1)]
        chosen = written(pick[0].unionByName(pick[1]), "quality-chosen")
        counts = dict(known.groupBy("q").count().collect())
        # The sample's bound is also that of the broadcast.
        same = (F.col("doc_id") == F.col("id")) & (F.xxhash64("text") == F.col("h"))
        got = short.select("doc_id", "text").join(F.broadcast(chosen), same).select("q", "o", "id", "h", F.encode("text", "UTF-8").alias("b")).dropDuplicates(["id", "h"]).collect()
    texts: dict[int, list[bytes]] = {0: [], 1: []}
    for r in sorted(got, key=lambda r: (r["o"], r["id"], r["h"])):
        texts[r["q"]].append(bytes(r["b"]))
    if not texts[0] or not texts[1]:
        return QualityModel(None, None, (0.0,))
    train, rest = {}, {}
    for q, ts in texts.items():
        train[q], rest[q] = ts[::2], ts[1::2] or ts
    good, bad = _dictionary(train[1]), _dictionary(train[0])
    size = _sizer(good, bad)
    x = np.array([_features(*size(t)) for q in (0, 1) for t in rest[q]])
    y = np.array([q for q in (0, 1) for _ in rest[q]])
    return QualityModel(good, bad, _calibrate(x, y, counts[1] / (counts[0] + counts[1])))


def score(documents: DataFrame, model: QualityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score, predicted. A null text scores as an empty one; without a fitted model scores are 0.5.

    One pass without a shuffle; the model (two dictionaries of DICT_BYTES) goes out with the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for b in batches:
            scores = np.array([of(t or b"") for t in b.column(1).to_pylist()], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores), pa.array((scores >= ACCEPT).astype(np.int32))], names=["id", "score", "predicted"])

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(F.col(id_col).alias("id"), F.encode(text_col, "UTF-8").alias("t")).transform(bounded_batches).mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)


def training_labels(labels: DataFrame) -> DataFrame:
    """Without the held-out quarter: crc32 of the id as text leaves 2 modulo 4."""
    return labels.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).select("doc_id", "quality")


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labels outside the held-out quarter and score every document: doc_id, score, predicted, held_out.

    One row per input row, repeated ones too, each scored by its own text; a
    null text scores as an empty one, a null id is not held out. Extra columns
    are not read. Where the model cannot be fitted (no labelled text of one of
    the classes) each score is 0.5. An empty table gives an empty result.
    """
    model = fit(documents, training_labels(labels))
    return score(documents, model).withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)))


def accepted(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score reaches ACCEPT, with all their columns.

    Each row is judged by its own text, whatever its id, null texts as empty
    ones. Where the model cannot be fitted no document can be rejected: all
    go on, with a warning. The score is formed beside the row in one pass, so
    no join is needed. An empty table gives an empty one.
    """
    model = fit(documents, training_labels(labels))
    if not model.fitted:
        warnings.warn("no labelled texts of both classes: all documents are accepted", stacklevel=2)
        return documents
    schema = documents.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            yield b.filter(pa.array([of(t.encode() if t else b"") >= ACCEPT for t in texts], type=pa.bool_()))

    return documents.transform(bounded_batches).mapInArrow(run, schema)
