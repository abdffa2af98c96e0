"""The scorer seam: scorers as functions over batches of rows, and the numeric pieces around them."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCEPT = 0.857


def sigmoid(x: Column) -> Column:
    """Stable for large |x|."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def softmax_yes(no: Column, yes: Column) -> Column:
    """The second probability of a softmax of two logits."""
    return sigmoid(yes - no)


def logsumexp(values: Column) -> Column:
    top = F.array_max(values)
    return top + F.log(F.aggregate(values, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def bce_loss(logit: Column, label: Column) -> Column:
    return F.greatest(logit, F.lit(0.0)) - logit * label + F.log1p(F.exp(-F.abs(logit)))


def bpr_loss(positive: Column, negative: Column) -> Column:
    d = positive - negative
    return F.greatest(-d, F.lit(0.0)) + F.log1p(F.exp(-F.abs(d)))


def infonce_loss(positive: Column, negatives: Column) -> Column:
    """Negative log-probability of the positive among it and an array of negatives."""
    return logsumexp(F.concat(F.array(positive), negatives)) - positive


@dataclass(frozen=True)
class Mlp:
    """Weights of Linear, LayerNorm, ReLU layers and a linear head, as nested lists; scaler by feature."""

    layers: list = field(default_factory=list)  # (weight rows, bias, norm weight, norm bias)
    head: tuple = ((), 0.0)
    mean: list = field(default_factory=list)
    deviation: list = field(default_factory=list)
    eps: float = 1e-5


def forward(features: Column, model: Mlp) -> Column:
    """The logit of an array column, as JVM expressions (for a few hundred weights)."""
    num = lambda xs: F.array(*(F.lit(float(x)) for x in xs))
    dotted = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    bind = lambda value, make: F.get(F.transform(F.array(value), make), F.lit(0))  # noqa: E731  # computes value once

    def linear(weight: list, bias: list) -> Callable[[Column], Column]:
        return lambda v: F.array(*(dotted(v, num(row)) + float(b) for row, b in zip(weight, bias)))

    def normed(scale: list, shift: list) -> Callable[[Column], Column]:
        """LayerNorm with population variance, then ReLU; mean and deviation are bound once."""
        n = len(scale)

        def apply(v: Column) -> Column:
            mean = F.aggregate(v, F.lit(0.0), lambda s, a: s + a) / float(n)
            centred = F.zip_with(v, F.array_repeat(mean, n), lambda a, m: a - m)

            def unit(c: Column) -> Column:
                ones = F.zip_with(c, F.array_repeat(F.sqrt(dotted(c, c) / float(n) + model.eps), n), lambda a, d: a / d)
                return F.zip_with(F.zip_with(ones, num(scale), lambda a, s: a * s), num(shift), lambda a, s: F.greatest(a + s, F.lit(0.0)))

            return bind(centred, unit)

        return apply

    x = F.zip_with(F.zip_with(features, num(model.mean), lambda a, m: a - m), num(model.deviation), lambda a, s: a / s)
    for weight, bias, scale, shift in model.layers:
        x = bind(bind(x, linear(weight, bias)), normed(scale, shift))
    weight, bias = model.head
    return dotted(x, num(weight)) + float(bias)


def decide(scored: DataFrame, logit: str = "logit", threshold: float = ACCEPT) -> DataFrame:
    """Add score and accept."""
    return scored.withColumn("score", sigmoid(F.col(logit))).withColumn("accept", F.col("score") >= threshold)


def batch_score(df: DataFrame, make: Callable[[], Callable], schema: str, *, batch: int = 32) -> DataFrame:
    """The seam for external scorers: make() builds one once in a worker, which then maps lists of `batch` row dicts to lists of row dicts.

    Rows keep their order within a partition; a worker holds one batch.
    """
    import pandas as pd

    names = [f.name for f in df.sparkSession.createDataFrame([], schema).schema.fields]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for f in frames:
            rows = f.to_dict("records")
            out = [r for k in range(0, len(rows), batch) for r in model(rows[k : k + batch])]
            yield pd.DataFrame(out, columns=names)

    return df.mapInPandas(run, schema)


def hashed_embedding(texts: list[str], dim: int = 16) -> list[list[float]]:
    """A deterministic stand-in for an embedding model: hashed words, length 1."""
    import zlib

    out = []
    for t in texts:
        v = [0.0] * dim
        for w in (t or "").split():
            h = zlib.crc32(w.encode())
            v[h % dim] += 1.0 if h >> 16 & 1 else -1.0
        n = math.sqrt(sum(x * x for x in v)) + 1e-9
        out.append([x / n for x in v])
    return out


def embed_texts(df: DataFrame, id_col: str, text_col: str, *, dim: int = 16, batch: int = 32) -> DataFrame:
    """(id, vector array<float>) through the seam with the stand-in."""

    def make():
        return lambda rows: [{id_col: r[id_col], "vector": v} for r, v in zip(rows, hashed_embedding([r[text_col] for r in rows], dim))]

    kind = df.schema[id_col].dataType.simpleString()
    return batch_score(df.select(id_col, text_col), make, f"{id_col} {kind}, vector array<float>", batch=batch)


def rerank(documents: DataFrame, scorer: Callable[[str, str], float], query: str, instruction: str) -> DataFrame:
    """(pos, score) of documents (pos, text) in their order, from a scorer of (instruction and query, document)."""

    def make():
        return lambda rows: [{"pos": r["pos"], "score": float(scorer(f"{instruction}\n{query}", r["text"] or ""))} for r in rows]

    return batch_score(documents.select("pos", "text"), make, "pos bigint, score double").orderBy("pos")


def platt(scores: DataFrame, *, c: float = 1e6) -> tuple[float, float]:
    """(slope, intercept) of a logistic fit of label on score with inverse regularisation c."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = scores.select(F.col("label").cast("double").alias("label"), array_to_vector(F.array(F.col("score").cast("double"))).alias("features"))
    n = rows.count()
    fit = LogisticRegression(regParam=1 / (c * max(n, 1)), standardization=False, tol=1e-10, maxIter=200).fit(rows)
    return float(fit.coefficients[0]), float(fit.intercept)


def ema(values: Column, decay: float = 0.9999, ramp: float = 2000.0) -> Column:
    """Moving average of an array in order, whose decay grows as decay * (1 - e^(-k / ramp)); starts at the first value."""
    first = F.struct(F.lit(0).alias("k"), F.get(values, F.lit(0)).cast("double").alias("v"))
    rest = F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0)))

    def step(s: Column, x: Column) -> Column:
        d = F.lit(decay) * (1 - F.exp(-(s["k"] + 1) / F.lit(ramp)))
        return F.struct((s["k"] + 1).alias("k"), (s["v"] * d + x * (1 - d)).alias("v"))

    return F.aggregate(rest, first, step, lambda s: s["v"])


def one_cycle(x: Column, y1: float = 0.0, y2: float = 1.0, steps: int = 100) -> Column:
    """A cosine ramp from y1 to y2 over the steps."""
    return (1 - F.cos(x * math.pi / steps)) / 2 * (y2 - y1) + y1
