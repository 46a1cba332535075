"""What the trained text operators share: the labelled sample, the held-out rule, an optimiser."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows a model is fitted on, at most: the bound of the training sample.
SAMPLE = 4000
#: Characters of all texts in the sample together, at most; the driver holds them.
SAMPLE_CHARS = 24_000_000


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts


def sample(
    docs: DataFrame, labels: DataFrame, label: str, learnable: Callable[[Column], Column], doc_id: str = "doc_id", text: str = "text", rows: int = SAMPLE
) -> tuple[list[str], np.ndarray]:
    """Texts and 0/1 labels of at most ``rows`` labelled rows of whose id ``learnable`` holds.

    The labels of the least id hashes are taken, so the sample is spread over all data and the same on every
    run; it also ends before SAMPLE_CHARS characters. An id with both labels counts as labelled 1; rows
    without a text are left out."""
    marks = labels.where(F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg(F.max(label).alias("__label"))
    marks = marks.where(learnable(F.col("__id"))).withColumn("__order", F.xxhash64("__id", F.lit("sample")))
    chosen = F.broadcast(marks.orderBy("__order", "__id").limit(rows))  # so many rows at most, whatever the input
    picked = (
        docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"))
        .where(F.col("__text").isNotNull())
        .join(chosen, "__id")
        .orderBy("__order", F.xxhash64("__text"))
        .limit(rows)
        .select("__text", "__label")
    )
    texts, ys, chars = [], [], 0
    for row in picked.toLocalIterator():
        chars += len(row["__text"])
        if chars > SAMPLE_CHARS and texts:
            break
        texts.append(row["__text"])
        ys.append(int(row["__label"]))
    return texts, np.array(ys, np.float32)


class Adam:
    """Adam over a dict of float32 arrays, changed in place."""

    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray], scale: float = 1.0) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        clip = min(1.0, 5.0 / (norm + 1e-9))
        for k, g in grads.items():
            g = g * clip
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            m, v = self.m[k] / (1 - 0.9**self.t), self.v[k] / (1 - 0.999**self.t)
            self.params[k] -= self.rate * scale * m / (np.sqrt(v) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))
