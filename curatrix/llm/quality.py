"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are dealt to overlapping chunks that cover all of it. Learned filters run
over the embedded bytes of each chunk; their rectified outputs are max-pooled (is the pattern there)
and averaged (how much of it) per chunk. A dense layer turns these into chunk features, whose mean
and maximum over the chunks give one probability per document.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from curatrix.llm import common, training

EMBED = 4
WIDTH = 6
FILTERS = 16
HIDDEN = 12
CHUNK = 512
#: The last bytes of a chunk are the first of the next.
OVERLAP = 64
#: Positions filtered at a time: what is in hand stays in the processor's cache.
PART = 32 * OVERLAP
#: Labelled rows it is fitted on, at most.
SAMPLE = 2500
#: Chunks of a training text that an epoch learns from, at most: another run of them in each epoch. Scores use all.
SPAN = 12
EPOCHS = 6
SEED = 7


def _padded(size: int) -> int:
    """Positions given to a text: whole cells, as many as its chunks need."""
    step = CHUNK - OVERLAP
    n = max(1, -(-(size - OVERLAP) // step))
    return (n - 1) * step + CHUNK


def _lengths(size: int, n: int) -> np.ndarray:
    """The positions of each chunk that lie inside the text (one at least)."""
    return np.clip(size - (CHUNK - OVERLAP) * np.arange(n), 1, CHUNK).astype(np.float32)


def _fold(a: np.ndarray, op) -> np.ndarray:
    """``op`` over the middle axis, whose length is a power of two."""
    while a.shape[1] > 1:
        half = a.shape[1] // 2
        a = op(a[:, :half], a[:, half:])
    return a[:, 0]


class ByteNet:
    def __init__(self, params: dict[str, np.ndarray] | None = None, prior: float = 0.5):
        self.prior = prior
        self.p = params

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> ByteNet:
        def w(*shape, fan):
            return (rng.standard_normal(shape) / np.sqrt(fan)).astype(np.float32)

        return cls(
            {
                "embed": w(256, EMBED, fan=1),
                "conv": w(WIDTH * EMBED, FILTERS, fan=WIDTH * EMBED),
                "conv_b": np.zeros(FILTERS, np.float32),
                "dense": w(2 * FILTERS, HIDDEN, fan=2 * FILTERS),
                "dense_b": np.zeros(HIDDEN, np.float32),
                "out": w(2 * HIDDEN, fan=2 * HIDDEN),
                "out_b": np.zeros(1, np.float32),
            }
        )

    def filtered(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rectified filter outputs (n, FILTERS) at every byte of ``x`` but its last WIDTH - 1, and what was filtered."""
        e = np.take(self.p["embed"], x, axis=0).reshape(-1)
        flat = np.ascontiguousarray(sliding_window_view(e, WIDTH * EMBED)[::EMBED])
        a = flat @ self.p["conv"]
        a += self.p["conv_b"]
        return np.maximum(a, 0, out=a), flat

    def pooled(self, cells_max: np.ndarray, cells_sum: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(chunks, 2 * FILTERS): maximum and mean of each filter over each chunk, from those of its cells."""
        per, step = CHUNK // OVERLAP, CHUNK // OVERLAP - 1
        k = (len(cells_max) - per) // step + 1
        at = np.arange(k)[:, None] * step + np.arange(per)
        n = _lengths(size, k)
        return np.concatenate([cells_max[at].max(1), cells_sum[at].sum(1) / n[:, None]], axis=1), n

    def logit(self, z: np.ndarray) -> tuple[float, np.ndarray]:
        h = np.tanh(z @ self.p["dense"] + self.p["dense_b"])
        d = np.concatenate([h.mean(0), h.max(0)])
        return float(d @ self.p["out"] + self.p["out_b"][0]), h

    def cells(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Maximum and sum of each filter over cells of OVERLAP bytes; a long text goes through in parts."""
        wide = _padded(len(text))
        x = np.zeros(wide + WIDTH - 1, np.uint8)
        x[: len(text)] = np.frombuffer(text, np.uint8)
        tops, sums = [], []
        for at in range(0, wide, PART):
            a, _ = self.filtered(x[at : min(at + PART, wide) + WIDTH - 1])
            if at + len(a) > len(text):
                a[max(len(text) - at, 0) :] = 0
            a = a.reshape(-1, OVERLAP, FILTERS)
            tops.append(_fold(a, np.maximum))
            sums.append(_fold(a, np.add))
        return (tops[0], sums[0]) if len(tops) == 1 else (np.concatenate(tops), np.concatenate(sums))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.p is None:
            return np.full(len(texts), self.prior)
        return training.sigmoid(np.array([self.logit(self.pooled(*self.cells(t), len(t))[0])[0] for t in texts], np.float64))

    def gradients(self, text: bytes, y: float, weight: float) -> dict[str, np.ndarray]:
        p = self.p
        wide = _padded(len(text))
        x = np.zeros(wide + WIDTH - 1, np.uint8)
        x[: len(text)] = np.frombuffer(text, np.uint8)
        a, flat = self.filtered(x)
        a[len(text) :] = 0
        cells = a.reshape(-1, OVERLAP, FILTERS)
        z, n = self.pooled(_fold(cells, np.maximum), _fold(cells, np.add), len(text))
        logit, h = self.logit(z)
        err = np.float32(weight * (training.sigmoid(np.float64(logit)) - y))
        d = np.concatenate([h.mean(0), h.max(0)])
        g = {"out": err * d, "out_b": np.array([err], np.float32)}
        gd = err * p["out"]
        gh = np.repeat(gd[None, :HIDDEN] / len(h), len(h), 0)
        gh[h.argmax(0), np.arange(HIDDEN)] += gd[HIDDEN:]
        gh *= 1 - h * h
        g["dense"], g["dense_b"] = z.T @ gh, gh.sum(0)
        gz = gh @ p["dense"].T
        ga = np.zeros_like(a)
        for c in range(len(z)):
            at = c * (CHUNK - OVERLAP)
            part = ga[at : at + CHUNK]
            part += gz[c, FILTERS:] / n[c]
            part[a[at : at + CHUNK].argmax(0), np.arange(FILTERS)] += gz[c, :FILTERS]
        ga *= a > 0
        g["conv"], g["conv_b"] = flat.T @ ga, ga.sum(0)
        back = (ga @ p["conv"].T).reshape(wide, WIDTH, EMBED)
        ge = np.zeros((len(x), EMBED), np.float32)
        for k in range(WIDTH):
            ge[k : k + wide] += back[:, k]
        g["embed"] = np.stack([np.bincount(x, ge[:, j], 256) for j in range(EMBED)], 1).astype(np.float32)
        return g


def fit(texts: list[str], y: np.ndarray, epochs: int = EPOCHS, batch: int = 8) -> ByteNet:
    """A network trained on labelled texts; without both labels, one that always gives their mean.

    Of a very long training text a random run of SPAN chunks is used in each epoch (scores use all)."""
    if not len(y) or y.min() == y.max():
        return ByteNet(None, float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(SEED)
    net = ByteNet.fresh(rng)
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) ** 0.5
    span = SPAN * CHUNK
    opt = training.Adam(net.p, 0.004)
    total = epochs * -(-len(raw) // batch)
    done = 0
    for _ in range(epochs):
        order = rng.permutation(len(raw))
        for at in range(0, len(order), batch):
            sums: dict[str, np.ndarray] = {}
            for i in order[at : at + batch]:
                t = raw[i]
                if len(t) > span:
                    s = int(rng.integers(0, len(t) - span))
                    t = t[s : s + span]
                for k, v in net.gradients(t, float(y[i]), float(balance[i])).items():
                    sums[k] = sums.get(k, 0) + v / batch
            opt.step(sums, 1.0 - 0.9 * done / total)
            done += 1
    return net


def scorer(net: ByteNet):
    """UDF of a text column: the probability of label 1. Null counts as empty."""

    @pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.round(net.scores([(t or "").encode("utf-8", "surrogatepass") for t in texts]), 6))

    return run


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> ByteNet:
    """Fits on labelled rows whose id's crc32 modulo 3 is not 1, ``rows`` of them at most."""
    return fit(*training.sample(docs, labels, "quality", learnable, rows=rows))


def learnable(doc_id: Column) -> Column:
    return training.remainder(doc_id, 3) != 1


def accepted(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the rows that the classifier scores below one half."""
    common.small_batches(docs.sparkSession)
    return docs.where(scorer(train(docs, labels))(F.col(text)) >= 0.5)


def op5_byte_convolution(spark, sf_dir: str) -> DataFrame:
    """Quality of every document: doc_id, held_out, score, predicted.

    Every row has a score: null and empty texts that of the empty text, very long ones by all their
    chunks; repeated rows equal ones. Without labels of both kinds the score is their mean."""
    common.small_batches(spark)
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    scored = docs.select("doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), scorer(train(docs, labels))(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
