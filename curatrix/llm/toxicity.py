"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Inputs are words and characters: a word gives a learned vector (by hash), its prior and that of its first
characters (how much more documents of label 1 hold them than others, from the training rows only) and learned
vectors of its first and last characters and its length. Overlapping windows of words cover the whole document; a gated
recurrent layer reads each window both ways, attention pools the states, and one logit results. The
document's score is fitted to its highest window and the highest one apart from that, since what is toxic may
be scattered, corrected for how high the highest of so many windows of clean text gets.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from curatrix.llm import common, training

WINDOW = 32
STRIDE = 24
#: Inputs of a word that are no vector: its prior and that of its beginning.
PRIORS = 2
HIDDEN = 6
WORD_SLOTS, WORD_DIM = 1 << 13, 4
CHAR_SLOTS, CHAR_DIM = 1 << 11, 3
LENGTHS = 16
#: Characters at the start of a word that have a prior and a vector.
BEGINNING = 5
#: The lowest logit that counts in a document's score.
FLOOR = -4.0
#: Windows that run through the network together.
LANES = 2048
EPOCHS = 8
STEPS = 360
SEED = 11
#: Labelled rows it is fitted on, at most.
SAMPLE = 4000
#: Folds of the training rows: a row's priors come from the other folds.
FOLDS = 5
#: Training rows a word must stand in to have a vector of its own; all rarer ones share one.
SEEN = 4
#: Share of training words that are known by their prior alone: all but OPEN of them at ENOUGH rows of label 1,
#: and the fewer such rows there are, the nearer to all, since vectors learn few rows by heart.
OPEN, ENOUGH = 0.5, 2000
#: Size from which a prior counts: three rows of label 1 and no other give more, two do not.
SURE = 0.8
#: Words remembered by a task.
KNOWN = 200_000

_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def beginning(w: str) -> str:
    """The first characters of a word, marked so that they are no word themselves."""
    return "<" + w[:BEGINNING]


def prior(toxic: int, clean: int, toxic_rows: int, clean_rows: int) -> float:
    """Signed root of the likelihood ratio that a word is bound to label 1; rare words stay near 0."""
    n, p = toxic + clean, toxic_rows / max(1, toxic_rows + clean_rows)
    if not n or not 0 < p < 1:
        return 0.0
    g = 0.0
    if toxic:
        g += toxic * np.log(toxic / (n * p))
    if clean:
        g += clean * np.log(clean / (n * (1 - p)))
    return float(np.sign(toxic - n * p) * min(np.sqrt(max(2 * g, 0.0)), 12.0) / 4.0)


class Vocabulary:
    """Word to input numbers: priors of the word and of its beginning, word slot, slots of the first and last characters, length."""

    def __init__(self, priors: dict[str, float], known: set[str]):
        self.priors, self.known = priors, known

    def entry(self, w: str, priors: dict[str, float] | None = None) -> tuple[float, float, int, int, int, int]:
        def slot(s: str, n: int) -> int:
            return zlib.crc32(s.encode("utf-8", "surrogatepass")) % n

        priors = self.priors if priors is None else priors
        return priors.get(w, 0.0), priors.get(beginning(w), 0.0), 1 + slot(w, WORD_SLOTS - 1) if w in self.known else 0, slot(beginning(w), CHAR_SLOTS), slot(w[-4:] + ">", CHAR_SLOTS), min(len(w), LENGTHS) - 1


def document_counts(rows: list[set[str]], y: np.ndarray) -> tuple[Counter, Counter]:
    toxic, clean = Counter(), Counter()
    for r, t in zip(rows, y, strict=True):
        (toxic if t else clean).update(r)
    return toxic, clean


def make_priors(rows: list[set[str]], y: np.ndarray) -> dict[str, float]:
    toxic, clean = document_counts(rows, y)
    t, c = int(y.sum()), int(len(y) - y.sum())
    out = {w: prior(toxic[w], clean[w], t, c) for w in toxic.keys() | clean.keys()}
    return {w: p for w, p in out.items() if abs(p) > SURE}


class BiGru:
    """The gated network over windows. Inputs are (steps, lanes) index arrays with a mask."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> BiGru:
        def w(*shape, fan):
            return (rng.standard_normal(shape) / np.sqrt(fan)).astype(np.float32)

        width = PRIORS + WORD_DIM + 3 * CHAR_DIM
        p = {
            # vectors begin at nothing, so that a word or an ending never trained on says nothing
            "word": np.zeros((WORD_SLOTS, WORD_DIM), np.float32),
            "head": np.zeros((CHAR_SLOTS, CHAR_DIM), np.float32),
            "tail": np.zeros((CHAR_SLOTS, CHAR_DIM), np.float32),
            "length": np.zeros((LENGTHS, CHAR_DIM), np.float32),
            "attend": w(2 * HIDDEN, fan=2 * HIDDEN),
            "out": w(2 * HIDDEN, fan=2 * HIDDEN),
            "out_b": np.full(1, -1.0, np.float32),
        }
        for d in "fb":
            p["in_" + d] = w(width, 3 * HIDDEN, fan=width)
            p["bias_" + d] = np.zeros(3 * HIDDEN, np.float32)
            p["gate_" + d] = w(HIDDEN, 2 * HIDDEN, fan=HIDDEN)
            p["new_" + d] = w(HIDDEN, HIDDEN, fan=HIDDEN)
        return cls(p)

    def inputs(self, e: tuple[np.ndarray, ...]) -> np.ndarray:
        p = self.p
        return np.concatenate([e[0][..., None], e[1][..., None], p["word"][e[2]], p["head"][e[3]], p["tail"][e[4]], p["length"][e[5]]], axis=-1)

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(x @ self.p["in_" + d] + self.p["bias_" + d] for d in "fb")

    def run(self, g: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States (steps, lanes, HIDDEN) of direction ``d`` from projected inputs; masked steps keep the state."""
        gate, new = self.p["gate_" + d], self.p["new_" + d]
        steps = range(len(g)) if d == "f" else range(len(g) - 1, -1, -1)
        h = np.zeros((g.shape[1], HIDDEN), np.float32)
        out = np.empty((*g.shape[:2], HIDDEN), np.float32)
        for t in steps:
            zr = 1 / (1 + np.exp(-(g[t, :, : 2 * HIDDEN] + h @ gate)))
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            rh = r * h
            c = np.tanh(g[t, :, 2 * HIDDEN :] + rh @ new)
            m = mask[t][:, None]
            nxt = h + m * z * (c - h)
            if keep is not None:
                keep.append((t, h, z, r, c, rh, m))
            out[t] = h = nxt
        return out

    def pool(self, hs: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = hs @ self.p["attend"] + np.where(mask, 0, -1e9).astype(np.float32)
        a = np.exp(a - a.max(0))
        a /= a.sum(0)
        v = np.einsum("tb,tbh->bh", a, hs)
        return v @ self.p["out"] + self.p["out_b"][0], a, v

    def logits(self, gf: np.ndarray, gb: np.ndarray, mask: np.ndarray) -> np.ndarray:
        m = mask.astype(np.float32)
        return self.pool(np.concatenate([self.run(gf, m, "f"), self.run(gb, m, "b")], -1), mask)[0]

    def gradients(self, e: tuple[np.ndarray, ...], mask: np.ndarray, y: np.ndarray, weight: np.ndarray, blind: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """Gradients of the mean loss. ``blind`` marks words whose learned vectors are left out."""
        p = self.p
        x = self.inputs(e)
        if blind is not None:
            x[blind, PRIORS:] = 0
        m = mask.astype(np.float32)
        kept = {"f": [], "b": []}
        proj = dict(zip("fb", self.project(x), strict=True))
        hs = np.concatenate([self.run(proj[d], m, d, kept[d]) for d in "fb"], -1)
        logit, a, v = self.pool(hs, mask)
        err = (weight * (training.sigmoid(logit) - y) / len(y)).astype(np.float32)
        g = {"out": v.T @ err, "out_b": np.array([err.sum()], np.float32)}
        gv = err[:, None] * p["out"]
        ga = np.einsum("bh,tbh->tb", gv, hs)
        gs = a * (ga - (a * ga).sum(0))
        g["attend"] = np.einsum("tb,tbh->h", gs, hs)
        ghs = a[:, :, None] * gv + gs[:, :, None] * p["attend"]
        gx = np.zeros_like(x)
        for d, part in (("f", ghs[..., :HIDDEN]), ("b", ghs[..., HIDDEN:])):
            gate, new = p["gate_" + d], p["new_" + d]
            gp = np.zeros_like(proj[d])
            g_gate, g_new = np.zeros_like(gate), np.zeros_like(new)
            gh = np.zeros((x.shape[1], HIDDEN), np.float32)
            for t, h, z, r, c, rh, mt in reversed(kept[d]):
                gh = gh + part[t]
                gc = gh * mt * z * (1 - c * c)
                gz = gh * mt * (c - h) * z * (1 - z)
                grh = gc @ new.T
                gr = grh * h * r * (1 - r)
                gzr = np.concatenate([gz, gr], 1)
                gp[t] = np.concatenate([gzr, gc], 1)
                g_gate += h.T @ gzr
                g_new += rh.T @ gc
                gh = gh * (1 - mt * z) + grh * r + gzr @ gate.T
            g["gate_" + d], g["new_" + d] = g_gate, g_new
            g["in_" + d] = np.tensordot(x, gp, ((0, 1), (0, 1)))
            g["bias_" + d] = gp.sum((0, 1))
            gx += gp @ p["in_" + d].T
        if blind is not None:
            gx[blind] = 0
        at = PRIORS
        for name, ids, dim in (("word", e[2], WORD_DIM), ("head", e[3], CHAR_DIM), ("tail", e[4], CHAR_DIM), ("length", e[5], CHAR_DIM)):
            acc = np.zeros_like(p[name])
            np.add.at(acc, ids, gx[..., at : at + dim])
            g[name] = acc
            at += dim
        return g


def starts(n: int) -> np.ndarray:
    """First words of the windows that cover ``n`` words, STRIDE apart; one for a text without words."""
    return np.arange(max(1, -(-(n - (WINDOW - STRIDE)) // STRIDE))) * STRIDE


class Model:
    """Network, vocabulary and the weights of the summary of the windows."""

    def __init__(self, net: BiGru | None, vocabulary: Vocabulary | None, bend: np.ndarray = np.array([1.0, 0.0, 0.0, 0.0]), base: float = 0.5):
        self.net, self.vocabulary, self.bend, self.base = net, vocabulary, bend, base
        self._slots: dict[str, int] = {}
        self._rows: list[np.ndarray] = []

    def __getstate__(self):
        return (self.net, self.vocabulary, self.bend, self.base)

    def __setstate__(self, state):
        self.__init__(*state)

    def window_logits(self, docs: list[list[str]]) -> list[np.ndarray]:
        """The logits of all windows of each document."""
        ids, table = self._known(docs)
        lanes = [(i, s) for i, d in enumerate(ids) for s in starts(len(d)).tolist()]
        flat = np.concatenate([*ids, np.zeros(WINDOW, np.int64)])
        offset = np.concatenate([[0], np.cumsum([len(d) for d in ids])])
        owner = np.array([i for i, _ in lanes])
        first = np.array([s for _, s in lanes])
        sizes = np.array([len(d) for d in ids])
        out = np.empty(len(lanes), np.float32)
        steps = np.arange(WINDOW)[:, None]
        for at in range(0, len(lanes), LANES):
            o, s = owner[at : at + LANES], first[at : at + LANES]
            mask = (s + steps) < np.maximum(sizes[o], 1)  # a text without words is one unknown word
            g = table[np.where(mask & (sizes[o] > 0), flat[np.minimum(offset[o] + s + steps, len(flat) - 1)], 0)]
            out[at : at + LANES] = self.net.logits(g[..., : 3 * HIDDEN], g[..., 3 * HIDDEN :], mask)
        cuts = np.searchsorted(owner, np.arange(1, len(docs)))
        return np.split(out, cuts)

    def _known(self, docs: list[list[str]]) -> tuple[list[np.ndarray], np.ndarray]:
        """Word indices of the documents, and the projected inputs of every word index."""
        slots = self._slots
        if len(slots) > KNOWN or not slots:
            slots.clear()
            slots[""] = 0
            self._rows = [self._projected([""])]
        fresh: list[str] = []
        ids = []
        for d in docs:
            row = np.empty(len(d), np.int64)
            for i, w in enumerate(d):
                k = slots.get(w)
                if k is None:
                    k = slots[w] = len(slots)
                    fresh.append(w)
                row[i] = k
            ids.append(row)
        if fresh:
            self._rows.append(self._projected(fresh))
        if len(self._rows) > 1:
            self._rows = [np.concatenate(self._rows)]
        return ids, self._rows[0]

    def _projected(self, words: list[str]) -> np.ndarray:
        e = tuple(np.array(c) for c in zip(*map(self.vocabulary.entry, words), strict=True))
        return np.concatenate(self.net.project(self.net.inputs((*(c.astype(np.float32) for c in e[:PRIORS]), *e[PRIORS:]))), -1).astype(np.float32)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.net is None:
            return np.full(len(texts), self.base)
        out = np.empty(len(texts))
        group: list[int] = []
        docs: list[list[str]] = []
        n = 0
        for i, t in enumerate(texts):
            d = words_of(t)
            group.append(i)
            docs.append(d)
            n += len(d)
            if n > LANES * STRIDE or i == len(texts) - 1:
                tops = self.window_logits(docs)
                out[group] = training.sigmoid(np.array([summary(x) for x in tops]) @ self.bend)
                group, docs, n = [], [], 0
        return out


def fit(texts: list[str], y: np.ndarray, epochs: int = EPOCHS, batch: int = 128) -> Model:
    """A model trained on labelled texts; without both labels, one that always gives their mean.

    Labels are of documents, so each epoch trains on the window of each document that the words' priors
    (at first) or the network (then) find highest, and on random windows of clean documents."""
    if not len(y) or y.min() == y.max():
        return Model(None, None, base=float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(SEED)
    docs = [words_of(t) for t in texts]
    sets = [set(d) | {beginning(w) for w in d} for d in docs]
    fold = np.arange(len(docs)) % FOLDS
    priors = []
    for f in range(FOLDS):
        rest = [i for i in range(len(docs)) if fold[i] != f]
        priors.append(make_priors([sets[i] for i in rest], y[rest]))
    held = Counter(w for s in sets for w in s)
    vocabulary = Vocabulary(make_priors(sets, y), {w for w, n in held.items() if n >= SEEN})
    entries = []
    for i, d in enumerate(docs):
        e = [vocabulary.entry(w, priors[fold[i]]) for w in d] or [vocabulary.entry("")]
        entries.append(tuple(np.array(c) for c in zip(*e, strict=True)))
    net = BiGru.fresh(rng)
    rate = 0.02
    opt = training.Adam(net.p, rate)

    def lanes(picked: list[tuple[int, int]]):
        """Input arrays of windows (document, first word)."""
        cols = [np.zeros((WINDOW, len(picked)), np.float32 if k < PRIORS else np.int64) for k in range(PRIORS + 4)]
        mask = np.zeros((WINDOW, len(picked)), bool)
        for j, (i, s) in enumerate(picked):
            n = min(WINDOW, len(entries[i][0]) - s)
            mask[:n, j] = True
            for c, e in zip(cols, entries[i], strict=True):
                c[:n, j] = e[s : s + n]
        return tuple(cols), mask

    def every(i: int) -> list[tuple[int, int]]:
        return [(i, int(s)) for s in starts(len(docs[i]))]

    def all_logits(which: list[int]) -> list[np.ndarray]:
        jobs = [w for i in which for w in every(i)]
        got = []
        for at in range(0, len(jobs), LANES):
            e, mask = lanes(jobs[at : at + LANES])
            got.append(net.logits(*net.project(net.inputs(e)), mask))
        return np.split(np.concatenate(got), np.cumsum([len(every(i)) for i in which])[:-1])

    def by_prior(i: int) -> np.ndarray:
        top = np.array([np.sort(np.maximum(entries[i][0], entries[i][1])[s : s + WINDOW])[-3:].sum() for _, s in every(i)])
        return top

    highest = {i: int(by_prior(i).argmax()) for i in range(len(docs))}
    share = float(y.mean())
    blind = 1 - OPEN * min(1.0, float(y.sum()) / ENOUGH)
    # few rows make few steps an epoch: then more epochs, until there are STEPS
    epochs = max(epochs, min(80, -(-STEPS * batch // (2 * len(docs)))))
    for epoch in range(epochs):
        if epoch >= 2 and epoch % 2 == 0:
            for i, lg in zip(range(len(docs)), all_logits(list(range(len(docs)))), strict=True):
                highest[i] = int(lg.argmax())
        picked = [(i, highest[i] * STRIDE) for i in range(len(docs))]
        picked += [every(i)[int(rng.integers(len(every(i))))] for i in range(len(docs)) if not y[i]]
        order = rng.permutation(len(picked))
        for at in range(0, len(order), batch):
            part = [picked[j] for j in order[at : at + batch]]
            e, mask = lanes(part)
            yy = y[[i for i, _ in part]]
            weight = np.where(yy == 1, (0.5 / share) ** 0.5, 1.0).astype(np.float32)
            opt.step(net.gradients(e, mask, yy, weight, rng.random(mask.shape) < blind), 1 - 0.9 * epoch / epochs)
    model = Model(net, vocabulary)
    model.bend = _bent(all_logits(list(range(len(docs)))), y)
    return model


def summary(logits: np.ndarray) -> tuple[float, float, float, float]:
    """What the score of a document rests on: its highest window, the highest of those that share no word with
    that one (FLOOR where there is none, and at least), the log of the number of windows, and 1."""
    top = int(logits.argmax())
    away = np.abs(np.arange(len(logits)) - top) * STRIDE >= WINDOW
    second = float(logits[away].max()) if away.any() else FLOOR
    return max(float(logits[top]), FLOOR), max(second, FLOOR), float(np.log(len(logits))), 1.0


def _bent(logits: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Logistic fit of the label to the summaries, drawn to the highest logit as it is."""
    x = np.array([summary(v) for v in logits])
    heavy = np.where(y == 1, (0.5 / y.mean()) ** 0.5, 1.0)  # as in training
    rest, toward = np.array([1.0, 1.0, 1.0, 0.1]), np.array([1.0, 0.0, 0.0, 0.0])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((heavy * (np.logaddexp(0, z) - y * z)).sum() + (rest * (w - toward) ** 2).sum() / 2)

    w = toward.copy()
    for _ in range(50):
        p = training.sigmoid(x @ w)
        h = (x * (heavy * p * (1 - p))[:, None]).T @ x + np.diag(rest)
        step = np.linalg.solve(h, x.T @ (heavy * (p - y)) + rest * (w - toward))
        size = 1.0
        while loss(w - size * step) > loss(w) and size > 1e-4:
            size /= 2
        w = w - size * step
    return np.maximum(w, [0.05, 0.0, -np.inf, -np.inf])


def scorer(model: Model):
    """UDF of a text column: the probability of label 1. Null counts as empty."""

    @pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.round(model.scores(list(texts)), 6))

    return run


def learnable(doc_id: Column) -> Column:
    return training.remainder(doc_id, 5) != 0


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Model:
    """Fits on labelled rows whose id's crc32 modulo 5 is not 0, ``rows`` of them at most."""
    return fit(*training.sample(docs, labels, "toxic", learnable, rows=rows))


def op4_recurrent_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document: doc_id, held_out, score, predicted.

    Every row has a score: null and wordless texts that of one unknown word, very long ones by all
    their windows; repeated rows equal ones. Without labels of both kinds the score is their mean."""
    common.small_batches(spark)
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    scored = docs.select("doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), scorer(train(docs, labels))(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
