"""Secret scans: base patterns, and a character convolutional network over every candidate.

The base findings are exact patterns and always stay. Candidates are these and every other token of 20 or
more characters of keys; the network reads each one whole together with the characters around it and gives it a
calibrated probability. Tokens outside the base findings are added where it reaches the threshold. The network
is trained in numpy on labelled findings. Some of them, among these all findings of forms that training does
not see, calibrate the probability (Platt's fit) and set the threshold: the highest value that keeps the
required recall.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType, StringType, StructField, StructType

from curatrix.llm import common, training

#: The base patterns and the least lengths of what they find. Fixed values.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE = 6
KINDS = ("assign", "access", "hex", "model")

#: Least characters of a candidate; dots only join its parts.
LEAST = 20
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=.-]{{{LEAST},}}")
LEFT, RIGHT = 24, 8
EMBED, WIDTH, FILTERS, HIDDEN = 6, 5, 16, 12
RECALL = 0.98
SEED = 5
FINDINGS = 2400
#: Positions filtered at a time, so a candidate of any length takes little memory.
PART = 8192


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, by start, then kind as listed."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans of all long tokens of the characters of keys, without dots at their ends."""
    out = []
    for m in CANDIDATE.finditer(text):
        token = m[0]
        start, end = m.start() + len(token) - len(token.lstrip(".")), m.end() - len(token) + len(token.rstrip("."))
        if end - start >= LEAST:
            out.append((start, end))
    return out


# ---------------------------------------------------------------- labelled findings


def labelled_findings(n: int = FINDINGS, seed: int = SEED) -> list[tuple[str, int, int, int, bool]]:
    """``n`` findings (text, start, end, label, late) drawn from rules: keys of known forms, and look-alikes.

    ``late`` marks forms that are kept for calibration."""
    rng = np.random.default_rng(seed)
    up, low, digit, hexa = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
    syllables = ("th er on an re he in ed nd ha at en es of or nt ea ti to it ich sch ver keit ung lich ge be pf tz au ein eur eux tion ment elle que re tre mos cion ado gar mente boc llo ja").split()

    def draw(chars: str, lo: int, hi: int) -> str:
        return "".join(chars[i] for i in rng.integers(0, len(chars), int(rng.integers(lo, hi + 1))))

    def word(lo: int = 2, hi: int = 5) -> str:
        return "".join(syllables[i] for i in rng.integers(0, len(syllables), int(rng.integers(lo, hi + 1))))

    def prose(k: int) -> str:
        return " ".join(word() for _ in range(k))

    def joined(by: str, lo: int, hi: int) -> str:
        return by.join(word(1, 4) for _ in range(int(rng.integers(lo, hi + 1))))

    alnum = up + low + digit
    #: (maker, whether it is kept for calibration)
    secret = (
        (lambda: "ghp_" + draw(alnum, 36, 36), False),
        (lambda: "sk-" + draw(alnum, 32, 48), False),
        (lambda: "xoxb-" + draw(digit, 10, 12) + "-" + draw(alnum, 24, 24), False),
        (lambda: ".".join(("eyJ" + draw(alnum, 17, 40), "eyJ" + draw(alnum + "-_", 30, 120), draw(alnum + "-_", 40, 43))), False),
        (lambda: draw(alnum + "+/", 38, 88) + "=" * int(rng.integers(0, 3)), False),
        (lambda: draw(up + digit, 24, 40), False),
        (lambda: draw(alnum, 24, 64), False),
        (lambda: draw(up + low, 24, 48), False),
        (lambda: draw(low, 28, 40), False),
        (lambda: draw(low + digit, 24, 40), False),
        (lambda: draw("0123456789ABCDEF", 32, 64), False),
        (lambda: word(1, 2) + pick("_", "-") + draw(alnum, 24, 40), False),
        (lambda: pick("gho_", "tok_", "") + "".join(pick("0123456789", "12345678", "AbCdEf", "abcdef", "ABCDEF", draw(alnum, 5, 9)) for _ in range(int(rng.integers(4, 7)))), False),
        (lambda: "sk_live_" + draw(alnum, 24, 32), True),
        (lambda: "AIza" + draw(alnum + "-_", 35, 35), True),
        (lambda: draw(alnum + "-_", 43, 43), True),
        (lambda: draw(up, 26, 32), True),
    )
    plain = (
        (lambda: "-".join(draw(hexa, k, k) for k in (8, 4, 4, 4, 12)), False),
        (lambda: joined("/", 4, 7) + pick("", "/v" + draw(digit, 1, 2)), False),
        (lambda: joined("_", 4, 6) + pick("", "_" + draw(digit, 1, 4)), False),
        (lambda: word(8, 12), False),
        (lambda: word(8, 12) + draw(digit, 1, 3), False),
        (lambda: "".join(word().capitalize() for _ in range(int(rng.integers(4, 8)))), False),
        (lambda: joined("-", 4, 7) + pick("", "-" + draw("12", 4, 4)), False),
        (lambda: pick("===", "---", "==") + word(5, 8) + pick("=", "-", "_") * int(rng.integers(18, 60)), False),
        (lambda: pick("=", "-", "_", ".-", "x", "a", "0", "+-", *low, *digit) * int(rng.integers(24, pick(70, 700))), False),
        (lambda: "2023-" + draw(digit, 2, 2) + "-" + draw(digit, 2, 2) + "T" + draw(digit, 6, 6) + "Z" + draw(digit, 2, 4), False),
        (lambda: draw(digit, 1, 2) + "." + draw(digit, 20, 30), False),
        (lambda: word().upper() + "_" + joined("_", 3, 4).upper(), False),
        (lambda: "www." + joined(".", 2, 3) + ".com/" + joined("/", 1, 4), False),
        (lambda: joined("-", 3, 5) + pick(".tar.gz", ".html", ".pdf", "_v2.docx"), False),
        (lambda: pick("and/or", "he/she") + "/" + joined("/", 3, 4), False),
        (lambda: word(1, 3) * int(rng.integers(6, pick(9, 90))), False),
        (lambda: joined(".", 4, 6), True),
        (lambda: word(9, 14).upper(), True),
        (lambda: joined("--", 3, 5) + ".." + word(), True),
    )

    def pick(*of):
        return of[int(rng.integers(len(of)))]

    lead = ("", "key ", "Authorization: Bearer ", "credential ", "export X_KEY ", "use ", "id ", "see ", "file ", "at ", "the ", "(", "<")
    out = []
    while len(out) < n:
        label = len(out) % 2
        make, late = pick(*(secret if label else plain))
        token = make().strip(".")
        if len(token) < LEAST:
            continue
        before = prose(int(rng.integers(0, 5))) + pick(" ", "\n", ": ") + pick(*lead)
        out.append((before + token + pick(" ", ". ", "\n", ")") + prose(int(rng.integers(0, 4))), len(before), len(before) + len(token), label, late))
    return out


# ---------------------------------------------------------------- network


def codes(text: str, start: int, end: int) -> tuple[np.ndarray, int, int]:
    """Character codes of a candidate and its surroundings, and where in them the candidate lies."""
    lo = max(0, start - LEFT)
    near = text[lo : end + RIGHT].rjust(WIDTH + end + RIGHT - lo, " ")
    x = np.minimum(np.frombuffer(near.encode("utf-32-le", "surrogatepass"), np.uint32), 128).astype(np.int64)
    shift = len(near) - (min(len(text), end + RIGHT) - lo)
    return x, start - lo + shift, end - lo + shift


class CharNet:
    def __init__(self):
        rng = np.random.default_rng(SEED)

        def w(*shape, fan):
            return (rng.standard_normal(shape) / np.sqrt(fan)).astype(np.float32)

        self.p = {
            "embed": w(129, EMBED, fan=2),
            "conv": w(WIDTH * EMBED, FILTERS, fan=WIDTH * EMBED),
            "conv_b": np.zeros(FILTERS, np.float32),
            "dense": w(3 * FILTERS, HIDDEN, fan=3 * FILTERS),
            "dense_b": np.zeros(HIDDEN, np.float32),
            "out": w(HIDDEN, fan=HIDDEN),
            "out_b": np.zeros(1, np.float32),
        }
        self.bend, self.threshold, self.precision = (1.0, 0.0), 0.5, 0.0

    def forward(self, x: np.ndarray, start: int, end: int):
        """Filters over all characters; pooled by maximum and mean inside, by maximum over the surroundings."""
        p = self.p
        e = p["embed"][x]
        n = len(x) - WIDTH + 1
        flat = np.concatenate([e[k : k + n] for k in range(WIDTH)], 1)
        a = np.maximum(flat @ p["conv"] + p["conv_b"], 0)
        inside = np.zeros(n, bool)
        inside[max(0, start - WIDTH // 2) : max(1, min(n, end - WIDTH // 2))] = True
        around = ~inside if not inside.all() else inside
        z = np.concatenate([a[inside].max(0), a[inside].mean(0), a[around].max(0)])
        h = np.tanh(z @ p["dense"] + p["dense_b"])
        return float(h @ p["out"] + p["out_b"][0]), (flat, a, inside, around, z, h)

    def gradients(self, x: np.ndarray, start: int, end: int, y: int) -> dict[str, np.ndarray]:
        p = self.p
        logit, (flat, a, inside, around, z, h) = self.forward(x, start, end)
        err = np.float32(training.sigmoid(np.float64(logit)) - y)
        gh = err * p["out"] * (1 - h * h)
        g = {"out": err * h, "out_b": np.array([err], np.float32), "dense": np.outer(z, gh), "dense_b": gh}
        gz = p["dense"] @ gh
        ga = np.zeros_like(a)
        cols = np.arange(FILTERS)
        where = np.flatnonzero(inside)
        ga[where[a[inside].argmax(0)], cols] += gz[:FILTERS]
        ga[inside] += gz[FILTERS : 2 * FILTERS] / len(where)
        ga[np.flatnonzero(around)[a[around].argmax(0)], cols] += gz[2 * FILTERS :]
        ga *= a > 0
        g["conv"], g["conv_b"] = flat.T @ ga, ga.sum(0)
        back = (ga @ p["conv"].T).reshape(len(a), WIDTH, EMBED)
        ge = np.zeros((129, EMBED), np.float32)
        for k in range(WIDTH):
            np.add.at(ge, x[k : k + len(a)], back[:, k])
        g["embed"] = ge
        return g

    def logit(self, x: np.ndarray, start: int, end: int) -> float:
        """What :func:`forward` gives, a part of the positions at a time."""
        p, n = self.p, len(x) - WIDTH + 1
        if n <= PART:
            return self.forward(x, start, end)[0]
        lo, hi = max(0, start - WIDTH // 2), max(1, min(n, end - WIDTH // 2))
        top, total, around = np.zeros(FILTERS, np.float32), np.zeros(FILTERS, np.float64), np.zeros(FILTERS, np.float32)
        for at in range(0, n, PART):
            k = min(PART, n - at)
            e = p["embed"][x[at : at + k + WIDTH - 1]]
            a = np.maximum(np.concatenate([e[j : j + k] for j in range(WIDTH)], 1) @ p["conv"] + p["conv_b"], 0)
            inside = (np.arange(at, at + k) >= lo) & (np.arange(at, at + k) < hi)
            if inside.any():
                top, total = np.maximum(top, a[inside].max(0)), total + a[inside].sum(0, dtype=np.float64)
            if not inside.all():
                around = np.maximum(around, a[~inside].max(0))
        z = np.concatenate([top, (total / (hi - lo)).astype(np.float32), around if hi - lo < n else top])
        h = np.tanh(z @ p["dense"] + p["dense_b"])
        return float(h @ p["out"] + p["out_b"][0])

    def probability(self, text: str, start: int, end: int) -> float:
        return float(training.sigmoid(np.float64(self.bend[0] * self.logit(*codes(text, start, end)) + self.bend[1])))


def fit(findings: list[tuple[str, int, int, int, bool]] | None = None, epochs: int = 8, batch: int = 16, recall: float = RECALL) -> CharNet:
    """Trains on four fifths of the findings of the forms that are not late; calibrates and sets the threshold on all others."""
    findings = labelled_findings() if findings is None else findings
    rng = np.random.default_rng(SEED)
    items = [(*codes(*findings[i][:3]), findings[i][3], findings[i][4]) for i in rng.permutation(len(findings))]
    seen = [f for f in items if not f[4]]
    cut = len(seen) * 4 // 5
    learn, rest = seen[:cut], seen[cut:] + [f for f in items if f[4]]
    net = CharNet()
    opt = training.Adam(net.p, 0.005)
    for epoch in range(epochs):
        turn = rng.permutation(len(learn))
        for at in range(0, len(turn), batch):
            sums: dict[str, np.ndarray] = {}
            for i in turn[at : at + batch]:
                for k, v in net.gradients(*learn[i][:4]).items():
                    sums[k] = sums.get(k, 0) + v / batch
            opt.step(sums, 1 - 0.8 * epoch / epochs)
    logits = np.array([net.logit(*f[:3]) for f in rest])
    y = np.array([f[3] for f in rest])
    more, less = float((y == 1).sum()), float((y == 0).sum())
    if not more or not less:
        net.threshold = 1.0
        return net
    goal = np.where(y == 1, (more + 1) / (more + 2), 1 / (less + 2))  # no finding is certain
    a, b = 1.0, 0.0
    for _ in range(60):  # Newton steps of Platt's fit, with a weak prior
        q = training.sigmoid(a * logits + b)
        w = q * (1 - q)
        h = np.array([[(w * logits**2).sum() + 0.1, (w * logits).sum()], [(w * logits).sum(), w.sum() + 0.1]])
        a, b = np.array([a, b]) - np.linalg.solve(h, np.array([((q - goal) * logits).sum() + 0.1 * (a - 1), (q - goal).sum() + 0.1 * b]))
    net.bend = (float(max(a, 1e-3)), float(b))
    said = training.sigmoid(net.bend[0] * logits + net.bend[1])
    found = np.sort(said[y == 1])
    net.threshold = float(found[int((1 - recall) * len(found))])  # the highest that keeps the recall
    net.precision = float((y[said >= net.threshold] == 1).mean())
    return net


def scan(text: str | None, net: CharNet) -> list[tuple[int, int, str, float]]:
    """All spans (start, end, kind, probability) of a text, by start, then kind as listed. Null: none."""
    t = text or ""
    base = base_spans(t)
    out = [(s, e, k, net.probability(t, s, e)) for s, e, k in base]
    for start, end in candidates(t):
        if not any(s < end and start < e for s, e, _ in base) and (p := net.probability(t, start, end)) >= net.threshold:
            out.append((start, end, "model", p))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _joined(spans: list[tuple[int, int, str, float]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k, _ in spans)


_RESULT = StructType([*[StructField(f"n_{k}", LongType()) for k in KINDS], StructField("base_sha256", StringType()), StructField("spans", StringType()), StructField("scores", StringType())])


def scanner(net: CharNet):
    """UDF of a text column: counts by kind, digest of the base spans, all spans (kind:start:end in code points), and
    the network's probability of each span."""

    @pandas_udf(_RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            spans = scan(t, net)
            kinds = [k for _, _, k, _ in spans]
            base = _joined([s for s in spans if s[2] != "model"])
            rows.append((*[kinds.count(k) for k in KINDS], hashlib.sha256(base.encode()).hexdigest(), _joined(spans), ",".join(f"{p:.4f}" for *_, p in spans)))
        return pd.DataFrame(rows, columns=[f.name for f in _RESULT])

    return run


def op7_character_convolution(spark, sf_dir: str) -> DataFrame:
    """Secrets in every document: doc_id, n_assign, n_access, n_hex, n_model, base_sha256, spans, scores.

    Null and empty texts have none (the digest is that of an empty string); very long texts and tokens are
    read whole; repeated rows equal ones; an empty table gives no rows; other columns are not read."""
    common.small_batches(spark)
    docs = common.table(spark, sf_dir, "documents")
    return docs.select("doc_id", scanner(fit())(F.col("text")).alias("r")).select("doc_id", "r.*")
