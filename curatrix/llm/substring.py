"""Exact substring de-duplication with difference-cover anchors.

A set D is a difference cover modulo v if any two positions can be moved forward by the same d < v so
that both fall on D modulo v. So if two windows of L words are equal, both have an anchor (a window of
L - v + 1 words that starts on D modulo v, counted from the start of its document) at the same
distance from their starts. With v = 21 five positions in 21 suffice, and only those are hashed. An
anchor that occurs once extends to no match; around one that occurs again the full windows are
hashed with 128 bits and compared, which settles every window.

Hot passages: a batch of documents sends one row for each different anchor or window it holds and
settles the occurrences inside the batch by itself, so a passage in a third of all documents meets
only once per batch, never once per document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType, StringType, StructField, StructType

from curatrix.llm import common

WINDOW = 35
#: A perfect difference set: every residue modulo 21 is a difference of two members. Fixed values.
PERIOD = 21
COVER = (0, 1, 4, 14, 16)
#: Bytes hashed at a time; a longer document is a chunk of its own.
CHUNK = 1 << 20

_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_BYTE_BASE = 0xA24BAED4963EE407


def _powers(base: int, n: int, _kept: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """base**i and base**-i modulo 2**64 for i < n at least."""
    have = _kept.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _kept[base] = have = np.cumprod(up), np.cumprod(down)
    return have


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _spans(values: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of values[start:end], each independent of where it stands."""
    up, down = _powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return _mix((total[ends] - total[starts]) * down[starts])


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and for each text the index of its first word (one more at the end)."""
    buf = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[buf]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    offsets = np.cumsum([1, *[len(t) + 1 for t in texts]])
    first = np.searchsorted(starts, offsets)
    return _spans(buf.astype(np.uint64) + np.uint64(1), _BYTE_BASE, starts, ends), first


def _chunks(texts: list[bytes]):
    """Ranges of texts of about CHUNK bytes together."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _once(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks: the first of each value, and all members of values that occur again."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    head = np.ones(len(s), bool)
    head[1:] = s[1:] != s[:-1]
    again = np.zeros(len(s), bool)
    again[1:] |= ~head[1:]
    again[:-1] |= ~head[1:]
    first, many = np.zeros(len(s), bool), np.zeros(len(s), bool)
    first[order], many[order] = head, again
    return first, many


def _distinct(batch: pd.DataFrame) -> pd.DataFrame:
    return batch.drop_duplicates(["k1", "k2"])


def _anchor_rows(window: int):
    width = window - PERIOD + 1

    def run(batches):
        for batch in batches:
            batch = _distinct(batch)
            texts = [t.encode("utf-8", "surrogatepass") for t in batch["text"]]
            hs, rows, poss = [], [], []
            for lo, hi in _chunks(texts):
                words, first = word_hashes(texts[lo:hi])
                n = np.diff(first)
                owner = np.repeat(np.arange(len(n)), n)
                pos = np.arange(len(words)) - first[owner]
                on = np.isin(pos % PERIOD, COVER) & (pos + width <= n[owner]) & (n[owner] >= window)
                at = np.flatnonzero(on)
                hs.append(_spans(words, _BASES[0], at, at + width))
                rows.append(owner[at] + lo)
                poss.append(pos[at])
            if not hs:
                continue
            h, row, pos = (np.concatenate(x) for x in (hs, rows, poss))
            first, many = _once(h)
            pick = np.concatenate([np.flatnonzero(first), np.flatnonzero(many)])
            sure = np.arange(len(pick)) >= first.sum()
            k1, k2 = batch["k1"].to_numpy()[row[pick]], batch["k2"].to_numpy()[row[pick]]
            # a settled row needs no meeting: it is dealt out by its own text
            h = np.where(sure, k1 + pos[pick], h[pick].view(np.int64))
            yield pd.DataFrame({"h": h, "k1": k1, "k2": k2, "pos": pos[pick].astype(np.int32), "sure": sure})

    return run


def _window_rows(window: int):
    width = window - PERIOD + 1

    def run(batches):
        for batch in batches:
            batch = _distinct(batch)
            texts = [t.encode("utf-8", "surrogatepass") for t in batch["text"]]
            found = [np.asarray([] if p is None else p, np.int64) for p in batch["positions"]]
            w1s, w2s, rows, poss = [], [], [], []
            for lo, hi in _chunks(texts):
                words, first = word_hashes(texts[lo:hi])
                starts, owners = [], []
                for i in range(lo, hi):
                    n = int(first[i - lo + 1] - first[i - lo])
                    p = found[i]
                    if n < window or not len(p):
                        continue
                    # windows that hold the anchor whole start at most PERIOD - 1 words before it
                    edge = np.zeros(n + 1, np.int32)
                    np.add.at(edge, np.maximum(p - (window - width), 0), 1)
                    np.add.at(edge, p + 1, -1)
                    s = np.flatnonzero(np.cumsum(edge)[: n - window + 1] > 0)
                    starts.append(s + first[i - lo])
                    owners.append(np.full(len(s), i))
                    poss.append(s)
                if starts:
                    at = np.concatenate(starts)
                    w1s.append(_spans(words, _BASES[0], at, at + window))
                    w2s.append(_spans(_mix(words ^ np.uint64(_BASES[1])), _BASES[1], at, at + window))
                    rows.append(np.concatenate(owners))
            if not w1s:
                continue
            w1, w2, row, pos = (np.concatenate(x) for x in (w1s, w2s, rows, poss))
            first, many = _once(w1 ^ _mix(w2))
            pick = np.concatenate([np.flatnonzero(first), np.flatnonzero(many)])
            sure = np.arange(len(pick)) >= first.sum()
            k1, k2 = batch["k1"].to_numpy()[row[pick]], batch["k2"].to_numpy()[row[pick]]
            yield pd.DataFrame(
                {
                    "w1": np.where(sure, k1 + pos[pick], w1[pick].view(np.int64)),
                    "w2": np.where(sure, k2, w2[pick].view(np.int64)),
                    "k1": k1,
                    "k2": k2,
                    "pos": pos[pick].astype(np.int32),
                    "sure": sure,
                }
            )

    return run


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _removal(window: int):
    def run(batches):
        for batch in batches:
            batch = _distinct(batch)
            out = []
            for k1, k2, text, starts, whole in zip(
                batch["k1"], batch["k2"], batch["text"], batch["starts"], batch["whole"], strict=True
            ):
                words = text.encode("utf-8", "surrogatepass").split()
                n = len(words)
                edge = np.zeros(n + 1, np.int32)
                if whole and n >= window:
                    edge[0] = 1
                if starts is not None and len(starts):
                    s = np.asarray(starts, np.int64)
                    np.add.at(edge, s, 1)
                    np.add.at(edge, s + window, -1)
                gone = np.cumsum(edge)[:n] > 0
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                out.append((k1, k2, int(gone.sum()), " ".join(w.decode("utf-8", "surrogatepass") for w in kept), _digest(kept)))
            yield pd.DataFrame(out, columns=["k1", "k2", "n_removed", "kept_text", "kept_sha256"])

    return run


@pandas_udf(StructType([StructField("n_words", LongType()), StructField("sha", StringType())]))
def _whole(texts: pd.Series) -> pd.DataFrame:
    words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    return pd.DataFrame({"n_words": [len(w) for w in words], "sha": [_digest(w) for w in words]}, columns=["n_words", "sha"])


def repeated_windows(docs: DataFrame, text: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """What repeats, by text: (texts, starts).

    ``texts`` (k1, k2, text, whole, positions): each text, once, that shares an anchor with another place,
    or whose whole row repeats (whole); ``starts`` (k1, k2, starts): the starts of its windows that
    also start elsewhere, but for those of whole repeats."""
    if window <= PERIOD:
        raise ValueError(f"a window has more than {PERIOD} words")
    common.small_batches(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    k1, k2 = common.text_keys(body)
    keyed = docs.select(k1.alias("k1"), k2.alias("k2"), body.alias("text"))
    anchors = keyed.mapInPandas(_anchor_rows(window), "h long, k1 long, k2 long, pos int, sure boolean")
    meet = Window.partitionBy("h")
    loose = F.when(~F.col("sure"), F.col("k1"))
    shared = (
        anchors.withColumns({"least": F.min(loose).over(meet), "most": F.max(loose).over(meet)})
        .where("sure or least != most")
        .select("k1", "k2", "pos")
    )
    places = common.written(shared.groupBy("k1", "k2").agg(F.collect_set("pos").alias("positions")), "places")
    # each task sends a text once, however many copies it holds
    once = keyed.groupBy("k1", "k2").agg(F.first("text").alias("text"), (F.count("*") > 1).alias("whole"))
    texts = common.written(once.join(places, ["k1", "k2"], "left").where("whole or positions is not null"), "texts")
    common.forget(places)
    windows = texts.mapInPandas(_window_rows(window), "w1 long, w2 long, k1 long, k2 long, pos int, sure boolean")
    meet = Window.partitionBy("w1", "w2")
    again = windows.withColumns({"least": F.min(loose).over(meet), "most": F.max(loose).over(meet)}).where("sure or least != most")
    starts = again.groupBy("k1", "k2").agg(F.collect_set("pos").alias("starts"))
    return texts, starts


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept_text, kept_sha256): every word goes that a repeated window covers.

    Words are runs of anything but space and the controls 9 to 13. All occurrences go, the first
    included; a repeated row repeats all its windows. Null and empty texts have no words; texts of
    fewer words than the window keep all; ``kept_text`` is null where nothing was removed (the text
    stands as it is); an empty table gives no rows."""
    texts, starts = repeated_windows(docs, text, window)
    changed = common.written(
        texts.select("k1", "k2", "text", "whole")
        .join(starts, ["k1", "k2"], "left")
        .where("whole or starts is not null")
        .mapInPandas(_removal(window), "k1 long, k2 long, n_removed long, kept_text string, kept_sha256 string"),
        "changed",
    )
    common.forget(texts)
    body = F.coalesce(F.col(text), F.lit(""))
    k1, k2 = common.text_keys(body)
    rows = docs.select(F.col(doc_id).alias("doc_id"), k1.alias("k1"), k2.alias("k2"), _whole(body).alias("whole"))
    return rows.join(changed, ["k1", "k2"], "left").select(
        "doc_id",
        F.col("whole.n_words").alias("n_words"),
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        "kept_text",
        F.coalesce("kept_sha256", "whole.sha").alias("kept_sha256"),
    )


def op9_difference_cover(spark, sf_dir: str) -> DataFrame:
    """Words removed from every document because a window of 35 words repeats."""
    return remove_repeats(common.table(spark, sf_dir, "documents")).drop("kept_text")


OP9_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), win AS (
  SELECT rid, s, md5(array_to_string(w[s:s + 34], ' ')) AS h
  FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35)
), dup AS (
  SELECT rid, s FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)
), gone AS (
  SELECT DISTINCT rid, unnest(range(s, s + 35)) AS p FROM dup
), word AS (
  SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d
), kept AS (
  SELECT rid, string_agg(word, ' ' ORDER BY p) AS body, count(*) AS n
  FROM word ANTI JOIN gone USING (rid, p) GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(body, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""
