"""Packing tokenised documents into sequences of a fixed length, cutting only what is longer than one.

Documents are tokenised where they are read; only those longer than a sequence are cut, so that all pieces but the
first fill a sequence. What matters for the packing is how many pieces there are of each length, and
lengths are no more than the capacity. So the best-fit plan is made from a histogram of at most ``capacity`` rows, in patterns
that repeat many times: lengths above a third of the capacity are matched first, two in a sequence at most,
the longest with the longest that fits; shorter ones then go, longest first, into the tightest gaps.
The pieces of each length are numbered across all tasks, and a piece's number names its sequence and place.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curatrix.llm import common

#: Tokens of a sequence.
CAPACITY = 2048
#: The id that ends a document.
END = 0
#: Words whose ids a worker keeps at once, and the length of the longest such word.
WORDS, LONGEST = 600_000, 48
#: Texts tokenised together.
TOGETHER = 64
#: The vocabulary file of the registered query; the operator takes any path.
TOKENIZER = "byte_bpe_50k.json"

_LETTERS, _DIGITS, _SPACE = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_LATIN = re.compile(r"[\x00-ɏ]*\Z")
#: The splits of the byte-level tokenizers, for texts of Latin letters; other texts are left to the tokenizer whole.
_SPLITS = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[{_DIGITS}]+| ?[^{_SPACE}{_LETTERS}{_DIGITS}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")

#: Bytes as the byte-level tokenizers write them: printable Latin-1 as it is, the others from U+0100 on.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: b if b in _SHOWN else 256 + sum(x not in _SHOWN for x in range(b)) for b in range(256)}
_BLANK = chr(_BYTES[32])


class Ids:
    """Ids of texts by a tokenizer file, as little-endian 32-bit numbers.

    A byte-level tokenizer splits a text into words before it merges bytes, so the ids of a text are those of its
    words. Words are sent to the tokenizer once and remembered; texts with characters beyond the Latin blocks, and
    files that split in another way, go to the tokenizer as they are."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # the name of a special token in a text is text
        self.by_words = self._splits_alike()
        self.words: dict[str, bytes] = {}

    def _splits_alike(self) -> bool:
        """Whether the file splits as _SPLITS does, on a text with every kind of split."""
        probe = "It's we'll  they've\n\n x1 12² étés?! ªµ\x85 \xa0y\t'S 'ss  \r\n#a_b \x1c\x1d z"
        state = self.tokenizer.pre_tokenizer
        pieces = [probe[a:b] for _, (a, b) in state.pre_tokenize_str(probe)] if state else []
        words = _SPLITS.findall(probe)
        ids = [t.id for w in words for t in self.tokenizer.model.tokenize(w.encode().decode("latin-1").translate(_BYTES))]
        return pieces == words and self.tokenizer.normalizer is None and ids == self.tokenizer.encode(probe, add_special_tokens=False).ids

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [_bytes(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: Iterable[str]) -> None:
        """Sends words, their bytes written as letters, to the merges of the tokenizer, past its splitting of texts."""
        merged, known = self.tokenizer.model.tokenize, self.words
        for w in words:
            if w.isascii() and w[1:].isalpha() and (w[0] == " " or w.isalpha()):
                letters = w.replace(" ", _BLANK)
            else:
                letters = w.encode().decode("latin-1").translate(_BYTES)
            known[w] = array("I", [t.id for t in merged(letters)]).tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.by_words:
            return self._encode(texts)
        latin = [_LATIN.match(t) is not None for t in texts]
        split = [_SPLITS.findall(t) if ok else [] for t, ok in zip(texts, latin, strict=True)]
        if len(self.words) > WORDS:
            self.words.clear()
        new = set(chain.from_iterable(split)).difference(self.words)
        self._learn(new)
        out = [b"".join(map(self.words.__getitem__, s)) for s in split]
        for w in new:
            if len(w) > LONGEST:
                del self.words[w]
        foreign = [i for i, ok in enumerate(latin) if not ok]
        for i, ids in zip(foreign, self._encode([texts[i] for i in foreign]), strict=True):
            out[i] = ids
        return out


def _bytes(ids) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


_loaded: dict[str, Ids] = {}


def encoder(path: str) -> Ids:
    """The tokenizer of a file, loaded once in a worker."""
    if path not in _loaded:
        _loaded[path] = Ids(path)
    return _loaded[path]


def named_file(name: str) -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids, task, nth) of each piece: ids are 32-bit little-endian, nth counts the
    pieces of one length in the task that made them. ``tokenizer`` is a path, the same on every machine; without one each
    task asks for the public file TOKENIZER."""
    common.small_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen = encoder(tokenizer or named_file(TOKENIZER)), TaskContext.get().partitionId(), Counter()
        end = _bytes([END])
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                rows, out = [], []
                for n, ids in enumerate(encode([t or "" for t in part["text"].to_pylist()])):
                    ids += end
                    total = len(ids) // 4
                    first = total if total <= capacity else total % capacity or capacity
                    for k, start in enumerate([0, *range(first, total, capacity)]):
                        length = first if k == 0 else capacity
                        rows.append(n)
                        out.append((k, start, length, ids[4 * start : 4 * (start + length)], task, seen[length]))
                        seen[length] += 1
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([part["id"].take(pa.array(rows)), *columns], ["id", "piece", "start", "length", "ids", "task", "nth"])

    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    out = rows.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids binary, task long, nth long")
    return out.withColumnRenamed("id", doc_id)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns ([(length, how many in a sequence)], how many sequences) that hold ``counts`` pieces of each length.

    Lengths above a third of the capacity are matched two by two, the longest first with the longest that fits, which leaves as few
    sequences as any matching of them. Shorter ones follow, longest first, each into the tightest gap, in bulk."""
    left = {s: c for s, c in counts.items() if c > 0}
    if left and max(left) > capacity:
        raise ValueError("a piece is longer than a sequence")
    large = sorted(s for s in left if 3 * s > capacity)
    groups: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}  # by gap
    gaps: list[int] = []

    def put(pattern: list[tuple[int, int]], gap: int, many: int) -> None:
        if gap not in groups:
            groups[gap] = []
            insort(gaps, gap)
        groups[gap].append((pattern, many))

    for s in reversed(large):
        for t in reversed(large[: bisect_left(large, min(s, capacity - s) + 1)]):
            if not left[s]:
                break
            pairs = left[s] // 2 if t == s else min(left[s], left[t])
            if pairs:
                left[s] -= pairs
                left[t] -= pairs
                put([(s, 2)] if s == t else [(s, 1), (t, 1)], capacity - s - t, pairs)
        if left[s]:
            put([(s, 1)], capacity - s, left[s])
            left[s] = 0
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        many = left[s]
        while many:
            at = bisect_left(gaps, s)
            if at == len(gaps):
                put([], capacity, many)  # empty sequences, of which those not used are dropped below
                continue
            gap = gaps[at]
            pattern, bins = groups[gap].pop()
            if not groups[gap]:
                del groups[gap]
                del gaps[at]
            each = gap // s
            full = min(bins, many // each)
            if full:
                put([*pattern, (s, each)], gap - each * s, full)
                many, bins = many - full * each, bins - full
            if many and bins:  # fewer than one sequence takes
                put([*pattern, (s, many)], gap - many * s, 1)
                many, bins = 0, bins - 1
            if bins and pattern:
                put(pattern, gap, bins)
    return [(pattern, many) for gap in gaps for pattern, many in groups[gap] if pattern]


def _places(patterns: list[tuple[list[tuple[int, int]], int]]) -> np.ndarray:
    """Rows (length, first number, first sequence, how many in a sequence, offset of the first), by length and number."""
    rows, given, sequence = [], Counter(), 0
    for pattern, many in patterns:
        offset = 0
        for s, each in pattern:
            rows.append((s, given[s], sequence, each, offset))
            given[s] += each * many
            offset += s * each
        sequence += many
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and its ``ids`` where kept.

    A null text counts as empty; an empty text is the end id alone; texts of any length are tokenised whole and cut
    into pieces. Rows may repeat or lack an id: each is a document. An empty table gives no rows. Other columns are not read.
    The driver holds one count per length, and the patterns made from them, at most a few per length."""
    spark = docs.sparkSession
    x = pieces(docs, tokenizer, capacity, doc_id, text).withColumn("ids_crc32", F.crc32("ids"))
    x = common.written(x if keep_ids else x.drop("ids"), "pieces")
    counts = common.written(x.groupBy("task", "length").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    places = _places(plan(histogram, capacity))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = x.join(counts.select("task", "length", before.alias("before")), ["task", "length"]).withColumn("number", F.col("before") + F.col("nth"))
    columns = [doc_id, "piece", "start", "length", "ids_crc32"] + (["ids"] if keep_ids else [])
    fields = ", ".join(f"`{c}` {numbered.schema[c].dataType.simpleString()}" for c in columns)
    held = spark.sparkContext.broadcast(places)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        starts = table[:, 0] << 44 | table[:, 1]
        for batch in batches:
            length, number = (batch[c].to_numpy(zero_copy_only=False) for c in ("length", "number"))
            row = table[np.searchsorted(starts, length << 44 | number, "right") - 1]
            past, each = number - row[:, 1], row[:, 3]
            sequence, offset = row[:, 2] + past // each, row[:, 4] + past % each * length
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in columns], pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    return numbered.select(*columns, "number").mapInArrow(place, f"{fields}, sequence_id long, offset long")


def op12_large_item_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place; edge rows as in :func:`pack`."""
    return pack(common.table(spark, sf_dir, "documents"), keep_ids=False)
