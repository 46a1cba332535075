import hashlib
import random
import re
from collections import Counter

import pytest

from curatrix.llm import substring
from tests.llm import cases


def plain(rows, window=35):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest()))
    return Counter(out)


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return Counter(tuple(r) for r in substring.remove_repeats(df).drop("kept_text").collect())


def test_cover():
    differences = {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER}
    assert differences == set(range(substring.PERIOD))


def test_random_passages_against_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(400)]
    passages = [[rng.choice(vocabulary) for _ in range(n)] for n in (34, 35, 36, 50, 80, 200)]
    rows = []
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 150))]
        for p in rng.sample(passages, rng.randint(0, 2)):
            at = rng.randint(0, len(words))
            words[at:at] = p
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(words)))
    rows += [(100, "a " * 90), (101, rows[3][1]), (101, rows[3][1]), (102, " ".join(passages[5] * 3))]
    assert run(spark, rows) == plain(rows)


def test_documents_against_brute_force(spark, small):
    rows = cases.texts(small)
    assert Counter(tuple(r) for r in substring.op9_difference_cover(spark, small).collect()) == plain(rows)


def test_edge_rows(spark):
    rows = [(r[0], r[1]) for r in cases.ROWS]
    got = Counter(tuple(r) for r in substring.remove_repeats(cases.docs(spark)).drop("kept_text").collect())
    assert got == plain(rows)
    assert substring.remove_repeats(cases.docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        substring.repeated_windows(cases.docs(spark), window=20)
