import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from curatrix.llm import packing as P
from tests.llm import cases

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain_ids(texts):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return [t.encode(x or "", add_special_tokens=False).ids + [0] for x in texts]


def best_fit_decreasing(sizes, capacity):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fits = [g for g in gaps if g >= s]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - s)
        else:
            gaps.append(capacity - s)
    return len(gaps)


def checked(rows, docs, capacity):
    """Pieces are those of the plain tokenizer, whole and once; sequences are gapless and not too long."""
    want = Counter()
    for d, ids in zip([d for d, _ in docs], plain_ids([t for _, t in docs]), strict=True):
        first = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
        for k, a in enumerate([0, *range(first, len(ids), capacity)]):
            part = ids[a : a + (first if k == 0 else capacity)]
            want[(d, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences)


def test_documents(spark, small):
    docs = cases.texts(small)
    rows = P.op12_large_item_packing(spark, small).collect()
    used = checked(rows, docs, 2048)
    sizes = [r.length for r in rows]
    assert used <= best_fit_decreasing(sizes, 2048)
    assert used <= max(-(-sum(sizes) // 2048), sum(2 * s > 2048 for s in sizes)) + 1


def test_edge_rows_and_short_sequences(spark):
    docs = cases.docs(spark)
    for capacity in (2048, 7, 1):
        rows = P.pack(docs, PATH, capacity).collect()
        checked(rows, [r[:2] for r in cases.ROWS], capacity)
        assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    assert P.pack(cases.docs(spark, []), PATH).count() == 0


def test_many_partitions_number_pieces_of_one_length(spark):
    rows = [(i, "w" * (i % 3), "en", "a") for i in range(2000)]
    out = P.pack(cases.docs(spark, rows).repartition(7), PATH, 16, keep_ids=False).collect()
    checked(out, [r[:2] for r in rows], 16)


def test_plan_against_best_fit():
    for seed in range(60):
        r = random.Random(seed)
        capacity = r.choice([9, 30, 100])
        sizes = [min(capacity, max(1, int(r.lognormvariate(r.uniform(0, 4), 1)))) for _ in range(r.randrange(1, 300))]
        patterns = P.plan(Counter(sizes), capacity)
        held = Counter()
        for pattern, many in patterns:
            assert sum(s * k for s, k in pattern) <= capacity and many > 0
            for s, k in pattern:
                held[s] += k * many
        assert held == Counter(sizes)
        used = sum(many for _, many in patterns)
        assert used <= best_fit_decreasing(sizes, capacity) + 1
        large = [s for s in sizes if 3 * s > capacity]
        if large == sizes:  # two of them at most: first-fit decreasing is optimal
            assert used == best_fit_decreasing(sizes, capacity)


def test_ids_of_words_are_those_of_the_text():
    texts = ["It's we'll  they've\n\n x1 12² étés?! ª\x85 \xa0y\t'S 'ss \r\n#a_b \x1c\x1d z", "日本 text", "<|endoftext|> is text", "a" * 500 + " b" * 500, "", " ", "  lead", "trail  ", cases.LONG[:5000]]
    r = random.Random(5)
    letters = ["a", "Z", "é", "ß", "ƿ", "ɏ", "'", "s", "t", " ", "  ", "\n", "\t", "\x0b", "\x1f", "\x85", "\xa0", "1", "²", "¼", "_", "-", "!", "𝔘", "ʰ", " ", "　"]
    texts += ["".join(r.choice(letters) for _ in range(60)) for _ in range(400)]
    ids = P.Ids(PATH)
    assert ids.by_words
    got = ids(texts)
    assert [list(np.frombuffer(b, "<u4")) + [0] for b in got] == plain_ids(texts)
    assert ids(texts) == got


def test_other_files_are_tokenised_whole():
    ids = P.Ids(public_tokenizers.path("word_bpe_49k.json"))
    assert not ids.by_words
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert list(np.frombuffer(ids(["Some Words, here"])[0], "<u4")) == t.encode("Some Words, here", add_special_tokens=False).ids
