import hashlib
from collections import Counter

import numpy as np

import corpus_pipeline
from curatrix.llm import common, decontaminate, pseudonyms, quality, training
from tests.llm import cases
from tests.llm.test_mixing import check


def plain_shingles(text, width=5):
    """The five-word sequences of a text; one of fewer words is a sequence itself."""
    words = text.encode().lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def test_stages_against_brute_force(spark, small):
    docs = common.table(spark, small, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    net = quality.train(docs, common.table(spark, small, "labels"))
    want = {d for d, r in rows.items() if net.scores([r.text.encode()])[0] >= 0.5}

    first = common.written(corpus_pipeline.quality_stage(spark, docs, small), "first")
    assert first.columns == docs.columns
    got = {r.doc_id for r in first.collect()}
    assert len(got ^ want) <= 1  # a score may round over the threshold
    sets = {d: plain_shingles(rows[d].text) for d in got}
    root = cases.components(sets, lambda a, b: sets[a] == sets[b] or 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))

    second = common.written(corpus_pipeline.near_duplicate_stage(spark, first, small), "second")
    assert Counter(r.doc_id for r in second.collect()) == Counter(set(root.values()))

    third = common.written(corpus_pipeline.decontamination_stage(spark, second, small), "third")
    flagged = {r.doc_id for r in decontaminate.op2_template_decontamination(spark, small).collect()}
    kept = {r.doc_id for r in third.collect()}
    assert kept == set(root.values()) - flagged

    fourth = common.written(corpus_pipeline.pii_stage(spark, third, small), "fourth")
    key = hashlib.blake2b(pseudonyms.QUERY_KEY.encode()).digest()
    assert {r.doc_id: r.text for r in fourth.collect()} == {d: pseudonyms._masked(rows[d].text, pseudonyms.findings(rows[d].text, key)) for d in kept}

    last = corpus_pipeline.mixing_stage(spark, fourth, small).collect()
    assert {r.doc_id for r in last} == kept
    check(last)
    assert Counter(last) == Counter(corpus_pipeline.run(spark, small).collect())


def test_edge_rows(spark, tmp_path):
    cases.docs(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(5, 1, 0), (6, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "too short")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert len(corpus_pipeline.run(spark, str(tmp_path)).collect()) == 6


def test_sample_is_bounded_and_stable(spark, small):
    docs, labels = common.table(spark, small, "documents"), common.table(spark, small, "labels")
    texts, y = training.sample(docs, labels, "quality", quality.learnable, rows=20)
    again, z = training.sample(docs.repartition(5), labels.repartition(3), "quality", quality.learnable, rows=20)
    assert texts == again and (y == z).all() and len(texts) <= 20 and set(np.unique(y)) <= {0.0, 1.0}
