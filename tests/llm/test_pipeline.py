"""The pipeline's stages on the small tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quantloom.llm import bpe, linededup, mixing
from quantloom.llm.common import read_table, written

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = read_table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, SF), name)
        out.append((name, before, docs))
    return {name: (a, b) for name, a, b in out}


def test_columns_and_ids(spark, stages):
    for name, (before, after) in stages.items():
        if name != "tokens":
            assert after.columns == before.columns
        assert after.join(before, "doc_id", "left_anti").count() == 0


@pytest.mark.parametrize("size, bad_kept", [("0.01", 0.2), ("0.001", 0.3)])
def test_quality_stage(spark, size, bad_kept):
    """A fifth of 58 bad documents at most stays on one table, three of 11 on the smallest, which has few labels to
    learn from."""
    sf = SF.replace("0.001", size)
    a, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    b = written(corpus_pipeline.quality_stage(spark, a, sf), "quality")
    clean, bad = (a.join(labels.filter(f"quality = {q}"), "doc_id", "left_semi").select("doc_id") for q in (1, 0))
    assert b.join(clean, "doc_id", "left_semi").count() >= 0.95 * clean.count()
    assert b.join(bad, "doc_id", "left_semi").count() <= bad_kept * bad.count()


def test_later_copies_go(stages):
    _, after = stages["near"]
    sets = [set(zip(*[r.text.lower().split()[k:] for k in range(5)])) for r in after.collect()]
    for i, a in enumerate(sets):
        for b in sets[:i]:
            assert not a or not b or len(a & b) < 0.8 * len(a | b)


def test_tokens_decode_to_the_mixture(stages):
    before, after = stages["tokens"]
    assert before.count() == after.count()
    texts = {r.doc_id: r.text for r in before.collect()}
    decode = bpe.codec(bpe.public_tokenizers.path(bpe.VOCABULARY)).decode
    assert all(decode([r.token_ids]) == [texts[r.doc_id] or ""] and r.n_tokens == len(r.token_ids) for r in after.collect())


def test_run_is_the_stages(spark, stages):
    key = lambda df: sorted((r.doc_id, r.n_tokens) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(stages["tokens"][1])
    assert linededup.without_repeated_lines(stages["lines"][1]).filter(F.col("_n_removed") > 0).count() == 0


def test_mixture_rows_come_in_the_permutation(spark):
    """A row that moves breaks the order of epochs and places."""
    docs = read_table(spark, SF, "documents")
    epoch, order = mixing.used_names(docs)
    want = sorted((r[epoch], r[order], r.doc_id) for r in mixing.mixed(docs).collect())
    got = [r.doc_id for r in corpus_pipeline.mixing_stage(spark, docs, SF).collect()]
    assert got == [x[2] for x in want] and got != sorted(got)
