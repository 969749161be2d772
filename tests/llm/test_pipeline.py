"""Each stage of the pipeline on its own input, against brute force."""

import importlib

import pytest

from millrace.llm import decontam, simhash, toxicity
from tests.llm import test_decontam, test_line_dedup, test_simhash

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{D}/documents.parquet")
    out = [docs.toPandas()]
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, D)
        if name != "mixing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.append(docs.toPandas())
        docs = spark.createDataFrame(out[-1])
    return out


def test_toxicity(spark, steps):
    model = toxicity.fit(spark.createDataFrame(steps[0]), spark.read.parquet(f"{D}/labels.parquet"))
    scores = toxicity.Reader(model.model).scores([t.encode() for t in steps[0].text])
    keep = [s < model.by_lang.get(lang, model.common) for s, lang in zip(scores, steps[0].lang)]
    assert sorted(steps[1].doc_id) == sorted(steps[0].doc_id[keep])


def test_lines(steps):
    want = test_line_dedup.brute(list(zip(steps[1].doc_id, steps[1].source, steps[1].text)), importlib.import_module("corpus_pipeline").LINE_SHARE, 5, True)
    assert sorted(zip(steps[2].doc_id, steps[2].text)) == sorted((i, t) for i, t, _ in want)
    assert (steps[2].n_chars == steps[2].text.str.len()).all()


def test_copies(steps):
    """One of each group of near fingerprints stays, and of those, in the order of ids, what is below 0.8 to all that stay."""
    prints = {i: test_simhash.slow_fingerprint(t) for i, t in zip(steps[2].doc_id, steps[2].text)}
    first = set(test_simhash.slow_components(prints).values())
    text = dict(zip(steps[2].doc_id, steps[2].text))
    want = []
    for i in sorted(first):
        if all(simhash.similarity(text[i].encode(), text[j].encode(), 5) < 0.8 for j in want):
            want.append(i)
    assert sorted(steps[3].doc_id) == want


def test_leaks(spark, steps):
    items = [tuple(r) for r in spark.read.parquet(f"{D}/benchmark.parquet").select("item_id", "text").collect()]
    before = {r[0]: r for r in test_decontam.brute(list(zip(steps[3].doc_id, steps[3].text)), items)}
    assert any(r[5] for r in before.values())
    assert not any(r[5] for r in test_decontam.brute(list(zip(steps[4].doc_id, steps[4].text)), items))
    for i, old, new in zip(steps[3].sort_values("doc_id").doc_id, steps[3].sort_values("doc_id").text, steps[4].sort_values("doc_id").text):
        assert before[i][5] or old == new
        assert len(decontam.words_of(new.encode())) <= before[i][1] - before[i][2]


def test_mix(steps):
    docs, out = steps[4], steps[5]
    size = docs.set_index("doc_id").text.str.split().str.len()
    assert out.groupby("doc_id").copy.max().le(2).all() and set(out.doc_id) <= set(docs.doc_id)
    want = 1.5 * size.sum()
    assert abs(sum(size[i] for i in out.doc_id) - want) < 0.1 * want


def test_run_is_registered(spark):
    entry = importlib.import_module("__spark_entry__")
    assert "pipeline" in entry.queries()
    assert entry.queries()["pipeline"](spark, D).count() > 0
