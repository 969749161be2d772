import random

import numpy as np
import pytest

from millrace.llm import toxicity


def corpus(n, seed=0):
    rng, rows = random.Random(seed), []
    for i in range(n):
        w = ["".join(rng.choices(["the", "er", "on", "ing", "tion", "ha"], k=rng.randint(1, 3))) for _ in range(rng.randint(1, 80))]
        bad = i % 5 == 0
        if bad:
            w.insert(rng.randint(0, len(w)), rng.choice(["Idiot!", "scum", "blorp" + rng.choice(["s", "ing", "ed", "ly"])]))
        rows.append((i, " ".join(w), "en" if i % 3 else "fr", int(bad)))
    return rows


def slow_pooled(model, text):
    words = toxicity.words_of(text.encode())
    e = [model.table[r].sum(axis=0) for r in toxicity.rows_of(words)]
    out = []
    for w, f, b in zip(toxicity.WIDTHS, model.filters, model.bias):
        padded = e + [np.zeros(toxicity.DIM)] * (w - 1)
        r = [sum(padded[i + k] @ f[k] for k in range(w)) + b for i in range(len(e))]
        out += list(np.maximum(np.max(r, axis=0), 0) if r else np.zeros(toxicity.FILTERS))
    return np.array(out)


def test_scores_against_a_plain_forward_pass(monkeypatch):
    monkeypatch.setattr(toxicity, "CHUNK", 7)
    model = toxicity.Model(3)
    texts = ["", "one", "a b c d e f g h i j k l m n o p", "x y", "   ", "Zeta élan zeta " * 9]
    got = toxicity.Reader(model).scores([None, *(t.encode() for t in texts)])
    want = [float(model.score(slow_pooled(model, t)[None])[0]) for t in ["", *texts]]
    assert got == pytest.approx(want, abs=1e-5)


def test_held_out_accuracy(spark):
    rows = corpus(1500)
    docs = spark.createDataFrame([(*r[:3], "c", 1.0) for r in rows], "doc_id long, text string, lang string, score string, threshold double")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows] + [(10**6, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    c = toxicity.fit(docs, labels)
    out = toxicity.score(docs, c)
    assert out.columns == ["doc_id", "text", "lang", "score", "threshold", "rejected"]
    got = out.toPandas().set_index("doc_id")
    import zlib

    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert np.mean([bool(got.rejected[i]) == bool(y) for i, _, _, y in held]) > 0.97
    assert np.mean([(got.score[i] >= 0.5) == bool(y) for i, _, _, y in held]) > 0.97


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "", "en"), (2, "", "en"), (3, "word " * 300_000, "xx"), (None, "a", "en")], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.fit(docs, none)).toPandas()
    assert len(out) == 5 and out.score.between(0, 1).all() and not out.rejected.any()
    assert toxicity.score(docs, toxicity.fit(docs, none), keep=("doc_id",)).toPandas().score.tolist() == out.score.tolist()
    assert toxicity.score(docs.limit(0), toxicity.fit(docs, none)).count() == 0
    one = spark.createDataFrame([(1, 1), (2, 0), (2, 1)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, one)).count() == 5


def test_all_labelled_rows_are_learned_from(spark, monkeypatch):
    """A word that stands only in rows beyond the 5,000 of a label, by the hash of the id, that were read before."""
    import zlib

    from pyspark.sql import functions as F

    part = lambda i: zlib.crc32(str(i).encode()) % 5
    by_hash = [r.id for r in spark.range(9000).orderBy(F.xxhash64("id"), "id").collect() if part(r.id)]
    assert len(by_hash) > 6500
    rows = [(i, "alpha" if k < 5000 else "omega", "en", 1) for k, i in enumerate(by_hash)] + [(i, f"w{i} q{i}", "en", 0) for i in range(10_000, 12_000) if part(i)]
    docs, labels = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string"), spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    read, own = [], toxicity.best_threshold
    monkeypatch.setattr(toxicity, "best_threshold", lambda reached, *rest: read.append(reached.sum(axis=1).tolist()) or own(reached, *rest))
    scores = toxicity.Reader(toxicity.fit(docs, labels).model).scores([b"alpha", b"omega", b"w1 q1"])
    assert scores[0] >= 0.5 and scores[1] >= 0.5 and scores[2] < 0.5
    apart = [sum(part(i) == 1 and y == x for i, _, _, y in rows) for x in (0, 1)]
    assert read == [apart, apart]  # the common threshold and that of the one language


def test_thresholds_against_brute_force():
    rng = np.random.default_rng(5)
    for n in (1, 3, 200):
        scores, labels = np.r_[rng.uniform(0, 1, n), 0.2, toxicity.TRIED[30], 0.8], np.r_[rng.integers(0, 2, n), 1, 0, 1]
        reached = np.zeros((2, len(toxicity.TRIED) + 1), int)
        np.add.at(reached, (labels, (scores[:, None] >= toxicity.TRIED).sum(axis=1)), 1)
        errors = [((scores >= t) != (labels > 0)).sum() for t in toxicity.TRIED]
        want = min((e, abs(t - 0.45), k) for k, (e, t) in enumerate(zip(errors, toxicity.TRIED)))[2]
        assert toxicity.best_threshold(reached, 0.45) == toxicity.TRIED[want]


def test_shards_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD", 150)
    rows = corpus(1000)
    docs, labels = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string"), spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    a, b = (toxicity.fit(d, x) for d, x in ((docs.coalesce(1), labels.repartition(3)), (docs.repartition(7), labels.coalesce(1))))
    assert (a.model.table == b.model.table).all() and (a.model.rest() == b.model.rest()).all() and (a.common, a.by_lang) == (b.common, b.by_lang)
    import zlib

    apart = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    scores = toxicity.Reader(a.model).scores([t.encode() for _, t, _, _ in apart])
    assert np.mean((scores >= 0.5) == np.array([y > 0 for *_, y in apart])) > 0.95


def test_long_texts_are_learned_chunk_by_chunk(monkeypatch):
    rng = np.random.default_rng(3)
    m, sizes = toxicity.Model(2), np.array([0, 5, 90, 1, 40])
    e = np.concatenate([rng.normal(0, 1, (30, toxicity.DIM)), np.zeros((1, toxicity.DIM))]).astype(np.float32)
    starts = np.cumsum(sizes + 2) - sizes - 2
    tokens = np.full((sizes + 2).sum(), -1)
    for s, z in zip(starts, sizes):
        tokens[s : s + z] = rng.integers(0, 30, z)
    whole = toxicity.peaks(m, e, tokens, starts, sizes)
    monkeypatch.setattr(toxicity, "CHUNK", 7)
    cut = toxicity.peaks(m, e, tokens, starts, sizes)
    assert (whole[1] == cut[1]).all() and cut[0] == pytest.approx(whole[0], abs=1e-5)


def test_marks_lose_no_labelled_row(spark):
    from pyspark.sql import functions as F

    ids, docs = spark.range(3000).select((F.col("id") * 7).alias("x")), spark.range(-50, 40_000).withColumnRenamed("id", "doc_id")
    got = [r.doc_id for r in toxicity.marked(ids, docs, "doc_id", 3000).collect()]
    assert set(range(0, 21_000, 7)) <= set(got) and len(got) < 3000 + 0.06 * 37_000


def test_one_row_of_an_id_is_read(spark):
    """Of rows of one id the first by packed text, however they are dealt."""
    rows = corpus(300)
    docs, labels = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string"), spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs.unionByName(docs).unionByName(docs).repartition(5), labels)
    assert (a.model.table == b.model.table).all() and (a.common, a.by_lang) == (b.common, b.by_lang)


def test_rows_held_out_teach_nothing(spark):
    """With ``held_out``, as the query asks, labels of rows with remainder 0 change nothing, and those rows are scored right all the same."""
    import zlib

    part = lambda i: zlib.crc32(str(i).encode()) % 5
    rows = corpus(1500)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = [spark.createDataFrame([(i, y if part(i) or not turned else 1 - y) for i, _, _, y in rows], "doc_id long, toxic int") for turned in (False, True)]
    a, b = (toxicity.fit(docs, x, held_out=5) for x in labels)
    assert (a.model.table == b.model.table).all() and (a.model.rest() == b.model.rest()).all() and (a.common, a.by_lang) == (b.common, b.by_lang)
    held = [r for r in rows if part(r[0]) == 0]
    scores = toxicity.Reader(a.model).scores([t.encode() for _, t, _, _ in held])
    assert np.mean((scores >= 0.5) == np.array([y > 0 for *_, y in held])) > 0.97


def test_the_driver_holds_no_round(spark, monkeypatch):
    """The shards' sums come in single precision, with no row object; the parameters told to the tasks of a round are given up after it."""
    import os
    import zlib

    rows = spark.createDataFrame([(i % 3, float(i)) for i in range(30)], "shard int, x double").repartition(4, "shard")

    def by_shard(batches):
        for b in batches:
            for shard, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield shard, np.arange(1000) * x

    monkeypatch.setattr(type(rows), "collect", None)
    got = toxicity.summed(rows, by_shard)
    assert got.dtype == np.float32 and got == pytest.approx(np.arange(1000) * 435.0, rel=1e-6)
    assert toxicity.summed(rows.limit(0), by_shard) is None
    monkeypatch.undo()
    told = os.listdir(spark.sparkContext._temp_dir)
    given = spark.createDataFrame([(0, i % 2, zlib.compress(b"a b" if i % 2 else b"c d")) for i in range(40)], "shard int, y int, t binary")
    model = toxicity.train(given, np.ones((2, toxicity.ROWS)), np.array([20.0, 20.0]))
    assert toxicity.Reader(model).scores([b"a b"])[0] > 0.5 > toxicity.Reader(model).scores([b"c d"])[0]
    assert sorted(os.listdir(spark.sparkContext._temp_dir)) == sorted(told)
