import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import cotraining


def corpus(n, seed=0):
    rng, rows = random.Random(seed), []
    for i in range(n):
        bad = i % 4 == 0
        w = ["".join(rng.choices(["the", "er", "on", "ing", "tion", "ha"], k=rng.randint(1, 3))) for _ in range(rng.randint(5, 80))]
        if bad:
            w = [x.upper() + "!!" for x in w] if rng.random() < 0.5 else [x for y in w for x in [y] * 6]
        # Pages of little worth are also broken into short lines.
        w = [x + ("\n" if bad and rng.random() < 0.5 else "") for x in w]
        rows.append((i, " ".join(w), rng.choice(["en", "fr"]), f"s{i % 7}", int(not bad)))
    return rows


def test_held_out_accuracy_and_both_views(spark):
    rows = corpus(1600)
    docs = spark.createDataFrame([(*r[:4], "x") for r in rows], "doc_id long, text string, lang string, source string, score string")
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows[:700]] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = cotraining.score(docs, cotraining.fit(docs, labels)).toPandas().set_index("doc_id")
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert np.mean([(got.score[r[0]] >= 0.5) == bool(r[4]) for r in held]) > 0.95
    assert np.mean([(got.page_score[r[0]] >= 0.5) == bool(r[4]) for r in held]) > 0.9
    assert got.score.between(0, 1).all()
    assert list(got.columns) == ["text", "lang", "source", "text_score", "page_score", "score"]


def test_scoring_agrees_with_the_training_features(spark):
    rows = corpus(60)
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, lang string, source string")
    m = cotraining.fit(docs, spark.createDataFrame([(r[0], r[4]) for r in rows], "doc_id long, quality int"))
    got = {r.doc_id: r.score for r in cotraining.score(docs, m).collect()}
    for i, t, lang, source, _ in rows:
        words = t.encode().split()
        want = m.scores(m.text.raw([cotraining.text_features(words)]), m.page.raw(cotraining.page_features(t.encode(), lang, source, len(t))[None]))
        assert got[i] == pytest.approx(want[0, 2], abs=1e-6)


def test_edge_rows(spark):
    schema = "doc_id long, text string, lang string, source string"
    docs = spark.createDataFrame([(1, None, None, None), (2, "", "en", "a"), (2, "", "en", "a"), (None, "b", "en", "a"), (4, "long " * 200_000, "xx", "b")], schema)
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = cotraining.score(docs, cotraining.fit(docs, none)).toPandas()
    assert len(out) == 5 and out.score.between(0, 1).all()
    one = spark.createDataFrame([(1, 1), (2, 0), (2, 1)], "doc_id long, quality int")
    assert cotraining.score(docs.limit(0), cotraining.fit(docs, one)).count() == 0
    assert cotraining.score(docs, cotraining.fit(docs.limit(0), none)).filter(F.col("score").isNull()).count() == 0


def test_page_view_reads_no_word():
    one = cotraining.page_features(b"abc def\n\nghi", "en", "s", 13)
    assert (one == cotraining.page_features(b"XXXXXXX\n\n!!1", "en", "s", 13)).all()


def test_shapes():
    words = [b"Word", b"ABc12", b"x", b"\xc3\xa9t\xc3\xa9", b"--", b"A1b2"]
    shape = lambda w: cotraining.re.sub(rb"[0-9]+", b"0", cotraining.re.sub(rb"[a-z\x80-\xff]+", b"a", cotraining.re.sub(rb"[A-Z]+", b"A", w)))
    got = cotraining.rows_of(words)
    assert got[0].tolist() == [zlib.crc32(w.lower()) % cotraining.ROWS for w in words]
    assert got[1].tolist() == [zlib.crc32(shape(w)[:16], 7) % cotraining.ROWS for w in words]
    assert [len(x) for x in cotraining.rows_of([])] == [0, 0]


def test_pseudo_labels_come_from_all_documents(spark):
    """The surest of every document without a label, whatever their number, and none twice; held-out ones never."""
    rows = corpus(900, seed=3)
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, lang string, source string").repartition(5)
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows[:300]], "doc_id long, quality int")
    seen, learn = [], cotraining.learn

    def spy(texts, pages, y, part, ask, *more):
        def asked(text, page, n0, n1, r):
            out = ask(text, page, n0, n1, r)
            if r == 0:
                free = [x for x in rows[300:] if zlib.crc32(str(x[0]).encode()) % 5]
                raw = {x[0]: text.raw([cotraining.text_features(x[1].encode().split())])[0] for x in free}
                want = [i for i in sorted(raw, key=lambda i: (raw[i], i)) if raw[i] < -1][:n0] + [i for i in sorted(raw, key=lambda i: (-raw[i], i)) if raw[i] > 1][:n1]
                texts_of = {x[0]: cotraining.text_features(x[1].encode().split()) for x in free}
                assert sorted((t[0].tolist(), v) for t, _, v in out[0]) == sorted((texts_of[i][0].tolist(), float(raw[i] > 0)) for i in want)
            seen.append([len(o) for o in out])
            return out

        return learn(texts, pages, y, part, asked, *more)

    cotraining.learn = spy
    try:
        cotraining.fit(docs, labels)
    finally:
        cotraining.learn = learn
    assert len(seen) == cotraining.ROUNDS and sum(map(sum, seen)) > 0


def test_packed_counts():
    rng = np.random.default_rng(3)
    rows, counts = np.arange(0, 3000, 7), rng.integers(1, 2000, 429)
    data = cotraining.pack(rows, counts)
    got = cotraining.unpack(data)
    assert (got[0] == rows).all() and np.allclose(got[1], 10 * counts / (counts.sum() / 2))
    view = cotraining.TextView()
    view.w[:], view.shift = rng.normal(size=cotraining.ROWS), 0.3
    empty = cotraining.pack(rows[:0], counts[:0])
    assert np.allclose(cotraining.packed_raw(view, [data, empty, data]), view.raw([got, cotraining.unpack(empty), got]))


def test_pages_together_are_those_one_by_one():
    data = [b"", b"a\n\nbcd", b"\n", b"x" * 500 + b"\n" + b"y" * 30, b"\xc3\xa9"]
    more = (["en", None, "fr", "en", ""], ["a", "b", None, "a", "c"], [0, 6, None, 531, 1])
    got = cotraining.pages_of(data, *more)
    assert np.allclose(got, [cotraining.page_features(*x) for x in zip(data, *more)])
    lines = np.array([1, 0, 3.0])
    assert got[1][:7] == pytest.approx(np.log1p([6, 1, 3, lines.mean(), 3, lines.std(), 3])) and got[1][7:11] == pytest.approx([1 / 3, 1, 1, 1])
    assert cotraining.pages_of([], [], [], []).shape == (0, got.shape[1])
