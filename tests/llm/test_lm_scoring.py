import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import attention_lm as A
from millrace.llm import lm_scoring as L
from millrace.llm.common import crc_bucket


def toy_model(n=70, seed=0):
    rng = np.random.default_rng(seed)
    leading = np.arange(n) % 3 == 0
    m = A.Model(leading, rng.integers(0, 50, n).astype(float), seed)
    m.p["rel"] = rng.normal(0, 0.3, A.LENGTH).astype(np.float32)
    return m


def slow(m, ids, at):
    """Log probabilities of all ids after place ``at`` of a text, one by one."""
    p, start = m.p, max(0, at // A.STRIDE * A.STRIDE - (A.LENGTH - A.STRIDE))
    e = p["E"][ids[start : at + 1]].astype(float)
    q, k, v = e[-1] @ p["Wq"] / math.sqrt(A.HEAD), e @ p["Wk"], e @ p["Wv"]
    a = k @ q + p["rel"][np.arange(len(e))[::-1]]
    a = np.exp(a - a.max())
    h = e[-1] + (a / a.sum()) @ v
    h = h + np.maximum(h @ p["W1"] + p["b1"], 0) @ p["W2"]
    c = np.exp(h @ p["Wc"] + p["bc"])
    out = np.zeros(m.n)
    for i in range(m.n):
        w = np.exp(h @ p["Wm"][m.cls[i]] + p["bm"][m.cls[i]])
        out[i] = c[m.cls[i]] / c.sum() * w[m.member[i]] / w.sum()
    return out


def test_windows_score_each_id_once_and_right():
    m, rng = toy_model(), np.random.default_rng(1)
    m.prepare()
    end = 0
    docs = [np.r_[end, rng.integers(1, m.n, k)] for k in (0, 1, 31, 32, 33, 100)]
    ids, sizes = np.concatenate(docs), np.array([len(d) for d in docs])
    lp, lead = A.score_texts(m, ids, sizes, end)
    at = 0
    for d in docs:
        for i in range(len(d)):
            p = slow(m, d, i)
            assert p.sum() == pytest.approx(1, abs=1e-4)
            follow = d[i + 1] if i + 1 < len(d) else end
            assert lp[at] == pytest.approx(math.log(p[follow]), abs=2e-3)
            assert lead[at] == pytest.approx(math.log(p[np.arange(m.n) % 3 == 0].sum()), abs=2e-3)
            at += 1


def test_gradients():
    m, rng = toy_model(), np.random.default_rng(2)
    m.p = {k: x.astype(np.float64) for k, x in m.p.items()}
    ids, t, _ = A.windows(np.r_[0, rng.integers(1, m.n, 60)], np.array([61]), 0, m.n)
    _, g = m.gradients(ids, t)
    for k, x in m.p.items():
        for _ in range(3):
            i = tuple(rng.integers(0, s) for s in x.shape)
            old, step = x[i], 1e-4
            x[i] = old + step
            up = m.gradients(ids, t)[0]
            x[i] = old - step
            down = m.gradients(ids, t)[0]
            x[i] = old
            assert g[k][i] == pytest.approx((up - down) / (2 * step), abs=1e-4, rel=2e-2), k


def test_gradients_of_far_logits():
    """Logits beyond ``TOP``, above and below, and windows with places that stand for no id: the loss is that of a plain reader, and the gradients are its slopes."""
    m, rng = toy_model(), np.random.default_rng(3)
    m.p = {k: x.astype(np.float64) for k, x in m.p.items()}
    m.p["bc"][0] += 150
    m.p["bm"][1] -= 200
    doc = np.r_[0, rng.integers(1, m.n, 40)]
    ids, t, _ = A.windows(doc, np.array([41]), 0, m.n)
    loss, g = m.gradients(ids, t)
    assert loss == pytest.approx(-np.mean([math.log(slow(m, doc, i)[doc[i + 1] if i < 40 else 0]) for i in range(41)]), rel=1e-6)
    for k in ("bc", "bm", "E", "Wk", "Wm"):
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old, ends = m.p[k][i], []
        for step in (1e-4, -1e-4):
            m.p[k][i] = old + step
            ends.append(m.gradients(ids, t)[0])
        m.p[k][i] = old
        assert g[k][i] == pytest.approx((ends[0] - ends[1]) / 2e-4, abs=1e-4, rel=2e-2), k


def test_words_are_a_distribution():
    """The pieces of a word and what follows: over all words of up to three pieces and the end, at most 1."""
    m = toy_model(9)
    m.prepare()
    lead = [i for i in range(9) if i % 3 == 0 and i]
    rest = [i for i in range(9) if i % 3]
    words = [[a, *b] for a in lead for b in [[], *[[x] for x in rest], *[[x, y] for x in rest for y in rest]]]
    total = 0
    for w in words:
        ids = np.array([0, *w])
        lp, b = A.score_texts(m, ids, np.array([len(ids)]), 0)
        total += math.exp(lp[: len(w)].sum() - b[0] + b[len(w)])
    end, b = A.score_texts(m, np.array([0]), np.array([1]), 0)
    assert 0.3 < total + math.exp(end[0] - b[0]) < 1.0


def corpus(n):
    rng, rows = random.Random(4), []
    for i in range(n):
        rows.append((i, " ".join("".join(rng.choices(["Th", "er", "on", "ing", "É"], k=rng.choice([1, 1, 2, 3]))) for _ in range(rng.randint(0, 120)))))
    return rows + [(10_001, None), (10_002, " \n"), (10_003, "solo"), (10_003, "solo"), (10_004, "x" * 5000 + " the")]


@pytest.mark.parametrize("head", [100_000, 5, 0])
def test_against_brute_force(spark, head):
    rows = corpus(150)
    docs = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, word string, score double").repartition(3)
    held = crc_bucket(F.col("doc_id"), 10) == 0
    out = L.score(docs, docs.filter(~held), head_words=head, steps=60, keep=("doc_id", "word", "score")).collect()
    assert {r.word for r in out} == {"x"}
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
    c = Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 10:
            c.update([*low(t), None])
    n, v = sum(c.values()), len(c)
    want = sorted((i, len(low(t)) + 1, sum(c[w] > 0 for w in [*low(t), None]), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*low(t), None]), 6)) for i, t in rows)
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
    assert all(r.score < 0 for r in out)
    test_against_brute_force.scores = got = sorted((r.doc_id, round(r.score, 4)) for r in out)
    assert got == getattr(test_against_brute_force, "first", got)
    test_against_brute_force.first = got


def test_it_beats_the_counts_on_held_out_texts(spark):
    """On a thousand documents; on a few hundred the counts are still ahead."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = crc_bucket(F.col("doc_id"), 10) == 0
    r = L.score(docs, docs.filter(~held)).join(docs.filter(held).select("doc_id"), "doc_id").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > r.b


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert L.score(none, none).count() == 0
    r = L.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), none).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9)) == (3, 0, 0, 0.0) and r.score < 0


def test_scores_are_those_of_a_plain_reader(spark):
    """Every word one by one, in logarithms: a long unseen word costs what its pieces cost."""
    rows = [(i, t) for i, t in corpus(60) if i < 10_002] + [(20_000, "the on"), (20_000_1, "the on " + "qz" * 450), (20_002, "#" * 3000 + " the")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    held = crc_bucket(F.col("doc_id"), 10) == 0
    learn = docs.filter(~held & (F.col("doc_id") < 20_000)).coalesce(1)
    out = {r.doc_id: r.score for r in L.score(docs, learn, steps=40).collect()}
    speller = L.Speller(L.read_ranks())
    model = L.refine(L.train(learn, speller, "doc_id", "text", steps=40), learn, speller, "text")
    counts = Counter()
    for r in learn.collect():
        counts.update([*L.words_of((r.text or "").encode()), L.END])
    n = sum(counts.values())
    for i, t in rows[-8:]:
        words, want = L.words_of((t or "").encode()), 0.0
        ids = np.array([speller.end] + [p for w in words for p in speller.spell([w])[0].tolist()])
        after = [np.log(slow(model, ids, k)) for k in range(len(ids))]
        begins = [np.log(np.exp(a)[speller.leading].sum()) for a in after]
        at = 0
        for w in [*words, None]:
            if w is None:
                own, c = after[at][speller.end] - begins[at], counts[L.END]
            else:
                m = len(speller.spell([w])[0])
                own, c = sum(after[at + k][ids[at + k + 1]] for k in range(m)) - begins[at] + begins[at + m], counts[w]
                at += m
            mixed = own + math.log(0.7)
            want += (np.logaddexp(math.log(0.3 * c / n), mixed) if c else mixed) / math.log(10)
        assert out[i] == pytest.approx(want, rel=1e-3, abs=1e-2), i
    assert out[20_000_1] < out[20_000] - 300 and out[20_002] < -500


def test_what_is_learned_from_grows_with_the_texts():
    """A stretch of every SPAN bytes: of long texts in each, of short ones in as many as make up that much."""
    assert L.spans_of(b"a bc d", span=6) in ([(b"a bc d", True, True)], [])
    text = b" ".join(b"w%d" % i for i in range(20_000))
    spans = L.spans_of(text)
    assert len(text) // L.SPAN <= len(spans) <= len(text) // L.SPAN + 1 and all(w in set(text.split()) for p, _, _ in spans for w in p.split())
    short = [b"%d " % i * 100 for i in range(1000, 4000)]
    assert sum(len(L.spans_of(t)) for t in short) == pytest.approx(sum(map(len, short)) / L.SPAN, rel=0.15)
    assert sum(len(L.spans_of(t)) for t in (None, b"", b"a")) <= 3
    speller = L.Speller(L.read_ranks())
    x, t = L.span_windows(spans, L.Texts(speller), speller.end, len(speller.leading))
    assert len(x) > 0.9 * len(spans)
    x, t = L.span_windows([(b"a bc d", True, True), (b"a bc d", True, False)], L.Texts(speller), speller.end, len(speller.leading))
    ids, per, _, _ = (texts := L.Texts(speller)).ids(*texts.read([b"a bc d"]))
    wx, wt, _ = A.windows(ids, per, speller.end, len(speller.leading))
    assert (x[0] == wx[0]).all() and (t[0] == wt[0]).all() and t[1].tolist() == [*ids[1:], *[-1] * (A.STRIDE - len(ids) + 1)]


def test_every_window_is_learned_from(spark, monkeypatch):
    """Each id of every text is a target once, the end marks too; with a window of every 4,096 bytes most were none."""
    monkeypatch.setattr(L, "GROUP", 500)
    monkeypatch.setattr(L, "MIXED", 7)
    speller = L.Speller(L.read_ranks())
    data = [t and t.encode() for _, t in corpus(60)] + [b"long text " * 3000]
    pad, texts = len(speller.leading), L.Texts(speller)
    found = list(L.every_window(data, texts, speller.end, pad))
    assert max(len(x) for x, _ in found) <= 7
    got = np.concatenate([t[t >= 0] for _, t in found]).tolist()
    want = [i for d in data for i in [*speller.spell(L.words_of(d))[0].tolist(), speller.end]]
    assert got == want

    # A word that stands in one place of a long text: every place of it moves the weights.
    monkeypatch.undo()
    docs = lambda at: spark.createDataFrame([(1, " ".join(["word"] * at + ["other"] * 40 + ["word"] * (2000 - at)))], "doc_id long, text string").coalesce(1)
    start = A.Model(speller.leading, np.ones(pad))
    moved = [L.refine(A.Model(speller.leading, np.ones(pad)), docs(at), speller, "text").p for at in (400, 1000, 1600)]
    other = int(speller.spell([b"other"])[0][0])
    c, k = start.cls[other], start.member[other]
    for p in moved:
        assert p["bm"][c, k] > start.p["bm"][c, k]  # a target at least once, so its bias rose
