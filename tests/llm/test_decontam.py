import hashlib
import random
import re

import numpy as np
import pytest

from millrace.llm import decontam
from millrace.llm.fm_index import FMIndex, suffix_order

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, n=10):
    wins = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            wins.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, names = words(t), set(), set()
        for size in {len(x) for x in wins}:
            for k in range(len(w) - size + 1):
                if (x := tuple(w[k : k + size])) in wins:
                    hit |= set(range(k, k + size))
                    names |= wins[x]
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(6))
def test_index_against_scanning(seed):
    rng = np.random.default_rng(seed)
    top = [1, 3, 40, 70000, 5, 2][seed]
    runs = [rng.integers(1, top + 1, rng.integers(1, 90)) for _ in range(30)]
    runs += [runs[0]] * 3
    text = np.concatenate([np.r_[r, 0] for r in runs])
    ends = np.flatnonzero(text == 0)
    left = ends[np.searchsorted(ends, np.arange(len(text)))] - np.arange(len(text))
    want = sorted(range(len(text)), key=lambda i: (text[i : i + left[i] + 1].tolist(), i))
    assert suffix_order(text, left, int(top).bit_length()).tolist() == want
    index = FMIndex(text, top)
    for _ in range(200):
        r = runs[rng.integers(len(runs))]
        k = rng.integers(len(r))
        p = r[k : k + 10] if rng.random() < 0.8 else rng.integers(1, top + 1, 4)
        low, high = index.search(np.r_[np.zeros(10 - len(p), int), p][None, :])
        places = sorted(index.locate(np.arange(low[0], high[0])).tolist()) if high[0] > low[0] else []
        assert places == [i for i in range(len(text) - len(p) + 1) if (text[i : i + len(p)] == p).all()]


@pytest.mark.parametrize("block,shard", [(10**7, 400_000), (300, 200)])
def test_against_brute_force(spark, monkeypatch, block, shard):
    monkeypatch.setattr(decontam, "SHARD_WORDS", shard)
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(60)] + ["É9", "ß"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([1, 3, 9, 10, 11, 40])))) for i in range(30)]
    items += [(99, None), (98, " -- "), (3, items[4][1]), (97, items[5][1])]
    docs = [(1, None), (2, ""), (3, "..."), (4, "x " * 5000 + items[0][1])]
    for i in range(5, 120):
        w = rng.choices(vocab, k=rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            k = rng.randint(0, len(w))
            w[k:k] = rng.choice(items[:30])[1].upper().split(" ")
        docs.append((i, ", ".join(w)))
    docs += docs[:9]
    d = spark.createDataFrame([(*x, "spans", 1) for x in docs], "doc_id long, text string, items string, n_words long").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = decontam.find(d, b, keep=("doc_id",), block_chars=block)
    from pyspark.sql import functions as F

    got = [(r.doc_id, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.n_hit > 0) for r in rows.withColumn("n_hit", decontam.hits(F.col("spans"))).collect()]
    assert sorted(got, key=str) == brute(docs, items)
    left = {r.doc_id: r.text for r in decontam.cut_spans(d.drop("items", "n_words"), b).collect()}
    assert left[1] is None and left[2] == "" and left[3] == "..."


def test_empty_tables(spark):
    d, b = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontam.find(d, b).select("n_words", "spans").first() == (2, [])
    assert decontam.find(d.limit(0), d.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_cut(spark):
    d = spark.createDataFrame([(1, "Keep, THIS one: is (out) now."), (2, "none here")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "this one is")], "item_id long, text string")
    got = {r.doc_id: r.text for r in decontam.cut_spans(d, b).collect()}
    assert got == {1: "Keep,  (out) now.", 2: "none here"}


def test_rows_of_phrases():
    items = [("b", b"a b c d e"), ("a", b"b c d e"), ("b", b"x"), ("c", b""), ("a", b"b c d e f a b c")]
    p = decontam.Phrases(items, 4)
    word = {i: w.decode() for w, i in p.ids.items()}
    got = {" ".join(word[x] for x in row if x): p.items(np.array([k])) for k, row in enumerate(p.rows.tolist())}
    assert got == {"a b c d": {"b"}, "b c d e": {"a", "b"}, "c d e f": {"a"}, "d e f a": {"a"}, "e f a b": {"a"}, "f a b c": {"a"}, "x": {"b"}}
    assert p.lengths.tolist() == [sum(x > 0 for x in row) for row in p.rows.tolist()] and p.shortest == 1


def test_no_phrase_is_left_with_many_blocks(spark):
    """Cuts bring words together; whatever the blocks, brute force finds nothing afterwards, and spans are the same."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(2, 5)))) for i in range(14)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(40)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    found = [sorted((r.doc_id, [tuple(x) for x in r.spans], r["items"]) for r in decontam.find(d, b, window=4, block_chars=c).collect()) for c in (1, 40, 10**6)]
    assert found[0] == found[1] == found[2]
    cut = [sorted(tuple(r) for r in decontam.cut_spans(d, b, window=4, block_chars=c).collect()) for c in (40, 10**6)]
    assert cut[0] == cut[1]
    grams = {tuple(t.split()[i : i + min(4, len(t.split()))]) for _, t in items for i in range(max(1, len(t.split()) - 3))}
    assert not any(tuple(t.split()[i : i + len(g)]) == g for _, t in cut[0] for g in grams for i in range(len(t.split())))
