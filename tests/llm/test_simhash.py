import random

import numpy as np
import pytest
import xxhash

from millrace.llm import simhash
from millrace.llm.components import components


def slow_fingerprint(text, n=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    sh = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(prints, radius=3):
    ids = list(prints)
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_fingerprints_and_components(spark):
    rng = random.Random(1)
    words = [f"w{i}É" for i in range(300)]
    texts = [None, "", " \n", "one", "One two", "a b c d"]
    base = [" ".join(rng.choices(words, k=rng.randint(1, 900))) for _ in range(60)]
    for t in base:
        texts.append(t)
        for _ in range(rng.randint(0, 4)):
            w = t.split(" ")
            w[rng.randrange(len(w))] = rng.choice(["X", "", "\t y"])
            texts.append(" ".join(w))
    texts += [base[0]] * 30
    rows = [(i, t, "fp", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, same string, component_id long")
    prints = {i: slow_fingerprint(t) for i, t, _, _ in rows}
    want = slow_components(prints)
    got = simhash.near_duplicates(df, tile_rows=16).collect()
    assert {r.doc_id: r.fp % (1 << 64) for r in got} == prints
    assert {r.doc_id: r.component_id for r in got} == want
    kept = simhash.dedup(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


@pytest.mark.parametrize("radius,tile_rows", [(3, 40), (3, 4000), (5, 64)])
def test_hot_bins(spark, radius, tile_rows):
    """Chains and clouds of close fingerprints that share most blocks."""
    rng = random.Random(9)
    fps, x = set(), rng.getrandbits(64)
    for _ in range(300):
        x ^= 1 << rng.randrange(16)
        fps.add(x)
    for _ in range(8):
        c = rng.getrandbits(64)
        fps |= {c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(60)}
    fps = sorted(fps)
    want = slow_components(dict(enumerate(fps)), radius)
    df = spark.createDataFrame([(i, f - (1 << 64) * (f >> 63)) for i, f in enumerate(fps)], "doc_id long, fp long")
    got = simhash.groups(df, "doc_id", radius, tile_rows).collect()
    assert {r["first"]: r.component_id for r in got} == want


def test_links_are_few(spark):
    fp = np.arange(2000, dtype=np.uint64)
    links = simhash.compare_tile(fp[:1024], np.bitwise_count(fp[:1024]).astype(int), np.zeros(1024, int), 3)
    assert len(links) == 1023


def test_empty_and_null_ids(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(None, "a"), (None, "a"), (None, "b c d e"), (4, "q r s"), (4, "q r s"), (4, "z")], "doc_id long, text string")
    assert sorted(simhash.dedup(df).collect(), key=str) == sorted([(4, "q r s"), (4, "z"), (None, "a"), (None, "b c d e")], key=str)


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001 + i) for i in range(300)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 201)) and all(got[1001 + i] == 1000 for i in range(300)) and len(got) == 500


def test_near_copies_go_only_for_one_that_stays(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(2000)]
    rows, copies = [], 0
    for i in range(150):
        w = rng.choices(words, k=rng.randint(100, 900))
        rows.append((len(rows), " ".join(w)))
        if i % 2:
            x = list(w)
            x[rng.randrange(len(x))] = "changed"
            rows.append((len(rows), " ".join(x)))
            copies += 1
    rows += [(9000, None), (9001, ""), (9002, "a b c"), (None, "q r s t u v")]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, __id int, part string")
    out = simhash.drop_similar(df)
    assert out.columns == df.columns
    left = {r.doc_id: r.text for r in out.collect()}
    gone = [r for r in rows if r[0] not in left]
    assert len(gone) >= 0.9 * copies
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for i, t in rows if t}
    for i, t in gone:
        assert t == "" or max(len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for j in left if left[j] and j is not None and j < i) >= 0.8
    assert None in left and 9002 in left and (9000 in left) and 9001 not in left
    assert simhash.drop_similar(df.limit(0)).count() == 0
    assert simhash.similarity(b"A b c d e f", b"a B c d e g", 5) == pytest.approx(1 / 3)


def test_sketches_rule_out_no_near_pair():
    """Bits that differ at a similarity of 0.8: far fewer than what is ruled out; unrelated texts are."""
    rng, limit = random.Random(3), simhash.far_bits(0.8)
    for _ in range(40):
        w = [f"w{rng.randrange(9000)}" for _ in range(rng.randint(60, 900))]
        x = list(w)
        while simhash.similarity(" ".join(w).encode(), " ".join(x).encode(), 5) > 0.83:
            x[rng.randrange(len(x))] = f"x{rng.random()}"
        a, b, c = (simhash.bins_of(" ".join(t).encode(), 5)[1].view(np.uint64) for t in (w, x, rng.sample(w, len(w))))
        if simhash.similarity(" ".join(w).encode(), " ".join(x).encode(), 5) >= 0.8:
            assert np.bitwise_count(a ^ b).sum() <= limit
        assert np.bitwise_count(a ^ c).sum() > limit
