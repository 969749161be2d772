"""What operators left undone before; each test failed then."""

import importlib
import random

import pytest

from millrace.llm import decontam, simhash


def test_lines_of_documents_are_cut(spark):
    """A line on a tenth of a source's documents goes; one on 4 of 100 stays."""
    pipeline = importlib.import_module("corpus_pipeline")
    rows = [(i, f"own {i}\n" + ("again and again\n" if i % 10 == 0 else "") + ("seldom\n" if i in (1, 2, 3, 4) else "") + f"end {i}", "en", "s", 0) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in pipeline.line_dedup_stage(spark, df, "").collect()}
    assert got == {i: t.replace("again and again\n", "") for i, t, *_ in rows}


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def greedy(rows, least=0.8):
    """In the order of ids, what isn't as near as that to any that stays."""
    sets, stays = {i: shingles(t) for i, t in rows}, []
    for i in sorted(sets):
        if all(len(sets[i] & sets[j]) < least * len(sets[i] | sets[j]) for j in stays):
            stays.append(i)
    return stays


def edited(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"x{rng.randrange(10**6)}"
    return out


def left_of(spark, rows, **more):
    return sorted(r.doc_id for r in simhash.drop_similar(spark.createDataFrame(rows, "doc_id long, text string"), **more).collect())


def test_near_copies_down_to_the_similarity_go(spark):
    """Copies at 0.8 to 0.95, whose fingerprints differ in far more than 6 bits."""
    rng, rows = random.Random(5), []
    for i in range(60):
        w = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(150, 400))]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(edited(rng, w, max(1, len(w) * (1 + i % 4) // 200))))]
    want = greedy(rows)
    assert len(want) < 65
    assert left_of(spark, rows) == want


@pytest.mark.parametrize("leads", [8, 1])
def test_members_of_a_group_are_held_against_each_other(spark, leads):
    """Chains of versions, each near the one before it and far from the first."""
    rng, rows = random.Random(6), []
    for c in range(4):
        w = [f"c{c}w{rng.randrange(3000)}" for _ in range(600)]
        for v in range(12):
            rows.append((c + 4 * v, " ".join(w)))
            at = rng.randrange(580)
            w = [*w[:at], *(f"x{rng.randrange(10**6)}" for _ in range(20)), *w[at + 20 :]]
    want = greedy(rows)
    assert 4 < len(want) < 40
    assert left_of(spark, rows, leads=leads) == want


def test_cuts_do_not_depend_on_the_blocks_of_the_benchmark(spark):
    """Windows of two blocks overlap, and a cut for the second brings together a phrase of the first."""
    items = [(1, "a b c d e"), (2, "d e f g h"), (3, "p q r s t")]
    docs = [(1, "x a b c d e f g h y"), (2, "x a b p q r s t c d e y"), (3, None), (4, "none here")]
    d = spark.createDataFrame([(*r, 7, "k") for r in docs], "doc_id long, text string, spans long, items string")
    b = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    for chars in (1, 100_000):
        got = decontam.cut_spans(d, b, window=5, block_chars=chars)
        assert got.schema == d.schema
        assert {r.doc_id: r.text and r.text.split() for r in got.collect()} == {1: ["x", "y"], 2: ["x", "y"], 3: None, 4: ["none", "here"]}
        assert all((r.spans, r["items"]) == (7, "k") for r in got.collect())


def test_toxicity_stage_learns_from_all_labelled_rows(spark, tmp_path):
    """Toxic documents with a word that only rows beyond the first 5,000 of a label hold go; they were kept while those rows taught nothing."""
    import importlib
    import zlib

    from pyspark.sql import functions as F

    by_hash = [r.id for r in spark.range(9000).orderBy(F.xxhash64("id"), "id").collect() if zlib.crc32(str(r.id).encode()) % 5]
    rows = [(i, "alpha" if k < 5000 else "omega", 1) for k, i in enumerate(by_hash)] + [(i, f"w{i} q{i}", 0) for i in range(10_000, 12_000)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r.text for r in importlib.import_module("corpus_pipeline").toxicity_stage(spark, docs, str(tmp_path)).select("text").collect()}
    assert not kept & {"alpha", "omega"} and len(kept) > 1900


def test_toxicity_stage_holds_no_labelled_row_out(spark, tmp_path):
    """A word that only rows with remainder 0 hold is learned too; no contract holds those rows out of the pipeline."""
    import zlib

    part = lambda i: zlib.crc32(str(i).encode()) % 5
    rows = [(i, "alpha" if part(i) else "omega", 1) for i in range(2000)] + [(i, f"w{i} q{i}", 0) for i in range(10_000, 12_000)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r.text for r in importlib.import_module("corpus_pipeline").toxicity_stage(spark, docs, str(tmp_path)).select("text").collect()}
    assert not kept & {"alpha", "omega"} and len(kept) > 1900
