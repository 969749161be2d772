import random

from millrace.llm import line_dedup


def brute(rows, ratio, min_pages, keep_whole):
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r")
    hosts = {}
    for _, h, t in rows:
        hosts.setdefault(h, []).append({strip(x) for x in (t or "").split("\n")} - {""})
    drop = {h: {x for p in ps for x in p if (n := sum(x in q for q in ps)) >= min_pages and n / len(ps) > ratio} for h, ps in hosts.items()}
    out = []
    for i, h, t in rows:
        if t is None or not drop[h]:
            out.append((i, t, 0))
            continue
        kept = [x for x in t.split("\n") if strip(x) not in drop[h]]
        if keep_whole and not any(strip(x) for x in kept):
            out.append((i, t, 0))
        else:
            out.append((i, "\n".join(kept), len(t.split("\n")) - len(kept)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        host = rng.choice(["a", "a", "a", "b", "c", None, "rare%d" % i])
        lines = [rng.choice(["menu", " menu ", "foot\t", "line %d" % rng.randint(0, 40), "", "x" * 5000]) for _ in range(rng.randint(0, 8))]
        rows.append((i, host, None if rng.random() < 0.05 else "\n".join(lines)))
    rows += rows[:20]
    df = spark.createDataFrame([(*r, "z", 5) for r in rows], "page_id long, host string, text string, line string, n long")
    for ratio, least, keep in ((0.2, 5, False), (0.05, 2, True)):
        got = line_dedup.dedup_lines(df, "host", "text", ratio, least, keep)
        assert got.columns == [*df.columns, "n_lines_dropped"]
        assert sorted(((r.page_id, r.text, r.n_lines_dropped) for r in got.collect()), key=str) == brute(rows, ratio, least, keep)


def test_empty_table(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], "host string, text string"), "host", "text").count() == 0
