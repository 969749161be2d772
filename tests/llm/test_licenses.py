import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.llm import licenses


def brute(rows, threshold):
    terms = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())
    df = Counter(t for _, x in rows for t in set(terms(x)))
    idf = lambda t: math.log((1 + len(rows)) / (1 + df[t] * (t in licenses.VOCABULARY))) + 1
    vec = lambda t: {k: n * idf(k) for k, n in Counter(terms(t)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    temps = [(n, vec(x)) for n, xs in licenses.TEMPLATES.items() for x in xs]

    def own(text):
        best, lines = (None, None), (text or "").lower().split("\n")
        units = list(lines)
        run = []
        for x in [*lines, ""]:
            if x.strip():
                run.append(x)
            else:
                if len(run) > 1:
                    units.append("\n".join(run))
                units += ["\n".join(run[a : b + 1]) for a, b in licenses.pieces(0, len(run) - 1)]
                run = []
        for u in units:
            v = vec(u)
            for n, t in temps:
                c = sum(t[k] * v[k] for k in t if k in v) / (norm(t) * norm(v)) if v else 0
                if c >= threshold and (best[1] is None or c > best[1] + 1e-9):
                    best = n, c
        return best

    got = [(p, *own(x)) for p, x in rows]
    granted = {}
    for p, lic, c in got:
        if p is not None and lic and re.match(licenses.LICENCE_FILE, p.rpartition("/")[2]):
            granted.setdefault(p.rpartition("/")[0], []).append((-c, lic, p))
    out = []
    for p, lic, c in got:
        up, src = (p.rpartition("/")[0] if p is not None else None), None
        while lic is None and up is not None:
            if up in granted:
                src = up
                break
            if not up:
                break
            up = up.rpartition("/")[0]
        out.append((p, lic, c and round(c, 9), lic or (min(granted[src])[1] if src is not None else None), src))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(6)
    statements = [x for xs in licenses.TEMPLATES.values() for x in xs]
    dirs = ["", "a", "a/b", "a/b/c", "a/b/c/d", "z", "z/y/x", "q"]
    rows = []
    for i in range(250):
        d = rng.choice(dirs + ["a/b/c"] * 8)
        name = rng.choice(["LICENSE", "COPYING.txt", "main.py", "x.txt", f"f{i}", "licenses.py"])
        lines = [" ".join(rng.choices(["the", "of", "work", "version", "code", "public", "blah", "use", "file"], k=rng.randint(0, 9))) for _ in range(rng.randint(0, 9))]
        if rng.random() < 0.4:
            s = rng.choice(statements).split(" ")
            for _ in range(rng.randint(0, 3)):
                s[rng.randrange(len(s))] = rng.choice(["foo", "the", ""])
            k = rng.randint(1, len(s))
            lines.insert(rng.randint(0, len(lines)), "# " + " ".join(s[:k]) + "\n# " + " ".join(s[k:]) if rng.random() < 0.5 else "// " + " ".join(s).upper())
        rows.append((f"{d}/{name}" if d else name, "\n".join(lines)))
    rows += [(None, statements[0]), (None, None), ("a/b/x", None), ("a/b/y", ""), ("/abs/f", "x")] + rows[:5]
    df = spark.createDataFrame([(*r, "dir", 2.0) for r in rows], "path string, text string, `from` string, own_score double")
    for threshold in (0.6, 0.8):
        got = licenses.scan(df.withColumn("dir", F.lit("x")).withColumn("near", F.lit(1)), threshold=threshold, keep=("dir", "near", "from", "own_score")).collect()
        assert {r.dir for r in got} == {"x"}
        assert sorted(((r.path, r.own_license, r.own_score and round(r.own_score, 9), r.license, r.inherited_from) for r in got), key=str) == brute(rows, threshold)


def test_every_line_of_the_tables_statements_is_told(spark):
    text = "x y z\n" * 2000
    for s, want in (("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("Released under the MIT License.", "MIT"), ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"), ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0")):
        assert licenses.Scanner(1000, {}).scan((text + s + "\n" + text).encode())[0] == want
    assert licenses.Scanner(1000, {}).scan(text.encode()) == (None, None)


def test_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], "path string, text string")).count() == 0


@pytest.mark.parametrize("path,want", [("a/b", "a"), ("/x", ""), ("a/b/c.txt", "a/b")])
def test_parent(spark, path, want):
    from pyspark.sql import functions as F

    assert spark.range(1).select(licenses.parent(F.lit(path))).first()[0] == want


def test_pieces_cover_a_run():
    for n in (1, 2, 3, 4, 5, 9, 40, 101):
        got = list(licenses.pieces(0, n - 1))
        assert all(0 <= a < b < n and b - a + 1 < n for a, b in got)
        for length in {b - a + 1 for a, b in got}:
            assert {x for a, b in got if b - a + 1 == length for x in range(a, b + 1)} == set(range(n))


def test_wrapped_headers_and_long_runs():
    """A header wrapped over lines with code right behind it, and one spread over more than forty lines."""
    mit = licenses.TEMPLATES["MIT"][1]
    words = mit.split()
    wrapped = "\n".join(" ".join(words[i : i + 7]) for i in range(0, len(words), 7))
    code = "\n".join(f"import module{i} as m{i}" for i in range(200))
    scanner = licenses.Scanner(1000, {})
    for text in (wrapped + "\n" + code, code + "\n" + wrapped + "\n" + code):
        name, score = scanner.scan(text.encode())
        assert name == "MIT" and score > 0.8
    name, score = scanner.scan("\n".join(words).encode())
    assert len(words) > 45 and name == "MIT" and score == pytest.approx(1)
