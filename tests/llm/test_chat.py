import hashlib
import random

from millrace.llm import chat


def expected(rows):
    told = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in rows)
    loss = "".join(t or "" for _, r, t in rows if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(rows), sha(told), len(loss), sha(loss)


def test_round_trip_of_hostile_texts(spark):
    rng = random.Random(5)
    bits = ["\\", "#", "###", "</turn>", "\n", "</turn>\n", "### assistant\n", "n", "word ", "é🙂", "<", "\\n", ""]
    rows, by = [], {}
    for conv in range(40):
        turns = []
        for turn in range(rng.randint(1, 30)):
            role = "system" if turn == 0 and conv % 3 == 0 else rng.choice(["user", "assistant", "a\\n\nb", "", "system"])
            text = None if rng.random() < 0.1 else "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))
            turns.append((turn, role, text))
        by[conv] = turns
        rows += [(conv, *t) for t in turns]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for budget in (1, 12, 60, 10_000):
        got = {r.conv_id: r for r in chat.read_back(chat.windows(df, budget=budget, history=3)).collect()}
        for conv, turns in by.items():
            r = got[conv]
            assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == expected(turns), (budget, conv)


def test_budget_and_context(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, i, "user" if i % 2 else "assistant", "w " * 10) for i in range(1, 20)]
    out = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=78, history=2).orderBy("window").collect()
    assert len(out) > 1
    for w in out:
        assert w.text.startswith("### system\nbe kind</turn>\n")
        turns = w.text.count("</turn>")
        assert (turns - 1) * 14 + 6 <= 78
        assert w.n_context == 0 if w.window == 0 else 1 < w.n_context <= 3


def test_budgets_hold_for_turns_of_any_size(spark):
    """Only a turn too long alone makes a longer window, and then without history; each turn is new once, in order."""
    rng, rows, size = random.Random(8), [], {}
    for conv in range(30):
        lead = rng.choice([0, 0, 3, 25])
        for turn in range(rng.randint(1, 60)):
            n = lead if turn == 0 and lead else rng.choice([0, 1, 5, 9, 14, 30, 70])
            rows.append((conv, turn, "system" if turn == 0 and lead else rng.choice(["user", "assistant"]), " ".join([f"c{conv}t{turn}"] * n)))
            size[conv, turn] = n + 4
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for budget, history in ((30, 2), (60, 3), (60, 0), (5, 2)):
        new = {c: [] for c in range(30)}
        for w in sorted(chat.windows(df, budget=budget, history=history).collect(), key=lambda r: (r.conv_id, r.window)):
            own = len(chat_turns(w.text))
            system = 1 if rows[next(i for i, r in enumerate(rows) if r[0] == w.conv_id)][2] == "system" else 0
            fresh = list(range(w.first_turn, w.first_turn + own - w.n_context))
            new[w.conv_id] += fresh
            back = [] if w.window == 0 else list(range(w.first_turn - (w.n_context - system), w.first_turn))
            assert len(back) <= history
            total = sum(size[w.conv_id, t] for t in {*fresh, *back, *([0] if system else [])})
            if total > budget:
                assert not back and len([t for t in fresh if t or not system]) <= 1
        assert all(got == sorted(t for c, t in size if c == conv) for conv, got in new.items())


def chat_turns(text):
    return [x for x in text.split(chat.END) if x]


def test_no_control_string_stands_in_a_text(spark):
    texts = ["#### Assistant: hi", "##", "###", "#" * 9, "a\\##b", "</turn></turn>", "## ## ###", "\n### Assistant: x", "#\\##"]
    df = spark.createDataFrame([(i, 0, "assistant", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    for r in chat.windows(df).collect():
        body = r.text.removeprefix("### assistant\n").removesuffix(chat.END)
        assert "##" not in body and "</turn>" not in body
    assert [r.loss_sha256 for r in chat.read_back(chat.windows(df)).orderBy("conv_id").collect()] == [hashlib.sha256(t.encode()).hexdigest() for t in texts]


def test_nulls_ties_empty_and_clashing_columns(spark):
    schema = "conv_id long, turn long, role string, text string, n long, sys long, prefix string, turns string"
    assert chat.read_back(chat.windows(spark.createDataFrame([], schema))).count() == 0
    rows = [(None, None, None, None, 1, 1, "p", "t"), (None, 0, "assistant", "b", 1, 1, "p", "t"), (None, 0, "assistant", "a", 1, 1, "p", "t"), (None, 0, "assistant", "a", 1, 1, "p", "t")]
    r = chat.read_back(chat.windows(spark.createDataFrame(rows, schema))).collect()
    assert len(r) == 1
    assert (r[0].n_turns, r[0].turns_sha256, r[0].loss_chars, r[0].loss_sha256) == expected([(None, None, None), (0, "assistant", "a"), (0, "assistant", "a"), (0, "assistant", "b")])


def test_query_against_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{d}/conversations.parquet'")
    want = sorted(con.sql(chat.SQL).fetchall())
    got = sorted(tuple(r) for r in chat.query(spark, d).collect())
    assert got == want
