"""Quotation links: worked threads, and the SQL on messages that do quote."""

import random

import duckdb

from check import compared
from lateline.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string, p string, depth int"
THREAD = [
    (1, 0, "user", "Shall we ship on Friday?\n\nThe tests are green.", "x", 1),
    (1, 1, "assistant", "Unrelated remark.", "x", 1),
    (1, 2, "user", "ann wrote:\n> The  tests ARE\n> green.\n\nThen yes.", "x", 1),
    (1, 3, "assistant", "On Monday bob wrote:\n\n> Then yes.\n>> The tests are green.\nAgreed.", "x", 1),
    (1, 4, "user", "> Unrelated remark.\nWhy?", "x", 1),
    (2, 0, "user", "> Agreed.\nA quote from elsewhere", "x", 1),
    (2, 1, "user", "> nobody said this\nhm", "x", 1),
]


def run(spark, tmp_path, rows):
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame(rows, SCHEMA).write.parquet(path)
    df = quotes.query(spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    result = db.execute(quotes.SQL)
    return compared(df.columns, [tuple(r) for r in df.collect()]), compared([c[0] for c in result.description], result.fetchall())


def test_thread(spark):
    found = quotes.reply_ordered(spark.createDataFrame(THREAD, SCHEMA)).collect()
    rows = {(r["conv_id"], r["turn"]): r for r in found}
    link = lambda c, t: (rows[c, t]["reply_conv"], rows[c, t]["reply_turn"], rows[c, t]["thread_turn"], rows[c, t]["depth"])
    assert link(1, 0) == link(1, 1)[:2] + (0, 0) == (None, None, 0, 0)
    assert link(1, 2) == (1, 0, 0, 1) and link(1, 3) == (1, 2, 0, 2) and link(1, 4) == (1, 1, 1, 1)
    assert link(2, 0) == (1, 3, 0, 0) and link(2, 1) == (None, None, 1, 0)
    assert rows[1, 2]["text"] == "Then yes." and rows[1, 3]["text"] == "Agreed."
    assert rows[1, 3]["n_quotes"] == rows[1, 3]["n_linked"] == rows[1, 3]["max_level"] == 2
    ordered = [(r["conv_id"], r["turn"]) for r in quotes.in_order(quotes.reply_ordered(spark.createDataFrame(THREAD, SCHEMA))).collect()]
    assert ordered == [(1, 0), (1, 2), (1, 3), (1, 1), (1, 4), (2, 0), (2, 1)]


# the first source of a line lies in the quoting conversation, at the same or a later turn
ELSEWHERE = [
    (0, 0, "u", "> common line\nwhat of it", "x", 1),
    (0, 1, "u", "common line", "x", 1),
    (1, 0, "u", "common line", "x", 1),
    (2, 0, "u", "> common line\nindeed", "x", 1),
    (3, 0, "u", "> own line\nown line", "x", 1),
    (4, 0, "u", "> self\nself", "x", 1),
    (7, 3, "u", "own line", "x", 1),
    (9, 1, "u", "own line", "x", 1),
]


def test_source_in_another_conversation(spark, tmp_path):
    rows = {(r["conv_id"], r["turn"]): r for r in quotes.reply_ordered(spark.createDataFrame(ELSEWHERE, SCHEMA)).collect()}
    link = lambda c, t: (rows[c, t]["n_linked"], rows[c, t]["reply_conv"], rows[c, t]["reply_turn"])
    assert link(0, 0) == (1, 1, 0) and link(2, 0) == (1, 0, 1) and link(3, 0) == (1, 7, 3) and link(4, 0) == (0, None, None)
    got, want = run(spark, tmp_path, ELSEWHERE)
    assert got == want


def test_query_against_sql(spark, tmp_path):
    rng = random.Random(6)
    rows, said = list(THREAD), []
    rows += [(None, 1, "user", "> Agreed.\nno id", None, None), (1, None, "user", "> Agreed.", "x", 1), (3, 0, None, None, "x", 1), (3, 1, "u", "", "x", 1)]
    rows += [(3, 2, "u", " \n>\n> >\n>>> x\n\t> y\r\nz\r", "x", 1), (1, 2, "user", THREAD[2][3], "x", 1), (4, 0, "u", "word " * 50_000, "x", 1)]
    for conv in range(10, 18):
        for turn in range(12):
            lines = []
            for text in rng.sample(said, min(len(said), rng.randrange(3))):
                level = rng.randrange(1, 4)
                lines += ["someone wrote:"] * rng.randrange(2) + [">" * level + " " + text]
            own = rng.choice(["yes", "no", f"point {rng.randrange(20)}", f"idea {conv} {turn}\nsecond line {turn}"])
            said += own.split("\n")
            rows.append((conv, turn, "u", "\n".join([*lines, *[""] * rng.randrange(2), own]), "x", 1))
    got, want = run(spark, tmp_path, rows)
    assert got == want


def test_long_chain_and_hot_passage(spark):
    chain = [(1, 0, "u", "say 0", "x", 1)] + [(1, i, "u", f"> say {i - 1}\nsay {i}", "x", 1) for i in range(1, 40)]
    hot = [(2, 0, "u", "hot line", "x", 1)] + [(2, i, "u", "> hot line\nme too", "x", 1) for i in range(1, 200)]
    rows = {(r["conv_id"], r["turn"]): r for r in quotes.reply_ordered(spark.createDataFrame(chain + hot, SCHEMA)).collect()}
    assert all(rows[1, i]["thread_turn"] == 0 and rows[1, i]["depth"] == i for i in range(40))
    assert all(rows[2, i]["reply_turn"] == 0 and rows[2, i]["depth"] == 1 for i in range(1, 200))


def test_no_python(spark):
    plan = quotes.parsed(spark.createDataFrame(THREAD, SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table(spark, tmp_path):
    got, want = run(spark, tmp_path, [])
    assert got[1] == want[1] == []
