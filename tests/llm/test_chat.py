import re

from bindery.llm import chat

MAIL = [(1, 0, "user", "Shall we meet on Monday?\n\nI have time at nine.\nBring the report.", 1),
        (1, 1, "user", "Another matter altogether.", 1),
        (1, 2, "assistant", "On Monday, A wrote:\n> Shall we  meet on monday?\nYes.\n\n> I have time at nine. Bring the report.\nGood.", 1),
        (1, 3, "user", "> Yes.\n>> Shall we meet on Monday?\n\nFine then.", 1),
        (1, 4, "user", "> Another matter\n> altogether.\nWhich one?", 1),
        (1, 5, None, "> nobody said this\nHm.", 1), (1, 6, "user", None, 1), (2, 0, "user", "Yes.", 1), (2, 1, "user", "a > b", 1),
        (None, 0, "user", "> Yes.\nlost", 1), (3, None, "user", "> x", 1)]
SHAPE = "conv_id long, turn long, role string, text string, lines int"


def test_links_and_order(spark):
    df = chat.conversations(spark.createDataFrame(MAIL, SHAPE))
    rows = df.collect()
    assert len(rows) == len(MAIL)
    by = {(r.conv_id, r.turn): r for r in rows}
    assert {t: by[1, t].reply_to for t in range(7)} == {0: None, 1: None, 2: 0, 3: 2, 4: 1, 5: None, 6: None}
    order = sorted((r.thread_turn, r.turn) for r in rows if r.conv_id == 1)
    assert [t for _, t in order] == [0, 2, 3, 1, 4, 5, 6]
    assert by[1, 3].quoted_turns == "1:2,2:0" and by[1, 3].n_linked == 2 and by[1, 2].quoted_turns == "1:0"
    assert by[1, 2].text == "Yes.\n\nGood." and by[1, 3].text == "Fine then." and by[1, 6].text == "" and by[2, 1].text == "a > b"
    assert by[1, 5].formatted == "<|unknown|>\nHm." and by[1, 5].n_quote_lines == 1 and by[1, 5].n_linked == 0
    assert by[None, 0].reply_to is None and by[3, None].text == ""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_long_chains_and_repeats(spark):
    rows = [(1, 0, "user", "message number 0", 1)] + [(1, i, "user", f"> message number {i - 1}\nmessage number {i}", 1) for i in range(1, 40)]
    rows += [(2, i, "user", "same words", 1) for i in range(50)] + [(2, 50, "user", "> same words\nok", 1)] * 2
    got = chat.conversations(spark.createDataFrame(rows, SHAPE)).collect()
    assert {r.thread_turn for r in got if r.conv_id == 1} == {0} and len(got) == len(rows)
    assert [r.reply_to for r in got if r.conv_id == 2 and r.turn == 50] == [0, 0]
    assert chat.conversations(spark.createDataFrame([], SHAPE)).count() == 0


def test_like_the_sql(spark):
    import duckdb
    import pandas as pd

    from bindery.llm.queries import ORACLES
    from checks.parity import rows_sorted

    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(MAIL + [(c + 5, *rest) for c, *rest in DEEP], columns=["conv_id", "turn", "role", "text", "lines"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    found = con.execute(ORACLES["op8_chat_formatting"])
    columns = [d[0] for d in found.description]
    df = chat.conversations(spark.createDataFrame(MAIL + [(c + 5, *rest) for c, *rest in DEEP], SHAPE))
    assert rows_sorted(df.columns, [tuple(r) for r in df.collect()]) == rows_sorted(columns, found.fetchall())


DEEP = [(1, 0, "a", "First point, which is long. Second point!\n\nAnother paragraph, over\ntwo lines.\n\nThe end.", 1),
        (1, 1, "b", "> Another paragraph, over two\n> lines.\n>\n> The end.\nI see.", 1),  # wrapped anew
        (1, 2, "c", ">> Second\n>> point!\n> I see.\nMe too.", 1), (1, 3, "d", ">>> First point, which\n>>> is long.\n>> nothing of this was said\n> nor this\nSo.", 1),
        (1, 4, "e", "> > > > The end.\nDeep.", 1)]


def test_every_depth_and_wrapped_paragraphs(spark):
    by = {r.turn: r for r in chat.conversations(spark.createDataFrame(DEEP, SHAPE)).collect()}
    assert [by[t].quoted_turns for t in range(5)] == ["", "1:0", "1:1,2:0", "3:0", "4:0"]
    assert [by[t].reply_to for t in range(5)] == [None, 0, 1, 0, 0]
    assert {r.thread_turn for r in by.values()} == {0} and by[3].text == "So."


def test_clashing_names(spark):
    rows = [(1, 0, "u", "One line said here.", "x", 1, None), (1, 1, "u", "> One line said here.\nok", "y", 2, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv string, own long, hash string")
    assert [r.reply_to for r in chat.conversations(df).orderBy("turn").collect()] == [None, 0]
