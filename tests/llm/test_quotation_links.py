from collections import Counter

import pytest

from crashrisk.llm.quotation_links import op4, parse_message, unquote

FIRST = "Hello all,\n\nI think the cat is on the mat today.\nWhat do you say?"
ROWS = [
    (1, 0, "a", FIRST),
    (1, 1, "b", "On Monday A wrote:\n> I think the cat is on the mat today.\n> What do you say?\n\nI agree with you on this."),
    (1, 2, "c", "> > I think the cat\n> > is on the mat today.\n> > What do you say?\n> I agree with you on this.\nNo, not at all my friend."),
    (1, 3, "d", "> Hello all,\n>\n> I THINK the cat is on the mat today!\nReply to the first one."),
    (2, 0, "x", "> I agree with you on this.\nFrom elsewhere"),
    (2, 1, "y", None),
    (3, 0, "s", ">not known at all here\nx > y"),
    (3, 5, "t", "a gap before this"),
    (None, None, None, "> quoted\nown"),
]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")


def test_links(frame):
    got = {(r["conv_id"], r["turn"]): tuple(r)[3:] for r in unquote(frame).collect()}
    # text, answered message, thread, depth, quoted passages, linked passages
    assert got == {
        (1, 0): (FIRST, None, None, 1, 0, 0, 0, 0),
        (1, 1): ("I agree with you on this.", 1, 0, 1, 0, 1, 1, 1),
        (1, 2): ("No, not at all my friend.", 1, 1, 1, 0, 2, 2, 2),
        (1, 3): ("Reply to the first one.", 1, 0, 1, 0, 1, 1, 1),
        (2, 0): ("From elsewhere", 1, 1, 1, 0, 2, 1, 1),
        (2, 1): ("", 2, 0, 1, 0, 3, 0, 0),
        (3, 0): ("x > y", None, None, 3, 0, 0, 1, 0),
        (3, 5): ("a gap before this", None, None, 3, 5, 0, 0, 0),
        (None, None): ("own", None, None, None, None, 0, 1, 0),
    }


def test_parsing():
    own, units, passages = parse_message("x\n>> deep one here\n> level one\n>\n> level one again\ny")
    assert own == "x\ny" and [d for d, _ in passages] == [2, 1]
    assert len(passages[1][1]) == 2  # the passage, and the paragraph and line of three words
    assert parse_message("") == ("", {}, [])


def test_conversations_without_quotes(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()
    turns = {(r["conv_id"], r["turn"]) for r in rows}
    got = {(r["conv_id"], r["turn"]): r for r in op4(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for row in rows:
        r = got[row["conv_id"], row["turn"]]
        before = (row["conv_id"], row["turn"] - 1)
        assert r["text"] == row["text"] and (r["parent_conv"], r["parent_turn"]) == (before if before in turns else (None, None))
        assert (r["thread_conv"], r["thread_turn"], r["depth"]) == (row["conv_id"], row["turn"] - r["depth"], r["depth"])


def test_long_threads_ties_and_clashing_names(spark):
    rows = [(7, i, "u", "> same quoted words here\nsame quoted words here") for i in range(70)] + [(7, 3, "v", "a second message of this turn")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'z' AS depth", "'z' AS hash", "'z' AS conv")
    got = Counter((r["turn"], r["parent_turn"], r["depth"]) for r in unquote(frame).collect())
    want = Counter((i, 0 if i else None, 1 if i else 0) for i in range(70))
    want[3, 0, 1] += 1
    assert got == want


def test_empty_table(frame):
    assert unquote(frame.limit(0)).count() == 0
