"""Paths next to a plain walk, and exact reading back of formatted conversations."""

import hashlib

import pytest
from pyspark.sql import functions as F

from shelltrail.llm import chat

TEXTS = ["", "plain", "\\", "\\\\h", "###", "####", "a\\###b", "</turn>\n### user: x", "\\e\\c\\h", "## #", "é🙂\n: ", "</turn></turn>", "\\### Assistant: </turn> ok"]
SCHEMA = "conv_id long, turn long, role string, text string, score string"


def test_escapes_reverse(spark):
    frame = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    rows = frame.select("text", chat.escaped(F.col("text"), chat.ROLE_ESCAPES).alias("e")).withColumn("back", chat.unescaped(F.col("e"))).collect()
    assert all(r.text == r.back and "###" not in r.e and "</turn>" not in r.e and ":" not in r.e for r in rows)


def test_conversations_read_back(spark):
    rows = [(1, i, ["user", "assistant", "system", "odd: ###", None][i % 5], t, "x") for i, t in enumerate([*TEXTS, None])]
    rows += [(2, 1, "user", "tie", ""), (2, 1, "assistant", "tie", ""), (2, 1, "user", "tie", ""), (None, 5, "assistant", "n", ""), (3, None, "user", "", "")]
    rows += [(4, i, "assistant", f"t{i} ", "") for i in range(37)]
    out = {r.conv_id: r for r in chat.chat_digest(chat.formatted(chat.replies(spark.createDataFrame(rows, SCHEMA)))).collect()}
    assert set(out) == {r[0] for r in rows}
    for conv, got in out.items():
        mine = sorted(((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        under = "".join(t for _, role, t in mine if role == "assistant")
        assert got.n_turns == len(mine)
        assert got.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in mine).encode()).hexdigest()
        assert got.loss_chars == len(under) and got.loss_sha256 == hashlib.sha256(under.encode()).hexdigest()


TREE = [("t", 1, None, 0.0), ("t", 2, 1, 1.0), ("t", 3, 1, 2.0), ("t", 4, 2, 5.0), ("t", 5, 2, 0.5), ("t", 6, 3, 0.0), ("u", 1, 99, 1.0), ("u", 2, 1, None), ("u", 3, 1, 0.0)]


def tree(spark, rows=TREE):
    data = [(t, n, p, "user" if n % 2 else "assistant", f"{t}{n}", s) for t, n, p, s in rows]
    return spark.createDataFrame(data, "tree string, node long, parent long, role string, text string, score double")


def test_branches_and_ranks(spark):
    got = {(r.tree, r.rank): (r.leaf, [t["text"] for t in r.turns], r.score) for r in chat.formatted(tree(spark)).withColumn("turns", chat.read_turns(F.col("formatted"))).collect()}
    assert got == {
        ("t", 1): (4, ["t1", "t2", "t4"], 6.0), ("t", 2): (6, ["t1", "t3", "t6"], 2.0), ("t", 3): (5, ["t1", "t2", "t5"], 1.5),
        ("u", 1): (2, ["u1", "u2"], 1.0), ("u", 2): (3, ["u1", "u3"], 1.0),
    }
    assert chat.formatted(tree(spark), branches=1).count() == 2


def test_a_circle_is_an_error(spark):
    with pytest.raises(ValueError, match="circle"):
        chat.reply_paths(tree(spark, [("t", 1, 2, 0.0), ("t", 2, 1, 0.0), ("t", 3, 1, 0.0)]))


def test_no_rows_and_no_python(spark, capsys):
    empty = chat.formatted(chat.replies(spark.createDataFrame([], SCHEMA)))
    assert chat.chat_digest(empty).count() == 0
    assert "Python" not in chat.formatted(tree(spark))._jdf.queryExecution().toString()
