from __future__ import annotations

import pytest

from textsql.functions import prompts as P

FENCE = P.SQL_FENCE_OPEN
CLOSE = P.SQL_FENCE_CLOSE


def ex(spark, fn, text):
    return spark.createDataFrame([(text,)], "t string").select(fn("t")).first()[0]


@pytest.mark.parametrize(("text", "want"), [
    (f"The depots are asked for.\n{FENCE}\nSELECT district FROM depot;\n{CLOSE}\nThat is all.", "SELECT district FROM depot"),
    (f"{FENCE}\nSELECT no FROM depot\n{CLOSE}\nNo, by name:\n{FENCE}\nSELECT district FROM depot\n{CLOSE}", "SELECT district FROM depot"),
    ("SELECT seats FROM car WHERE fleet_no = 101", "SELECT seats FROM car WHERE fleet_no = 101"),
    ("the depot in the harbour", None),
    ("", None),
    (None, None),
    ("```sqlite\nSELECT 4 + 4\n```", "SELECT 4 + 4"),
    ("```SqL\nSELECT 5\n```", "SELECT 5"),
    ("```\nSELECT 6\n```", "SELECT 6"),
    ("\twith d as (select no from depot) select max(no) from d;;  ", "with d as (select no from depot) select max(no) from d"),
])
def test_extract_sql(spark, text, want):
    assert ex(spark, P.extract_sql, text) == want


@pytest.mark.parametrize(("text", "reasoning", "sql"), [
    (f" Cars stand in depots.\nCount them. \n{FENCE}\nSELECT count(*) FROM car\n{CLOSE}\n", "Cars stand in depots.\nCount them.",
     "SELECT count(*) FROM car"),
    (f"{FENCE}\nSELECT 8\n{CLOSE}", None, "SELECT 8"),
    ("nothing of use", None, None),
    (f"first\n{FENCE}\nSELECT 8\n{CLOSE}\nthen\n{FENCE}\nSELECT 9\n{CLOSE}", f"first\n{FENCE}\nSELECT 8\n{CLOSE}\nthen", "SELECT 9"),
    (f"a plan\n{FENCE}\nSELECT 8\n{CLOSE}\nand ```sql never closed", "a plan", "SELECT 8"),
])
def test_split_reasoning(spark, text, reasoning, sql):
    assert ex(spark, P.split_reasoning, text) == reasoning
    assert ex(spark, P.extract_sql, text) == sql


def test_prompt_and_messages(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("CREATE TABLE depot (\n  no NUMBER\n);", "\n which depots? ", "direct"),
                                ("", "x", "reasoning")], "s string, q string, m string")
    got = [r[0] for r in df.select(P.user_prompt("s", "q", "m")).collect()]
    assert got == ["### Schema (SQLite)\nCREATE TABLE depot (\n  no NUMBER\n);\n\n### Question\nwhich depots?\n\n### Instruction\n"
                   + P.DIRECT_INSTRUCTION, "### Schema (SQLite)\n\n\n### Question\nx\n\n### Instruction\n" + P.REASONING_INSTRUCTION]
    msgs = df.select(P.chat_messages(P.user_prompt("s", "q", "m"),
                                     P.assistant_completion(F.lit(" SELECT no FROM depot ; "), F.lit("\nall of them ")))).first()[0]
    assert [(m.role, m.content) for m in msgs] == [("system", P.SYSTEM_PROMPT), ("user", got[0]),
                                                   ("assistant", "all of them\n\n```sql\nSELECT no FROM depot\n```")]
