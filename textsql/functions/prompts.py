"""Prompt, completion and chat Columns.

Fence parsing is done with ``regexp_extract_all`` on the whole completion text: the last fenced
block is the SQL, everything before the last fence (stripped) is the reasoning.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_sql, col_, py_strip

# --- fixed values -----------------------------------------------------------------------------
SYSTEM_PROMPT = (
    "You are an expert SQL writer. Given an SQLite schema and a natural-language "
    "question, produce a single SQLite query that answers the question. "
    "Use only tables and columns that appear in the provided schema."
)
SQL_FENCE_OPEN = "```sql"
SQL_FENCE_CLOSE = "```"
REASONING_INSTRUCTION = (
    "Think briefly (2-4 sentences) about which tables and columns the question "
    "needs and any joins or aggregations involved. Then output the final SQL "
    "in a fenced ```sql block."
)
DIRECT_INSTRUCTION = "Output the final SQL in a fenced ```sql block. Do not include any other text."
# A fenced block: ```sqlite / ```sql / bare ```, optional blanks and one newline, lazy body.
FENCE_RE = r"(?is)```(?:sqlite|sql)?[ \t]*\n?(.*?)```"
# Bare statements accepted when there is no fence (lower-cased prefix test).
BARE_SQL_PREFIXES = ("select ", "with ", "insert ", "update ", "delete ")
MAX_TOKENS_DIRECT = 256
MAX_TOKENS_REASONING = 512
# ----------------------------------------------------------------------------------------------


def user_prompt(schema_block: Column | str, question: Column | str, mode: Column | str) -> Column:
    """P7."""
    instr = F.when(col_(mode) == "reasoning", F.lit(REASONING_INSTRUCTION)).otherwise(F.lit(DIRECT_INSTRUCTION))
    return F.concat(
        F.lit("### Schema (SQLite)\n"), col_(schema_block), F.lit("\n\n### Question\n"),
        py_strip(question), F.lit("\n\n### Instruction\n"), instr,
    )


def assistant_completion(sql: Column | str, reasoning: Column | str | None = None) -> Column:
    """Optional reasoning, blank line, fenced SQL without trailing ``;``."""
    body = F.concat(F.lit(SQL_FENCE_OPEN + "\n"), clean_sql(sql), F.lit("\n" + SQL_FENCE_CLOSE))
    if reasoning is None:
        return body
    r = col_(reasoning)
    has = r.isNotNull() & (r != "")
    return F.when(has, F.concat(py_strip(r), F.lit("\n\n"), body)).otherwise(body)


def chat_messages(user: Column, assistant: Column | None = None, system: Column | None = None) -> Column:
    """``array<struct<role, content>>`` (system, user[, assistant])."""
    sys_c = system if system is not None else F.lit(SYSTEM_PROMPT)
    msgs = [
        F.struct(F.lit("system").alias("role"), sys_c.alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content")),
    ]
    if assistant is not None:
        msgs.append(F.struct(F.lit("assistant").alias("role"), assistant.alias("content")))
    return F.array(*msgs)


def max_tokens_for(mode: Column | str) -> Column:
    """Completion ceiling by mode."""
    return F.when(col_(mode) == "reasoning", F.lit(MAX_TOKENS_REASONING)).otherwise(F.lit(MAX_TOKENS_DIRECT))


def _bare_sql(text: Column) -> Column:
    s = py_strip(text)
    low = F.lower(s)
    starts = None
    for p in BARE_SQL_PREFIXES:
        cond = low.startswith(p)
        starts = cond if starts is None else (starts | cond)
    return F.when(starts, py_strip(F.rtrim(s, F.lit(";"))))


def extract_sql(text: Column | str) -> Column:
    """P10: SQL of the *last* fenced block; else a bare statement; else NULL."""
    t = col_(text)
    bodies = F.regexp_extract_all(t, F.lit(FENCE_RE), 1)
    last = F.element_at(bodies, -1)
    return F.when(F.size(bodies) > 0, clean_sql(last)).otherwise(_bare_sql(t))


def split_reasoning(text: Column | str) -> Column:
    """The text before the last fence, stripped, NULL when blank (or when no fence).

    ``split`` on the fence pattern yields the gaps between fences; the last fence starts after
    all gaps before it plus all earlier fences. Linear in the text length (one regex scan per
    array), unlike a lazy ``(.*?)fence`` tiling that rescans the tail after the last fence.
    """
    t = col_(text)
    fences = F.regexp_extract_all(t, F.lit(FENCE_RE), 0)
    gaps = F.split(t, FENCE_RE, -1)
    m = F.size(fences)
    start = (F.length(F.array_join(F.slice(gaps, F.lit(1), m), ""))
             + F.length(F.array_join(F.slice(fences, F.lit(1), F.greatest(m - 1, F.lit(0))), "")))
    prefix = py_strip(t.substr(F.lit(1), start))
    return F.when((m > 0) & (prefix != ""), prefix)


def token_estimate(*texts: Column | str) -> Column:
    """Summed characters / 4, floored."""
    total = None
    for x in texts:
        ln = F.coalesce(F.length(col_(x)), F.lit(0))
        total = ln if total is None else total + ln
    return F.floor(total / 4).cast("bigint")
