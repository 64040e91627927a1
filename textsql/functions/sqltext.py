"""Column expressions over SQL text: difficulty, exact match, failure mode, error category,
statement fingerprint, referenced tables, grounding.

Everything here is a built-in Spark expression (regex, string and higher-order array functions),
so it runs inside whole-stage codegen on the executors and never leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import PY_WS_CLASS, clean_sql, col_, count_substr, is_blank, py_strip, remove_first

# --- fixed values -----------------------------------------------------------------------------
# Difficulty keywords, each weight 1, matched as lower-case substrings (so "or " also hits
# "author "); a second "select" adds 2. Buckets: <=1 easy, <=3 medium, <=5 hard, else extra.
HARDNESS_KEYWORDS = (
    "where", "group", "order", "having", "limit", "join",
    "or ", "and ", "intersect", "union", "except", "distinct",
)
NESTED_SELECT_WEIGHT = 2
DIFFICULTY_BUCKETS = ("easy", "medium", "hard", "extra")
DIFFICULTY_LABELS = ("easy", "medium", "hard", "extra", "unknown")
FAILURE_MODES = ("ok", "wrong-result", "execution", "parse", "empty")
# Error categories in rule order (first match wins).
ERROR_CATEGORIES = (
    "empty-output", "parse-error", "schema-mismatch", "missing-join", "spurious-join",
    "aggregation-mismatch", "missing-group-by", "missing-filter", "spurious-filter",
    "missing-order", "missing-distinct", "other",
)
AGG_CALL_RE = r"\b(count|sum|avg|min|max)" + PY_WS_CLASS + r"*\("
# ----------------------------------------------------------------------------------------------


def hardness_score(sql: Column | str) -> Column:
    """P16 score: keyword substring counts on the lower-cased text, +2 for a second SELECT."""
    s = F.lower(col_(sql))
    score = F.lit(0).cast("bigint")
    for kw in HARDNESS_KEYWORDS:
        score = score + count_substr(s, kw)
    nested = F.when(remove_first(s, "select").contains("select"), F.lit(NESTED_SELECT_WEIGHT)).otherwise(0)
    return score + nested


def difficulty(sql: Column | str) -> Column:
    """P16 bucket."""
    sc = hardness_score(sql)
    return (
        F.when(sc <= 1, "easy").when(sc <= 3, "medium").when(sc <= 5, "hard").otherwise("extra")
    )


def exact_match(pred_sql: Column | str, gold_sql: Column | str) -> Column:
    """Cleaned prediction equals cleaned gold, case-insensitively (NULL prediction = '')."""
    p = F.coalesce(clean_sql(pred_sql), F.lit(""))
    g = F.coalesce(clean_sql(gold_sql), F.lit(""))
    return F.lower(p) == F.lower(g)


def classify_failure(pred_sql: Column | str, parses: Column | str, executes: Column | str,
                     exec_match: Column | str) -> Column:
    """Ok -> empty -> parse -> execution -> wrong-result; first failing check wins."""
    em = F.coalesce(col_(exec_match), F.lit(False))
    return (
        F.when(em, "ok")
        .when(is_blank(pred_sql), "empty")
        .when(~F.coalesce(col_(parses), F.lit(False)), "parse")
        .when(~F.coalesce(col_(executes), F.lit(False)), "execution")
        .otherwise("wrong-result")
    )


def _agg_names(s: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(s, F.lit(AGG_CALL_RE), 1)))


def error_category(gold_sql: Column | str, pred_sql: Column | str, failure: Column | str,
                   whitespace_tolerant: bool = False) -> Column:
    """12 labels, first rule wins.

    Keyword tests look for the keyword with a space on both sides, exactly like the pipeline
    (a keyword after a newline is not seen). ``whitespace_tolerant=True`` first squashes every
    whitespace run to one space.
    """
    g = F.lower(F.coalesce(col_(gold_sql), F.lit("")))
    p = F.lower(F.coalesce(col_(pred_sql), F.lit("")))
    if whitespace_tolerant:
        g = F.regexp_replace(g, PY_WS_CLASS + "+", " ")
        p = F.regexp_replace(p, PY_WS_CLASS + "+", " ")
    f = F.coalesce(col_(failure), F.lit(""))
    jg, jp = g.contains(" join "), p.contains(" join ")
    wg, wp = g.contains(" where "), p.contains(" where ")
    return (
        F.when(f == "empty", "empty-output")
        .when(f == "parse", "parse-error")
        .when(f == "execution", "schema-mismatch")
        .when(jg & ~jp, "missing-join")
        .when(jp & ~jg, "spurious-join")
        .when(_agg_names(g) != _agg_names(p), "aggregation-mismatch")
        .when(g.contains(" group by ") & ~p.contains(" group by "), "missing-group-by")
        .when(wg & ~wp, "missing-filter")
        .when(~wg & wp, "spurious-filter")
        .when(g.contains(" order by ") & ~p.contains(" order by "), "missing-order")
        .when(g.contains("distinct") & ~p.contains("distinct"), "missing-distinct")
        .otherwise("other")
    )


# --- statement fingerprint (P12) ---------------------------------------------------------------
# Token grammar: comment | single-quoted string | double-quoted identifier | back-quoted identifier |
# bracketed identifier | word | number | operator of two characters | any other single non-space
# character.
_NON_SPACE = r"[^ \t\n\x0B\f\r]"
TOKEN_RE = (
    r"--[^\n]*|/\*(?:[^*]|\*+[^*/])*\*+/"
    r"|'(?:[^']|'')*'"
    r'|"(?:[^"]|"")*"'
    r"|`[^`]*`"
    r"|\[[^\]]*\]"
    r"|[A-Za-z_][A-Za-z0-9_$]*"
    r"|[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
    r"|<=>|<=|>=|<>|!=|==|\|\||<<|>>|->>|->|::"
    r"|" + _NON_SPACE
)


def _tokens(s: Column) -> Column:
    """The tokens of a text, comments left out."""
    return F.filter(F.regexp_extract_all(s, F.lit(TOKEN_RE), 0), lambda t: ~(t.startswith("--") | t.startswith("/*")))


def fingerprint(sql: Column | str) -> Column:
    """Whitespace- and case-invariant (outside quotes) statement text without its comments.

    ``''`` for NULL/blank input; total (never fails) and idempotent. It is a fingerprint for
    logging and de-duplication, not a SQL re-rendering.
    """
    toks = _tokens(F.coalesce(clean_sql(sql), F.lit("")))
    # A token is quoted iff its first character opens a quote (cheaper than a regex per token).
    norm = F.transform(toks, lambda t: F.when(F.substring(t, 1, 1).isin("'", '"', "`", "["), t)
                       .otherwise(F.lower(t)))
    return F.array_join(norm, " ")


def stored_sql(sql: Column | str) -> Column:
    """The cleaned statement itself, which parses wherever the candidate did, or the trimmed
    raw text when cleaning leaves nothing. The fingerprint is for hashing only."""
    text = F.coalesce(clean_sql(sql), F.lit(""))
    raw = F.rtrim(py_strip(F.coalesce(col_(sql), F.lit(""))), F.lit(";"))
    return F.when(text != "", text).otherwise(raw)


# --- referenced tables (P13) -------------------------------------------------------------------
# What the innermost open parenthesis (or the statement) is in the middle of:
#   other   anything that names no table        call   a parenthesis without a SELECT of its own
#   table   a table name comes next             item   behind a name in a FROM list (alias, JOIN, comma)
#   part    behind the dot of a qualified name  cond   a join condition
#   cte     a CTE name comes next               body   behind a CTE name
_ENDS_FROM = ("select", "where", "group", "order", "having", "limit", "union", "except", "intersect", "window", "qualify",
              "offset", "fetch")
_NO_NAME = ("lateral", "only", "as", "values", "from", "join", "on", "using", "with", *_ENDS_FROM)


def _name(token: Column) -> Column:
    quoted = token.startswith('"') | token.startswith("`") | token.startswith("[")
    return F.lower(F.when(quoted, F.substring(token, F.lit(2), F.length(token) - 2)).otherwise(token))


def _read_token(s: Column, t: Column) -> Column:
    """One step of the fold: the state after token ``t``."""
    quoted = t.startswith('"') | t.startswith("`") | t.startswith("[")
    word = F.when(quoted, F.lit("")).otherwise(F.lower(t))
    top, below = F.element_at(s["at"], -1), F.slice(s["at"], F.lit(1), F.size(s["at"]) - 1)
    opens, closes, comma, dot = t == "(", t == ")", t == ",", t == "."
    mark = opens | closes | comma | dot
    name = ~mark & (quoted | ~word.isin(*_NO_NAME))
    named = (top == "table") & name
    now = (
        F.when(dot, F.when(s["name"].isNotNull(), "part").otherwise(top))
        .when((top == "part") & name, "item")
        .when((word == "with") & s["prev"].isin("", "(", "as"), "cte")
        .when((top == "cte") & name & (word != "recursive"), "body")
        .when(word.isin(*_ENDS_FROM), "other")
        # FROM inside EXTRACT(.. FROM d) or behind IS DISTINCT begins no list
        .when((word == "from") & (top != "call") & (s["prev"] != "distinct"), "table")
        .when((word == "join") & (top != "call"), "table")
        .when(word.isin("on", "using") & (top == "item"), "cond")
        .when(comma & top.isin("item", "cond"), "table")
        .when(comma & (top == "body"), "cte")
        .when(named | ((top == "table") & (word == "values")), "item")
        .otherwise(top)
    )
    at = (
        # a parenthesis in place of a table holds a joined list or a query
        F.when(opens & (top == "table"), F.concat(below, F.array(F.lit("item"), F.lit("table"))))
        .when(opens, F.concat(s["at"], F.array(F.lit("call"))))
        .when(closes, F.when(F.size(s["at"]) > 1, below).otherwise(s["at"]))
        .otherwise(F.concat(below, F.array(now)))
    )
    pending = F.when(named | ((top == "part") & name), _name(t)).when(dot, s["name"])
    # a name is a table's once the next token shows that it is neither qualified further nor a function
    is_table = s["name"].isNotNull() & ~dot & ~opens & (top != "part")
    return F.struct(
        at.alias("at"), pending.alias("name"), F.when(quoted, F.lit('"')).otherwise(word).alias("prev"),
        F.when(is_table, F.concat(s["tables"], F.array(s["name"]))).otherwise(s["tables"]).alias("tables"),
        F.when((top == "cte") & name & (word != "recursive"), F.concat(s["ctes"], F.array(_name(t)))).otherwise(s["ctes"]).alias("ctes"))


def referenced_tables(sql: Column | str) -> Column:
    """Sorted distinct lower-case base-table names after FROM / JOIN, minus CTE names.

    One pass over the tokens that carries a small state: what each open parenthesis is in the middle of, the name
    read last, and the names found. A qualified name counts by its last part, a table function not at all, a
    derived table by the names inside. There is no grammar: a text that is no statement may still
    name tables.
    """
    tokens = F.filter(_tokens(F.coalesce(col_(sql), F.lit(""))), lambda t: t.rlike(r'^[A-Za-z_"`\[(),.]'))
    none = F.array().cast("array<string>")
    start = F.struct(F.array(F.lit("other")).alias("at"), F.lit(None).cast("string").alias("name"), F.lit("").alias("prev"),
                     none.alias("tables"), none.alias("ctes"))
    return F.aggregate(tokens, start, _read_token, lambda s: F.array_sort(F.array_except(
        F.array_compact(F.concat(s["tables"], F.array(s["name"]))), s["ctes"])))


def grounded(refs: Column | str, schema_tables: Column | str) -> Column:
    """no table named -> pass; else at least one named table is in the schema."""
    r = col_(refs)
    return (F.size(r) == 0) | F.arrays_overlap(r, F.transform(col_(schema_tables), F.lower))
