from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textsql.functions import sqltext as S


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(col.alias("x")).first()["x"]


def test_difficulty_counts_keywords_as_substrings(spark):
    cases = [
        ("SELECT harbour FROM berths", "easy"),
        ("SELECT harbour FROM berths WHERE depth > 4", "easy"),
        ("SELECT harbour FROM berths WHERE depth > 4 AND quay = 'north' LIMIT 5", "medium"),
        ("SELECT harbour, max(depth) FROM berths WHERE quay = 'north' GROUP BY harbour HAVING max(depth) > 4 ORDER BY 2", "hard"),
        ("SELECT DISTINCT b.harbour FROM berths b JOIN boats v ON v.berth = b.id WHERE b.depth > 4 GROUP BY b.harbour "
         "HAVING count(v.id) > 2 ORDER BY b.harbour LIMIT 1", "extra"),
        ("SELECT harbour FROM berths WHERE depth > (SELECT avg(depth) FROM berths)", "medium"),
        ("SELECT operators FROM cranes WHERE make = 'x'", "easy"),  # no blank behind that "or"
        ("SELECT motor , make FROM cranes WHERE hook_colour = 'red' ORDER BY make", "medium"),  # "motor " holds "or "
    ]
    df = spark.createDataFrame(cases, "sql string, want string")
    got = df.select("sql", "want", S.difficulty("sql").alias("got")).collect()
    assert [(r.sql, r.got) for r in got] == [(r.sql, r.want) for r in got]


@pytest.mark.parametrize(("pred", "parses", "executes", "match", "want"), [
    ("SELECT depth FROM berths", True, True, True, "ok"),
    ("not a statement", None, None, True, "ok"),  # a match decides alone
    (None, True, True, None, "empty"),
    ("\n\t ", True, True, False, "empty"),
    ("SELECT depth FROM (berths", False, None, False, "parse"),
    ("SELECT draught FROM berths", True, None, False, "execution"),
    ("SELECT min(depth) FROM berths", True, True, None, "wrong-result"),
])
def test_classify_failure(spark, pred, parses, executes, match, want):
    df = spark.createDataFrame([(pred, parses, executes, match)], "p string, a boolean, b boolean, c boolean")
    assert df.select(S.classify_failure("p", "a", "b", "c")).first()[0] == want


BOATS = "SELECT name FROM boats"
CATEGORY_CASES = [
    (BOATS, "", "empty", "empty-output"),
    (BOATS, "SELECT name FROM (boats", "parse", "parse-error"),
    (BOATS, "SELECT title FROM boats", "execution", "schema-mismatch"),
    ("SELECT v.name FROM boats v JOIN berths b ON b.id = v.berth WHERE b.quay = 'north'", "SELECT name FROM boats WHERE quay = 'north'",
     "wrong-result", "missing-join"),
    ("SELECT count(*) FROM boats", "SELECT count(*) FROM boats v JOIN berths b ON b.id = v.berth", "wrong-result", "spurious-join"),
    ("SELECT max(length) FROM boats", "SELECT min(length) FROM boats", "wrong-result", "aggregation-mismatch"),
    ("SELECT flag, count(*) FROM boats GROUP BY flag", "SELECT flag, COUNT (*) FROM boats", "wrong-result", "missing-group-by"),
    (BOATS + " WHERE length > 9", BOATS, "wrong-result", "missing-filter"),
    (BOATS, BOATS + " WHERE length > 9", "wrong-result", "spurious-filter"),
    (BOATS + " ORDER BY length DESC", BOATS + " LIMIT 1", "wrong-result", "missing-order"),
    ("SELECT DISTINCT flag FROM boats", "SELECT flag FROM boats", "wrong-result", "missing-distinct"),
    (BOATS + " WHERE length > 9", BOATS + " WHERE length > 10", "wrong-result", "other"),
    # two faults: the earlier rule names the case
    ("SELECT v.name FROM boats v JOIN berths b ON b.id = v.berth WHERE b.depth > 2 ORDER BY 1", BOATS, "wrong-result", "missing-join"),
    # a keyword behind a line break has no blank before it
    (BOATS + "\nORDER BY length", BOATS, "wrong-result", "other"),
]


def test_error_categories(spark):
    df = spark.createDataFrame(CATEGORY_CASES, "g string, p string, f string, want string")
    rows = df.select("g", "p", "want", S.error_category("g", "p", "f").alias("got")).collect()
    assert [(r.g, r.p, r.got) for r in rows] == [(r.g, r.p, r.want) for r in rows]
    assert set(S.ERROR_CATEGORIES) == {c[3] for c in CATEGORY_CASES}


def test_error_category_whitespace_tolerant(spark):
    df = spark.createDataFrame([(BOATS + "\nORDER BY length", BOATS, "wrong-result")], "g string, p string, f string")
    assert df.select(S.error_category("g", "p", "f", whitespace_tolerant=True)).first()[0] == "missing-order"


def test_exact_match_cleans_and_ignores_case(spark):
    df = spark.createDataFrame([("  select 1 ;\n", "SELECT 1;"), ("SELECT 2", "SELECT 1")], "p string, g string")
    assert [r[0] for r in df.select(S.exact_match("p", "g")).collect()] == [True, False]


@pytest.mark.parametrize(("sql", "want"), [
    ("SELECT v.name FROM Boats v LEFT JOIN berths b ON b.id = v.berth", ["berths", "boats"]),
    ("WITH deep AS (SELECT id FROM berths WHERE depth > 5), north AS (SELECT * FROM deep) SELECT * FROM north, boats", ["berths", "boats"]),
    ("no words that matter", []),
    (None, []),
    ("SELECT 1", []),
    ("SELECT name FROM boats WHERE berth IN (SELECT id FROM berths WHERE quay = (SELECT max(quay) FROM quays))", ["berths", "boats", "quays"]),
    ("(SELECT name FROM boats) UNION (SELECT name FROM ferries) ORDER BY 1", ["boats", "ferries"]),
    ("SELECT * FROM a AS x, b y, \"C D\" WHERE x.id = y.id", ["a", "b", "c d"]),
    ("SELECT 1 FROM main.owls JOIN lib.sub.\"Nest Box\" n ON true", ["nest box", "owls"]),
    ("WITH t(a) AS (SELECT 1 FROM roots), u AS MATERIALIZED (SELECT 2) SELECT * FROM t, u", ["roots"]),
    ("SELECT 'rows from nowhere' FROM here -- from gone\n JOIN there ON true /* from away */", ["here", "there"]),
    # joined lists in parentheses, and commas behind a join
    ("SELECT 1 FROM boats CROSS JOIN (berths)", ["berths", "boats"]),
    ("SELECT 1 FROM (boats JOIN berths ON boats.berth = berths.id) JOIN quays ON true", ["berths", "boats", "quays"]),
    ("SELECT 1 FROM ((a JOIN b) JOIN (c))", ["a", "b", "c"]),
    ("SELECT 1 FROM boats JOIN berths, quays", ["berths", "boats", "quays"]),
    ("SELECT 1 FROM a JOIN b ON least(a.x, b.y) = 1, c d WHERE a.x IN (1, 2)", ["a", "b", "c"]),
    # FROM that begins no list
    ("SELECT 1 FROM boats WHERE flag IS NOT DISTINCT FROM owner", ["boats"]),
    ("SELECT \"from x\", `join y` FROM boats", ["boats"]),
    ("SELECT extract(YEAR FROM built), trim(BOTH ' ' FROM name) FROM boats", ["boats"]),
    ("SELECT substring(name FROM 2 FOR 3), (SELECT max(depth) FROM berths) FROM boats", ["berths", "boats"]),
    # table functions, value lists, laterals
    ("SELECT * FROM range(10) AS r(i), boats", ["boats"]),
    ("SELECT * FROM (VALUES (1, 2), (3, 4)) AS v JOIN boats ON true", ["boats"]),
    ("SELECT * FROM boats b, LATERAL (SELECT 1 FROM berths) e LEFT JOIN `the quays` USING (id, no)", ["berths", "boats", "the quays"]),
    ("WITH RECURSIVE up AS (SELECT 1 FROM base UNION ALL SELECT n + 1 FROM up JOIN steps) SELECT * FROM up ORDER BY (SELECT 1 FROM q)",
     ["base", "q", "steps"]),
    ("SELECT a FROM boats GROUP BY a, b HAVING count(*) > 1 ORDER BY c, d", ["boats"]),
])
def test_referenced_tables(spark, sql, want):
    df = spark.createDataFrame([(sql,)], "s string")
    assert df.select(S.referenced_tables("s")).first()[0] == want


def test_grounding(spark):
    df = spark.createDataFrame([("SELECT 2 + 2",), ("SELECT * FROM BOATS",), ("SELECT * FROM lorries",),
                                ("SELECT * FROM lorries JOIN berths",)], "s string")
    tables = F.array(F.lit("Boats"), F.lit("berths"))
    got = [r[0] for r in df.select(S.grounded(S.referenced_tables("s"), tables)).collect()]
    assert got == [True, True, False, True]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=8))
def test_fingerprint_total_and_idempotent(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    once = df.select(S.fingerprint("s").alias("f"))
    twice = once.select("f", S.fingerprint("f").alias("g")).collect()
    assert all(r.f == r.g for r in twice)


def test_fingerprint_whitespace_and_case_invariant(spark):
    df = spark.createDataFrame([("SELECT  a FROM T WHERE b = 'X y';",), ("select a\nfrom t where B='X y'",),
                                ("",), (None,)], "s string")
    fp = [r[0] for r in df.select(S.fingerprint("s")).collect()]
    assert fp[0] == fp[1] == "select a from t where b = 'X y'"
    assert fp[2] == fp[3] == ""


def test_fingerprint_leaves_comments_out(spark):
    texts = ["SELECT 1 -- one\n, 2", "SELECT 1 -- one , 2", "SELECT /* a\nb */ 1, 2", "SELECT '--1', \"/*x*/\"", "SELECT 4 - -1"]
    fp = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "s string").select(S.fingerprint("s")).collect()]
    assert fp == ["select 1 , 2", "select 1", "select 1 , 2", "select '--1' , \"/*x*/\"", "select 4 - - 1"]


def test_token_folds_bound_a_tasks_rows(spark, tmp_path, monkeypatch):
    """the longest task of the queries that read statements token by token does not grow with the table."""
    from textsql.plans import queries as Q

    spark.range(0, 400, 1, 1).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey", "1.5D AS o_totalprice").write.parquet(
        str(tmp_path / "orders.parquet"))
    monkeypatch.setattr(Q, "_FOLD_ROWS", 20, raising=False)
    for name in ("referenced_tables", "grounding"):
        df = Q.QUERIES[name](spark, str(tmp_path))
        sizes = df.groupBy(F.spark_partition_id()).count().collect()
        assert df.count() == 400 and max(r["count"] for r in sizes) <= 30, name
