"""Fixed (gold, prediction) statement pairs over the TPC-H-like tables for X1/X4.

Each statement reads whole tables, so the work grows with the scale factor; the verdicts do
not depend on the data. ``kind`` says how the oracle decides: ``cmp`` = DuckDB runs both
statements and compares them as multisets (EXCEPT ALL both ways); ``parse`` / ``execution`` /
``empty`` = the prediction cannot run.
"""

# --- fixed values -----------------------------------------------------------------------------
# (pair_id, gold, prediction, kind, expected exec_match)
PAIRS = (
    (1, "SELECT count(*) FROM orders", "SELECT COUNT(*) FROM orders;", "cmp", True),
    (2, "SELECT n_name FROM nation WHERE n_regionkey = 1",
        "SELECT n_name FROM nation WHERE n_regionkey = 1 ORDER BY n_name DESC", "cmp", True),
    (3, "SELECT r_name, count(*) FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
        "SELECT r.r_name, count(n.n_nationkey) FROM region AS r JOIN nation AS n ON n.n_regionkey = r.r_regionkey "
        "GROUP BY r.r_name", "cmp", True),
    (4, "SELECT c_mktsegment, count(*) FROM customer GROUP BY c_mktsegment",
        "SELECT c_mktsegment, count(*) + 1 FROM customer GROUP BY c_mktsegment", "cmp", False),
    (5, "SELECT DISTINCT o_orderstatus FROM orders", "SELECT o_orderstatus FROM orders", "cmp", False),
    (6, "SELECT p_brand FROM part WHERE p_size > 40 EXCEPT SELECT p_brand FROM part WHERE p_size > 45",
        "SELECT p_brand FROM part WHERE p_size > 40 EXCEPT SELECT p_brand FROM part WHERE p_size > 45", "cmp", True),
    (7, "SELECT count(*) FROM lineitem", "SELECT (p_name FROM part", "parse", False),
    (8, "SELECT count(*) FROM supplier", "SELECT * FROM missing_part_list", "execution", False),
    (9, "SELECT count(*) FROM part", "", "empty", False),
    (10, "SELECT s_name FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)",
         "SELECT s.s_name FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey WHERE n.n_regionkey = 0",
         "cmp", True),
    (11, "SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
         "SELECT count(*) FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)",
         "cmp", True),
    (12, "SELECT max(o_orderkey) FROM orders", "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 1",
         "cmp", True),
    (13, "WITH t AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) "
         "SELECT count(*) FROM t WHERE n > 3",
         "SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) > 3) AS x",
         "cmp", True),
    (14, "SELECT n_name FROM nation UNION ALL SELECT n_name FROM nation",
         "SELECT n_name FROM nation UNION SELECT n_name FROM nation", "cmp", False),
    (15, "SELECT sum(p_size) FROM part", "SELECT sum(p_size) FROM part WHERE p_size IS NOT NULL OR p_size IS NULL",
         "cmp", True),
    (16, "SELECT c_nationkey, count(*) FROM customer GROUP BY c_nationkey HAVING count(*) > 1000000000",
         "SELECT c_nationkey, count(*) FROM customer GROUP BY c_nationkey", "cmp", False),
    (17, "SELECT o_orderpriority, count(DISTINCT o_custkey) FROM orders GROUP BY o_orderpriority",
         "SELECT o_orderpriority, count(o_custkey) FROM orders GROUP BY o_orderpriority", "cmp", False),
    (18, "SELECT r_name, count(*) FROM region GROUP BY r_name",
         "SELECT r_name, r_regionkey, count(*) FROM region GROUP BY r_name", "execution", False),
    (19, "SELECT count(*) FROM nation", "DROP TABLE nation", "execution", False),
    (20, "SELECT l_returnflag, l_linestatus, count(*), sum(l_linenumber) FROM lineitem "
         "GROUP BY l_returnflag, l_linestatus",
         "select L_RETURNFLAG, L_LINESTATUS, COUNT(*), SUM(L_LINENUMBER) from LINEITEM "
         "group by L_LINESTATUS, L_RETURNFLAG order by 1", "cmp", True),
    (21, "SELECT count(*) FROM part WHERE p_size > (SELECT avg(p_size) FROM part)",
         "SELECT count(*) FROM part WHERE p_size > (SELECT sum(p_size) / count(*) FROM part)", "cmp", True),
    (22, "SELECT p_partkey FROM part WHERE p_size = (SELECT max(p_size) FROM part)",
         "SELECT p_partkey FROM part WHERE p_size >= (SELECT max(p_size) FROM part)", "cmp", True),
    (23, "SELECT n.n_name, c.cnt FROM nation n JOIN (SELECT c_nationkey, count(*) AS cnt FROM customer "
         "GROUP BY c_nationkey) c ON c.c_nationkey = n.n_nationkey",
         "SELECT n_name, count(*) FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name",
         "cmp", True),
    # LIKE is case-sensitive in Spark (and DuckDB), unlike SQLite: a documented dialect gap.
    (24, "SELECT count(*) FROM part WHERE p_type LIKE 'ECO%'",
         "SELECT count(*) FROM part WHERE p_type LIKE 'eco%'", "cmp", False),
    (25, "SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier",
         "SELECT DISTINCT c_nationkey FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)",
         "cmp", True),
    (26, "SELECT count(*) FROM orders WHERE o_orderstatus = 'F' OR o_orderstatus = 'O'",
         "SELECT count(*) FROM orders WHERE o_orderstatus IN ('F', 'O')", "cmp", True),
)
TPCH_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
# ----------------------------------------------------------------------------------------------
