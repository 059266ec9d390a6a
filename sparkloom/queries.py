"""One query for each operator, with SQL that gives the same rows in DuckDB."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .plans.lexer import SqlError
from .session import Engine
from .sources.storage import Sources, parquet_folder
from .streaming.pull import pulled

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


def engine(spark: SparkSession, sf_dir: str, **options) -> Engine:
    return Engine(spark, Sources([parquet_folder(spark, sf_dir, TABLES)]), **options)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def add(name: str, text: str, oracle: str | None = None, dialect: str = "ansi", params=None, **options) -> None:
    """A query given as text; the oracle is the same text where it is left out."""
    QUERIES[name] = lambda spark, sf_dir: engine(spark, sf_dir, **options).sql(text, dialect, params)
    ORACLES[name] = oracle or text


def change(name: str, table: str, texts: list[str], oracle: str, dialect: str = "ansi", output: bool = False, start: str | None = None) -> None:
    """Statements that change a table, started from a query if given; the result is the table, or the last output."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir)
        if start:
            e.register(table, e.sql(start))
        last = None
        for t in texts:
            for last in e.script(t, dialect):
                pass
        return last.output if output else e.table(table)

    QUERIES[name], ORACLES[name] = run, oracle


add("flagship", "SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, COUNT(*) AS n FROM lineitem WHERE l_shipdate <= '1998-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus")

# scans and projection
add("select_star_nation", "SELECT * FROM nation")
add("project_alias", "SELECT n_name AS name, n_regionkey region FROM nation")
add("table_star_join", "SELECT n.*, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
add("dup_names_qualified", "SELECT a.n_name, b.n_name FROM nation a JOIN nation b ON a.n_nationkey = b.n_regionkey", 'SELECT a.n_name AS "a.n_name", b.n_name AS "b.n_name" FROM nation a JOIN nation b ON a.n_nationkey = b.n_regionkey')
add("distinct_one", "SELECT DISTINCT c_mktsegment FROM customer")
add("distinct_multi", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
add("select_expr_arith", "SELECT o_orderkey, o_totalprice * 2 + 1 AS x, o_orderkey % 7 AS m, -o_orderkey AS neg FROM orders")
add("no_from", "SELECT UPPER('abc') AS u, LENGTH('abcd') AS n")
add("alias_in_where", "SELECT UPPER(c_mktsegment) AS seg, c_custkey FROM customer WHERE seg = 'BUILDING'", "SELECT UPPER(c_mktsegment) AS seg, c_custkey FROM customer WHERE UPPER(c_mktsegment) = 'BUILDING'")
add("names_by_case", "SELECT n_name AS Name, n_nationkey AS nAMe2 FROM nation")
add("aggregate_names", "SELECT SUM(p_size), COUNT(*) FROM part", 'SELECT CAST(SUM(p_size) AS BIGINT) AS "SUM(p_size)", COUNT(*) AS "COUNT" FROM part')

# predicates
add("cmp_all", "SELECT p_partkey FROM part WHERE p_size >= 3 AND p_size <= 40 AND p_size <> 7 AND p_size > 2 AND p_size < 49 AND p_size !< 4 AND p_size !> 39", "SELECT p_partkey FROM part WHERE p_size >= 4 AND p_size <= 39 AND p_size <> 7")
add("and_or_not", "SELECT p_partkey FROM part WHERE NOT (p_size = 1 OR p_size = 2) AND (p_size < 10 OR p_retailprice > 1000)")
add("like", "SELECT c_custkey FROM customer WHERE c_name LIKE '%1_'")
add("not_like", "SELECT c_custkey FROM customer WHERE c_name NOT LIKE '%1%'")
add("in_list", "SELECT p_partkey FROM part WHERE p_size IN (1, 3, 5)")
add("not_in_list", "SELECT p_partkey FROM part WHERE p_size NOT IN (1, 3, 5)")
add("is_null", "SELECT o.o_orderkey, c.c_custkey FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_acctbal > 0 WHERE c.c_custkey IS NULL")
add("is_not_null", "SELECT o.o_orderkey, c.c_custkey FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_acctbal > 0 WHERE c.c_custkey IS NOT NULL")
add("between", "SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 9")
add("not_between", "SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 5 AND 45")
add("case_searched", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'mid' END AS class FROM part")
add("case_simple", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS code FROM orders")
add("cast_types", "SELECT CAST(p_size AS VARCHAR(10)) AS s, CAST(p_retailprice AS INT) AS i, CAST(p_partkey AS DOUBLE) AS d, CAST('2020-01-02' AS DATE) AS day FROM part", "SELECT CAST(p_size AS VARCHAR) AS s, CAST(trunc(p_retailprice) AS INT) AS i, CAST(p_partkey AS DOUBLE) AS d, CAST('2020-01-02' AS DATE) AS day FROM part")
add("bitwise", "SELECT p_size & 6 AS a, p_size | 1 AS o, p_size ^ 5 AS x, ~p_size AS n FROM part", "SELECT p_size & 6 AS a, p_size | 1 AS o, xor(p_size, 5) AS x, ~p_size AS n FROM part")
add("boolean_words", "SELECT n_name FROM nation WHERE (n_nationkey > 20) = yes", "SELECT n_name FROM nation WHERE n_nationkey > 20")
add("params_named", "SELECT n_name FROM nation WHERE n_regionkey = @region OR n_nationkey = @nation OR n_regionkey = @region + 1", "SELECT n_name FROM nation WHERE n_regionkey IN (1, 2) OR n_nationkey = 0", params={"@region": 1, "nation": 0})
add("params_positional", "SELECT n_name FROM nation WHERE n_regionkey = ? AND n_nationkey > ? ORDER BY n_name LIMIT ?", "SELECT n_name FROM nation WHERE n_regionkey = 1 AND n_nationkey > 2 ORDER BY n_name LIMIT 3", params=[1, 2, 3])

# joins
add("join_inner", "SELECT o.o_orderkey, c.c_name FROM orders o INNER JOIN customer c ON o.o_custkey = c.c_custkey")
add("join_left", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT OUTER JOIN orders o ON c.c_custkey = o.o_custkey")
add("join_right", "SELECT o.o_orderkey, c.c_custkey FROM orders o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey")
add("join_full", "SELECT n.n_name, s.s_suppkey FROM nation n FULL OUTER JOIN supplier s ON n.n_nationkey = s.s_suppkey")
add("join_chain", "SELECT c.c_custkey, n.n_name, r.r_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey")
add("join_theta", "SELECT a.n_nationkey AS x, b.r_regionkey AS y FROM nation a JOIN region b ON a.n_nationkey < b.r_regionkey * 3")
add("join_between", "SELECT a.n_nationkey AS x, b.r_regionkey AS y FROM nation a JOIN region b ON a.n_nationkey BETWEEN b.r_regionkey AND b.r_regionkey + 2")
add("join_self", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
add("join_where_right", "SELECT c.c_name, o.o_totalprice FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 100000")
add("join_cross", "SELECT a.r_name AS x, b.n_name AS y FROM region a CROSS JOIN nation b")
add("join_using", "SELECT x.k, y.v FROM (SELECT n_nationkey AS k FROM nation) x JOIN (SELECT r_regionkey AS k, r_name AS v FROM region) y USING (k)")
add("join_hint", "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey OPTION (HASH JOIN, MAXDOP 2)", "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey", "sqlserver")
add("table_hint", "SELECT n_name FROM [nation] WITH (NOLOCK) WHERE [n_regionkey] = 2", "SELECT n_name FROM nation WHERE n_regionkey = 2", "sqlserver")
add("semi_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
add("anti_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey)")
add("in_subquery", "SELECT n_name FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%')")
add("not_in_subquery", "SELECT n_name FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%')")
add("join_derived", "SELECT n.n_name, d.n FROM nation n JOIN (SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_nationkey) d ON n.n_nationkey = d.c_nationkey")

# aggregation
add("agg_global", "SELECT COUNT(*) AS n, CAST(SUM(p_size) AS BIGINT) AS s, ROUND(AVG(p_size), 6) AS a, MIN(p_name) AS lo, MAX(p_retailprice) AS hi FROM part")
add("agg_count_null", "SELECT COUNT(NULLIF(p_size, 1)) AS n, COUNT(*) AS all_n FROM part")
add("agg_group", "SELECT o_orderstatus, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS s FROM orders GROUP BY o_orderstatus")
add("group_without_aggregate", "SELECT o_orderstatus FROM orders GROUP BY o_orderstatus")
add("agg_having_alias", "SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_nationkey HAVING n > 55", "SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_nationkey HAVING COUNT(*) > 55")
add("agg_having_expr", "SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_nationkey HAVING SUM(c_acctbal) > 100 AND COUNT(*) > 50")
add("agg_distinct", "SELECT COUNT(DISTINCT l_suppkey) AS n, CAST(SUM(DISTINCT l_linenumber) AS BIGINT) AS s, AVG(DISTINCT l_linenumber) AS a FROM lineitem")
add("agg_stddev_var", "SELECT ROUND(STDEV(p_size), 6) AS a, ROUND(STDEVP(p_size), 6) AS b, ROUND(VAR(p_size), 6) AS c, ROUND(VARP(p_size), 6) AS d FROM part", "SELECT ROUND(STDDEV_SAMP(p_size), 6) AS a, ROUND(STDDEV_POP(p_size), 6) AS b, ROUND(VAR_SAMP(p_size), 6) AS c, ROUND(VAR_POP(p_size), 6) AS d FROM part")
add("agg_over_join", "SELECT r.r_name, COUNT(*) AS n FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name")
add("rollup", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY ROLLUP(o_orderstatus, o_orderpriority)")
add("cube", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY CUBE(o_orderstatus, o_orderpriority)")
add("grouping_sets", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())")
add("group_col_plus_rollup", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY o_orderstatus, ROLLUP(o_orderpriority)")
add("mysql_with_rollup", "SELECT `o_orderstatus`, COUNT(*) AS n FROM orders GROUP BY o_orderstatus WITH ROLLUP", "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY ROLLUP(o_orderstatus)", "mysql")

# windows
add("row_number", "SELECT c_custkey, CAST(ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS BIGINT) AS rn FROM customer")
add("rank_dense_rank", "SELECT p_partkey, CAST(RANK() OVER (ORDER BY p_size) AS BIGINT) AS r, CAST(DENSE_RANK() OVER (ORDER BY p_size) AS BIGINT) AS d FROM part")
add("lag_lead", "SELECT c_custkey, LAG(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS a, LEAD(c_custkey, 2, -1) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS b FROM customer")
add("ntile", "SELECT c_custkey, CAST(NTILE(4) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS BIGINT) AS q FROM customer")
add("first_last_nth", "SELECT c_custkey, FIRST_VALUE(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS f, LAST_VALUE(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, NTH_VALUE(c_custkey, 2) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS s FROM customer")
add("win_sum_partition", "SELECT c_custkey, ROUND(SUM(c_acctbal) OVER (PARTITION BY c_nationkey), 2) AS s, COUNT(*) OVER (PARTITION BY c_nationkey) AS n FROM customer")
add("win_running_rows", "SELECT c_custkey, CAST(SUM(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s FROM customer")
add("win_running_range", "SELECT p_partkey, COUNT(*) OVER (PARTITION BY p_brand ORDER BY p_size) AS n FROM part")
add("win_rows_sliding", "SELECT c_custkey, MIN(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS lo, MAX(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS hi FROM customer")
add("win_range_offset", "SELECT p_partkey, COUNT(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS n FROM part")
add("win_groups", "SELECT p_partkey, COUNT(*) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM part")
add("win_count_distinct", "SELECT c_custkey, CAST(COUNT(DISTINCT c_mktsegment) OVER (PARTITION BY c_nationkey) AS BIGINT) AS n FROM customer")
add("win_over_join", "SELECT n.n_name, CAST(ROW_NUMBER() OVER (PARTITION BY r.r_name ORDER BY n.n_name) AS BIGINT) AS rn FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
add("win_distinct_limit", "SELECT DISTINCT c_nationkey, COUNT(*) OVER (PARTITION BY c_nationkey) AS n FROM customer ORDER BY c_nationkey LIMIT 5")

# order and limit
add("order_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
add("order_limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 5")
add("offset_only", "SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 20")
add("limit_zero", "SELECT n_nationkey FROM nation LIMIT 0")
add("mysql_limit_comma", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5, 10", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 5", "mysql")
add("top_n", "SELECT TOP (7) o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 7", "sqlserver")
add("top_percent", "SELECT TOP 10 PERCENT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r, count(*) OVER () AS n FROM orders) WHERE r <= ceil(n * 0.1)", "sqlserver")
add("top_with_ties", "SELECT TOP 10 WITH TIES p_partkey, p_size FROM part ORDER BY p_size DESC", "SELECT p_partkey, p_size FROM (SELECT p_partkey, p_size, rank() OVER (ORDER BY p_size DESC) AS r FROM part) WHERE r <= 10", "sqlserver")
add("fetch_first", "SELECT o_orderkey FROM orders ORDER BY o_orderkey FETCH FIRST 4 ROWS ONLY")
add("nulls_order", "SELECT n_nationkey, NULLIF(n_regionkey, 2) AS r FROM nation ORDER BY r NULLS LAST, n_nationkey DESC LIMIT 22")

# set operations, CTEs, subqueries
add("union_all", "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
add("union", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region")
add("intersect", "SELECT n_nationkey AS k FROM nation INTERSECT SELECT r_regionkey FROM region")
add("except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT r_regionkey FROM region")
add("intersect_all", "SELECT n_regionkey AS k FROM nation INTERSECT ALL SELECT c_nationkey FROM customer")
add("except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT n_nationkey FROM nation")
add("setop_chain", "SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region INTERSECT SELECT n_regionkey FROM nation ORDER BY k LIMIT 4", "SELECT k FROM (SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region) INTERSECT SELECT n_regionkey FROM nation ORDER BY k LIMIT 4")
add("cte_single", "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 150000) SELECT o_custkey, COUNT(*) AS n FROM big GROUP BY o_custkey")
add("cte_multi", "WITH a AS (SELECT n_regionkey AS k FROM nation), b AS (SELECT r_regionkey AS k FROM region) SELECT a.k, COUNT(*) AS n FROM a JOIN b ON a.k = b.k GROUP BY a.k")
add("cte_chained", "WITH a AS (SELECT n_nationkey AS k FROM nation WHERE n_nationkey > 3), b AS (SELECT k FROM a WHERE k < 12) SELECT k FROM b")
add("cte_shadows_table", "WITH nation AS (SELECT r_name AS n_name FROM region) SELECT n_name FROM nation")
add("cte_recursive", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 10) SELECT n FROM t")
add("scalar_subquery_where", "SELECT p_partkey FROM part WHERE p_retailprice > (SELECT AVG(p_retailprice) FROM part)")
add("scalar_subquery_select", "SELECT r_name, (SELECT COUNT(*) FROM nation WHERE n_regionkey = r_regionkey) AS n FROM region")
add("correlated_scalar", "SELECT c_custkey FROM customer c WHERE c_acctbal > (SELECT AVG(d.c_acctbal) FROM customer d WHERE d.c_nationkey = c.c_nationkey)")

# functions
add("fn_upper_lower", "SELECT UPPER(c_name) AS u, LOWER(c_mktsegment) AS l FROM customer")
add("fn_length", "SELECT LENGTH(c_name) AS a, LEN(c_mktsegment) AS b FROM customer", "SELECT LENGTH(c_name) AS a, LENGTH(c_mktsegment) AS b FROM customer")
add("fn_abs", "SELECT c_custkey, ABS(c_acctbal) AS a FROM customer")
add("fn_round", "SELECT c_custkey, ROUND(c_custkey / 8.0, 1) AS r FROM customer", "SELECT c_custkey, ROUND(CAST(c_custkey / 8.0 AS DECIMAL(20, 6)), 1) AS r FROM customer")
add("fn_round_half_even", "SELECT c_custkey, ROUND(c_custkey / 2.0, 0) AS r FROM customer", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 1 THEN (c_custkey - 1) / 2 WHEN c_custkey % 4 = 3 THEN (c_custkey + 1) / 2 ELSE c_custkey / 2 END AS r FROM customer", half_even=True)
add("fn_nested_where", "SELECT c_custkey FROM customer WHERE LENGTH(UPPER(c_mktsegment)) > 8 AND UPPER(c_mktsegment) LIKE '%E%'")
add("mysql_ifnull_if_coalesce", "SELECT IFNULL(NULLIF(n_regionkey, 1), -1) AS a, IF(n_regionkey > 2, 'hi', 'lo') AS b, COALESCE(NULLIF(n_regionkey, 0), 99) AS c FROM nation", "SELECT COALESCE(NULLIF(n_regionkey, 1), -1) AS a, CASE WHEN n_regionkey > 2 THEN 'hi' ELSE 'lo' END AS b, COALESCE(NULLIF(n_regionkey, 0), 99) AS c FROM nation", "mysql")
add("mysql_concat_ws", "SELECT CONCAT_WS('-', n_name, NULL, n_nationkey) AS s FROM nation", "SELECT concat_ws('-', n_name, NULL, n_nationkey) AS s FROM nation", "mysql")
add("mysql_date_format", "SELECT o_orderkey, DATE_FORMAT(o_orderdate, '%Y-%m-%d %H:%i:%s') AS d, DATE_FORMAT(o_orderdate, '%d/%m/%y at %e') AS e FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS d, strftime(o_orderdate, '%d/%m/%y at %-d') AS e FROM orders", "mysql")
add("mysql_str_to_date", "SELECT STR_TO_DATE('03/02/2021', '%d/%m/%Y') AS d, STR_TO_DATE('2021-02-03 04:05:06', '%Y-%m-%d %H:%i:%s') AS t FROM region", "SELECT DATE '2021-02-03' AS d, TIMESTAMP '2021-02-03 04:05:06' AS t FROM region", "mysql")
add("mysql_datediff", "SELECT o_orderkey, DATEDIFF(o_orderdate, '1995-01-01') AS n FROM orders", "SELECT o_orderkey, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS n FROM orders", "mysql")
add("mysql_date_add_sub", "SELECT o_orderkey, DATE_ADD(o_orderdate, INTERVAL 3 DAY) AS a, DATE_SUB(o_orderdate, INTERVAL 2 MONTH) AS b, DATE_ADD(o_orderdate, INTERVAL '1 2' DAY_HOUR) AS c FROM orders", "SELECT o_orderkey, o_orderdate + INTERVAL 3 DAY AS a, o_orderdate - INTERVAL 2 MONTH AS b, o_orderdate + INTERVAL 26 HOUR AS c FROM orders", "mysql")

# arrays and JSON
add("pg_cast_chain", "SELECT p_size::text::int + 1 AS x, '7'::bigint AS y FROM part", None, "postgresql")
add("pg_array_ctor", "SELECT size(ARRAY[n_nationkey, n_regionkey, 3]) AS n FROM nation", "SELECT 3 AS n FROM nation", "postgresql")
add("pg_array_subscript", "SELECT vec_id, embedding[1] AS a, embedding[9999] AS b FROM embeddings", None, "postgresql")
add("pg_array_slice", "SELECT n_nationkey, concat_ws(',', (ARRAY[n_nationkey, n_regionkey, 3, 4])[2:3]) AS s FROM nation", "SELECT n_nationkey, concat_ws(',', n_regionkey, 3) AS s FROM nation", "postgresql")
add("pg_array_literal", "SELECT n_nationkey FROM nation WHERE n_nationkey = ANY('{1,2,5}'::integer[])", "SELECT n_nationkey FROM nation WHERE n_nationkey IN (1, 2, 5)", "postgresql")
add("pg_any_all", "SELECT n_nationkey FROM nation WHERE n_nationkey > ANY(ARRAY[20, 22]) OR n_nationkey < ALL(ARRAY[3, 5])", "SELECT n_nationkey FROM nation WHERE n_nationkey > 20 OR n_nationkey < 3", "postgresql")
add("pg_json_arrow", "SELECT event_id, props ->> 'k' AS v, props -> 'k' AS j FROM events", "SELECT event_id, props ->> '$.k' AS v, CAST(json_extract(props, '$.k') AS VARCHAR) AS j FROM events", "postgresql")
add("pg_json_path", "SELECT event_id, props #>> '{k}' AS v FROM events", "SELECT event_id, props ->> '$.k' AS v FROM events", "postgresql")
add("pg_json_contains", """SELECT event_id FROM events WHERE props @> '{"k": 7}'""", "SELECT event_id FROM events WHERE props ->> '$.k' = '7'", "postgresql")
add("pg_json_keys", "SELECT event_id, props ? 'k' AS a, props ?| ARRAY['x', 'k'] AS b, props ?& ARRAY['x', 'k'] AS c FROM events", "SELECT event_id, true AS a, true AS b, false AS c FROM events", "postgresql")

# changes of rows
_R = "SELECT r_regionkey, r_name FROM region"
change("insert_values", "region", ["INSERT INTO region (r_regionkey, r_name) VALUES (5, 'NEW'), (6, 'O''NE')"], f"{_R} UNION ALL VALUES (5, 'NEW'), (6, 'O''NE')", start=_R)
change("insert_select", "region", ["INSERT INTO region SELECT n_nationkey + 100, n_name FROM nation WHERE n_regionkey = 1"], f"{_R} UNION ALL SELECT n_nationkey + 100, n_name FROM nation WHERE n_regionkey = 1", start=_R)
_KEY = "CREATE UNIQUE INDEX k ON region (r_regionkey)"
change("upsert_mysql", "region", [_KEY, "INSERT INTO region (r_regionkey, r_name) VALUES (1, 'X'), (9, 'Y') ON DUPLICATE KEY UPDATE r_name = CONCAT(r_name, VALUES(r_name))"], "SELECT r_regionkey, CASE WHEN r_regionkey = 1 THEN r_name || 'X' ELSE r_name END AS r_name FROM region UNION ALL SELECT 9, 'Y'", "mysql", start=_R)
change("upsert_pg_nothing", "region", [_KEY, "INSERT INTO region (r_regionkey, r_name) VALUES (1, 'X'), (9, 'Y') ON CONFLICT DO NOTHING"], f"{_R} UNION ALL SELECT 9, 'Y'", "postgresql", start=_R)
change("upsert_pg_update_where", "region", ["INSERT INTO region AS r (r_regionkey, r_name) VALUES (1, 'X'), (2, 'Z'), (9, 'Y') ON CONFLICT (r_regionkey) DO UPDATE SET r_name = excluded.r_name WHERE r.r_name <> 'ASIA'"], "SELECT r_regionkey, CASE WHEN r_regionkey = 1 THEN 'X' WHEN r_regionkey = 2 AND r_name <> 'ASIA' THEN 'Z' ELSE r_name END AS r_name FROM region UNION ALL SELECT 9, 'Y'", "postgresql", start=_R)
change("update_where", "customer", ["UPDATE customer SET c_acctbal = c_acctbal + 1, c_mktsegment = 'NONE' WHERE c_nationkey = 3"], "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_nationkey = 3 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_nationkey = 3 THEN 'NONE' ELSE c_mktsegment END AS c_mktsegment FROM customer")
change("update_join", "nation", ["UPDATE nation n JOIN region r ON n.n_regionkey = r.r_regionkey SET n_name = r.r_name WHERE r.r_name = 'ASIA'"], "SELECT n_nationkey, CASE WHEN r_name = 'ASIA' THEN r_name ELSE n_name END AS n_name, n_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey", "mysql")
change("update_from", "nation", ["UPDATE nation SET n_name = r_name FROM region WHERE n_regionkey = r_regionkey AND r_regionkey > 2"], "SELECT n_nationkey, CASE WHEN r_regionkey > 2 THEN r_name ELSE n_name END AS n_name, n_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey", "postgresql")
change("delete_where", "orders", ["DELETE FROM orders WHERE o_orderstatus = 'F'"], "SELECT * FROM orders WHERE o_orderstatus <> 'F'")
change("delete_join", "nation", ["DELETE n FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name LIKE 'A%'"], "SELECT * FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%')", "mysql")
_MERGE = """MERGE INTO region AS t USING (SELECT n_nationkey AS k, n_name AS n FROM nation WHERE n_nationkey BETWEEN 2 AND 7) AS s ON t.r_regionkey = s.k
WHEN MATCHED AND s.k = 3 THEN DELETE WHEN MATCHED THEN UPDATE SET r_name = s.n
WHEN NOT MATCHED BY TARGET AND s.k < 7 THEN INSERT (r_regionkey, r_name) VALUES (s.k, s.n)
WHEN NOT MATCHED BY SOURCE AND t.r_regionkey = 0 THEN DELETE"""
change("merge_full", "region", [_MERGE], "SELECT r_regionkey, CASE WHEN r_regionkey IN (2, 4) THEN n_name ELSE r_name END AS r_name FROM region JOIN nation ON n_nationkey = r_regionkey WHERE r_regionkey NOT IN (0, 3) UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (5, 6)", "sqlserver", start=_R)
change("output_update", "region", ["UPDATE region SET r_name = 'X' OUTPUT DELETED.r_name AS was, INSERTED.r_name AS now_is WHERE r_regionkey < 2"], "SELECT r_name AS was, 'X' AS now_is FROM region WHERE r_regionkey < 2", "sqlserver", True)
change("output_merge", "region", [_MERGE + " OUTPUT DELETED.r_regionkey AS d, INSERTED.r_regionkey AS i"], "VALUES (0, NULL), (2, 2), (3, NULL), (4, 4), (NULL, 5), (NULL, 6)", "sqlserver", True, start=_R)
ORACLES["output_merge"] = "SELECT * FROM (VALUES (0, NULL), (2, 2), (3, NULL), (4, 4), (NULL, 5), (NULL, 6)) t(d, i)"
change("returning_delete", "nation", ["DELETE FROM nation WHERE n_regionkey = 2 RETURNING n_nationkey, UPPER(n_name) AS u"], "SELECT n_nationkey, UPPER(n_name) AS u FROM nation WHERE n_regionkey = 2", "postgresql", True)
change("returning_insert", "region", ["INSERT INTO region VALUES (8, 'X') RETURNING *"], "SELECT 8 AS r_regionkey, 'X' AS r_name", "postgresql", True, start=_R)

# definitions and transactions
change("create_view", "v", ["CREATE VIEW v (k, n) AS SELECT n_regionkey, COUNT(*) FROM nation GROUP BY n_regionkey"], "SELECT n_regionkey AS k, COUNT(*) AS n FROM nation GROUP BY n_regionkey")
change("alter_table_columns", "nation", ["ALTER TABLE nation ADD COLUMN extra INT DEFAULT 7, DROP COLUMN n_name; ALTER TABLE nation RENAME COLUMN n_regionkey TO region; ALTER TABLE nation MODIFY region BIGINT"], "SELECT n_nationkey, CAST(n_regionkey AS BIGINT) AS region, 7 AS extra FROM nation", "mysql")
change("create_table_defaults", "t", ["CREATE TABLE t (id INT PRIMARY KEY AUTO_INCREMENT, name VARCHAR(20) NOT NULL, n INT DEFAULT 5, CHECK (n > 0)); INSERT INTO t (name) VALUES ('a'), ('b'); INSERT INTO t (name, n) VALUES ('c', DEFAULT)"], "SELECT * FROM (VALUES (1, 'a', 5), (2, 'b', 5), (3, 'c', 5)) t(id, name, n)", "mysql")
change("savepoint_rollback", "region", ["BEGIN; DELETE FROM region WHERE r_regionkey = 0; SAVEPOINT s; DELETE FROM region; ROLLBACK TO SAVEPOINT s; COMMIT"], "SELECT * FROM region WHERE r_regionkey <> 0")
change("select_into", "kept", ["SELECT n_name INTO kept FROM nation WHERE n_regionkey = 4"], "SELECT n_name FROM nation WHERE n_regionkey = 4")
change("rename_drop", "b", ["RENAME TABLE nation TO b; DROP TABLE IF EXISTS missing"], "SELECT * FROM nation")
change("foreign_key_cascade", "nation", ["ALTER TABLE nation ADD CONSTRAINT f FOREIGN KEY (n_regionkey) REFERENCES region (r_regionkey) ON DELETE CASCADE; DELETE FROM region WHERE r_regionkey = 1"], "SELECT * FROM nation WHERE n_regionkey <> 1")


def check_violation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators import ddl

    e = engine(spark, sf_dir)
    e.script("ALTER TABLE part ADD CONSTRAINT c CHECK (p_size > 0)")
    rows = e.sql("SELECT p_partkey, p_size - 10 AS p_size FROM part")
    found = [bad.select(F.lit(label).alias("label"), "p_partkey") for label, bad in ddl.violations(e, "part", rows)]
    return found[0]


QUERIES["check_violation_report"] = check_violation_report
ORACLES["check_violation_report"] = "SELECT 'CHECK c' AS label, p_partkey FROM part WHERE p_size - 10 <= 0"


def udf_callback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).sql("SELECT n_name, PLUS(40, 2) AS x FROM nation WHERE n_regionkey = PICK()", functions={"plus": lambda a, b: a + b, "PICK": lambda: 3})


QUERIES["udf_callback"] = udf_callback
ORACLES["udf_callback"] = "SELECT n_name, 42 AS x FROM nation WHERE n_regionkey = 3"


def multi_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = lambda name: spark.createDataFrame([(1, "first")], "k int, v string") if name == "a" else None
    e = Engine(spark, Sources([first, parquet_folder(spark, sf_dir, TABLES)]))
    return e.sql("SELECT a.v, n.n_name FROM a JOIN NATION n ON a.k = n.n_nationkey")


QUERIES["multi_provider"] = multi_provider
ORACLES["multi_provider"] = "SELECT 'first' AS v, n_name FROM nation WHERE n_nationkey = 1"


# expressions by dialect
add("division", "SELECT p_partkey, ROUND(p_retailprice / p_size, 6) AS x FROM part")
add("pg_whole_division", "SELECT c_custkey, CAST(c_custkey / 7 AS BIGINT) AS q, CAST(-c_custkey / 7 AS BIGINT) AS r, (c_custkey / 7) * 2 % 3 AS m, ROUND(CAST(c_custkey / 7.0 AS DOUBLE), 6) AS d FROM customer", "SELECT c_custkey, CAST(trunc(c_custkey / 7) AS BIGINT) AS q, CAST(trunc(-c_custkey / 7) AS BIGINT) AS r, CAST(trunc(c_custkey / 7) AS BIGINT) * 2 % 3 AS m, ROUND(c_custkey / 7, 6) AS d FROM customer", "postgresql")
add("tsql_whole_division", "SELECT p_brand, SUM(p_size) / COUNT(*) AS mean FROM part WHERE p_size / 10 = 2 GROUP BY p_brand HAVING COUNT(*) / 2 > 1", "SELECT p_brand, CAST(trunc(SUM(p_size) / COUNT(*)) AS BIGINT) AS mean FROM part WHERE p_size BETWEEN 20 AND 29 GROUP BY p_brand HAVING COUNT(*) >= 4", "sqlserver")
add("tsql_plus_joins_texts", "SELECT [c_name] + '/' + [c_mktsegment] AS [a b], c_custkey + 1 AS n FROM customer", "SELECT c_name || '/' || c_mktsegment AS \"a b\", c_custkey + 1 AS n FROM customer", "sqlserver")
add("tsql_quoted_names", 'SELECT "n_name" AS "a b" FROM "nation" WHERE [n_regionkey] = 1', 'SELECT n_name AS "a b" FROM nation WHERE n_regionkey = 1', "sqlserver")
add("alias_not_in_subquery", "SELECT n_nationkey AS r_regionkey FROM nation WHERE EXISTS (SELECT r_name FROM region WHERE r_regionkey = 3)", "SELECT n_nationkey AS r_regionkey FROM nation WHERE EXISTS (SELECT r_name FROM region WHERE region.r_regionkey = 3)")
add("like_backslash", r"SELECT n_nationkey FROM nation WHERE CONCAT(n_name, '\x') LIKE '%A\x'", r"SELECT n_nationkey FROM nation WHERE n_name || '\x' LIKE '%A\x'")
add("like_escape", "SELECT n_nationkey FROM nation WHERE CONCAT(n_nationkey, '%') LIKE '1_!%' ESCAPE '!'", "SELECT n_nationkey FROM nation WHERE n_nationkey BETWEEN 10 AND 19")
add("mysql_like_backslash", r"SELECT n_nationkey FROM nation WHERE CONCAT(n_nationkey, '%') LIKE '1_\%'", "SELECT n_nationkey FROM nation WHERE n_nationkey BETWEEN 10 AND 19", "mysql")
add("in_empty_list", "SELECT n_nationkey FROM nation WHERE n_nationkey IN () OR n_nationkey = 4", "SELECT n_nationkey FROM nation WHERE n_nationkey = 4")
add("parameter_column", "SELECT n_name, @x AS x FROM nation", "SELECT n_name, 'it''s' AS x FROM nation", params={"x": "it's"})
add("null_join_keys", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM (SELECT n_nationkey, NULLIF(n_regionkey, 1) AS k FROM nation) a FULL JOIN (SELECT n_nationkey, NULLIF(n_regionkey, 1) AS k FROM nation WHERE n_nationkey < 9) b ON a.k = b.k")
add("group_null_key", "SELECT NULLIF(n_regionkey, 2) AS k, COUNT(*) AS n FROM nation GROUP BY NULLIF(n_regionkey, 2)")
add("win_avg", "SELECT c_custkey, ROUND(AVG(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), 6) AS a FROM customer")
add("nested_derived", "SELECT y.n, (SELECT MAX(z.k) FROM (SELECT r_regionkey AS k FROM region) z) AS most FROM (SELECT COUNT(*) AS n FROM (SELECT DISTINCT n_regionkey FROM (SELECT n_regionkey FROM nation WHERE n_nationkey > 2) w) x) y")
add("group_hint", "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus OPTION (HASH GROUP, FAST 10, RECOMPILE, MAXDOP 4, EXPAND VIEWS)", "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus", "sqlserver")
add("union_hint", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region OPTION (CONCAT UNION, ORDER GROUP)", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region", "sqlserver")
add("now_and_curdate", "SELECT n_name, CAST(NOW() AS DATE) = CURDATE() AS same, DATEDIFF(CURDATE(), '2000-01-01') > 0 AS later FROM nation", "SELECT n_name, true AS same, true AS later FROM nation", "mysql")
_UNITS = {"MICROSECOND": ("7", "7 MICROSECOND"), "SECOND": ("70", "70 SECOND"), "MINUTE": ("3", "3 MINUTE"), "HOUR": ("30", "30 HOUR"), "DAY": ("40", "40 DAY"), "WEEK": ("2", "14 DAY"), "MONTH": ("14", "14 MONTH"), "QUARTER": ("3", "9 MONTH"), "YEAR": ("2", "24 MONTH"), "SECOND_MICROSECOND": ("'1.5'", "1500 MILLISECOND"), "MINUTE_MICROSECOND": ("'2:1.000005'", "121000005 MICROSECOND"), "MINUTE_SECOND": ("'2:3'", "123 SECOND"), "HOUR_MICROSECOND": ("'1:0:0.25'", "3600250 MILLISECOND"), "HOUR_SECOND": ("'1:2:3'", "3723 SECOND"), "HOUR_MINUTE": ("'2:30'", "150 MINUTE"), "DAY_MICROSECOND": ("'1 0:0:0.5'", "86400500 MILLISECOND"), "DAY_SECOND": ("'1 1:1:1'", "90061 SECOND"), "DAY_MINUTE": ("'1 0:1'", "1441 MINUTE"), "DAY_HOUR": ("'-1 2'", "-26 HOUR"), "YEAR_MONTH": ("'1-2'", "14 MONTH")}
add("mysql_interval_units", f"SELECT o_orderkey, {', '.join(f'DATE_ADD(o_orderdate, INTERVAL {v} {u}) AS u{i}' for i, (u, (v, _)) in enumerate(_UNITS.items()))} FROM orders", f"SELECT o_orderkey, {', '.join(f'o_orderdate + INTERVAL ({w.split()[0]}) {w.split()[1]} AS u{i}' for i, (_, w) in enumerate(_UNITS.values()))} FROM orders", "mysql")

# arrays and JSON, by type and in lists
add("pg_array_slice_bounds", "SELECT n_nationkey, CONCAT_WS(',', (ARRAY[n_nationkey, n_regionkey, 3])[0:2]) AS a, CONCAT_WS(',', (ARRAY[n_nationkey, n_regionkey, 3])[2:]) AS b, CONCAT_WS(',', (ARRAY[n_nationkey, n_regionkey, 3])[:1]) AS c, CONCAT_WS(',', (ARRAY[n_nationkey, n_regionkey, 3])[3:9]) AS d, CONCAT_WS(',', (ARRAY[n_nationkey, 3])[-4:-1]) AS e, (ARRAY[n_nationkey])[0] AS f FROM nation", "SELECT n_nationkey, concat_ws(',', n_nationkey, n_regionkey) AS a, concat_ws(',', n_regionkey, 3) AS b, CAST(n_nationkey AS VARCHAR) AS c, '3' AS d, '' AS e, CAST(NULL AS BIGINT) AS f FROM nation", "postgresql")
add("pg_json_chain", """SELECT n_nationkey, CONCAT('{"a":{"b":[', n_nationkey, ',"', n_name, '"]}}') -> 'a' -> 'b' ->> 1 AS v, CONCAT('{"a":{"b":', n_regionkey, '}}') #> '{a,b}' AS w FROM nation""", "SELECT n_nationkey, n_name AS v, CAST(n_regionkey AS VARCHAR) AS w FROM nation", "postgresql")
_DOC = """CONCAT('{"k":[', n_nationkey, ',{"r":', n_regionkey, ',"s":"', n_regionkey, '"}],"f":', n_regionkey, '.0,"b":', CASE WHEN n_nationkey < 9 THEN 'true' ELSE 'null' END, '}')"""
add("pg_json_contains_by_type", f"""SELECT n_nationkey, {_DOC} @> '{{"k":[{{"r":2}}]}}' AS a, {_DOC} @> '{{"k":[{{"r":"2"}}]}}' AS b, {_DOC} @> '{{"k":[{{"s":"2"}},7]}}' AS c, {_DOC} @> '{{"f":2}}' AS d, {_DOC} @> '{{"b":true}}' AS e, {_DOC} @> '{{"b":null}}' AS f, '{{"f":3.00}}' <@ {_DOC} AS g, {_DOC} @> '{{"k":{{}}}}' AS h, ({_DOC} -> 'k') @> '7' AS i FROM nation""", "SELECT n_nationkey, n_regionkey = 2 AS a, false AS b, n_regionkey = 2 AND n_nationkey = 7 AS c, n_regionkey = 2 AS d, n_nationkey < 9 AS e, n_nationkey >= 9 AS f, n_regionkey = 3 AS g, false AS h, n_nationkey = 7 AS i FROM nation", "postgresql")
add("pg_json_keys_in_lists", """SELECT n_nationkey, CONCAT('["', n_name, '","x",5]') ? 'CHINA' AS a, CONCAT('["', n_name, '","x",5]') ?| ARRAY['CHINA', 'JAPAN'] AS b, CONCAT('["', n_name, '","x",5]') ?& ARRAY['CHINA', 'x'] AS c, CONCAT('{"', n_name, '":1}') ? 'CHINA' AS d, '[5]' ? '5' AS e, '"t"' ? 't' AS f, NULLIF('[]', '[]') ? 'a' AS g FROM nation""", "SELECT n_nationkey, n_name = 'CHINA' AS a, n_name IN ('CHINA', 'JAPAN') AS b, n_name = 'CHINA' AS c, n_name = 'CHINA' AS d, false AS e, true AS f, CAST(NULL AS BOOLEAN) AS g FROM nation", "postgresql")

# TOP below the outermost SELECT, GROUPS over joins and groups
add("top_ties_nested", "SELECT COUNT(*) AS n, MIN(t.p_size) AS least FROM (SELECT TOP 10 WITH TIES p_partkey, p_size FROM part ORDER BY p_size DESC) t", "SELECT COUNT(*) AS n, MIN(p_size) AS least FROM (SELECT p_size, rank() OVER (ORDER BY p_size DESC) AS r FROM part) WHERE r <= 10", "sqlserver")
add("top_percent_nested", "WITH t AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F') SELECT o_orderkey FROM (SELECT TOP 10 PERCENT o_orderkey FROM t ORDER BY o_totalprice, o_orderkey) x", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS r, count(*) OVER () AS n FROM orders WHERE o_orderstatus = 'F') WHERE r <= ceil(n * 0.1)", "sqlserver")
add("top_in_set_operation", "SELECT * FROM (SELECT TOP 2 WITH TIES p_size FROM part ORDER BY p_size) a UNION ALL SELECT p_size FROM part WHERE p_size IN (SELECT TOP 1 WITH TIES p_size FROM part ORDER BY p_size DESC)", "SELECT p_size FROM (SELECT p_size, rank() OVER (ORDER BY p_size) AS r FROM part) WHERE r <= 2 UNION ALL SELECT p_size FROM part WHERE p_size = (SELECT MAX(p_size) FROM part)", "sqlserver")
add("groups_over_join", "SELECT n.n_name, COUNT(*) OVER (PARTITION BY r.r_name ORDER BY LENGTH(n.n_name) GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS c FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE n.n_nationkey > 1")
add("groups_over_groups", "SELECT p_brand, p_size, COUNT(*) AS n, CAST(SUM(COUNT(*)) OVER (PARTITION BY p_brand ORDER BY COUNT(*) GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS s FROM part GROUP BY p_brand, p_size HAVING COUNT(*) > 1")

add("time_type", "SELECT n_nationkey, CAST(CAST(CONCAT('0', n_regionkey, ':10:20') AS TIME) AS VARCHAR(8)) AS t FROM nation WHERE CAST(CONCAT('0', n_regionkey, ':10:20') AS TIME(3)) > CAST('02:00:00' AS TIME)", "SELECT n_nationkey, '0' || n_regionkey || ':10:20' AS t FROM nation WHERE n_regionkey >= 2")

# keys, defaults and numbers
_KEYLESS = "SELECT NULLIF(r_regionkey, 1) AS r_regionkey, r_name FROM region"
change("upsert_null_keys", "region", [_KEY, "INSERT INTO region (r_regionkey, r_name) VALUES (NULL, 'X'), (NULL, 'Y'), (2, 'Z') ON CONFLICT (r_regionkey) DO UPDATE SET r_name = excluded.r_name"], "SELECT r_regionkey, CASE WHEN r_regionkey = 2 THEN 'Z' ELSE r_name END AS r_name FROM (SELECT NULLIF(r_regionkey, 1) AS r_regionkey, r_name FROM region) UNION ALL VALUES (NULL, 'X'), (NULL, 'Y')", "postgresql", start=_KEYLESS)
change("upsert_rows_of_one_key", "region", [_KEY, "INSERT INTO region (r_regionkey, r_name) VALUES (9, 'a'), (1, 'b'), (9, 'c'), (1, 'd'), (9, 'e') ON DUPLICATE KEY UPDATE r_name = CONCAT(r_name, VALUES(r_name))"], "SELECT r_regionkey, CASE WHEN r_regionkey = 1 THEN r_name || 'bd' ELSE r_name END AS r_name FROM region UNION ALL SELECT 9, 'ace'", "mysql", start=_R)
change("upsert_two_keys", "region", [_KEY, "CREATE UNIQUE INDEX m ON region (r_name)", "INSERT INTO region (r_regionkey, r_name) VALUES (1, 'NEW'), (50, 'ASIA'), (51, 'MORE'), (51, 'EUROPE') ON DUPLICATE KEY UPDATE r_regionkey = region.r_regionkey + 100"], "SELECT CASE WHEN r_regionkey = 1 OR r_name = 'ASIA' THEN r_regionkey + 100 ELSE r_regionkey END AS r_regionkey, r_name FROM region UNION ALL SELECT 151, 'MORE'", "mysql", start=_R)
change("upsert_nothing_twice", "region", [_KEY, "INSERT INTO region (r_regionkey, r_name) VALUES (9, 'a'), (9, 'b'), (3, 'c') ON CONFLICT DO NOTHING"], f"{_R} UNION ALL SELECT 9, 'a'", "postgresql", start=_R)
change("insert_select_identity", "t", ["CREATE TABLE t (id INT IDENTITY(10, 5), o INT); INSERT INTO t (o) SELECT o_orderkey FROM orders ORDER BY o_orderkey; INSERT INTO t (o) VALUES (-1)"], "SELECT CAST(5 + 5 * row_number() OVER (ORDER BY o) AS INT) AS id, o FROM (SELECT o_orderkey AS o FROM orders) UNION ALL SELECT CAST(10 + 5 * (SELECT COUNT(*) FROM orders) AS INT), -1", "sqlserver")
change("partial_unique_index", "region", ["CREATE UNIQUE INDEX u ON region (r_name) WHERE r_regionkey < 3", "INSERT INTO region VALUES (7, 'ASIA'), (8, 'ASIA')", "INSERT INTO region (r_regionkey, r_name) VALUES (1, 'ASIA'), (1, 'NEW'), (9, 'NEW') ON CONFLICT (r_name) WHERE r_regionkey < 3 DO NOTHING"], f"{_R} UNION ALL VALUES (7, 'ASIA'), (8, 'ASIA'), (1, 'NEW'), (9, 'NEW')", "postgresql", start=_R)
change("create_drop_index", "region", [_KEY, "DROP INDEX k", "INSERT INTO region VALUES (1, 'AGAIN')"], f"{_R} UNION ALL SELECT 1, 'AGAIN'", start=_R)
change("alter_view", "v", ["CREATE VIEW v AS SELECT n_name FROM nation", "ALTER VIEW v AS SELECT r_name FROM region WHERE r_regionkey > 1"], "SELECT r_name FROM region WHERE r_regionkey > 1")
change("output_into", "log", ["UPDATE region SET r_name = 'X' OUTPUT DELETED.r_name AS was INTO log WHERE r_regionkey < 2"], "SELECT r_name AS was FROM region WHERE r_regionkey < 2", "sqlserver")

# foreign keys; a statement that fails leaves all tables as they were
_FK = "ALTER TABLE nation ADD CONSTRAINT f FOREIGN KEY (n_regionkey) REFERENCES region (r_regionkey)"
_NATION = "SELECT n_nationkey, n_name, {0} AS n_regionkey FROM nation"
change("fk_update_cascade", "nation", [f"{_FK} ON DELETE CASCADE ON UPDATE CASCADE", "UPDATE region SET r_regionkey = r_regionkey + 10 WHERE r_regionkey < 2", "DELETE FROM region WHERE r_regionkey = 11"], _NATION.format("CASE WHEN n_regionkey < 2 THEN n_regionkey + 10 ELSE n_regionkey END") + " WHERE n_regionkey <> 1")
change("fk_update_set_null", "nation", [f"{_FK} ON DELETE CASCADE ON UPDATE SET NULL", "UPDATE region SET r_regionkey = 9 WHERE r_regionkey = 3", "UPDATE region SET r_name = 'X'"], _NATION.format("NULLIF(n_regionkey, 3)"))


def refused(name: str, table: str, texts: list[str], bad: str, oracle: str, dialect: str = "ansi") -> None:
    """Statements, then one that must raise; the result is a table, or a query, as it is after that."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir)
        for t in texts:
            e.script(t, dialect)
        try:
            e.sql(bad, dialect)
        except SqlError:
            return e.sql(table) if table.startswith("SELECT") else e.table(table)
        raise AssertionError(f"{name}: the statement was not refused")

    QUERIES[name], ORACLES[name] = run, oracle


_BOTH = "SELECT r_regionkey AS k, r_name AS v FROM region UNION ALL SELECT n_regionkey, n_name FROM nation"
refused("fk_update_restrict", _BOTH, [f"{_FK} ON DELETE CASCADE ON UPDATE RESTRICT"], "UPDATE region SET r_regionkey = 9 WHERE r_regionkey = 3", _BOTH)
refused("fk_delete_restrict", _BOTH, [_FK], "DELETE FROM region WHERE r_regionkey = 3", _BOTH)
refused("fk_column_restrict", "SELECT k FROM child UNION ALL SELECT k FROM parent", ["CREATE TABLE parent (k INT PRIMARY KEY); CREATE TABLE child (k INT REFERENCES parent (k)); INSERT INTO parent SELECT n_nationkey FROM nation; INSERT INTO child SELECT n_nationkey FROM nation WHERE n_nationkey < 5; DELETE FROM parent WHERE k > 20"], "DELETE FROM parent WHERE k < 9", "SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 5 UNION ALL SELECT n_nationkey FROM nation WHERE n_nationkey <= 20")
refused("rename_column_check", "t", ["CREATE TABLE t (a INT PRIMARY KEY, b INT CHECK (b > 0), CONSTRAINT c CHECK (a < b))", "ALTER TABLE t RENAME COLUMN b TO z", "INSERT INTO t (a, z) SELECT n_nationkey, n_nationkey + 1 FROM nation"], "INSERT INTO t (a, z) VALUES (100, 7)", "SELECT n_nationkey AS a, n_nationkey + 1 AS z FROM nation")
refused("upsert_same_row_twice", "region", [_KEY], "INSERT INTO region (r_regionkey, r_name) VALUES (9, 'a'), (9, 'b') ON CONFLICT (r_regionkey) DO UPDATE SET r_name = excluded.r_name", "SELECT * FROM region", "postgresql")
refused("unique_where_refused", "region", ["CREATE UNIQUE INDEX u ON region (r_name) WHERE r_regionkey < 3"], "UPDATE region SET r_name = 'X' WHERE r_regionkey < 2", "SELECT * FROM region")


def default_now_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.script("CREATE TABLE t (k INT, at TIMESTAMP DEFAULT NOW()); INSERT INTO t (k) SELECT n_nationkey FROM nation", "mysql")
    first = e.sql("SELECT k, at FROM t").collect()
    again = {r.k: r["at"] for r in e.sql("SELECT k, at FROM t").collect()}
    return spark.createDataFrame([(r.k, again[r.k] == r["at"]) for r in first], "k int, same boolean")


QUERIES["default_now_twice"], ORACLES["default_now_twice"] = default_now_twice, "SELECT n_nationkey AS k, true AS same FROM nation"


def row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, out = engine(spark, sf_dir), []
    for text in ("INSERT INTO region (r_regionkey) VALUES (7), (8)", "UPDATE nation SET n_name = 'X' WHERE n_regionkey = 1", "DELETE FROM orders WHERE o_orderstatus = 'F'"):
        e.sql(text, "mysql")
        out.append(e.sql(f"SELECT {len(out)} AS step, CAST(ROW_COUNT() AS BIGINT) AS n", "mysql"))
    return out[0].unionAll(out[1]).unionAll(out[2])


QUERIES["row_count"] = row_count
ORACLES["row_count"] = "SELECT 0 AS step, 2 AS n UNION ALL SELECT 1, COUNT(*) FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 2, COUNT(*) FROM orders WHERE o_orderstatus = 'F'"


def three_part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.register("a.nation", e.table("nation")).register("b.nation", e.table("nation").where("n_nationkey < 5"))
    return e.sql("SELECT a.nation.n_name AS x, b.nation.n_name AS y FROM a.nation JOIN b.nation ON a.nation.n_regionkey = b.nation.n_nationkey WHERE a.nation.n_nationkey > 3")


QUERIES["three_part_names"] = three_part_names
ORACLES["three_part_names"] = "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_nationkey WHERE b.n_nationkey < 5 AND a.n_nationkey > 3"


def registered_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    twice = F.pandas_udf(lambda s: s * 2, "long")
    return engine(spark, sf_dir).register_function("twice", twice).sql("SELECT n_name, TWICE(n_nationkey) AS d FROM nation WHERE TWICE(n_regionkey) > 3")


QUERIES["registered_function"] = registered_function
ORACLES["registered_function"] = "SELECT n_name, n_nationkey * 2 AS d FROM nation WHERE n_regionkey * 2 > 3"


def endless_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 results over a source without an end."""
    rows = ((i, f"v{i}") for i in itertools.count())
    schema = StructType.fromDDL("k long, v string")
    found = pulled(spark, rows, schema, lambda df: engine(spark, sf_dir).register("s", df).sql("SELECT k, UPPER(v) AS v FROM s WHERE k % 3 = 1"), 16)
    return spark.createDataFrame([tuple(r) for r in itertools.islice(found, 20)], schema)


QUERIES["endless_source"] = endless_source
ORACLES["endless_source"] = "SELECT CAST(3 * i + 1 AS BIGINT) AS k, 'V' || (3 * i + 1) AS v FROM range(20) t(i)"


def unknown_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = engine(spark, sf_dir).unknown_functions("SELECT FROB(n_name), UPPER(n_name), (SELECT GLORP(1)) FROM nation WHERE LEN(n_name) > 2")
    return spark.createDataFrame([(n,) for n in names], "name string")


QUERIES["unknown_functions"], ORACLES["unknown_functions"] = unknown_functions, "SELECT unnest(['FROB', 'GLORP']) AS name"
