import itertools

import pytest
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from sparkloom.operators.ddl import ConstraintError
from sparkloom.plans import nodes as N
from sparkloom.plans.lexer import SqlError
from sparkloom.plans.parser import parse, parse_script
from sparkloom.session import Engine
from sparkloom.sources import storage
from sparkloom.sources.storage import appended
from sparkloom.streaming.pull import pulled, windowed_counts


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture
def staff(spark):
    data = [(1, "Ann", "Engineering", 90000), (2, "Bob", "Engineering", 100000), (3, "Cy", "Engineering", 110000), (4, "Di", "Sales", 75000), (5, "Ed", "Sales", 80000)]
    return Engine(spark).register("employees", spark.createDataFrame(data, "id int, name string, department string, salary int"))


def test_group_and_having(staff):
    got = rows(staff.sql("SELECT department, COUNT(*) AS n, SUM(salary) AS s FROM employees GROUP BY department ORDER BY department"))
    assert got == [("Engineering", 3, 300000), ("Sales", 2, 155000)]
    assert rows(staff.sql("SELECT department FROM employees GROUP BY department HAVING COUNT(*) > 2")) == [("Engineering",)]


def test_ranks_and_running_sum(spark):
    e = Engine(spark).register("players", spark.createDataFrame([("a", 100), ("b", 90), ("c", 100), ("d", 80)], "name string, score int"))
    got = rows(e.sql("SELECT name, RANK() OVER (ORDER BY score DESC) AS r, DENSE_RANK() OVER (ORDER BY score DESC) AS d FROM players ORDER BY name"))
    assert got == [("a", 1, 1), ("b", 3, 2), ("c", 1, 1), ("d", 4, 3)]


def test_outer_joins(spark):
    e = Engine(spark)
    e.register("customers", spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "id int, name string"))
    e.register("orders", spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 9)], "orderid int, customerid int"))
    for kind, n in (("LEFT", 4), ("RIGHT", 4), ("FULL", 5), ("INNER", 3)):
        assert e.sql(f"SELECT c.name, o.orderid FROM customers c {kind} JOIN orders o ON c.id = o.customerid").count() == n


def test_set_operations_go_left_to_right(spark):
    e = Engine(spark)
    for t, names in (("t1", "Alice Bob"), ("t2", "Bob Carol"), ("t3", "Bob")):
        e.register(t, spark.createDataFrame([(x,) for x in names.split()], "name string"))
    got = rows(e.sql("SELECT name FROM t1 UNION ALL SELECT name FROM t2 EXCEPT SELECT name FROM t3 ORDER BY name"))
    assert got == [("Alice",), ("Carol",)]


def test_names_that_differ_in_case(spark):
    e = Engine(spark).register("t", spark.createDataFrame([(1.0, "x")], "id double, v string"))
    assert e.sql("SELECT v AS Name, id AS nAMe FROM t").columns == ["Name", "nAMe"]


def test_errors_say_why(staff):
    for text in ("SELECT nope FROM employees", "SELECT * FROM missing", "SELECT FROM", "SELECT a.b.c.d FROM employees", "SELECT 'x FROM employees"):
        with pytest.raises(SqlError):
            staff.sql(text)
    with pytest.raises(SqlError, match="no value for parameter"):
        staff.sql("SELECT id FROM employees WHERE id = @x")
    with pytest.raises(SqlError, match="unknown dialect"):
        staff.sql("SELECT 1", dialect="klingon")


def test_parse_shapes():
    q = parse("SELECT a + b * 2 AS x FROM t WHERE NOT a = 1 OR b IN (1, 2) AND c IS NOT NULL")
    assert isinstance(q.first.items[0].expr, N.Bin) and q.first.items[0].expr.op == "+"
    assert q.first.where.op == "OR"
    assert len(parse_script("SELECT 1; /* two */ SELECT 2 -- end\n")) == 2
    pg = parse("SELECT a FROM t WHERE j ? 'k' AND b = ?", "postgresql")
    assert [x.name for x in N.walk(pg) if isinstance(x, N.Param)] == ["?0"]
    assert parse("SELECT TOP 5 PERCENT WITH TIES a FROM t ORDER BY a", "sqlserver").first.top.ties
    assert parse("CREATE TABLE t (a INT IDENTITY(5, 2) PRIMARY KEY)").columns[0].identity == (5, 2)


def test_constraints_raise(spark):
    e = Engine(spark)
    e.script("CREATE TABLE t (id INT PRIMARY KEY, n INT CHECK (n > 0), u VARCHAR(5) UNIQUE)")
    e.sql("INSERT INTO t VALUES (1, 2, 'a')")
    for bad in ("(1, 3, 'b')", "(2, 0, 'b')", "(NULL, 1, 'c')", "(3, 1, 'a')"):
        with pytest.raises(ConstraintError):
            e.sql(f"INSERT INTO t VALUES {bad}")
    e.sql("INSERT INTO t VALUES (4, 1, NULL), (5, 1, NULL)")
    assert e.table("t").count() == 3


def test_a_failing_change_leaves_all_tables(spark):
    """A cascade that ends in a refused row takes nothing with it."""
    e = Engine(spark)
    e.script("""CREATE TABLE a (k INT PRIMARY KEY); CREATE TABLE b (k INT PRIMARY KEY, a INT REFERENCES a (k) ON DELETE CASCADE ON UPDATE CASCADE);
    CREATE TABLE c (b INT REFERENCES b (k)); INSERT INTO a VALUES (1), (2), (3); INSERT INTO b VALUES (10, 1), (20, 2), (30, 3); INSERT INTO c VALUES (20)""")
    with pytest.raises(ConstraintError):
        e.sql("DELETE FROM a WHERE k < 3")
    assert [e.table(t).count() for t in "abc"] == [3, 3, 1]
    e.sql("DELETE FROM a WHERE k = 1")
    e.sql("UPDATE a SET k = k + 100")
    assert sorted(rows(e.table("b"))) == [(20, 102), (30, 103)]
    with pytest.raises(ConstraintError, match="refers to"):
        e.sql("ALTER TABLE a DROP COLUMN k")
    e.script("ALTER TABLE a RENAME COLUMN k TO z; INSERT INTO a (z) VALUES (7); INSERT INTO b VALUES (40, 7); DELETE FROM a WHERE z = 7")
    assert sorted(r[0] for r in rows(e.table("b"))) == [20, 30]


def test_actions_on_null_and_default(spark):
    e = Engine(spark)
    e.script("""CREATE TABLE p (k INT PRIMARY KEY); CREATE TABLE x (id INT, k INT DEFAULT 1 REFERENCES p (k) ON DELETE SET DEFAULT ON UPDATE SET NULL, CONSTRAINT q CHECK (id > 0));
    INSERT INTO p VALUES (1), (2), (3); INSERT INTO x VALUES (1, 2), (2, 3), (3, NULL); DELETE FROM p WHERE k = 2; UPDATE p SET k = 5 WHERE k = 3""")
    assert sorted(rows(e.table("x"))) == [(1, 1), (2, None), (3, None)]
    e.script("ALTER TABLE x DROP COLUMN id; INSERT INTO x (k) VALUES (5)")
    assert e.table("x").columns == ["k"] and e.table("x").count() == 4


def test_defaults_and_numbers_in_merge_update_and_alter(spark):
    e = Engine(spark).register("s", spark.createDataFrame([(1, "x"), (7, "y"), (8, "z")], "k int, v string"))
    e.script("CREATE TABLE t (id INT AUTO_INCREMENT, k INT, v TEXT DEFAULT 'new', w INT DEFAULT 4); INSERT INTO t (k, v, w) VALUES (1, 'a', 0)")
    e.sql("MERGE INTO t USING s ON t.k = s.k WHEN MATCHED THEN UPDATE SET v = s.v WHEN NOT MATCHED THEN INSERT (k, w) VALUES (s.k, DEFAULT)")
    assert sorted(tuple(r)[1:] for r in rows(e.table("t"))) == [(1, "x", 0), (7, "new", 4), (8, "new", 4)] and sorted(r[0] for r in rows(e.table("t"))) == [1, 2, 3]
    e.sql("UPDATE t SET v = DEFAULT, w = DEFAULT WHERE k = 1")
    assert rows(e.sql("SELECT v, w FROM t WHERE k = 1")) == [("new", 4)]
    e.sql("ALTER TABLE t ADD COLUMN n INT IDENTITY(10, 10)")
    assert sorted(r.n for r in e.table("t").collect()) == [10, 20, 30]


def test_values_of_the_moment_stay(spark):
    e = Engine(spark).register("s", spark.range(5).selectExpr("id as k", "cast(0 as double) as r"))
    e.script("UPDATE s SET r = RAND(); CREATE TABLE t AS SELECT k, RAND() AS r FROM s; SELECT k, RAND() AS r INTO u FROM s; DELETE FROM t WHERE RAND() < 0.5")
    for name in "stu":
        assert sorted(rows(e.table(name))) == sorted(rows(e.table(name)))


def test_tables_that_others_refer_to(spark):
    e = Engine(spark)
    e.script("CREATE TABLE p (k INT PRIMARY KEY); CREATE TABLE c (k INT REFERENCES p (k) ON DELETE CASCADE); INSERT INTO p VALUES (1), (2); INSERT INTO c VALUES (1), (2)")
    with pytest.raises(ConstraintError):
        e.sql("DROP TABLE p")
    e.script("RENAME TABLE p TO q; DELETE FROM q WHERE k = 1")
    assert rows(e.table("c")) == [(2,)]
    with pytest.raises(ConstraintError):
        e.sql("INSERT INTO c VALUES (9)")
    e.sql("DROP TABLE c, q")


@pytest.mark.parametrize(
    ("text", "dialect", "want"),
    [
        ("SELECT 7 / 2 AS x, 7 / 2 * 2 AS y, -7 / 2 AS z, 7.0 / 2 AS d", "postgresql", [3, 6, -3, 3.5]),
        ("SELECT 7 / 2 AS x, 'a' + 'b' AS s, 1 + 2 AS n, 'a' + NULL AS o", "sqlserver", [3, "ab", 3, None]),
        ("SELECT 7 / 2 AS x", "mysql", [3.5]),
        ("WITH c AS (SELECT 9 AS k) SELECT k / 2 AS x, (SELECT MAX(d.k / 4) FROM c d) AS y FROM c WHERE k / 4 = 2", "postgresql", [4, 2]),
        ("SELECT (SELECT MAX(r.k / 2) FROM (SELECT 5 AS k) r WHERE r.k / 5 = o.k / 7) AS y FROM (SELECT 9 AS k) o", "postgresql", [2]),
        ("SELECT CAST(7 / 2 AS VARCHAR(9)) AS s, SUM(7) / 2 AS n, 7 / CAST(2 AS BIGINT) AS b", "sqlserver", ["3", 3, 3]),
        ("SELECT COUNT(*) AS n FROM (SELECT 1 AS a) x JOIN (SELECT 3 AS b) y ON y.b / 2 = x.a", "sqlserver", [1]),
        ("SELECT '{\"a\":[1,2,{\"b\":[3]}]}' @> '{\"a\":[{\"b\":[3]},2]}' AS x, '[1,[2]]' @> '[[2]]' AS y, '{\"a\":1}' @> '{}' AS z, '[]' @> '{}' AS w", "postgresql", [True, True, True, False]),
        ("SELECT 'a_b' LIKE 'a!_b' ESCAPE '!' AS x, 'axb' LIKE 'a!_b' ESCAPE '!' AS y, 'a\\b' LIKE 'a\\b' AS z", "ansi", [True, False, True]),
        ("SELECT 'a%' LIKE 'a\\%' AS x, 'ab' LIKE 'a\\%' AS y, 'ab' LIKE 'a\\b' AS z", "postgresql", [True, False, True]),
    ],
)
def test_expressions(spark, text, dialect, want):
    assert [float(x) if hasattr(x, "quantize") else x for x in rows(Engine(spark).sql(text, dialect))[0]] == want


def test_many_changes(spark):
    """Tables are written after some changes, and rows come out as if they were not."""
    e = Engine(spark)
    e.sql("CREATE TABLE t (id INT AUTO_INCREMENT, v INT)")
    for i in range(18):
        e.sql(f"INSERT INTO t (v) VALUES ({i})")
    assert sorted(rows(e.table("t"))) == [(i + 1, i) for i in range(18)]
    assert "Union" not in e.table("t")._jdf.queryExecution().optimizedPlan().toString() or e.state.age["t"] == 18


def test_identity_from_many_partitions(spark):
    e = Engine(spark).register("s", spark.range(1000).repartition(7).selectExpr("id as v"))
    e.script("CREATE TABLE t (id SMALLINT IDENTITY(1, 2), v BIGINT); INSERT INTO t (v) SELECT v FROM s", "sqlserver")
    assert sorted(r[0] for r in rows(e.table("t"))) == list(range(1, 2001, 2)) and rows(e.table("t").orderBy("id")) == rows(e.table("t").orderBy("id"))


def test_shared_storage(spark, tmp_path, monkeypatch):
    """A folder of the application, gone when it is asked to go."""
    monkeypatch.setattr(storage, "_base", lambda s: f"file://{tmp_path}/app")
    assert storage.stored(spark.range(3)).count() == 3 and len(list((tmp_path / "app").iterdir())) == 1
    storage.remove_workspaces(spark)
    assert not (tmp_path / "app").exists()


def test_merge_raises_on_two_matches(spark):
    e = Engine(spark).register("t", spark.createDataFrame([(1, "a")], "k int, v string")).register("s", spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string"))
    with pytest.raises(SqlError, match="several rows"):
        e.sql("MERGE INTO t USING s ON t.k = s.k WHEN MATCHED THEN UPDATE SET v = s.v")


def test_rollback_and_last_insert_id(spark):
    e = Engine(spark)
    e.script("CREATE TABLE t (id INT AUTO_INCREMENT, v TEXT); INSERT INTO t (v) VALUES ('a'); BEGIN; INSERT INTO t (v) VALUES ('b'); ROLLBACK")
    assert rows(e.table("t")) == [(1, "a")]
    e.sql("INSERT INTO t (v) VALUES ('c')")
    assert rows(e.sql("SELECT id FROM t WHERE id = LAST_INSERT_ID()", "mysql")) == [(2,)]


def test_empty_tables(spark):
    e = Engine(spark).register("t", spark.createDataFrame([], "k int, v string"))
    assert rows(e.sql("SELECT COUNT(*) AS n, SUM(k) AS s FROM t")) == [(0, None)]
    assert e.sql("SELECT TOP 3 WITH TIES k FROM t ORDER BY k", "sqlserver").count() == 0
    assert e.sql("DELETE FROM t RETURNING *", "postgresql").output.count() == 0


def test_unending_source_is_drawn_as_needed(spark):
    drawn = itertools.count()
    source = ((next(drawn), "x") for _ in itertools.count())
    schema = StructType([StructField("id", IntegerType()), StructField("v", StringType())])
    got = list(itertools.islice(pulled(spark, source, schema, lambda df: df.where("id % 2 = 0"), 10), 7))
    assert [r[0] for r in got] == [0, 2, 4, 6, 8, 10, 12] and next(drawn) <= 20


def test_append_checks_schema(spark):
    a = spark.createDataFrame([(1,)], "k int")
    assert appended(a, a).count() == 2
    with pytest.raises(ValueError):
        appended(a, spark.createDataFrame([("x",)], "k string"))


def test_unknown_functions(staff):
    assert staff.unknown_functions("SELECT FROBNICATE(name), UPPER(name) FROM employees") == ["FROBNICATE"]


def test_windowed_stream(spark, tmp_path):
    spark.createDataFrame([(1, "2020-01-01 00:01:00", "a"), (2, "2020-01-01 00:02:00", "a"), (3, "2020-01-01 00:12:00", "b")], "id int, ts string, kind string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, ts string, kind string").parquet(str(tmp_path / "in"))
    q = windowed_counts(stream, "ts", "kind").writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.kind, r.n) for r in spark.sql("SELECT * FROM counts").collect()) == [("a", 2), ("b", 1)]
