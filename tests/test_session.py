"""Statements in a session, on small tables."""

import pytest

from tarn.dialect.lexer import DialectError, parse
from tarn.operators import relational
from tarn.operators.flatten import flatten_rows, steps
from tarn.session import Session


@pytest.fixture
def s(spark, request):
    session = Session(spark)
    session.execute(f"CREATE SCHEMA {request.node.name}; USE SCHEMA {request.node.name}")
    yield session
    session.execute(f"DROP SCHEMA {request.node.name}")


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_pivot_family(s):
    s.execute("""CREATE TABLE q (empid INT, amount INT, quarter TEXT);
        INSERT INTO q VALUES (1, 10000, 'Q1'), (1, 400, 'Q1'), (2, 4500, 'Q1'), (1, 5000, 'Q2'), (2, 90700, 'Q3')""")
    assert rows(s.execute("SELECT * FROM q PIVOT (sum(amount) FOR quarter IN ('Q1', 'Q2')) ORDER BY empid")) == [(1, 10400, 5000), (2, 4500, None)]
    any_ = s.execute("SELECT * FROM q PIVOT (sum(amount) FOR quarter IN (ANY ORDER BY quarter DESC)) ORDER BY empid")
    assert any_.columns == ["empid", "Q3", "Q2", "Q1"]
    assert rows(s.execute("SELECT * FROM q PIVOT (sum(amount) FOR quarter IN (SELECT 'Q2' AS quarter) DEFAULT ON NULL (0)) ORDER BY empid")) == [(1, 5000), (2, 0)]
    assert rows(s.execute("WITH a AS (SELECT empid, amount, quarter FROM q WHERE empid = 2) SELECT * FROM a PIVOT (max(amount) FOR quarter IN (ANY)) ")) == [(2, 4500, 90700)]


def test_unpivot(s):
    s.execute("CREATE TABLE m AS SELECT * FROM VALUES (1, 100, 200), (2, NULL, 300) AS t (empid, jan, feb)")
    assert len(rows(s.execute("SELECT * FROM m UNPIVOT (sales FOR month IN (jan, feb))"))) == 3
    assert len(rows(s.execute("SELECT * FROM m UNPIVOT INCLUDE NULLS (sales FOR month IN (jan, feb))"))) == 4


def test_merge_clauses_in_order(s):
    s.execute("CREATE TABLE t AS SELECT * FROM VALUES (1, 'a'), (2, 'b'), (3, 'c') AS v (id, d); CREATE TABLE u AS SELECT * FROM VALUES (2, 'x'), (3, 'y'), (4, 'z'), (5, 'w') AS v (id, d)")
    told = s.execute("""MERGE INTO t USING u ON t.id = u.id WHEN MATCHED AND u.d = 'y' THEN DELETE WHEN MATCHED THEN UPDATE SET d = u.d
        WHEN NOT MATCHED AND u.id < 5 THEN INSERT (id, d) VALUES (u.id, u.d)""").first().asDict()
    assert told == {"number of rows inserted": 1, "number of rows updated": 1, "number of rows deleted": 1}
    assert rows(s.execute("SELECT * FROM t ORDER BY id")) == [(1, "a"), (2, "x"), (4, "z")]
    with pytest.raises(DialectError):
        s.execute("MERGE INTO t USING u ON t.id = u.id WHEN NOT MATCHED BY SOURCE THEN DELETE")


def test_merge_on_a_range(s):
    s.execute("CREATE TABLE t AS SELECT * FROM VALUES (1, 10, 20) AS v (id, lo, hi); CREATE TABLE u AS SELECT * FROM VALUES (15), (25) AS v (x)")
    s.execute("MERGE INTO t USING u ON u.x BETWEEN t.lo AND t.hi WHEN MATCHED THEN UPDATE SET id = u.x WHEN NOT MATCHED THEN INSERT (id) VALUES (u.x)")
    assert sorted(rows(s.execute("SELECT id, lo FROM t")), key=str) == [(15, 10), (25, None)]


def test_tables_and_errors(s):
    s.execute("CREATE TABLE t (a INT, b NUMBER(10, 2))")
    with pytest.raises(DialectError) as e:
        s.execute("CREATE TABLE t (a INT)")
    assert e.value.code == "002002"
    with pytest.raises(DialectError) as e:
        s.execute("SELECT * FROM nowhere")
    assert e.value.code == "002003"
    assert rows(s.execute("DESCRIBE TABLE t"))[1][1] == "NUMBER(10,2)"
    s.execute("INSERT INTO t VALUES ('50.9'::int, '1.255')")
    assert float(s.execute("SELECT b FROM t").first()[0]) in (1.25, 1.26)
    s.execute("DROP TABLE t; DROP TABLE IF EXISTS t")
    with pytest.raises(DialectError):
        s.execute("SELECT h3_cell_to_parent(1)")


def test_variables_history_and_show(s):
    s.execute("SET (a, b) = (1, 'x'); SET c = (SELECT max(column1) FROM VALUES (3), (4))")
    assert rows(s.execute("SELECT $a, $b, $c")) == [(1, "x", 4)]
    assert rows(s.execute("SELECT * FROM TABLE(RESULT_SCAN(LAST_QUERY_ID()))")) == [(1, "x", 4)]
    assert ("A", "1", "int") in rows(s.execute("SHOW VARIABLES"))
    s.execute("UNSET a")
    with pytest.raises(DialectError):
        s.execute("SELECT $a")
    s.execute("ALTER SESSION SET week_start = 1")
    assert rows(s.execute("SELECT dayofweek('2024-01-07'::date)")) == [(7,)]


def test_catalog(s):
    s.execute("CREATE EXTERNAL VOLUME vol TYPE = 'memory'; CREATE DATABASE other EXTERNAL_VOLUME = 'vol'; CREATE SCHEMA other.sc; CREATE TABLE other.sc.t AS SELECT 1 AS x; CREATE VIEW other.sc.v AS SELECT x + 1 AS y FROM other.sc.t")
    assert rows(s.execute("SELECT * FROM other.sc.v")) == [(2,)]
    assert [r[1] for r in rows(s.execute("SHOW OBJECTS IN other.sc"))] == ["t", "v"]
    assert [r[1] for r in rows(s.execute("SHOW DATABASES LIKE 'oth%'"))] == ["other"]
    assert rows(s.execute("SELECT table_name FROM other.information_schema.views")) == [("v",)]
    s.execute("DROP DATABASE other")
    with pytest.raises(DialectError):
        s.execute("USE DATABASE other")


def test_upload_and_results(s):
    from tarn.sources import results

    assert s.upload("up", b"a,b\n1,x\n2,y\n") == 2 and s.upload("up", b"b,a\nz,3\n") == 1
    df = s.execute("SELECT a, b FROM up ORDER BY a")
    assert list(results.json_rows(df)) == [["1", "x"], ["2", "y"], ["3", "z"]] and len(results.arrow_base64(df)) > 100
    assert results.columns(df)[1] == {"name": "b", "type": "VARCHAR", "nullable": True}


def test_flatten_rows():
    assert steps("a.b[0]['k x']") == ["a", "b", 0, "k x"]
    assert list(flatten_rows('{"a":[1,{"b":2}]}', recursive=True)) == [("a", "a", None, '[1,{"b":2}]', '{"a":[1,{"b":2}]}'), (None, "a[0]", 0, "1", '[1,{"b":2}]'), (None, "a[1]", 1, '{"b":2}', '[1,{"b":2}]'), ("b", "a[1].b", None, "2", '{"b":2}')]
    assert list(flatten_rows("[]")) == [] and len(list(flatten_rows("[]", outer=True))) == 1
    assert list(flatten_rows('{"a":1}', mode="ARRAY")) == [] and list(flatten_rows("bad")) == []


def test_dataframe_operators(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2)], "k string, v int")
    assert {tuple(r) for r in relational.top_k_per(df, ["k"], 1, F.col("v").desc()).collect()} == {("a", 3), ("b", 2)}
    assert relational.pivot(df, "k", [F.sum("v")], keys=[], default=0).first().asDict() == {"a": 4, "b": 2}
    assert {tuple(r) for r in relational.salted_sum(df, ["k"], "v", "s").collect()} == {("a", 4), ("b", 2)}
    assert relational.grouping_sets(df, [["k"], []], F.sum("v").alias("s")).count() == 3
    assert relational.unpivot(df, "x", "n", ["v"]).count() == 3


STATEMENTS = [
    ("SELECT column1 FROM VALUES (910), (256) WHERE column1 LIKE '%56'", [(256,)]),
    ("SELECT CASE WHEN a IS NULL THEN 1 ELSE 2 END::varchar AS q FROM (SELECT 1 a)", [("2",)]),
    ("SELECT substr('mystring', -3), substr(12345, 2, 3), substr('mystring', NULL, 3), len(NULL), sha2(NULL)", [("ing", "234", None, None, None)]),
    ("SELECT listagg(name, ', ') WITHIN GROUP (ORDER BY name DESC) FROM (VALUES ('b'), ('a')) AS t(name)", [("b, a",)]),
    ("SELECT value, key FROM FLATTEN(INPUT => parse_json('[]'), OUTER => TRUE) f", [(None, None)]),
    ("SELECT a, ROW_NUMBER() OVER (PARTITION BY a ORDER BY b DESC) rn FROM VALUES (1, 2), (1, NULL) AS t(a, b) QUALIFY rn = 1", [(1, 1)]),
    ("SELECT t.value:name::string n FROM (SELECT f.value FROM (SELECT parse_json('[{\"name\":\"q\"}]') j), LATERAL FLATTEN(j) f) t", [("q",)]),
    ("WITH s AS (SELECT 'S1' AS sid, 1 AS st, 1 AS us UNION ALL SELECT 'S2', 5, 1) SELECT us AS st, max(CASE WHEN st = us THEN sid END) AS f FROM s GROUP BY us", [(1, "S1")]),
    ("SELECT 1 UNION ALL SELECT 2 ORDER BY 1 DESC LIMIT 1", [(2,)]),
    ("SELECT k, max(v) FILTER (WHERE v < 3) AS m FROM VALUES ('a', 1), ('a', 5) AS t(k, v) GROUP BY ALL", [("a", 1)]),
    ("SELECT (SELECT 3) + 1 AS m, -1 AS neg, 'a' || 'b' AS cc, 5 % 3 AS md", [(4, -1, "ab", 2)]),
]


@pytest.mark.parametrize("sql, want", STATEMENTS)
def test_statements(spark, sql, want):
    assert rows(Session(spark).execute(sql)) == want


def test_quoted_names(s):
    s.execute('CREATE SCHEMA main."odd schema"; CREATE TABLE main."odd schema"."odd table" (id INT) AS VALUES (1), (2)')
    assert rows(s.execute('SELECT max(id) FROM main."odd schema"."odd table"')) == [(2,)]
    assert [r[1] for r in rows(s.execute('SHOW TABLES IN main."odd schema"'))] == ["odd table"]
    s.execute('DROP SCHEMA main."odd schema"')


def test_stage_and_null_columns(s, tmp_path):
    (tmp_path / "x.csv").write_text("id,name\n1,a\n2,\n")
    s.execute(f"CREATE STAGE st URL = 'file://{tmp_path}/x.csv' FILE_FORMAT = (TYPE = CSV SKIP_HEADER = 1 PARSE_HEADER = true)")
    assert rows(s.execute("SELECT id, name FROM @st ORDER BY id")) == [(1, "a"), (2, None)]
    s.execute("CREATE TABLE n AS SELECT NULL AS c; INSERT INTO n VALUES ('x'); CREATE TABLE loaded (id INT, name VARCHAR); COPY INTO loaded FROM @st")
    assert rows(s.execute("SELECT c FROM n ORDER BY c")) == [("x",), (None,)]
    assert rows(s.execute("SELECT count(*) FROM loaded")) == [(2,)]


def test_stream_of_files(spark, tmp_path):
    from pyspark.sql import functions as F

    from tarn.streaming import events

    rows_ = spark.range(200).select(F.timestamp_seconds(F.col("id") * 60 + 1700000000).alias("ts"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("event_type"), F.col("id").cast("double").alias("value"))
    rows_.repartition(3).write.parquet(f"{tmp_path}/in")
    out = events.windowed(events.stream(spark, f"{tmp_path}/in", rows_.schema, per_trigger=1), late="10 days")
    events.to_table(out, "stream_test", f"{tmp_path}/cp", mode="complete")
    want = {tuple(r) for r in events.windowed(rows_).collect()}
    assert {tuple(r) for r in spark.table("stream_test").collect()} == want


def test_merge_with_several_matches(s):
    s.execute("CREATE TABLE t (k INT, v VARCHAR); INSERT INTO t VALUES (1, 'a'), (2, 'b')")
    with pytest.raises(DialectError, match="Duplicate row"):
        s.execute("MERGE INTO t USING (SELECT column1 AS k, column2 AS v FROM VALUES (1, 'x'), (1, 'y')) s ON t.k = s.k WHEN MATCHED THEN UPDATE SET v = s.v")
    # One of the matches comes to a clause: the row changes once and isn't doubled.
    s.execute("MERGE INTO t USING (SELECT column1 AS k, column2 AS v FROM VALUES (1, 'x'), (1, 'y'), (2, 'p'), (2, 'q')) s ON t.k = s.k WHEN MATCHED AND s.v = 'x' THEN UPDATE SET v = s.v")
    assert sorted(map(tuple, s.execute("SELECT k, v FROM t").collect())) == [(1, "x"), (2, "b")]


def test_alter_table(s):
    s.execute("CREATE TABLE t AS SELECT 1 AS a, 'x' AS b; CREATE TABLE u AS SELECT 2 AS c")
    s.execute("ALTER TABLE t ADD COLUMN n NUMBER(10, 2)")
    s.execute("ALTER TABLE t RENAME COLUMN b TO bb")
    assert [f.name for f in s.execute("SELECT * FROM t").schema] == ["a", "bb", "n"] and s.execute("SELECT * FROM t").first() == (1, "x", None)
    s.execute("ALTER TABLE t DROP COLUMN a")
    s.execute("ALTER TABLE t RENAME TO w")
    assert s.execute("SELECT * FROM w").columns == ["bb", "n"]
    s.execute("ALTER TABLE w SWAP WITH u")
    assert s.execute("SELECT * FROM w").columns == ["c"] and s.execute("SELECT * FROM u").columns == ["bb", "n"]
    for bad in ("ALTER TABLE nowhere RENAME TO x", "ALTER TABLE u DROP COLUMN nowhere", "ALTER TABLE u ADD COLUMN bb INT", "ALTER TABLE u RENAME TO w", "ALTER TABLE u FLY AWAY"):
        with pytest.raises(DialectError):
            s.execute(bad)
    assert s.execute("ALTER TABLE IF EXISTS nowhere RENAME TO x").count() == 1


def test_explain_gives_plans(s):
    kinds = lambda sql: [r.plan_type for r in s.execute(sql).collect()]
    query = "SELECT count(*) AS n FROM (SELECT column1 AS a FROM VALUES (1), (2), (3)) WHERE a > 1"
    assert kinds(f"EXPLAIN {query}") == ["logical_plan", "physical_plan"]
    assert kinds(f"EXPLAIN VERBOSE {query}") == ["initial_logical_plan", "logical_plan", "physical_plan"]
    (plan,) = [r.plan for r in s.execute(f"EXPLAIN ANALYZE {query}").collect()]
    assert "output_rows=1" in plan


def test_filters_on_typed_dates_reach_the_scan(spark, tmp_path):
    spark.sql("SELECT date '2024-01-01' AS d, timestamp_ntz '2024-01-01 01:02:03' AS t").write.parquet(f"{tmp_path}/f.parquet")
    s = Session(spark)
    s.attach(str(tmp_path), ("f",))
    for condition in ("to_date(d) < '2025-01-01'::date", "to_timestamp(t) > '2023-01-01'::timestamp", "try_to_date(t) = '2024-01-01'::date"):
        df = s.execute(f"SELECT d FROM f WHERE {condition}")
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [IsNotNull" in plan and any(x in plan for x in ("LessThan(", "GreaterThan(", "GreaterThanOrEqual(")), plan
        assert df.count() == 1


def test_texts_of_nested_array_calls_grow_in_proportion(s):
    sizes, text = [], "a"
    for _ in range(6):
        text = f"array_slice(array_sort(array_flatten(array_construct({text}))), 0, 3)"
        sizes.append(len(s.to_spark(f"SELECT {text} FROM VALUES ('[1]') t(a)")))
    steps = [b - a for a, b in zip(sizes, sizes[1:])]
    assert max(steps) <= 1.1 * min(steps)


def test_pivots_of_too_many_values_raise(s, monkeypatch):
    monkeypatch.setattr(relational, "MOST_PIVOTED", 2)
    with pytest.raises(ValueError):
        s.execute("SELECT * FROM (SELECT column1 AS k, column2 AS v FROM VALUES (1, 1), (2, 1), (3, 1)) PIVOT (sum(v) FOR k IN (ANY))")


def test_unknown_functions_are_refused_by_name(s):
    with pytest.raises(DialectError, match="no_such_thing' is not implemented"):
        s.execute("SELECT no_such_thing(1)")


def test_distinct_counts_apart_from_percentiles(s):
    s.execute("""CREATE TABLE d AS SELECT * FROM VALUES ('a', 1, 1.0D), ('a', 1, 2.0D), ('a', 2, 9.0D), ('b', 5, 4.0D), (NULL, NULL, 7.0D), (NULL, 3, 8.0D), ('c', 1, 1.0D) AS t (k, x, y)""")
    sql = "SELECT k, count(DISTINCT x), median(y) AS m, count(*) + count(DISTINCT x) AS n FROM d WHERE k IS NULL OR k <> 'c' GROUP BY k HAVING count(DISTINCT x) >= 1 AND max(y) > 1 ORDER BY m DESC, k"
    df = s.execute(sql)
    assert df.columns == ["k", "count(DISTINCT x)", "m", "n"]
    assert rows(df) == [(None, 1, 7.5, 3), ("b", 1, 4.0, 2), ("a", 2, 2.0, 5)]
    # No percentile is kept for each value that is counted.
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert not [line for line in plan.splitlines() if "percentile(" in line and "x#" in line.split("functions=")[0]]
    assert rows(s.execute("SELECT count(DISTINCT x) AS n, approx_median(y) AS m FROM d")) == [(4, 4.0)]
    assert rows(s.execute("SELECT count(DISTINCT x) AS n, median(y) AS m FROM d WHERE y > 100")) == [(0, None)]
    by = s.to_spark("SELECT upper(k) AS u, array_agg(y), sum(DISTINCT x) AS n FROM d GROUP BY 1")
    assert "`_distinct`" in by and s.spark.sql(by).columns == ["u", "to_json(collect_list(y))", "n"]
    # Rows that may differ when they are read again are read once.
    for source in ("(SELECT k, x, y FROM d LIMIT 3)", "(SELECT k, x, random() AS y FROM d)", "(SELECT k, x, row_number() OVER (ORDER BY k) AS y FROM d)"):
        assert "`_distinct`" not in s.to_spark(f"SELECT k, count(DISTINCT x) AS n, median(y) AS m FROM {source} AS q GROUP BY k")


def test_refused_texts_are_not_parsed(s):
    """Parsers see only texts of a shape they may take; all others stay what they were."""
    texts = {"x": None, "2020-02-30": None, "1/2/2020": "2020-01-02", "01/02/02020": None, "001/02/2020": "2020-01-02", "2/30/2020": None, "13/2/2020": None, "1/2/20": None, "05-mar-2020": "2020-03-05", "5-Mar-2020": None, "31-Feb-2020": None, " 86400 ": "+86400-01-01", " 12 ": "1970-01-01", "-1": "1969-12-31", "1x": None, "": None}
    values = ", ".join(f"('{t}')" for t in texts)
    got = rows(s.execute(f"SELECT t, cast(try_to_date(t) AS varchar) FROM VALUES {values} AS v (t)"))
    assert dict(got) == texts
    times = {"x1": None, "1e3": "1970-01-01 00:16:40", "1600000000.5": "2020-09-13 12:26:40.5", "1600000000000": "2020-09-13 12:26:40", "1/2/2020 3:04:05": "2020-01-02 03:04:05", "1/2/2020 3:4:5": None, "2/30/2020 3:04:05": None, "05-Mar-2020 01:02:03": "2020-03-05 01:02:03", "٣": "1970-01-01 00:00:03", ".": None}
    values = ", ".join(f"('{t}')" for t in times)
    got = rows(s.execute(f"SELECT t, cast(try_to_timestamp_ntz(t) AS varchar) FROM VALUES {values} AS v (t)"))
    assert dict(got) == times
    assert rows(s.execute("SELECT hex_encode(try_to_binary('4aB')), try_to_binary('zz'), to_array('[1'), to_array(' [1]')")) == [("04AB", None, '["[1"]', " [1]")]
    # Each parser stands behind a test of the text's shape, and a number is read once.
    text = s.expression(parse("try_to_timestamp(t)"))
    assert text.count("try_to_timestamp(") == text.count(" RLIKE ") - 1 == 2 and text.count("as decimal") == 1
    assert s.expression(parse("try_to_date(t)")).count(" RLIKE ") == 3
