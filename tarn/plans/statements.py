"""Queries that run statements first: DDL, DML, MERGE, sources and sinks.

Each works in a schema of its own and returns what the statements left."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarn.session import Session

CALLABLES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _script(name: str, tables: tuple[str, ...], script: str, oracle: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        schema = f"q_{uuid.uuid4().hex[:12]}"
        s = Session(spark)
        s.attach(sf_dir, tables)
        return s.execute(f"CREATE SCHEMA {schema}; USE SCHEMA {schema};" + script)

    CALLABLES[name] = run
    ORACLES[name] = oracle


_script(
    "ctas_insert",
    ("customer",),
    """CREATE TABLE rich AS SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000;
       INSERT INTO rich SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0;
       SELECT c_custkey, c_acctbal FROM rich""",
    "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000 OR c_acctbal < 0",
)
_script(
    "insert_try_cast",
    ("nation",),
    """CREATE TABLE t (k INT, name VARCHAR, n NUMBER(10, 2));
       INSERT INTO t (name, k, n) SELECT n_name, n_nationkey, concat(n_nationkey, '.5') FROM nation;
       INSERT INTO t (name, k, n) SELECT 'bad', 99, 'x';
       SELECT k, name, cast(n AS double) AS n FROM t""",
    "SELECT n_nationkey::BIGINT AS k, n_name AS name, n_nationkey + 0.5::DOUBLE AS n FROM nation UNION ALL SELECT 99, 'bad', NULL",
)
_script("truncate", ("nation",), "CREATE TABLE t AS SELECT * FROM nation; TRUNCATE TABLE t; SELECT count(*) AS n FROM t", "SELECT 0::BIGINT AS n")
_script("create_or_replace", ("nation",), "CREATE TABLE t AS SELECT n_name AS a FROM nation; CREATE OR REPLACE TABLE t AS SELECT n_nationkey AS b FROM nation WHERE n_regionkey = 1; SELECT b FROM t", "SELECT n_nationkey AS b FROM nation WHERE n_regionkey = 1")
_script(
    "merge_into",
    ("customer", "orders"),
    """CREATE TABLE target AS SELECT c_custkey AS k, c_acctbal AS v, c_mktsegment AS seg FROM customer WHERE c_custkey % 3 <> 0;
       MERGE INTO target t USING (SELECT o_custkey AS k, max(o_totalprice) AS top FROM orders GROUP BY o_custkey) s ON t.k = s.k
         WHEN MATCHED AND s.top > 450000 THEN DELETE
         WHEN MATCHED AND t.v < 0 THEN UPDATE SET v = s.top, seg = 'NEW'
         WHEN MATCHED THEN UPDATE SET v = t.v + 1
         WHEN NOT MATCHED AND s.top > 100000 THEN INSERT (k, v) VALUES (s.k, s.top);
       SELECT k, round(v, 2) AS v, seg FROM target""",
    """WITH t AS (SELECT c_custkey AS k, c_acctbal AS v, c_mktsegment AS seg FROM customer WHERE c_custkey % 3 <> 0), s AS (SELECT o_custkey AS k, max(o_totalprice) AS top FROM orders GROUP BY o_custkey)
       SELECT coalesce(t.k, s.k) AS k, round(CASE WHEN t.k IS NULL THEN s.top WHEN s.k IS NULL THEN t.v WHEN t.v < 0 THEN s.top ELSE t.v + 1 END, 2) AS v, CASE WHEN t.k IS NOT NULL AND s.k IS NOT NULL AND t.v < 0 THEN 'NEW' ELSE t.seg END AS seg
       FROM t FULL JOIN s ON t.k = s.k WHERE (t.k IS NULL AND s.top > 100000) OR (t.k IS NOT NULL AND (s.k IS NULL OR s.top <= 450000))""",
)
_script(
    "merge_counts",
    ("nation",),
    """CREATE TABLE t AS SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_nationkey < 10;
       MERGE INTO t USING (SELECT n_nationkey AS k, lower(n_name) AS name FROM nation WHERE n_nationkey >= 5) s ON t.k = s.k WHEN MATCHED THEN UPDATE SET name = s.name WHEN NOT MATCHED THEN INSERT (k, name) VALUES (s.k, s.name)""",
    'SELECT 15::BIGINT AS "number of rows inserted", 5::BIGINT AS "number of rows updated"',
)
_script("update_delete", ("nation",), "CREATE TABLE t AS SELECT n_nationkey, n_name, n_regionkey FROM nation; UPDATE t SET n_name = lower(n_name) WHERE n_regionkey = 1; DELETE FROM t WHERE n_regionkey = 2; SELECT * FROM t", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN lower(n_name) ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_regionkey <> 2")
_script("views", ("nation",), "CREATE TABLE t AS SELECT * FROM nation; CREATE VIEW v (k, name) AS SELECT n_nationkey, n_name FROM t WHERE n_regionkey = 3; SELECT * FROM v", "SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_regionkey = 3")
_script("session_variables", ("orders",), "SET (low, high) = (100000, 200000); SET status = 'F'; SELECT count(*) AS n FROM orders WHERE o_totalprice BETWEEN $low AND $high AND o_orderstatus = $status", "SELECT count(*) AS n FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000 AND o_orderstatus = 'F'")
_script("describe_table", (), "CREATE TABLE t (a INT, b VARCHAR NOT NULL, c NUMBER(12, 3), d TIMESTAMP_NTZ, e DATE, f BOOLEAN, g VARIANT); SELECT column_name, data_type FROM information_schema.columns WHERE table_name = 't' AND table_schema = current_schema()", "SELECT * FROM (VALUES ('a', 'NUMBER(38,0)'), ('b', 'VARCHAR'), ('c', 'NUMBER(12,3)'), ('d', 'TIMESTAMP_NTZ'), ('e', 'DATE'), ('f', 'BOOLEAN'), ('g', 'VARCHAR')) t(column_name, data_type)")


def _base(spark: SparkSession) -> str:
    """The folder that all executors share; /tmp on a single machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return (base or "file:///tmp").rstrip("/")


def _files(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    """Unloads a query to files and copies them back."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        schema = f"q_{uuid.uuid4().hex[:12]}"
        url = f"{_base(spark)}/tarn-{schema}"
        s = Session(spark)
        s.attach(sf_dir, ("supplier",))
        extra = " parse_header = true" if kind == "csv" else ""
        header = " header = true" if kind == "csv" else ""
        return s.execute(
            f"""CREATE SCHEMA {schema}; USE SCHEMA {schema};
                COPY INTO '{url}' FROM (SELECT s_suppkey, s_name, s_acctbal FROM supplier) file_format = (type = {kind}){header};
                CREATE TABLE t (s_suppkey INT, s_name VARCHAR, s_acctbal DOUBLE);
                COPY INTO t FROM '{url}' file_format = (type = {kind}{extra});
                SELECT s_suppkey, s_name, s_acctbal FROM t"""
        )

    return run


for _kind in ("csv", "json", "parquet", "orc"):
    CALLABLES[f"copy_{_kind}"] = _files(_kind)
    ORACLES[f"copy_{_kind}"] = "SELECT s_suppkey, s_name, s_acctbal FROM supplier"


_script(
    "show_and_result_scan",
    ("nation",),
    """CREATE TABLE t1 AS SELECT * FROM nation; CREATE TABLE other (a INT); CREATE VIEW v1 AS SELECT n_name FROM t1;
       SHOW TABLES LIKE 't%'; SELECT name, kind FROM TABLE(RESULT_SCAN(LAST_QUERY_ID()))""",
    "SELECT 't1' AS name, 'TABLE' AS kind",
)
_script("show_views", ("nation",), "CREATE TABLE t1 AS SELECT * FROM nation; CREATE VIEW v1 AS SELECT n_name FROM t1; SHOW VIEWS; SELECT name, kind FROM TABLE(RESULT_SCAN(LAST_QUERY_ID()))", "SELECT 'v1' AS name, 'VIEW' AS kind")
_script("show_objects", ("nation",), "CREATE TABLE t1 AS SELECT * FROM nation; CREATE VIEW v1 AS SELECT n_name FROM t1; SHOW OBJECTS; SELECT name, kind FROM TABLE(RESULT_SCAN(LAST_QUERY_ID()))", "SELECT 't1' AS name, 'TABLE' AS kind UNION ALL SELECT 'v1', 'VIEW'")
_script("show_columns", (), "CREATE TABLE t (a INT, b VARCHAR NOT NULL, c NUMBER(8, 2)); SHOW COLUMNS IN TABLE t; SELECT column_name, data_type FROM TABLE(RESULT_SCAN(LAST_QUERY_ID())) WHERE schema_name = current_schema()", "SELECT * FROM (VALUES ('a', 'NUMBER(38,0)'), ('b', 'VARCHAR'), ('c', 'NUMBER(8,2)')) t(column_name, data_type)")
_script("show_schemas_databases", (), "SHOW DATABASES LIKE 'main'; SHOW SCHEMAS STARTS WITH 'information'; SELECT s.name AS schema_name, d.name AS database_name FROM TABLE(RESULT_SCAN(LAST_QUERY_ID())) s CROSS JOIN TABLE(RESULT_SCAN(LAST_QUERY_ID(-2))) d", "SELECT 'information_schema' AS schema_name, 'main' AS database_name")
_script("show_variables_parameters", (), "SET low = 5; SET name = 'x'; ALTER SESSION SET week_start = 1; SHOW VARIABLES; SHOW PARAMETERS LIKE 'WEEK_START'; SELECT v.name, v.value, p.value AS week_start FROM TABLE(RESULT_SCAN(LAST_QUERY_ID(-2))) v CROSS JOIN TABLE(RESULT_SCAN(LAST_QUERY_ID(-1))) p", "SELECT * FROM (VALUES ('LOW', '5', '1'), ('NAME', 'x', '1')) t(name, value, week_start)")
_script("describe_statement", (), "CREATE TABLE t (a INT, b VARCHAR, c DATE, d DOUBLE, e TIMESTAMP_NTZ); DESCRIBE TABLE t; SELECT name, type FROM TABLE(RESULT_SCAN(LAST_QUERY_ID()))", "SELECT * FROM (VALUES ('a', 'NUMBER(38,0)'), ('b', 'VARCHAR'), ('c', 'DATE'), ('d', 'FLOAT'), ('e', 'TIMESTAMP_NTZ')) t(name, type)")
_script("schema_tables", ("nation",), "CREATE TABLE t AS SELECT * FROM nation; CREATE VIEW v AS SELECT * FROM t; SELECT table_name, table_type FROM information_schema.tables WHERE table_schema = current_schema()", "SELECT 't' AS table_name, 'BASE TABLE' AS table_type UNION ALL SELECT 'v', 'VIEW'")
_script("schema_views", ("nation",), "CREATE TABLE t AS SELECT * FROM nation; CREATE VIEW v AS SELECT n_name FROM t; SELECT table_name, upper(definition) LIKE '%N_NAME%' AS told FROM information_schema.views WHERE table_schema = current_schema()", "SELECT 'v' AS table_name, true AS told")
_script("schema_schemata", (), "SELECT count(*) AS n, max(schema_name = current_schema()) AS mine FROM information_schema.schemata WHERE schema_name IN (current_schema(), 'information_schema')", "SELECT 2::BIGINT AS n, true AS mine")
_script("schema_databases", (), "CREATE DATABASE IF NOT EXISTS main; SELECT database_name, database_type FROM information_schema.databases WHERE database_name = 'main'", "SELECT 'main' AS database_name, 'STANDARD' AS database_type")
_script("schema_settings", (), "ALTER SESSION SET query_tag = 'a tag'; SELECT name, value FROM information_schema.df_settings WHERE name = 'query_tag'", "SELECT 'query_tag' AS name, 'a tag' AS value")
_script("schema_routines", (), "SELECT specific_name, routine_type FROM information_schema.routines WHERE specific_name IN ('iff', 'array_agg', 'no_such_function')", "SELECT * FROM (VALUES ('iff', 'FUNCTION'), ('array_agg', 'FUNCTION')) t(specific_name, routine_type)")
_script("schema_parameters", (), "SELECT count(*) AS n FROM information_schema.parameters", "SELECT 0::BIGINT AS n")
_script("schema_navigation_tree", ("region",), 'CREATE TABLE t AS SELECT * FROM region; SELECT "table" AS name, table_type FROM information_schema.navigation_tree WHERE "schema" = current_schema()', "SELECT 't' AS name, 'TABLE' AS table_type")
_script("drop_and_recreate", ("region",), "CREATE TABLE t AS SELECT * FROM region; DROP TABLE t; DROP TABLE IF EXISTS t; CREATE TABLE IF NOT EXISTS t AS SELECT r_name FROM region; CREATE TABLE IF NOT EXISTS t AS SELECT 1 AS x; SELECT * FROM t", "SELECT r_name FROM region")
_script("drop_view", ("region",), "CREATE TABLE t AS SELECT * FROM region; CREATE VIEW v AS SELECT * FROM t; DROP VIEW v; SELECT count(*) AS n FROM information_schema.views WHERE table_schema = current_schema()", "SELECT 0::BIGINT AS n")
_script("alter_table", ("region",), "CREATE TABLE t AS SELECT * FROM region; ALTER TABLE t ADD COLUMN n NUMBER(10, 2); ALTER TABLE t RENAME COLUMN r_name TO name; ALTER TABLE t RENAME TO w; UPDATE w SET n = r_regionkey + 0.5; SELECT r_regionkey, name, cast(n AS double) AS n FROM w", "SELECT r_regionkey, r_name AS name, r_regionkey + 0.5::DOUBLE AS n FROM region")
_script("alter_table_columns", ("region",), "CREATE TABLE a AS SELECT * FROM region; CREATE TABLE b AS SELECT 1 AS x; ALTER TABLE a DROP COLUMN r_regionkey; ALTER TABLE a SWAP WITH b; SELECT * FROM b", "SELECT r_name FROM region")
_script("use_and_context", (), "CREATE DATABASE IF NOT EXISTS side; CREATE SCHEMA IF NOT EXISTS side.inner_one; USE DATABASE side; USE SCHEMA inner_one; USE WAREHOUSE big; USE ROLE reader; SELECT current_database() AS a, current_schema() AS b, current_warehouse() AS c, current_role() AS d", "SELECT 'side' AS a, 'inner_one' AS b, 'big' AS c, 'reader' AS d")
_script("names_in_three_parts", ("region",), "CREATE DATABASE IF NOT EXISTS side; CREATE SCHEMA IF NOT EXISTS side.three; CREATE OR REPLACE TABLE side.three.t AS SELECT * FROM region; SELECT * FROM side.three.t", "SELECT * FROM region")
_script("transactions", ("region",), "CREATE TABLE t AS SELECT * FROM region; BEGIN; DELETE FROM t WHERE r_regionkey = 0; COMMIT; ROLLBACK; SELECT count(*) AS n FROM t", "SELECT 4::BIGINT AS n")
_script("external_volume", (), "CREATE EXTERNAL VOLUME IF NOT EXISTS vol STORAGE_PROVIDER = 'MEMORY'; CREATE DATABASE IF NOT EXISTS on_vol EXTERNAL_VOLUME = vol; SHOW DATABASES LIKE 'on_vol'; SELECT name FROM TABLE(RESULT_SCAN(LAST_QUERY_ID()))", "SELECT 'on_vol' AS name")
_script("cancel_query", (), "SELECT system$cancel_query('none') AS a", "SELECT 'query [none] terminated.' AS a")
_script("explain_plans", ("region",), "EXPLAIN SELECT * FROM region; SELECT plan_type, length(plan) > 0 AS told FROM TABLE(RESULT_SCAN(LAST_QUERY_ID()))", "SELECT 'logical_plan' AS plan_type, true AS told UNION ALL SELECT 'physical_plan', true")
_script("clone_and_like", ("region",), "CREATE TABLE t AS SELECT * FROM region; CREATE TABLE c CLONE t; CREATE TABLE l LIKE t; SELECT r_regionkey, r_name FROM c UNION ALL SELECT r_regionkey, r_name FROM l", "SELECT r_regionkey, r_name FROM region")
_script("merge_insert_delete", ("nation",), """CREATE TABLE t AS SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_nationkey < 15;
    MERGE INTO t USING (SELECT n_nationkey AS k, n_name AS name, n_regionkey AS r FROM nation WHERE n_nationkey > 4) s ON t.k = s.k AND s.k > 4
      WHEN MATCHED AND s.r = 0 THEN DELETE WHEN MATCHED AND s.r = 1 THEN UPDATE SET name = concat(s.name, '!') WHEN NOT MATCHED AND s.r < 3 THEN INSERT (k) VALUES (s.k);
    SELECT k, name FROM t""", """SELECT n_nationkey AS k, CASE WHEN n_nationkey >= 15 THEN NULL WHEN n_nationkey > 4 AND n_regionkey = 1 THEN n_name || '!' ELSE n_name END AS name FROM nation
    WHERE n_nationkey <= 4 OR (n_nationkey < 15 AND n_regionkey <> 0) OR (n_nationkey >= 15 AND n_regionkey < 3)""")
_script("merge_table_source", ("region",), "CREATE TABLE t AS SELECT r_regionkey AS k, r_name AS v FROM region WHERE r_regionkey < 3; CREATE TABLE s AS SELECT r_regionkey AS k, lower(r_name) AS v FROM region; MERGE INTO t USING s ON t.k = s.k WHEN MATCHED THEN UPDATE SET t.v = s.v WHEN NOT MATCHED THEN INSERT VALUES (s.k, s.v); SELECT k, v FROM t", "SELECT r_regionkey AS k, lower(r_name) AS v FROM region")


def _staged(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    """Files of a stage as a relation, as the source of a COPY, or as an external table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        schema = f"q_{uuid.uuid4().hex[:12]}"
        url = f"{_base(spark)}/tarn-{schema}"
        s = Session(spark)
        s.attach(sf_dir, ("supplier",))
        s.execute(f"CREATE SCHEMA {schema}; USE SCHEMA {schema}; COPY INTO '{url}' FROM (SELECT s_suppkey, s_name FROM supplier) file_format = (type = parquet)")
        stage = f"CREATE STAGE st_{schema} URL = '{url}' FILE_FORMAT = (TYPE = parquet); "
        return s.execute({
            "relation": f"{stage} SELECT s_suppkey, s_name FROM @st_{schema}",
            "copy": f"{stage} CREATE TABLE t (s_suppkey INT, s_name VARCHAR); COPY INTO t FROM @st_{schema}; SELECT s_suppkey, s_name FROM t",
            "external": f"CREATE EXTERNAL TABLE t WITH LOCATION = '{url}' FILE_FORMAT = (TYPE = parquet); SELECT s_suppkey, s_name FROM t",
        }[kind])

    return run


for _kind in ("relation", "copy", "external"):
    CALLABLES[f"stage_{_kind}"] = _staged(_kind)
    ORACLES[f"stage_{_kind}"] = "SELECT s_suppkey, s_name FROM supplier"


def _uploaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A client's CSV made a table, then added to."""
    s = Session(spark)
    schema = f"q_{uuid.uuid4().hex[:12]}"
    s.execute(f"CREATE SCHEMA {schema}; USE SCHEMA {schema}")
    s.upload("t", b"a,b\n1,x\n2,y\n")
    s.upload("t", b"a,b\n3,z\n")
    return s.execute("SELECT cast(a AS bigint) AS a, b FROM t")


CALLABLES["upload_csv"] = _uploaded
ORACLES["upload_csv"] = "SELECT * FROM (VALUES (1::BIGINT, 'x'), (2::BIGINT, 'y'), (3::BIGINT, 'z')) t(a, b)"
