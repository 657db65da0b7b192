"""The information schema, as DataFrames over the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tarn.functions import FUNCTIONS

_S, _L = T.StringType(), T.LongType()


def type_name(t: T.DataType) -> str:
    """The dialect's name of a Spark type."""
    if isinstance(t, T.DecimalType):
        return f"NUMBER({t.precision},{t.scale})"
    names = {T.LongType: "NUMBER(38,0)", T.IntegerType: "NUMBER(38,0)", T.ShortType: "NUMBER(38,0)", T.ByteType: "NUMBER(38,0)", T.DoubleType: "FLOAT", T.FloatType: "FLOAT", T.StringType: "VARCHAR", T.BinaryType: "BINARY", T.BooleanType: "BOOLEAN", T.DateType: "DATE", T.TimestampNTZType: "TIMESTAMP_NTZ", T.TimestampType: "TIMESTAMP_LTZ", T.ArrayType: "ARRAY", T.MapType: "MAP", T.StructType: "OBJECT"}
    return names.get(type(t), t.simpleString().upper())


def frame(session, name: str, database: str) -> DataFrame | None:
    """The view `name` of a database, or None if there is no such view."""
    build = {"tables": _tables, "views": _views, "columns": _columns, "schemata": _schemata, "databases": _databases, "df_settings": _settings, "routines": _routines, "parameters": _parameters, "navigation_tree": _tree}.get(name)
    if build is None:
        return None
    columns, rows = build(session, database)
    kinds = {"ordinal_position": _L, "numeric_precision": _L, "numeric_scale": _L, "datetime_precision": _L}
    schema = T.StructType([T.StructField(c, kinds.get(c, _S)) for c in columns])
    return session.spark.createDataFrame([tuple(r) for r in rows], schema)


def _tables(s, db):
    return ("table_catalog", "table_schema", "table_name", "table_type"), [(d, sc, t, "BASE TABLE" if k == "TABLE" else k) for d, sc, t, k in s.catalog.tables(db)]


def _views(s, db):
    return ("table_catalog", "table_schema", "table_name", "definition"), [(*k, sql) for k, sql in sorted(s.catalog.views.items()) if k[0] == db]


def _columns(s, db):
    names = ("table_catalog", "table_schema", "table_name", "column_name", "ordinal_position", "column_default", "is_nullable", "data_type", "numeric_precision", "numeric_scale", "datetime_precision")
    rows = []
    for d, sc, t, _ in s.catalog.tables(db):
        for k, f in enumerate(s.read_table((d, sc, t)).schema):
            number = isinstance(f.dataType, T.DecimalType)
            rows.append((d, sc, t, f.name, k, None, "YES" if f.nullable else "NO", type_name(f.dataType), f.dataType.precision if number else None, f.dataType.scale if number else None, 6 if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)) else None))
    return names, rows


def _schemata(s, db):
    return ("catalog_name", "schema_name", "schema_owner"), [(d, sc, None) for d, sc in s.catalog.schemas(db)] + [(db, "information_schema", None)]


def _databases(s, db):
    return ("database_name", "database_owner", "database_type"), [(d, None, "STANDARD") for d in sorted(s.catalog.databases)]


def _settings(s, db):
    return ("name", "value", "description"), [(k, v, None) for k, v in sorted(s.settings.items())]


def _routines(s, db):
    return ("specific_catalog", "specific_schema", "specific_name", "routine_type"), [(db, "information_schema", n, "FUNCTION") for n in sorted(FUNCTIONS)]


def _parameters(s, db):
    return ("specific_catalog", "specific_schema", "specific_name", "ordinal_position", "parameter_name", "data_type"), []


def _tree(s, db):
    rows = [(d, sc, t, k) for d, sc, t, k in s.catalog.tables()]
    seen = {r[:2] for r in rows}
    rows += [(d, sc, None, None) for d, sc in s.catalog.schemas() if (d, sc) not in seen]
    return ("database", "schema", "table", "table_type"), sorted(rows, key=lambda r: tuple(x or "" for x in r))
