"""Files as tables: stages, COPY, uploads and unloading."""

from __future__ import annotations

import io

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.dialect.lexer import DialectError

#: File systems a location may name.
SCHEMES = ("s3", "s3a", "gcs", "gs", "file", "memory", "hdfs", "viewfs")


def location(url: str) -> str:
    """A path that Spark reads, of a location of the dialect."""
    scheme, mark, rest = url.partition("://")
    if not mark:
        return url
    scheme = scheme.lower()
    if scheme not in SCHEMES:
        raise DialectError(f"unsupported location {url!r}")
    return {"s3": "s3a", "gcs": "gs"}.get(scheme, scheme) + mark + rest


def read(spark: SparkSession, url: str, options: dict[str, str], schema: T.StructType | None = None) -> DataFrame:
    """The rows of files, by the dialect's file_format options. Without a header
    CSV columns are named column1 and so on."""
    kind, path = options.get("type", "csv").lower(), location(url)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "json":
        return (spark.read.schema(schema) if schema else spark.read).json(path)
    if kind == "orc":
        return spark.read.orc(path)
    if kind != "csv":
        raise DialectError(f"Unsupported file format: {kind}")
    separator = options.get("field_delimiter", ",")
    if len(separator) != 1:
        raise DialectError("field_delimiter is one character")
    header = options.get("parse_header", "false").lower() == "true" or options.get("skip_header", "0") == "1"
    reader = spark.read.option("header", header).option("sep", separator).option("inferSchema", schema is None)
    if quote := options.get("field_optionally_enclosed_by"):
        reader = reader.option("quote", quote)
    df = (reader.schema(schema) if schema else reader).csv(path)
    df = df if header or schema else df.toDF(*[f"column{i + 1}" for i in range(len(df.columns))])
    return df.select(*[F.col(f"`{f.name}`").cast("string").alias(f.name) if isinstance(f.dataType, T.NullType) else F.col(f"`{f.name}`") for f in df.schema])


def fit(df: DataFrame, schema: T.StructType, *, by_name: bool) -> DataFrame:
    """df in the columns and types of a table: values that don't fit are null, as
    are columns that df lacks."""
    have = {c.lower(): c for c in df.columns}
    out = []
    for k, f in enumerate(schema):
        source = have.get(f.name.lower()) if by_name else df.columns[k] if k < len(df.columns) else None
        value = F.lit(None) if source is None else F.col(f"`{source}`")
        same = source is not None and df.schema[source].dataType == f.dataType
        out.append((value if same else value.try_cast(f.dataType)).alias(f.name))
    return df.select(*out)


def upload(spark: SparkSession, data: bytes, options: dict[str, str] | None = None) -> DataFrame:
    """Rows of a small CSV that a client sent; texts and numbers are told apart."""
    options = options or {}
    header = 0 if options.get("parse_header", "true").lower() == "true" else None
    pdf = pd.read_csv(io.BytesIO(data), sep=options.get("field_delimiter", ","), header=header)
    pdf.columns = [str(c) if header == 0 else f"column{i + 1}" for i, c in enumerate(pdf.columns)]
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None)) if len(pdf) else spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in pdf.columns]))


def unload(df: DataFrame, url: str, options: dict[str, str]) -> None:
    """Writes rows as files; the count of files follows the count of partitions."""
    kind = options.get("type", "csv").lower()
    writer = df.write.mode("overwrite" if options.get("overwrite", "false").lower() == "true" else "errorifexists")
    path = location(url)
    if kind == "csv":
        writer.option("header", options.get("header", "false")).option("sep", options.get("field_delimiter", ",")).csv(path)
    elif kind in ("parquet", "json", "orc"):
        getattr(writer, kind)(path)
    else:
        raise DialectError(f"Unsupported file format: {kind}")
