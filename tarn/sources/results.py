"""Results as a client reads them: JSON rows or an Arrow stream.

Results stream a partition at a time, so the driver holds no more than one."""

from __future__ import annotations

import base64
import datetime
import decimal
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame

from tarn.catalog.information_schema import type_name


def columns(df: DataFrame) -> list[dict[str, object]]:
    """Name, dialect type and nullability of each column."""
    return [{"name": f.name, "type": type_name(f.dataType), "nullable": f.nullable} for f in df.schema]


def _plain(value: object) -> object:
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex().upper()
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat(sep=" ") if isinstance(value, datetime.datetime) else value.isoformat()
    if isinstance(value, (int, float, decimal.Decimal)):
        return str(value)
    return json.dumps(value, default=str)


def json_rows(df: DataFrame) -> Iterator[list]:
    """Rows as lists of texts, the dialect's JSON result form."""
    for row in df.toLocalIterator(prefetchPartitions=True):
        yield [_plain(v) for v in row]


def arrow_base64(df: DataFrame) -> str:
    """The whole result as a base64 Arrow stream; for results a client can hold."""
    import pyarrow as pa

    table = df.toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return base64.b64encode(sink.getvalue().to_pybytes()).decode()
