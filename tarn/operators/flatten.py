"""FLATTEN: the elements of a JSON array or object as rows."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql.functions import udtf

COLUMNS = "seq bigint, key string, path string, index bigint, value string, this string"
_STEP = re.compile(r"""\.?([^.\[\]'"]+)|\[(\d+)\]|\[(?:'([^']*)'|"([^"]*)")\]""")


def steps(path: str) -> list[str | int]:
    """Keys and positions of a path such as ``a.b[0]['k']``."""
    out: list[str | int] = []
    at = 0
    while at < len(path):
        m = _STEP.match(path, at)
        if not m:
            raise ValueError(f"invalid path {path!r}")
        out.append(int(m[2]) if m[2] is not None else next(g for g in (m[1], m[3], m[4]) if g is not None))
        at = m.end()
    return out


def _text(value) -> str | None:
    return None if value is None else json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def _walk(this, path: str, recursive: bool, mode: str) -> Iterator[tuple]:
    if isinstance(this, list) and mode != "OBJECT":
        rows = [(None, f"{path}[{i}]", i, v) for i, v in enumerate(this)]
    elif isinstance(this, dict) and mode != "ARRAY":
        rows = [(k, f"{path}.{k}" if path else k, None, v) for k, v in this.items()]
    else:
        rows = []
    for key, where, index, value in rows:
        yield key, where, index, _text(value), _text(this)
        if recursive and isinstance(value, (list, dict)):
            yield from _walk(value, where, recursive, mode)


def flatten_rows(text: str | None, path: str | None = None, outer: bool = False, recursive: bool = False, mode: str = "BOTH") -> Iterator[tuple]:
    """(key, path, index, value, this) of each element, depth first; with outer
    one row of nulls where there is none."""
    found = False
    try:
        this = json.loads(text) if text is not None else None
        for s in steps(path or ""):
            this = this[s] if isinstance(this, list) == isinstance(s, int) else None
    except (ValueError, KeyError, IndexError, TypeError):
        this = None
    for row in _walk(this, path or "", recursive, (mode or "BOTH").upper()):
        found = True
        yield row
    if outer and not found:
        yield None, path or "", None, None, _text(this)


class _Flatten:
    def __init__(self) -> None:
        self._seq = 0

    def eval(self, text: str, path: str, outer: bool, recursive: bool, mode: str):
        self._seq += 1
        for row in flatten_rows(text, path, bool(outer), bool(recursive), mode):
            yield self._seq, *row


Flatten = udtf(_Flatten, returnType=COLUMNS)
