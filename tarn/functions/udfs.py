"""Functions that no built-in expression gives, as Arrow-batched pandas UDFs."""

from __future__ import annotations

import ipaddress
import json
import re
import time

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parse_ip(text: str | None, kind: str | None, permissive: bool) -> str | None:
    """JSON text that describes an address, with its network when it has a prefix."""
    if text is None or kind is None:
        return None
    try:
        if kind.upper() != "INET":
            raise ValueError(f"unknown kind {kind}")
        face = ipaddress.ip_interface(text)
    except ValueError as e:
        if permissive:
            return json.dumps({"error": str(e)})
        raise
    v4, ip = face.version == 4, face.ip
    out: dict = {"family": face.version, "host": str(ip), "ip_fields": [int(ip), 0, 0, 0] if v4 else [int(ip) >> s & 0xFFFFFFFF for s in (96, 64, 32, 0)], "ip_type": "inet"}
    out["netmask_prefix_length"] = face.network.prefixlen if "/" in text else None
    # A fixed value of the dialect's format.
    out["snowflake$type"] = "ip_address"
    if v4:
        out["ipv4"] = int(ip)
    else:
        out["hex_ipv6"] = f"{int(ip):032X}"
    if "/" in text:
        first, last = face.network[0], face.network[-1]
        names = ("ipv4_range_start", "ipv4_range_end") if v4 else ("hex_ipv6_range_start", "hex_ipv6_range_end")
        out |= dict(zip(names, (int(first), int(last)) if v4 else (f"{int(first):032X}", f"{int(last):032X}")))
    return json.dumps(out)


def jaro_winkler(a: str | None, b: str | None) -> int | None:
    """Percent of likeness, whatever the case; 0 if either is empty."""
    if a is None or b is None:
        return None
    a, b = a.lower(), b.lower()
    if not a or not b:
        return 0
    reach = max(len(a), len(b)) // 2 - 1
    hit_a, hit_b = [False] * len(a), [False] * len(b)
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not hit_b[j] and b[j] == c:
                hit_a[i] = hit_b[j] = True
                break
    m = sum(hit_a)
    if not m:
        return 0
    swapped = sum(x != y for x, y in zip((c for c, h in zip(a, hit_a) if h), (c for c, h in zip(b, hit_b) if h))) / 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return int(100 * (jaro + 0.1 * prefix * (1 - jaro)) + 1e-9)


def replace_nth(text, pattern, new, start, nth):
    if text is None or pattern is None or new is None:
        return None
    found = list(re.finditer(pattern, text[start - 1 :]))
    if len(found) < nth:
        return text
    m = found[nth - 1]
    return text[: start - 1 + m.start()] + m.expand(re.sub(r"\$(\d)", r"\\\1", new)) + text[start - 1 + m.end() :]


def instr(text, pattern, start, nth, after, group):
    if text is None or pattern is None:
        return None
    found = list(re.finditer(pattern, text[start - 1 :]))
    if len(found) < nth:
        return 0
    m = found[nth - 1]
    return start + (m.end(group) if after else m.start(group))


def _vector(f, kind: T.DataType):
    def run(*cols: pd.Series) -> pd.Series:
        return pd.Series([f(*[None if x is None or x is pd.NA else x for x in row]) for row in zip(*cols)], dtype="object")

    return F.pandas_udf(run, kind)


def _int(x):
    return int(x)


def install(spark: SparkSession) -> None:
    """Registers the functions with a session, once."""
    if spark.conf.get("tarn.udfs", "") == "on":
        return
    reg = spark.udf.register
    reg("tarn_parse_ip", _vector(lambda t, k, p: parse_ip(t, k, bool(p)), T.StringType()))
    reg("tarn_jaro_winkler", _vector(jaro_winkler, T.LongType()))
    reg("tarn_regexp_replace_nth", _vector(lambda t, p, n, s, k: replace_nth(t, p, n, _int(s), _int(k)), T.StringType()))
    reg("tarn_regexp_instr", _vector(lambda t, p, s, k, o, g: instr(t, p, _int(s), _int(k), _int(o), _int(g)), T.LongType()))
    reg("tarn_sleep", _vector(lambda s: time.sleep(s) or s, T.DoubleType()))
    from tarn.operators.flatten import Flatten

    spark.udtf.register("tarn_flatten", Flatten)
    spark.conf.set("tarn.udfs", "on")
