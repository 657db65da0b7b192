"""Date and time functions.

``datediff`` counts boundaries crossed, as ``date_trunc`` sees them, and weeks
begin on Monday unless the session's week_start says Sunday. ``dayofyear``
counts from 1, as the dialect's documentation has it and as ``date_part`` does
(its engine of record counts from 0 in the one and not in the other).
"""

from tarn.functions.registry import ArgumentError, constant, register, renamed, same, templates

PARTS = {
    "year": "year years y yy yyy yyyy yr yrs",
    "quarter": "quarter quarters q qtr qtrs",
    "month": "month months mm mon mons",
    "week": "week weeks w wk weekofyear woy wy",
    "day": "day days d dd dayofmonth",
    "hour": "hour hours h hh hr hrs",
    "minute": "minute minutes m mi min mins",
    "second": "second seconds s sec secs",
    "millisecond": "millisecond milliseconds ms msec",
    "microsecond": "microsecond microseconds us usec",
    "nanosecond": "nanosecond nanoseconds ns nsec nanosec",
}
_PART = {alias: part for part, names in PARTS.items() for alias in names.split()}
_MICROS = {"week": 604800000000, "day": 86400000000, "hour": 3600000000, "minute": 60000000, "second": 1000000, "millisecond": 1000, "microsecond": 1}


def part_of(arg: str) -> str:
    name = constant(arg).lower()
    if name not in _PART:
        raise ArgumentError(f"unknown date part {name}")
    return _PART[name]


def _datediff(args: list[str]) -> str:
    part, a, b = part_of(args[0]), args[1], args[2]
    if part == "nanosecond":
        return f"1000 * ({_datediff(['microsecond', a, b])})"
    months = f"(12 * (year({b}) - year({a})) + month({b}) - month({a}))"
    if part == "year":
        return f"(year({b}) - year({a}))"
    if part == "quarter":
        return f"(4 * (year({b}) - year({a})) + quarter({b}) - quarter({a}))"
    if part == "month":
        return months
    if part == "day":
        return f"date_diff(cast({b} as date), cast({a} as date))"
    if part == "week":
        return f"(date_diff(cast(date_trunc('week', {b}) as date), cast(date_trunc('week', {a}) as date)) div 7)"
    width = _MICROS[part]
    micros = "unix_micros(cast(date_trunc('{p}', {x}) as timestamp))"
    one, two = (micros.format(p=part, x=x) for x in (a, b))
    return f"(({two} - {one}) div {width})"


def _dateadd(args: list[str]) -> str:
    part, n, x = part_of(args[0]), args[1], args[2]
    if part == "nanosecond":
        part, n = "microsecond", f"cast(({n}) div 1000 as int)"
    # Sums with whole days, months or years keep a date a date.
    unit = {"year": ("YEAR", 1), "quarter": ("MONTH", 3), "month": ("MONTH", 1), "week": ("DAY", 7), "day": ("DAY", 1)}.get(part)
    if unit is None or x.strip().startswith("'"):
        return f"timestampadd({part.upper()}, cast({n} as int), {x})"
    times = f" * {unit[1]}" if unit[1] > 1 else ""
    return f"({x} + cast(cast({n} as int){times} as interval {unit[0]}))"


def _date_trunc(args: list[str]) -> str:
    part, x = args
    if part.strip()[:1] != "'" and constant(part).lower() not in _PART:
        part, x = x, part
    return f"date_trunc('{part_of(part)}', {x})"


_EXTRA_PARTS = {
    "dayofweek": "(dayofweek({0}) - 1)", "dow": "(dayofweek({0}) - 1)", "weekday": "(dayofweek({0}) - 1)", "dw": "(dayofweek({0}) - 1)",
    "dayofweekiso": "(weekday({0}) + 1)", "dayofweek_iso": "(weekday({0}) + 1)", "isodow": "(weekday({0}) + 1)",
    "dayofyear": "dayofyear({0})", "doy": "dayofyear({0})", "yearday": "dayofyear({0})", "dy": "dayofyear({0})",
    "weekiso": "weekofyear({0})", "week_iso": "weekofyear({0})", "yearofweek": "extract(YEAROFWEEK FROM {0})", "yearofweekiso": "extract(YEAROFWEEK FROM {0})",
    "epoch": "unix_seconds(cast({0} as timestamp))", "epoch_second": "unix_seconds(cast({0} as timestamp))", "epoch_seconds": "unix_seconds(cast({0} as timestamp))",
    "epoch_millisecond": "unix_millis(cast({0} as timestamp))", "epoch_milliseconds": "unix_millis(cast({0} as timestamp))",
    "epoch_microsecond": "unix_micros(cast({0} as timestamp))", "epoch_microseconds": "unix_micros(cast({0} as timestamp))",
}


def _date_part(args: list[str]) -> str:
    name = constant(args[0]).lower()
    if name in _EXTRA_PARTS:
        return _EXTRA_PARTS[name].replace("{0}", args[1])
    part = part_of(args[0])
    if part == "millisecond":
        return f"cast(extract(SECOND FROM {args[1]}) * 1000 as bigint)"
    if part in ("microsecond", "nanosecond"):
        return f"cast(extract(SECOND FROM {args[1]}) * {1000000 if part == 'microsecond' else 1000000000} as bigint)"
    return f"cast(date_part('{part}', {args[1]}) as bigint)"


def _last_day(args: list[str]) -> str:
    x, part = args[0], part_of(args[1]) if len(args) > 1 else "month"
    if part == "month":
        return f"last_day({x})"
    if part == "week":
        return f"date_add(cast(date_trunc('week', {x}) as date), 6)"
    if part not in ("quarter", "year"):
        raise ArgumentError(f"last_day doesn't take the part {part}")
    return f"date_sub(add_months(cast(date_trunc('{part}', {x}) as date), {12 if part == 'year' else 3}), 1)"


register("datediff date_diff timediff time_diff timestampdiff timestamp_diff", _datediff)
register("dateadd date_add timeadd time_add timestampadd timestamp_add", _dateadd)
register("date_trunc datetrunc", _date_trunc)
register("date_part datepart", _date_part)
register("last_day", _last_day)
same("current_date current_timestamp from_unixtime make_date hour minute second quarter month year day dayofmonth weekofyear to_unix_timestamp")
renamed(now="current_timestamp", today="current_date", getdate="current_timestamp", week="weekofyear", weekiso="weekofyear", localtimestamp="localtimestamp")
templates("current_time", _0="current_time()", _1="current_time({0})")
templates("add_months", _2="add_months({0}, cast(round({1}) as int))")
templates("convert_timezone", _2="convert_timezone({0}, cast({1} as timestamp_ntz))", _3="convert_timezone({0}, {1}, cast({2} as timestamp_ntz))")
templates("date_from_parts datefromparts", _3="date_add(add_months(make_date({0}, 1, 1), cast({1} as int) - 1), cast({2} as int) - 1)")
templates("dayname", _1="date_format({0}, 'E')")
templates("monthname", _1="date_format({0}, 'MMM')")
templates("dayofweek", _1="(dayofweek({0}) - 1)")
templates("dayofweekiso", _1="(weekday({0}) + 1)")
templates("dayofyear", _1="dayofyear({0})")
templates("yearofweek yearofweekiso", _1="extract(YEAROFWEEK FROM {0})")
templates("next_day", _2="next_day(cast({0} as date), substr({1}, 1, 2))")
templates("previous_day", _2="next_day(date_sub(cast({0} as date), 8), substr({1}, 1, 2))")
_OF_DAY = "(timestamp_ntz '1970-01-01 00:00:00' + make_dt_interval(0, cast({0} as int), cast({1} as int), cast({2} as decimal(18, 6))))"
templates("time_from_parts timefromparts", _3=f"date_format({_OF_DAY}, 'HH:mm:ss')", _4=f"date_format({_OF_DAY} + make_dt_interval(0, 0, 0, cast({{3}} / 1000000000 as decimal(18, 6))), 'HH:mm:ss.SSSSSS')")
_DAY = "cast(date_add(add_months(make_date({0}, 1, 1), cast({1} as int) - 1), cast({2} as int) - 1) as timestamp_ntz)"
_FULL = f"({_DAY} + make_dt_interval(0, cast({{3}} as int), cast({{4}} as int), cast({{5}} as decimal(18, 6))))"
_NANO = f"({_FULL} + make_dt_interval(0, 0, 0, cast({{6}} / 1000000000 as decimal(18, 6))))"
_JOINED = "(cast({0} as timestamp_ntz) + (cast(concat('1970-01-01 ', {1}) as timestamp_ntz) - timestamp_ntz '1970-01-01 00:00:00'))"
templates("timestamp_from_parts timestampfromparts timestamp_ntz_from_parts timestampntzfromparts", _2=_JOINED, _6=_FULL, _7=_NANO)
templates("timestamp_ltz_from_parts timestampltzfromparts timestamp_tz_from_parts timestamptzfromparts", _6=f"cast({_FULL} as timestamp)", _7=f"cast({_NANO} as timestamp)", _8=f"to_utc_timestamp({_NANO}, {{7}})")
#: strftime letters (fixed values) and their Java patterns.
_STRFTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%y": "yy", "%b": "MMM", "%B": "MMMM", "%a": "E", "%A": "EEEE", "%j": "DDD", "%I": "hh", "%p": "a"}


def _date_format(args: list[str]) -> str:
    pattern = args[1]
    for a, b in _STRFTIME.items():
        pattern = pattern.replace(a, b)
    return f"date_format({args[0]}, {pattern})"


register("date_format", _date_format)


def _bin(x: str, n: int, part: str, origin: str | None = None, *, ends: bool = False) -> str:
    """Where the bin of n parts that holds a time begins, or ends; bins are counted
    from the origin, or from 1970."""
    months = n * {"month": 1, "quarter": 3, "year": 12}.get(part, 0)
    shift = " + 1" if ends else ""
    if months:
        since = f"(12 * (year({x}) - 1970) + month({x}) - 1)"
        return f"cast(add_months(date '1970-01-01', {months} * (cast(floor({since} / {months}) as int){shift})) as timestamp)"
    width = n * _MICROS[part]
    micros = f"unix_micros(cast({x} as timestamp))"
    from_origin = micros if origin is None else f"({micros} - unix_micros(cast({origin} as timestamp)))"
    return f"timestamp_micros({micros} - pmod({from_origin}, {width}L){f' + {width}L' if ends else ''})"


def _date_bin(args: list[str]) -> str:
    count, name = constant(args[0].strip().removeprefix("INTERVAL").strip()).split()
    return _bin(args[1], int(count), part_of(name), args[2] if len(args) > 2 else None)


def _time_slice(args: list[str]) -> str:
    return _bin(args[0], int(args[1]), part_of(args[2]), ends=len(args) > 3 and constant(args[3]).lower() == "end")


register("date_bin", _date_bin)
register("time_slice", _time_slice)
