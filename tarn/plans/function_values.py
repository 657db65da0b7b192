"""Queries of the values of single functions: a dialect expression for each name,
and the same in DuckDB's SQL. Columns vary by row, so constants can't stand in."""

from tarn.plans.relational import add


def _values(name: str, table: str, key: str, pairs: list[tuple[str, str]], where: str = "") -> None:
    """One query of many expressions, columns c0, c1 and so on."""
    sides = [", ".join([key, *(f"{p[side]} AS c{i}" for i, p in enumerate(pairs))]) for side in (0, 1)]
    add(name, *(f"SELECT {s} FROM {table}{where}" for s in sides))


_D = "o_orderdate"
_AT = "(o_orderdate + INTERVAL 1 HOUR * (o_orderkey % 24) + INTERVAL 1 SECOND * (o_orderkey % 4000))"
_TS = "dateadd(second, o_orderkey % 4000, dateadd(hour, o_orderkey % 24, o_orderdate))"
_values("values_date_parts", "orders", "o_orderkey", [
    (f"day({_D})", f"CAST(day({_D}) AS INT)"),
    (f"dayofmonth({_D})", f"CAST(day({_D}) AS INT)"),
    (f"month({_D})", f"CAST(month({_D}) AS INT)"),
    (f"week({_D})", f"CAST(weekofyear({_D}) AS INT)"),
    (f"weekofyear({_D})", f"CAST(weekofyear({_D}) AS INT)"),
    (f"yearofweek({_D})", f"CAST(isoyear({_D}) AS INT)"),
    (f"minute({_TS})", f"CAST(minute({_AT}) AS INT)"),
    (f"second({_TS})", f"CAST(second({_AT}) AS INT)"),
    (f"hour({_TS})", f"CAST(hour({_AT}) AS INT)"),
    (f"datepart('dayofyear', {_D})", f"CAST(dayofyear({_D}) AS INT)"),
    (f"date_part('doy', {_D}) - dayofyear({_D})", "0"),
    (f"datepart(month, {_D})", f"CAST(month({_D}) AS BIGINT)"),
    (f"date_part('epoch_millisecond', {_TS})", f"CAST(epoch_ms({_AT}) AS BIGINT)"),
    (f"extract(year FROM {_D})", f"CAST(year({_D}) AS BIGINT)"),
    (f"datetrunc('hour', {_TS})", f"date_trunc('hour', {_AT})"),
    (f"date_trunc('week', {_D})", f"CAST(date_trunc('week', {_D}) AS TIMESTAMP)"),
    (f"datetrunc('quarter', {_D})", f"CAST(date_trunc('quarter', {_D}) AS TIMESTAMP)"),
    (f"last_day({_D}, 'quarter')", f"CAST(date_trunc('quarter', {_D}) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE)"),
    (f"last_day({_D}, week)", f"CAST(date_trunc('week', {_D}) + INTERVAL 6 DAY AS DATE)"),
    (f"date_format({_TS}, '%Y/%m/%d %H-%M-%S')", f"strftime({_AT}, '%Y/%m/%d %H-%M-%S')"),
    (f"date_bin('15 minutes', {_TS})", f"time_bucket(INTERVAL 15 MINUTE, {_AT}, TIMESTAMP '1970-01-01')"),
    (f"date_bin('2 hours', {_TS}, '2001-01-01 01:00:00'::timestamp)", f"time_bucket(INTERVAL 2 HOUR, {_AT}, TIMESTAMP '1970-01-01 01:00:00')"),
    (f"time_slice({_TS}, 4, 'hour')", f"time_bucket(INTERVAL 4 HOUR, {_AT}, TIMESTAMP '1970-01-01')"),
    (f"time_slice({_D}, 5, 'month')", f"CAST(time_bucket(INTERVAL 5 MONTH, {_D}, TIMESTAMP '1970-01-01') AS TIMESTAMP)"),
    (f"time_slice({_D}, 1, 'quarter', 'end')", f"CAST(date_trunc('quarter', {_D}) + INTERVAL 3 MONTH AS TIMESTAMP)"),
])
_values("values_date_sums", "orders", "o_orderkey", [
    (f"add_months(to_date({_D}), 1)", f"CAST({_D}::DATE + INTERVAL 1 MONTH AS DATE)"),
    (f"add_months(to_date({_D}), -13)", f"CAST({_D}::DATE - INTERVAL 13 MONTH AS DATE)"),
    (f"date_add(day, 3, {_D})", f"{_D} + INTERVAL 3 DAY"),
    (f"time_add(hour, 5, {_D})", f"{_D} + INTERVAL 5 HOUR"),
    (f"timeadd('minute', -7, {_D})", f"{_D} - INTERVAL 7 MINUTE"),
    (f"timestamp_add(second, 90, {_D})", f"{_D} + INTERVAL 90 SECOND"),
    (f"timestampadd('year', 2, {_D})", f"{_D} + INTERVAL 2 YEAR"),
    (f"dateadd(week, 2, {_D})", f"{_D} + INTERVAL 14 DAY"),
    (f"dateadd(quarter, -1, {_D})", f"{_D} - INTERVAL 3 MONTH"),
    (f"date_diff(week, {_D}, '1999-01-01'::date)", f"date_diff('day', date_trunc('week', {_D}), date_trunc('week', DATE '1999-01-01')) // 7"),
    (f"time_diff(hour, {_D}, {_TS})", f"date_diff('hour', {_D}, {_AT})"),
    (f"timediff('second', {_D}, {_TS})", f"date_diff('second', {_D}, {_AT})"),
    (f"timestamp_diff(minute, {_D}, {_TS})", f"date_diff('minute', {_D}, {_AT})"),
    (f"timestampdiff('millisecond', {_D}, {_TS})", f"date_diff('millisecond', {_D}, {_AT})"),
    (f"datediff(microsecond, {_D}, {_TS})", f"date_diff('microsecond', {_D}, {_AT})"),
    (f"datefromparts(year({_D}), 2, 30)", f"CAST(make_date(CAST(year({_D}) AS INT), 2, 1) + 29 AS DATE)"),
    (f"make_date(year({_D}), 3, 4)", f"make_date(CAST(year({_D}) AS INT), 3, 4)"),
    ("time_from_parts(o_orderkey % 24, 5, 6)", "format('{:02d}:05:06', o_orderkey % 24)"),
    ("timefromparts(1, o_orderkey % 60, 70)", "strftime(TIMESTAMP '1970-01-01 01:00:00' + INTERVAL 1 MINUTE * (o_orderkey % 60) + INTERVAL 70 SECOND, '%H:%M:%S')"),
    (f"timestamp_from_parts(year({_D}), 14, 1, 25, 0, o_orderkey % 60)", f"make_timestamp(CAST(year({_D}) + 1 AS BIGINT), 2, 2, 1, 0, CAST(o_orderkey % 60 AS DOUBLE))"),
    (f"timestamp_ntz_from_parts(year({_D}), 1, 2, 3, 4, 5, 6000)", f"make_timestamp(year({_D}), 1, 2, 3, 4, 5.000006)"),
    (f"timestampntzfromparts(to_date({_D}), '10:11:12')", f"CAST({_D}::DATE AS TIMESTAMP) + INTERVAL 36672 SECOND"),
    (f"timestamp_ltz_from_parts(year({_D}), 1, 2, 3, 4, 5)", f"make_timestamp(year({_D}), 1, 2, 3, 4, 5.0)"),
    (f"timestampltzfromparts(year({_D}), 1, 2, 3, 4, 5)", f"make_timestamp(year({_D}), 1, 2, 3, 4, 5.0)"),
    (f"timestamp_tz_from_parts(year({_D}), 1, 2, 13, 4, 5, 0, 'Asia/Tokyo')", f"make_timestamp(year({_D}), 1, 2, 4, 4, 5.0)"),
    (f"timestamptzfromparts(year({_D}), 1, 2, 13, 4, 5)", f"make_timestamp(year({_D}), 1, 2, 13, 4, 5.0)"),
    (f"convert_timezone('UTC', 'Asia/Tokyo', {_D})", f"{_D} + INTERVAL 9 HOUR"),
    ("from_unixtime(o_orderkey * 1000)", "strftime(TIMESTAMP '1970-01-01' + INTERVAL 1000 SECOND * o_orderkey, '%Y-%m-%d %H:%M:%S')"),
    ("current_date() = today()", "true"),
    ("now() = current_timestamp()", "true"),
    ("current_time() IS NOT NULL", "true"),
], " WHERE day(o_orderdate) < 28")
_values("values_conversions", "orders", "o_orderkey", [
    ("arrow_cast(o_totalprice, 'Int64')", "CAST(trunc(o_totalprice) AS BIGINT)"),
    ("arrow_typeof(o_orderkey)", "'bigint'"),
    ("system$typeof(o_orderstatus)", "'string'"),
    ("to_array(o_orderstatus)", "'[\"' || o_orderstatus || '\"]'"),
    ("to_array(array_construct(o_orderkey, 'x'))", "'[' || o_orderkey || ',\"x\"]'"),
    ("hex_encode(try_to_binary(iff(o_orderkey % 2 = 0, '4a4B', 'zz')))", "CASE WHEN o_orderkey % 2 = 0 THEN '4A4B' END"),
    ("try_to_char(o_orderkey)", "CAST(o_orderkey AS VARCHAR)"),
    ("try_to_varchar(o_custkey)", "CAST(o_custkey AS VARCHAR)"),
    (f"date(to_varchar({_D}, 'YYYY-MM-DD'))", f"{_D}::DATE"),
    (f"to_date({_D})", f"{_D}::DATE"),
    (f"try_to_date(to_varchar({_D}, 'MM/DD/YYYY'))", f"{_D}::DATE"),
    (f"try_to_date(iff(o_orderkey % 2 = 0, 'x', '2020-02-30'))", "CAST(NULL AS DATE)"),
    ("cast(to_number(concat(o_orderkey, '.6')) AS bigint)", "o_orderkey + 1"),
    ("cast(to_numeric(concat(o_orderkey, '.25'), 20, 2) AS double)", "o_orderkey + 0.25::DOUBLE"),
    ("cast(try_to_decimal(iff(o_orderkey % 2 = 0, concat(o_orderkey, '.5'), 'x'), 20, 1) AS double)", "CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey + 0.5::DOUBLE END"),
    ("cast(try_to_numeric(concat(o_orderkey, 'x')) AS bigint)", "CAST(NULL AS BIGINT)"),
    ("to_object(object_construct('k', o_orderkey))", "'{\"k\":' || o_orderkey || '}'"),
    ("try_to_time(iff(o_orderkey % 2 = 0, '13:14:15', '25:00'))", "CASE WHEN o_orderkey % 2 = 0 THEN '13:14:15' END"),
    ("time(concat(o_orderkey % 24, ':05'))", "format('{:02d}:05:00', o_orderkey % 24)"),
    (f"to_timestamp_ltz(to_varchar({_D}, 'YYYY-MM-DD'))", _D),
    (f"to_timestamp_ntz({_TS})", _AT),
    (f"to_timestamp_tz(concat(to_varchar({_D}, 'YYYY-MM-DD'), ' 01:02:03+01:00'))", f"{_D} + INTERVAL 123 SECOND"),
    ("try_to_timestamp_ltz(concat('x', o_orderkey))", "CAST(NULL AS TIMESTAMP)"),
    ("try_to_timestamp_ntz(1600000000 + o_orderkey)", "TIMESTAMP '1970-01-01' + INTERVAL 1 SECOND * (1600000000 + o_orderkey)"),
    ("try_to_timestamp_tz(iff(o_orderkey % 2 = 0, '2024-02-03 04:05:06', 'no'))", "CASE WHEN o_orderkey % 2 = 0 THEN TIMESTAMP '2024-02-03 04:05:06' END"),
    ("to_timestamp_seconds(o_orderkey)", "TIMESTAMP '1970-01-01' + INTERVAL 1 SECOND * o_orderkey"),
    ("to_timestamp_millis(o_orderkey)", "TIMESTAMP '1970-01-01' + INTERVAL 1 MILLISECOND * o_orderkey"),
    ("to_timestamp_micros(o_orderkey)", "TIMESTAMP '1970-01-01' + INTERVAL 1 MICROSECOND * o_orderkey"),
    ("to_timestamp_nanos(o_orderkey * 1000)", "TIMESTAMP '1970-01-01' + INTERVAL 1 MICROSECOND * o_orderkey"),
    (f"to_unixtime({_TS})", f"CAST(epoch({_AT}) AS BIGINT)"),
    (f"to_local_time({_D})", _D),
    ("to_variant(o_orderkey)", "CAST(o_orderkey AS VARCHAR)"),
    ("to_hex(o_orderkey)", "lower(to_hex(o_orderkey))"),
    ("typeof(to_variant(o_orderkey))", "'INTEGER'"),
])
_X = "((o_orderkey % 19 - 9) / 10.0::double)"
_Y = "(((o_orderkey % 19) - 9) / 10.0::DOUBLE)"
_values("values_numbers", "orders", "o_orderkey", [
    *((f"round({f}({_X}), 9)", f"round({f}({_Y}), 9)") for f in ("acos", "asin", "asinh", "atan", "atanh", "cosh", "exp", "sinh", "tan", "tanh")),
    (f"round(acosh(1 + abs({_X})), 9)", f"round(acosh(1 + abs({_Y})), 9)"),
    (f"round(cot({_X} + 2), 9)", f"round(cot({_Y} + 2), 9)"),
    ("factorial(cast(o_orderkey % 15 AS int))", "CAST(factorial(CAST(o_orderkey % 15 AS INT)) AS BIGINT)"),
    ("isnan(iff(o_orderkey % 2 = 0, 'NaN'::double, 1::double))", "o_orderkey % 2 = 0"),
    ("nanvl(iff(o_orderkey % 2 = 0, 'NaN'::double, 1::double), 7::double)", "CASE WHEN o_orderkey % 2 = 0 THEN 7.0::DOUBLE ELSE 1.0::DOUBLE END"),
    ("round(log10(o_orderkey + 1), 9)", "round(log10(o_orderkey + 1), 9)"),
    ("round(pi() * o_orderkey, 6)", "round(pi() * o_orderkey, 6)"),
    ("pow(o_orderkey % 7, 3)", "pow(o_orderkey % 7, 3)"),
    ("random() BETWEEN 0 AND 1", "true"),
    (f"signum({_X})", f"CAST(sign({_Y}) AS DOUBLE)"),
    ("cast(trunc(4.35, 2) AS double)", "4.35::DOUBLE"),
    ("cast(trunc(0.29, 2) AS double)", "0.29::DOUBLE"),
    ("cast(truncate(-4.359, 1) AS double)", "-4.3::DOUBLE"),
    ("trunc(o_totalprice)", "trunc(o_totalprice)"),
    ("trunc(o_orderkey, -1)", "o_orderkey - o_orderkey % 10"),
    ("to_varchar(trunc(1234567890123456789.75, 1))", "'1234567890123456789.7'"),
    ("floor(o_totalprice)", "CAST(floor(o_totalprice) AS BIGINT)"),
    ("mod(o_orderkey, 7)", "o_orderkey % 7"),
])
_values("values_strings", "supplier", "s_suppkey", [
    ("char_length(s_name)", "CAST(length(s_name) AS INT)"),
    ("character_length(s_name)", "CAST(length(s_name) AS INT)"),
    ("length(s_name)", "CAST(length(s_name) AS INT)"),
    ("hex_encode(digest(s_name, 'md5'))", "upper(md5(s_name))"),
    ("hex_encode(digest(s_name, 'sha256'))", "upper(sha256(s_name))"),
    ("encode(s_name, 'base64')", "to_base64(encode(s_name))"),
    ("encode(s_name, 'hex')", "lower(hex(s_name))"),
    ("find_in_set(to_varchar(s_suppkey % 4), '0,1,2')", "CAST(CASE WHEN s_suppkey % 4 < 3 THEN s_suppkey % 4 + 1 ELSE 0 END AS INT)"),
    ("hex_encode(hex_decode_binary(hex_encode(s_name)))", "hex(s_name)"),
    ("hex_encode(try_hex_decode_binary(iff(s_suppkey % 2 = 0, '414', '4142')))", "CASE WHEN s_suppkey % 2 <> 0 THEN '4142' END"),
    ("instr(s_name, '0')", "CAST(instr(s_name, '0') AS INT)"),
    ("strpos(s_name, '1')", "CAST(instr(s_name, '1') AS INT)"),
    ("lower(s_name)", "lower(s_name)"),
    ("ltrim(concat('  ', s_name, ' '))", "s_name || ' '"),
    ("rtrim(concat(' ', s_name, '  '))", "' ' || s_name"),
    ("trim(concat(' ', s_name, ' '))", "s_name"),
    ("md5_hex(s_name)", "md5(s_name)"),
    ("sha256(s_name)", "sha256(s_name)"),
    ("sha2_hex(s_name, 256)", "sha256(s_name)"),
    ("length(sha224(s_name)) + length(sha384(s_name)) + length(sha512(s_name))", "280"),
    ("sha224('abc')", "'23097d223405d8228642a477bda255b32aadbce4bda0b3f7e36c9da7'"),
    ("sha384('abc')", "'cb00753f45a35e8bb5a03d699ac65007272c32ab0eded1631a8b605a43ff5bed8086072ba1e7cc2358baeca134c825a7'"),
    ("sha512('abc')", "'ddaf35a193617abacc417349ae20413112e6fa4e89a97ea20a9eeee64b55d39a2192992a274fc1a836ba3c23a3feebbd454d4423643ce80e2a9ac94fa54ca49f'"),
    ("overlay(s_name PLACING 'xy' FROM 2 FOR 1)", "substr(s_name, 1, 1) || 'xy' || substr(s_name, 3)"),
    ("length(randstr(7, 3))", "7"),
    ("length(uuid())", "36"),
    ("substr_index(s_name, '0', 2)", "array_to_string(list_slice(string_split(s_name, '0'), 1, 2), '0')"),
    ("substring(s_name, 3, 4)", "substring(s_name, 3, 4)"),
    ("jarowinkler_similarity(s_name, 'Supplier_1')", "CAST(floor(100 * jaro_winkler_similarity(lower(s_name), 'supplier_1') + 1e-9) AS BIGINT)"),
    ("json_get_str(parse_ip(concat('10.0.', s_suppkey % 200, '.7/24'), 'INET'), 'host')", "'10.0.' || (s_suppkey % 200) || '.7'"),
    ("json_get_int(parse_ip(concat('10.0.', s_suppkey % 200, '.7/24'), 'INET'), 'ipv4_range_start')", "167772160 + (s_suppkey % 200) * 256"),
    ("json_get_int(parse_ip('fe80::1', 'INET'), 'family')", "6::BIGINT"),
    ("decode(decrypt_raw(unhex(encrypt_raw(to_binary(hex_encode(s_name)), unhex('000102030405060708090A0B0C0D0E0F'), unhex('0102030405060708090A0B0C')):ciphertext), unhex('000102030405060708090A0B0C0D0E0F'), unhex('0102030405060708090A0B0C'), NULL, 'AES-GCM', unhex(encrypt_raw(to_binary(hex_encode(s_name)), unhex('000102030405060708090A0B0C0D0E0F'), unhex('0102030405060708090A0B0C')):tag)), 'utf-8')", "s_name"),
    ("regexp_extract_all(s_name, '[a-z]+')", "'[\"' || array_to_string(regexp_extract_all(s_name, '[a-z]+'), '\",\"') || '\"]'"),
    ("list_element(regexp_match(s_name, '[0-9]+'), 1)", "regexp_extract(s_name, '[0-9]+')"),
    ("regexp_instr(s_name, '[0-9]')", "CAST(length(regexp_extract(s_name, '^[^0-9]*')) + 1 AS BIGINT)"),
    ("regexp_instr(concat('ab', s_name, 'ab', s_suppkey, 'ab'), 'ab', 1, 2)", "CAST(length(s_name) + 3 AS BIGINT)"),
    ("regexp_instr(concat('ab', s_name, 'ab', s_suppkey), 'AB', 2, 1, 1, 'i')", "CAST(length(s_name) + 5 AS BIGINT)"),
    ("regexp_instr(s_name, '#[a-z]', 1, 1)", "0::BIGINT"),
    ("regexp_instr(concat('x', s_suppkey), '(x)([0-9]+)', 1, 1, 0, 'e', 2)", "2::BIGINT"),
    ("rlike(s_name, '[A-Za-z]+.*')", "true"),
    ("rlike(s_name, '[a-z]+')", "false"),
    ("s_name LIKE 'Supplier!_%' ESCAPE '!'", "s_name LIKE 'Supplier!_%' ESCAPE '!'"),
])
_J = "object_construct('a', object_construct('b', array_construct(r_regionkey, 2)), 'c', r_name, 'd', r_regionkey % 2 = 0, 'e', r_regionkey + 0.5)"
_values("values_json", "region", "r_regionkey", [
    ("as_array(array_construct(r_regionkey))", "'[' || r_regionkey || ']'"),
    (f"as_array({_J})", "CAST(NULL AS VARCHAR)"),
    (f"get_ignore_case({_J}, 'C')", "'\"' || r_name || '\"'"),
    (f"is_array(get_path({_J}, 'a.b'))", "true"),
    (f"is_array({_J})", "false"),
    (f"is_boolean(json_get({_J}, 'd'))", "true"),
    ("is_decimal('1.5')", "true"),
    ("is_double(to_varchar(r_regionkey))", "true"),
    ("is_real('\"x\"')", "false"),
    ("is_null_value('null')", "true"),
    ("is_varchar(concat('\"', r_name, '\"'))", "true"),
    (f"json_as_text({_J}, 'c')", "r_name"),
    (f"json_contains({_J}, 'a', 'b')", "true"),
    (f"json_contains({_J}, 'z')", "false"),
    (f"json_extract_path_text({_J}, 'a.b[0]')", "CAST(r_regionkey AS VARCHAR)"),
    (f"json_get({_J}, 'a', 'b', 1)", "'2'"),
    (f"json_get_bool({_J}, 'd')", "r_regionkey % 2 = 0"),
    (f"json_get_float({_J}, 'e')", "r_regionkey + 0.5::DOUBLE"),
    (f"json_get_json({_J}, 'a')", "'{\"b\":[' || r_regionkey || ',2]}'"),
    (f"json_get_str({_J}, 'c')", "r_name"),
    (f"list_to_string(json_keys({_J}), ',')", "'a,c,d,e'"),
    (f"list_to_string(json_object_keys({_J}, 'a'), ',')", "'b'"),
    (f"json_len({_J}, 'a', 'b')", "2"),
    ("make_object('k', r_regionkey)", "'{\"k\":' || r_regionkey || '}'"),
    ("object_construct_keep_null('k', nullif(r_regionkey, 1), 'n', NULL)", "'{\"k\":' || coalesce(CAST(nullif(r_regionkey, 1) AS VARCHAR), 'null') || ',\"n\":null}'"),
    (f"variant_element({_J}, '$.c', true)", "r_name"),
    ("array_element(array_construct(r_name, 5), '$[1]')", "'5'"),
    ("union_extract(object_construct('k', r_name), 'k')", "r_name"),
    ("get_field(named_struct('f', r_name), 'f')", "r_name"),
    ("array_construct_compact(r_regionkey, NULL, 'x')", "'[' || r_regionkey || ',\"x\"]'"),
    ("array_max(array_construct(r_regionkey, 2, NULL))", "CAST(greatest(r_regionkey, 2) AS VARCHAR)"),
    ("array_min(array_construct(r_name, 'M'))", "least(r_name, 'M')"),
    ("array_position(2, array_construct(r_regionkey, 2))", "CASE WHEN r_regionkey = 2 THEN 0::BIGINT ELSE 1::BIGINT END"),
    ("array_remove(array_construct(r_regionkey, 2, 2), 2)", "CASE WHEN r_regionkey = 2 THEN '[]' ELSE '[' || r_regionkey || ']' END"),
    ("array_slice(array_slice(array_slice(array_construct(1, 2, r_regionkey, 4, 5), 0, -1), 1, 4), -2, 2)", "'[' || r_regionkey || ']'"),
    ("make_array(r_regionkey, r_name)", "'[' || r_regionkey || ',\"' || r_name || '\"]'"),
    ("make_list(r_name)", "'[\"' || r_name || '\"]'"),
    ("generate_range(0, r_regionkey, 2)", "replace(CAST(range(0, r_regionkey, 2) AS VARCHAR), ', ', ',')"),
])


_L, _M = "sequence(1, n_regionkey + 3)", "range(1, n_regionkey + 4)"
_R = "array(n_regionkey, 2, NULL, 2, n_regionkey)"
_DR = "[n_regionkey, 2, NULL, 2, n_regionkey]"


def _texts(mine: str, theirs: str) -> tuple[str, str]:
    """A list as text on both sides, null as a word."""
    return f"to_json(transform({mine}, e -> coalesce(cast(e AS string), 'null')))", f"'[' || array_to_string(list_transform({theirs}, lambda e: '\"' || coalesce(CAST(e AS VARCHAR), 'null') || '\"'), ',') || ']'"


for _name in ("list", "array"):
    _more: list[tuple[str, str]] = [
        (f"{_name}_any_value(array(NULL, n_regionkey))", "n_regionkey"),
        (_texts(f"{_name}_dims({_L})", "[n_regionkey + 3]")),
        (f"{_name}_ndims(array({_L}))", "2::BIGINT"),
        (f"round({_name}_distance(array(n_regionkey, 1), array(1, 4)), 9)", "round(sqrt((n_regionkey - 1) * (n_regionkey - 1) + 9), 9)"),
        (f"{_name}_empty({_L})", "false"),
        (f"{_name}_extract({_L}, 2)", "2"),
        (f"{_name}_has_all({_L}, array(1, n_regionkey))", "n_regionkey > 0"),
        (f"{_name}_has_any({_L}, array(9, n_regionkey))", "n_regionkey > 0"),
        (f"{_name}_has({_L}, 4)", "n_regionkey >= 1"),
        (f"{_name}_indexof({_L}, 6)", "CASE WHEN n_regionkey >= 3 THEN 6::BIGINT END"),
        (f"{_name}_length({_L})", "n_regionkey + 3"),
        _texts(f"{_name}_pop_back({_L})", "range(1, n_regionkey + 3)"),
        _texts(f"{_name}_pop_front({_L})", "range(2, n_regionkey + 4)"),
        _texts(f"{_name}_positions({_R}, 2)", f"list_filter(range(1, 6), lambda i: {_DR}[i] = 2)"),
        _texts(f"{_name}_push_back({_L}, n_regionkey)", f"list_append({_M}, n_regionkey)"),
        _texts(f"{_name}_push_front({_L}, n_regionkey)", f"list_prepend(n_regionkey, {_M})"),
        _texts(f"{_name}_remove_all(array(n_regionkey, 2, 2), 2)", "list_filter([n_regionkey, 2, 2], lambda e: e <> 2)"),
        _texts(f"{_name}_remove_n(array(2, 7, 2, 2), 2, 2)", "[7, 2]"),
        _texts(f"{_name}_replace(array(2, n_regionkey + 7, 2), 2, 0)", "[0, n_regionkey + 7, 2]"),
        _texts(f"{_name}_replace_all(array(2, n_regionkey + 7, 2), 2, 0)", "[0, n_regionkey + 7, 0]"),
        _texts(f"{_name}_replace_n(array(2, n_regionkey + 7, 2, 2), 2, 0, 2)", "[0, n_regionkey + 7, 0, 2]"),
        _texts(f"{_name}_resize({_L}, 5, 0)", f"list_resize({_M}, 5, 0)"),
        _texts(f"{_name}_concat({_L}, array(n_regionkey))", f"list_concat({_M}, [n_regionkey])"),
        _texts(f"{_name}_intersect({_L}, array(9, 2))", "[2]"),
        _texts(f"{_name}_union(array(1, 2), array(2, n_regionkey + 3))", "[1, 2, n_regionkey + 3]"),
        _texts(f"{_name}_repeat(n_regionkey, 3)", "[n_regionkey, n_regionkey, n_regionkey]"),
        (f"{_name}_join(array(n_name, 'x'), '-')", "n_name || '-x'"),
    ]
    if _name == "list":
        _more += [
            _texts(f"list_append({_L}, 0)", f"list_append({_M}, 0)"),
            _texts(f"list_cat({_L}, {_L})", f"list_concat({_M}, {_M})"),
            (f"list_contains({_L}, 5)", "n_regionkey >= 2"),
            _texts("list_distinct(array(1, n_regionkey, 1))", "CASE WHEN n_regionkey = 1 THEN [1] ELSE [1, n_regionkey] END"),
            (f"list_element({_L}, 3)", "3"),
            _texts(f"list_except({_L}, array(2))", f"list_filter({_M}, lambda e: e <> 2)"),
            (f"list_max({_L})", "n_regionkey + 3"),
            (f"list_position({_L}, 3)", "3::BIGINT"),
            _texts(f"list_prepend({_L}, 0)", f"list_prepend(0, {_M})"),
            _texts("list_remove(array(2, n_regionkey + 5, 2), 2)", "[n_regionkey + 5, 2]"),
            _texts(f"list_reverse({_L})", f"list_reverse({_M})"),
            _texts(f"list_slice({_L}, 2, 3)", "[2, 3]"),
            _texts("list_sort(array(3, n_regionkey, 1))", "list_sort([3, n_regionkey, 1])"),
            _texts("list_sort(array(3, n_regionkey, 1), false)", "list_reverse_sort([3, n_regionkey, 1])"),
            ("list_to_string(array(n_name, 'y'), '+')", "n_name || '+y'"),
        ]
    else:
        _more += [
            (f"cardinality({_L})", "n_regionkey + 3"),
            (f"element_at({_L}, 1)", "1"),
            (f"empty({_L})", "false"),
            _texts(f"generate_series(1, n_regionkey + 3)", _M),
            _texts("range(n_regionkey)", "range(n_regionkey)"),
            _texts("range(1, 10, n_regionkey + 1)", "range(1, 10, n_regionkey + 1)"),
            ("get_field(row(n_name, n_regionkey + 1), 'col2')", "n_regionkey + 1"),
            ("get_field(struct(n_name AS a, 2 AS b), 'b')", "2"),
            ("element_at(map('k', n_name), 'k')", "n_name"),
            _texts("map_keys(map('k', n_name))", "['k']"),
            _texts("map_values(map('k', n_name))", "[n_name]"),
            _texts("map_extract(map('k', n_name), 'k')", "[n_name]"),
            ("get_field(named_struct('a', n_name), 'a')", "n_name"),
            _texts("string_to_array(n_name, 'A')", "string_split(n_name, 'A')"),
            _texts("string_to_list(concat(n_name, ',x'), ',', 'x')", "[n_name, NULL]"),
        ]
    _values(f"values_{_name}s", "nation", "n_nationkey", _more)

add(
    "values_aggregates",
    """SELECT l_returnflag, any_value(l_returnflag) AS c0, approx_distinct(l_linenumber) AS c1, approx_median(l_linenumber) AS c2, approx_percentile_cont(l_linenumber, 0.75) AS c3, approx_percentile_cont_with_weight(l_linenumber, 2, 0.25) AS c4, bool_and(l_quantity > 0) AS c5, bool_or(l_quantity > 50) AS c6,
              round(covar(l_quantity, l_extendedprice), 4) AS c7, round(mean(l_quantity), 6) AS c8, min(l_shipdate) AS c9, round(regr_syy(l_quantity, l_discount), 4) AS c10, round(stddev_samp(l_quantity), 6) AS c11, round(var(l_quantity), 6) AS c12, round(var_pop(l_quantity), 6) AS c13,
              round(var_samp(l_quantity), 6) AS c14, round(var_sample(l_quantity), 6) AS c15, listagg(DISTINCT l_linenumber, ',') WITHIN GROUP (ORDER BY l_linenumber DESC) AS c16, string_agg(DISTINCT l_linestatus, '|') WITHIN GROUP (ORDER BY l_linestatus) AS c17, count(*) AS c18
       FROM lineitem GROUP BY l_returnflag""",
    """SELECT l_returnflag, any_value(l_returnflag) AS c0, count(DISTINCT l_linenumber) AS c1, quantile_disc(l_linenumber, 0.5) AS c2, quantile_disc(l_linenumber, 0.75) AS c3, CAST(quantile_cont(l_linenumber, 0.25) AS DOUBLE) AS c4, bool_and(l_quantity > 0) AS c5, bool_or(l_quantity > 50) AS c6,
              round(covar_samp(l_quantity, l_extendedprice), 4) AS c7, round(avg(l_quantity), 6) AS c8, min(l_shipdate) AS c9, round(regr_syy(l_quantity, l_discount), 4) AS c10, round(stddev_samp(l_quantity), 6) AS c11, round(var_samp(l_quantity), 6) AS c12, round(var_pop(l_quantity), 6) AS c13,
              round(var_samp(l_quantity), 6) AS c14, round(var_samp(l_quantity), 6) AS c15, string_agg(DISTINCT CAST(l_linenumber AS VARCHAR), ',' ORDER BY CAST(l_linenumber AS VARCHAR) DESC) AS c16, string_agg(DISTINCT l_linestatus, '|' ORDER BY l_linestatus) AS c17, count(*) AS c18
       FROM lineitem GROUP BY l_returnflag""",
)
add(
    "values_array_union_agg",
    "SELECT r, array_sort(array_union_agg(a)) AS u FROM (SELECT n_regionkey AS r, array_construct(n_nationkey, 1) AS a FROM nation) GROUP BY r",
    "SELECT r, replace(CAST(list_sort(list_distinct(flatten(list(a)))) AS VARCHAR), ', ', ',') AS u FROM (SELECT n_regionkey AS r, [n_nationkey, 1] AS a FROM nation) GROUP BY r",
)
add("values_context", "SELECT current_client() AS a, current_ip_address() AS b, length(current_session()) > 0 AS c, current_schemas() AS d, current_version() = version() AS e, last_query_id() IS NULL AS f, sleep(0) AS g", """SELECT 'tarn' AS a, '' AS b, true AS c, '["main.public"]' AS d, true AS e, true AS f, 0.0::DOUBLE AS g""")
add("values_ifnull", "SELECT o_orderkey, ifnull(nullif(o_orderstatus, 'F'), 'f') AS a, 'a.b' ILIKE 'A.%' AS b FROM orders", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'f' ELSE o_orderstatus END AS a, true AS b FROM orders")
_values("values_casts", "orders", "o_orderkey", [
    ("'2024-01-02 03:04:05'::timestamp", "TIMESTAMP '2024-01-02 03:04:05'"),
    ("'2024-01-02 03:04:05.678'::timestamp_ntz", "TIMESTAMP '2024-01-02 03:04:05.678'"),
    ("'2024-01-02 03:04:05'::timestamp_ltz", "TIMESTAMP '2024-01-02 03:04:05'"),
    ("'2024-01-02 03:04:05+02:00'::timestamp_tz", "TIMESTAMP '2024-01-02 01:04:05'"),
    (f"{_D}::timestamp_ltz", _D),
    (f"{_D}::date", f"{_D}::DATE"),
    ("'5:06'::time", "'05:06:00'"),
    ("cast(concat(o_orderkey, '.456')::number(20, 2) AS double)", "o_orderkey + 0.46::DOUBLE"),
    ("concat(o_orderkey, '.5')::int", "o_orderkey + 1"),
    ("o_orderkey::varchar", "CAST(o_orderkey AS VARCHAR)"),
    ("(o_orderkey % 2)::boolean", "o_orderkey % 2 = 1"),
    ("o_orderkey::variant", "CAST(o_orderkey AS VARCHAR)"),
    ("cast(concat('[', o_orderkey, ',2]')::array AS string) IS NOT NULL", "true"),
    ("try_cast(concat('x', o_orderkey) AS int)", "CAST(NULL AS BIGINT)"),
    ("o_totalprice::float", "o_totalprice"),
    ("object_construct('a b', o_orderstatus):\"a b\"", "o_orderstatus"),
    ("array_construct(o_orderkey, o_orderstatus)[1]", "o_orderstatus"),
    ("object_construct('t', concat('true', o_orderkey), 'u', '[', 'v', ' 12 ', 'w', 'null')", "'{\"t\":\"true' || o_orderkey || '\",\"u\":\"[\",\"v\":12,\"w\":null}'"),
])
