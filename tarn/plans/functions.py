"""Queries of function families: (dialect SQL, the same in DuckDB's SQL)."""

from tarn.plans.relational import add

add(
    "fn_conditional",
    "SELECT c_custkey, iff(c_acctbal > 0, 'in', 'out') AS a, nvl(nullif(c_mktsegment, 'BUILDING'), '-') AS b, nvl2(nullif(c_nationkey, 3), 1, 0) AS c, zeroifnull(nullif(c_nationkey, 5)) AS d, nullifzero(c_nationkey) AS e, equal_null(nullif(c_nationkey, 3), NULL) AS f, booland(c_nationkey > 3, c_acctbal > 0) AS g, boolor(c_nationkey > 3, c_acctbal > 0) AS h, boolxor(c_nationkey > 3, c_acctbal > 0) AS i, greatest(c_nationkey, 7) AS j, least(c_nationkey, 7) AS k, decode(c_nationkey, 1, 'one', 2, 'two', 'more') AS l FROM customer",
    "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'in' ELSE 'out' END AS a, coalesce(nullif(c_mktsegment, 'BUILDING'), '-') AS b, CASE WHEN c_nationkey <> 3 THEN 1 ELSE 0 END AS c, coalesce(nullif(c_nationkey, 5), 0) AS d, nullif(c_nationkey, 0) AS e, c_nationkey = 3 AS f, c_nationkey > 3 AND c_acctbal > 0 AS g, c_nationkey > 3 OR c_acctbal > 0 AS h, (c_nationkey > 3) <> (c_acctbal > 0) AS i, greatest(c_nationkey, 7) AS j, least(c_nationkey, 7) AS k, CASE c_nationkey WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'more' END AS l FROM customer",
)
add(
    "fn_numeric",
    "SELECT p_partkey, abs(p_size - 20) AS a, round(sqrt(p_size), 6) AS b, round(ln(p_retailprice), 6) AS c, round(log(p_retailprice), 6) AS d, round(log2(p_size), 6) AS e, cast(ceil(p_retailprice) AS bigint) AS f, cast(floor(p_retailprice) AS bigint) AS g, sign(p_size - 20) AS h, round(power(p_size, 2), 2) AS i, round(div0(p_retailprice, p_size - 5), 6) AS j, round(div0null(p_retailprice, nullif(p_size, 7)), 6) AS k, gcd(p_size, 12) AS l, lcm(p_size, 12) AS m, round(trunc(p_retailprice, 1), 2) AS n, iszero(p_size - 10) AS o, round(cbrt(p_size), 6) AS p, round(sin(p_size) + cos(p_size) + atan2(p_size, 3), 6) AS q, round(degrees(p_size), 6) AS r, round(radians(p_size), 6) AS s FROM part",
    "SELECT p_partkey, abs(p_size - 20) AS a, round(sqrt(p_size), 6) AS b, round(ln(p_retailprice), 6) AS c, round(log10(p_retailprice), 6) AS d, round(log2(p_size), 6) AS e, CAST(ceil(p_retailprice) AS BIGINT) AS f, CAST(floor(p_retailprice) AS BIGINT) AS g, CAST(sign(p_size - 20) AS DOUBLE) AS h, round(power(p_size, 2), 2) AS i, round(CASE WHEN p_size = 5 THEN 0 ELSE p_retailprice / (p_size - 5) END, 6) AS j, round(CASE WHEN p_size = 7 THEN 0 ELSE p_retailprice / p_size END, 6) AS k, gcd(p_size::BIGINT, 12) AS l, lcm(p_size::BIGINT, 12) AS m, round(trunc(p_retailprice * 10) / 10, 2) AS n, p_size = 10 AS o, round(cbrt(p_size), 6) AS p, round(sin(p_size) + cos(p_size) + atan2(p_size, 3), 6) AS q, round(degrees(p_size), 6) AS r, round(radians(p_size), 6) AS s FROM part",
)
add(
    "fn_string",
    "SELECT c_custkey, upper(c_name) AS a, initcap(c_mktsegment) AS b, insert(c_name, 1, 2, 'ZZ') AS c, split_part(c_name, '#', 2) AS d, replace(c_name, '0') AS e, strtok(c_name, '#0', 2) AS f, lpad(c_custkey, 8, '*') AS g, rpad(c_mktsegment, 12, '.') AS h, reverse(c_name) AS i, left(c_name, 4) AS j, right(c_name, 4) AS k, len(c_name) AS l, position('r' IN c_name) AS m, translate(c_mktsegment, 'AEIOU', '12345') AS n, repeat('ab', 2) AS o, contains(c_name, '7') AS p, starts_with(c_name, 'Cust') AS q, ends_with(c_name, '1') AS r, substr(c_name, -3, 2) AS s, rtrimmed_length(concat(c_mktsegment, '   ')) AS t, levenshtein(c_mktsegment, 'BUILDING') AS u, ascii(c_name) AS v, chr(65 + c_custkey % 26) AS w, concat_ws('-', c_custkey, c_mktsegment) AS x, substring_index(c_name, '#', 1) AS y, btrim('xxaxx', 'x') AS z FROM customer",
    "SELECT c_custkey, upper(c_name) AS a, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS b, 'ZZ' || c_name[3:] AS c, split_part(c_name, '#', 2) AS d, replace(c_name, '0', '') AS e, list_filter(regexp_split_to_array(c_name, '[#0]'), lambda x: x <> '')[2] AS f, lpad(c_custkey::VARCHAR, 8, '*') AS g, rpad(c_mktsegment, 12, '.') AS h, reverse(c_name) AS i, left(c_name, 4) AS j, right(c_name, 4) AS k, CAST(length(c_name) AS INT) AS l, CAST(position('r' IN c_name) AS INT) AS m, translate(c_mktsegment, 'AEIOU', '12345') AS n, 'abab' AS o, contains(c_name, '7') AS p, starts_with(c_name, 'Cust') AS q, ends_with(c_name, '1') AS r, substr(c_name, length(c_name) - 2, 2) AS s, CAST(length(c_mktsegment) AS INT) AS t, CAST(levenshtein(c_mktsegment, 'BUILDING') AS INT) AS u, ascii(c_name) AS v, chr((65 + c_custkey % 26)::INT) AS w, c_custkey || '-' || c_mktsegment AS x, split_part(c_name, '#', 1) AS y, 'a' AS z FROM customer",
)
add(
    "fn_hash_encode",
    "SELECT p_partkey, md5(p_name) AS a, sha2(p_name) AS b, sha2(p_name, 256) AS c, sha1(p_name) AS d, hex_encode(p_name) AS e, hex_encode(p_name, 0) AS f, hex_decode_string(hex_encode(p_name)) AS g, base64_encode(p_name) AS h, try_hex_decode_string('zz') AS i, bit_length(p_name) AS j, octet_length(p_name) AS k FROM part",
    "SELECT p_partkey, md5(p_name) AS a, sha256(p_name) AS b, sha256(p_name) AS c, sha1(p_name) AS d, hex(p_name) AS e, lower(hex(p_name)) AS f, p_name AS g, base64(p_name::BLOB) AS h, CAST(NULL AS VARCHAR) AS i, CAST(8 * strlen(p_name) AS INT) AS j, CAST(strlen(p_name) AS INT) AS k FROM part",
)
add(
    "fn_regexp",
    "SELECT p_partkey, regexp_like(p_type, '.*BRASS') AS a, regexp_count(p_name, '[0-9]') AS b, regexp_replace(p_name, '[0-9]+', '#') AS c, regexp_substr(p_type, '[A-Z]+', 1, 2) AS d, regexp_substr(p_name, '([a-zA-Z]+)[^0-9]*([0-9]+)', 1, 1, 'e', 2) AS e, regexp_instr(p_name, '[0-9]') AS f, regexp_replace(p_type, '(\\\\w+) (\\\\w+)', '\\\\2 \\\\1') AS g, regexp_substr_all(p_type, '[A-Z]+') AS h, regexp_like(p_type, 'promo.*', 'i') AS i FROM part",
    "SELECT p_partkey, regexp_full_match(p_type, '.*BRASS') AS a, CAST(length(regexp_replace(p_name, '[^0-9]', '', 'g')) AS INT) AS b, regexp_replace(p_name, '[0-9]+', '#', 'g') AS c, regexp_extract_all(p_type, '[A-Z]+')[2] AS d, nullif(regexp_extract(p_name, '([a-zA-Z]+)[^0-9]*([0-9]+)', 2), '') AS e, CAST(CASE WHEN regexp_matches(p_name, '[0-9]') THEN length(regexp_extract(p_name, '^[^0-9]*')) + 1 ELSE 0 END AS BIGINT) AS f, regexp_replace(p_type, '(\\w+) (\\w+)', '\\2 \\1', 'g') AS g, '[\"' || array_to_string(regexp_extract_all(p_type, '[A-Z]+'), '\",\"') || '\"]' AS h, regexp_full_match(lower(p_type), 'promo.*') AS i FROM part",
)
add(
    "fn_dates",
    "SELECT o_orderkey, datediff('day', o_orderdate, '1998-12-31'::date) AS a, datediff(month, o_orderdate, '1998-12-31'::date) AS b, datediff(year, o_orderdate, '1998-12-31'::date) AS c, datediff('quarter', o_orderdate, '1998-12-31'::date) AS d, year(o_orderdate) AS e, quarter(o_orderdate) AS f, dayofweek(o_orderdate) AS g, dayofweekiso(o_orderdate) AS h, dayofyear(o_orderdate) AS i, weekiso(o_orderdate) AS j, yearofweekiso(o_orderdate) AS k, cast(last_day(o_orderdate) AS date) AS l, dayname(o_orderdate) AS m, monthname(o_orderdate) AS n, date_trunc('month', o_orderdate) AS o, dateadd(day, 10, o_orderdate) AS p, dateadd('month', -1, o_orderdate) AS q, next_day(o_orderdate, 'friday') AS r, previous_day(o_orderdate, 'mo') AS s, date_from_parts(year(o_orderdate), 14, 0) AS t, date_part('epoch_second', o_orderdate) AS u, to_char(o_orderdate, 'YYYY/MM/DD HH24:MI') AS v, hour(o_orderdate) AS w, cast(last_day(o_orderdate, 'year') AS date) AS x FROM orders",
    "SELECT o_orderkey, CAST(date_diff('day', o_orderdate, DATE '1998-12-31') AS INT) AS a, CAST(date_diff('month', o_orderdate, DATE '1998-12-31') AS INT) AS b, CAST(date_diff('year', o_orderdate, DATE '1998-12-31') AS INT) AS c, CAST(date_diff('quarter', o_orderdate, DATE '1998-12-31') AS INT) AS d, CAST(year(o_orderdate) AS INT) AS e, CAST(quarter(o_orderdate) AS INT) AS f, CAST(dayofweek(o_orderdate) AS INT) AS g, CAST(isodow(o_orderdate) AS INT) AS h, CAST(dayofyear(o_orderdate) AS INT) AS i, CAST(weekofyear(o_orderdate) AS INT) AS j, CAST(isoyear(o_orderdate) AS INT) AS k, CAST(last_day(o_orderdate) AS DATE) AS l, strftime(o_orderdate, '%a') AS m, strftime(o_orderdate, '%b') AS n, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS o, o_orderdate + INTERVAL 10 DAY AS p, o_orderdate - INTERVAL 1 MONTH AS q, CAST(o_orderdate AS DATE) + CAST((4 - (isodow(o_orderdate) - 1) + 6) % 7 + 1 AS INT) AS r, CAST(o_orderdate AS DATE) - CAST((isodow(o_orderdate) - 1 + 6) % 7 + 1 AS INT) AS s, CAST(make_date(CAST(year(o_orderdate) + 1 AS INT), 2, 1) - 1 AS DATE) AS t, CAST(epoch(o_orderdate) AS BIGINT) AS u, strftime(o_orderdate, '%Y/%m/%d %H:%M') AS v, CAST(hour(o_orderdate) AS INT) AS w, make_date(CAST(year(o_orderdate) AS INT), 12, 31) AS x FROM orders",
)
add(
    "fn_conversion",
    "SELECT o_orderkey, to_varchar(o_orderkey) AS a, try_to_number('x' || o_orderkey) AS b, cast(to_decimal('12.345', 10, 2) AS double) AS c, to_boolean(iff(o_orderkey % 2 = 0, 'yes', 'no')) AS d, try_to_boolean('maybe') AS e, to_date('2024-03-04') AS f, try_to_date('04-MAR-2024') AS g, to_timestamp(1700000000) AS h, to_timestamp('2024-03-04 05:06:07') AS i, to_timestamp(1700000000123, 3) AS j, try_to_timestamp('nope') AS k, to_time('5:06:07') AS l, '50.9'::int AS m, try_cast('7' AS int) AS n, typeof('[1]') AS o, typeof('1') AS p, to_varchar(12.0::double) AS q, hex_encode(to_binary('4142')) AS r, to_date('03/04/2024', 'MM/DD/YYYY') AS s FROM orders",
    "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS a, CAST(NULL AS DECIMAL(38, 0)) AS b, 12.35::DOUBLE AS c, o_orderkey % 2 = 0 AS d, CAST(NULL AS BOOLEAN) AS e, DATE '2024-03-04' AS f, DATE '2024-03-04' AS g, TIMESTAMP '2023-11-14 22:13:20' AS h, TIMESTAMP '2024-03-04 05:06:07' AS i, TIMESTAMP '2023-11-14 22:13:20.123' AS j, CAST(NULL AS TIMESTAMP) AS k, '05:06:07' AS l, 51::BIGINT AS m, 7::BIGINT AS n, 'ARRAY' AS o, 'INTEGER' AS p, '12' AS q, '4142' AS r, DATE '2024-03-04' AS s FROM orders",
)
add(
    "fn_json_object",
    "SELECT event_id, parse_json(props):k AS a, object_construct('id', event_id, 'type', event_type) AS b, object_insert(props, 'z', 1) AS c, object_delete(props, 'k') AS d, object_pick(object_construct('a', 1, 'b', 2), 'b') AS e, object_keys(props) AS f, is_object(props) AS g, get_path(props, 'k') AS h, is_integer(get(props, 'k')) AS i, json_get_int(props, 'k') AS j, json_length(props) AS l, try_parse_json('{bad') AS m, as_object(props) IS NOT NULL AS n FROM events",
    """SELECT event_id, json_extract_string(props, '$.k') AS a, '{"id":' || event_id || ',"type":"' || event_type || '"}' AS b, '{"k":' || json_extract_string(props, '$.k') || ',"z":1}' AS c, '{}' AS d, '{"b":2}' AS e, '["k"]' AS f, true AS g, json_extract_string(props, '$.k') AS h, true AS i, CAST(json_extract_string(props, '$.k') AS BIGINT) AS j, 1 AS l, CAST(NULL AS VARCHAR) AS m, true AS n FROM events""",
)
add(
    "fn_json_array",
    "SELECT r_regionkey, array_construct(r_regionkey, r_name, NULL) AS a, array_append([1, 2], r_regionkey) AS b, array_cat([1], [r_regionkey]) AS c, array_contains(2, [1, r_regionkey]) AS d, array_distinct([1, 1, r_regionkey]) AS e, array_size([r_regionkey, 1]) AS f, array_slice([1, 2, 3, 4], 1, 3) AS g, array_sort([3, r_regionkey, 2]) AS h, array_to_string([1, 'x', r_regionkey], '-') AS i, array_flatten([[1], [r_regionkey, 3]]) AS j, array_generate_range(0, r_regionkey) AS k, array_insert([1, 2], 1, r_regionkey) AS l, array_compact([1, NULL, 2]) AS m, array_except([1, 2, 3], [r_regionkey]) AS n, array_intersection([1, 2, 3], [r_regionkey, 1]) AS o, array_remove_at([5, 6, 7], 1) AS p, arrays_overlap([1, 2], [r_regionkey]) AS q, arrays_zip([1, 2], [r_regionkey]) AS r, arrays_to_object(['a'], [r_regionkey]) AS s, array_reverse([1, r_regionkey]) AS t, array_prepend([1], r_regionkey) AS u, split(r_name, 'A') AS v, strtok_to_array(r_name, 'AE') AS w FROM region",
    """SELECT r_regionkey, '[' || r_regionkey || ',"' || r_name || '",null]' AS a, '[1,2,' || r_regionkey || ']' AS b, '[1,' || r_regionkey || ']' AS c, r_regionkey = 2 AS d, CASE WHEN r_regionkey = 1 THEN '[1]' ELSE '[1,' || r_regionkey || ']' END AS e, 2 AS f, '[2,3]' AS g, replace(CAST(list_sort([3, r_regionkey, 2]) AS VARCHAR), ', ', ',') AS h, '1-x-' || r_regionkey AS i, '[1,' || r_regionkey || ',3]' AS j, replace(CAST(range(0, r_regionkey) AS VARCHAR), ', ', ',') AS k, '[1,' || r_regionkey || ',2]' AS l, '[1,2]' AS m, replace(CAST(list_filter([1, 2, 3], lambda x: x <> r_regionkey) AS VARCHAR), ', ', ',') AS n, replace(CAST(list_filter([r_regionkey, 1], lambda x: x IN (1, 2, 3)) AS VARCHAR), ', ', ',') AS o, '[5,7]' AS p, r_regionkey IN (1, 2) AS q, '[{"$1":1,"$2":' || r_regionkey || '},{"$1":2,"$2":null}]' AS r, '{"a":' || r_regionkey || '}' AS s, '[' || r_regionkey || ',1]' AS t, '[' || r_regionkey || ',1]' AS u, '["' || replace(r_name, 'A', '","') || '"]' AS v, '["' || array_to_string(list_filter(regexp_split_to_array(r_name, '[AE]'), lambda x: x <> ''), '","') || '"]' AS w FROM region""",
)
add(
    "fn_list_map",
    "SELECT vec_id, cardinality(embedding) AS a, list_position(sequence(1, 5), 3) AS c, list_has_all(sequence(1, 5), sequence(2, 3)) AS d, list_to_string(list_reverse(sequence(1, 3)), ',') AS e, list_length(list_resize(sequence(1, 3), 5, 0)) AS f, round(list_distance(embedding, embedding), 6) AS g, list_element(list_pop_back(sequence(1, 3)), 1) AS h FROM embeddings",
    "SELECT vec_id, CAST(len(embedding) AS INT) AS a, 3::BIGINT AS c, true AS d, '3,2,1' AS e, 5 AS f, 0.0::DOUBLE AS g, 1 AS h FROM embeddings",
)
add("fn_context", "SELECT current_database() AS db, current_schema() AS sch, current_role() AS role, current_warehouse() AS wh, current_role_type() AS rt", "SELECT 'main' AS db, 'public' AS sch, 'default' AS role, 'default' AS wh, 'ROLE' AS rt")
add("fn_parse_ip_similarity", "SELECT s_suppkey, jarowinkler_similarity(s_name, 'Supplier#000000001') AS j, parse_ip(concat('10.0.0.', s_suppkey % 250, '/24'), 'INET'):host AS host FROM supplier", "SELECT s_suppkey, CAST(floor(100 * jaro_winkler_similarity(lower(s_name), 'supplier#000000001') + 1e-9) AS BIGINT) AS j, '10.0.0.' || (s_suppkey % 250) AS host FROM supplier")
add("fn_encrypt", "SELECT p_partkey, decode(decrypt_raw(unhex(e:ciphertext), unhex(k), unhex(e:iv), NULL, 'AES-GCM', unhex(e:tag)), 'utf-8') = p_name AS same FROM (SELECT p_partkey, p_name, k, encrypt_raw(to_binary(hex_encode(p_name)), unhex(k), unhex('0102030405060708090A0B0C')) AS e FROM (SELECT p_partkey, p_name, '000102030405060708090A0B0C0D0E0F' AS k FROM part))", "SELECT p_partkey, true AS same FROM part")
