"""Values of functions, many in one row."""

import datetime as dt

import pytest

from tarn.session import Session, expr

D, TS = dt.date, dt.datetime
CASES = [
    ("iff(NULL, 1, 2)", 2), ("nvl2(NULL, 1, 2)", 2), ("equal_null(NULL, NULL)", True), ("booland(1, NULL)", None), ("boolor(1, NULL)", True), ("boolxor(1, 0)", True), ("zeroifnull(NULL)", 0), ("nullifzero(0)", None),
    ("div0(1, 0)", 0), ("div0null(1, NULL)", 0), ("gcd(12, 18)", 6), ("lcm(4, 6)", 12), ("log(100)", 2.0), ("iszero(0)", True), ("factorial(5)", 120), ("square(3)", 9),
    ("insert('abcdef', 3, 2, 'zzz')", "abzzzef"), ("strtok('a.b.c', '.', 2)", "b"), ("strtok('', '.', 1)", None), ("split('127.0.0.1', '.')", '["127","0","0","1"]'), ("replace('down', 'down')", ""), ("hex_encode('A')", "41"), ("hex_decode_string('41')", "A"), ("try_hex_decode_string('4')", None), ("rtrimmed_length(' ab  ')", 3), ("jarowinkler_similarity('Dwayne', 'Duane')", 84), ("jarowinkler_similarity('', 'a')", 0), ("md5('a')", "0cc175b9c0f1b6a831c399e269772661"), ("sha2('a', 224)", "abd37534c7d9a2efb9465de931cd7055ffdb8879563ae98078d6d6d5"),
    ("regexp_like('abc', 'b')", False), ("regexp_like('ABC', 'a.*', 'i')", True), ("regexp_substr('a1b22', '[0-9]+', 1, 2)", "22"), ("regexp_replace('aXbX', 'X', '-', 1, 2)", "aXb-"), ("regexp_instr('abcabc', 'c', 1, 2)", 6), ("regexp_count('aXbX', 'X')", 2), ("regexp_substr_all('a1b2', '[a-z]')", '["a","b"]'),
    ("datediff('month', '2021-01-31'::date, '2021-02-01'::date)", 1), ("datediff(year, '2020-12-31'::date, '2021-01-01'::date)", 1), ("datediff('hour', '2021-01-01 00:59:00'::timestamp, '2021-01-01 01:01:00'::timestamp)", 1), ("dateadd('month', 1, '2024-01-31'::date)::date", D(2024, 2, 29)), ("last_day('2024-02-10'::date)", D(2024, 2, 29)), ("last_day('2024-02-10'::date, 'year')", D(2024, 12, 31)), ("previous_day('2024-01-01'::date, 'mo')", D(2023, 12, 25)), ("next_day('2024-01-01'::date, 'friday')", D(2024, 1, 5)), ("date_from_parts(2024, 2, 31)", D(2024, 3, 2)), ("timestamp_from_parts(2024, 13, 1, 0, 0, 90)", TS(2025, 1, 1, 0, 1, 30)), ("time_from_parts(1, 2, 63)", "01:03:03"), ("dayofyear('2024-01-02'::date)", 2), ("dayname('2024-02-03'::date)", "Sat"), ("monthname('2024-02-03'::date)", "Feb"), ("add_months('2024-01-31'::date, 1)", D(2024, 2, 29)),
    ("to_boolean('on')", True), ("try_to_boolean('maybe')", None), ("'50.9'::int", 51), ("'50.459'::int", 50), ("'50.5'::int", 51), ("to_date('01/02/2024')", D(2024, 1, 2)), ("try_to_date('x')", None), ("to_timestamp(1700000000)", TS(2023, 11, 14, 22, 13, 20)), ("to_timestamp(1700000000123, 3)", TS(2023, 11, 14, 22, 13, 20, 123000)), ("to_varchar(12.0::double)", "12"), ("to_char('2024-01-02'::date, 'YYYY/MM/DD')", "2024/01/02"), ("to_time('5:06:07')", "05:06:07"), ("typeof('true')", "BOOLEAN"), ("typeof('{\"a\":1}')", "OBJECT"),
    ("parse_json('{\"a\":[1,,2]}')", '{"a":[1,null,2]}'), ("try_parse_json('{')", None), ("get_path('{\"a\":{\"b\":[3]}}', 'a.b[0]')", "3"), ("get('[1,\"x\"]', 1)", '"x"'), ("get_ignore_case('{\"Ab\":1}', 'aB')", "1"), ("object_construct('a', 1, 'b', NULL)", '{"a":1}'), ("object_construct_keep_null('b', NULL)", '{"b":null}'), ("object_insert('{\"a\":1}', 'a', 2, true)", '{"a":2}'), ("object_delete('{\"a\":1,\"b\":2}', 'a')", '{"b":2}'), ("object_pick('{\"a\":1,\"b\":2}', 'a')", '{"a":1}'), ("object_keys('{\"a\":1}')", '["a"]'), ("is_array('[1]')", True), ("json_get_str('{\"a\":[\"q\"]}', 'a', 0)", "q"), ("json_length('[1,2]')", 2),
    ("array_construct(1, 'a', NULL)", '[1,"a",null]'), ("array_contains('a', ['a'])", True), ("array_contains('1', ['a', 2])", False), ("array_sort([3, NULL, 1])", "[1,3,null]"), ("array_slice([0, 1, 2, 3], 1, 3)", "[1,2]"), ("array_insert([0, 1], 1, 9)", "[0,9,1]"), ("array_remove_at([5, 6], 5)", None), ("array_flatten([[1], NULL])", None), ("array_size('x')", None), ("array_to_string([1, 'a'], '-')", "1-a"), ("array_generate_range(3, 1)", "[]"), ("array_generate_range(5, 1, -2)", "[5,3]"), ("array_except([1, 1, 2], [2])", "[1,1]"), ("arrays_overlap([1], [2])", False), ("arrays_to_object(['k'], [1])", '{"k":1}'), ("arrays_zip([1, 2], ['a'])", '[{"$1":1,"$2":"a"},{"$1":2,"$2":null}]'), ("strtok_to_array('a.b', '.')", '["a","b"]'),
    ("list_remove(sequence(1, 3), 2)", [1, 3]), ("list_replace_n(array(1, 1, 1), 1, 9, 2)", [9, 9, 1]), ("list_resize(array(1), 3, 0)", [1, 0, 0]), ("list_positions(array(1, 2, 1), 1)", [1, 3]), ("generate_series(1, 3)", [1, 2, 3]), ("range(0, 3)", [0, 1, 2]), ("range(3, 0)", []),
]


@pytest.fixture(scope="module")
def session(spark):
    return Session(spark)


def test_values(session, spark):
    got = list(session.execute("SELECT " + ", ".join(f"{sql} AS c{i}" for i, (sql, _) in enumerate(CASES))).first())
    wrong = [(sql, have, want) for (sql, want), have in zip(CASES, got) if have != want]
    assert not wrong


def test_expressions_in_the_dataframe_api(session, spark):
    rows = spark.createDataFrame([('{"a": 5}',), (None,)], "j string").select(expr("j:a::int").alias("a")).collect()
    assert [r.a for r in rows] == [5, None]


def test_parse_ip(session):
    out = session.execute("SELECT parse_ip('192.168.1.5/24', 'INET') AS p, parse_ip('x', 'INET', 1) AS q").first()
    assert '"ipv4_range_start": 3232235776' in out.p and "error" in out.q


def test_encryption_round_trip(session):
    key, iv = "000102030405060708090A0B0C0D0E0F", "0102030405060708090A0B0C"
    out = session.execute(f"SELECT e, decode(decrypt_raw(unhex(e:ciphertext), unhex('{key}'), unhex('{iv}'), NULL, 'AES-GCM', unhex(e:tag)), 'utf-8') AS t FROM (SELECT encrypt_raw(to_binary(hex_encode('secret')), unhex('{key}'), unhex('{iv}')) AS e)").first()
    assert out.t == "secret"
