"""Every function name is called once, with arguments that make sense."""

import pytest

from tarn.dialect.lexer import lex
from tarn.functions import FUNCTIONS
from tarn.session import Session

J = """'{"a":{"b":[1,2]},"c":"x"}'"""
A, B = "[1,2,3]", "[2,9]"
L, M = "sequence(1, 4)", "array(1, 2, NULL)"
D, TS = "'2024-02-10'::date", "'2024-02-10 11:12:13'::timestamp_ntz"
AGGREGATES = """
any_value(x) approx_distinct(x) approx_median(x) approx_percentile_cont(x, 0.5) approx_percentile_cont_with_weight(x, x, 0.5) array_agg(x) array_union_agg(j) array_unique_agg(x) avg(x)
bit_and(x) bit_or(x) bit_xor(x) bool_and(b) bool_or(b) booland_agg(b) boolor_agg(b) boolxor_agg(b) corr(x, y) count(x) covar(x, y) covar_pop(x, y) covar_samp(x, y) first_value(x) last_value(x)
listagg(s) max(x) mean(x) median(x) min(x) object_agg(s, x) regr_avgx(x, y) regr_avgy(x, y) regr_count(x, y) regr_intercept(x, y) regr_r2(x, y) regr_slope(x, y) regr_sxx(x, y) regr_sxy(x, y) regr_syy(x, y)
stddev(x) stddev_pop(x) stddev_samp(x) string_agg(s, ',') sum(x) var(x) var_pop(x) var_population(x) var_samp(x) var_sample(x) variance(x) variance_pop(x) variance_samp(x) approx_count_distinct(x) mode(x) kurtosis(x) skewness(x)
"""
WINDOWS = "conditional_true_event(b) cume_dist() dense_rank() lag(x) lead(x) nth_value(x, 1) ntile(2) percent_rank() rank() row_number()".split(") ")
SCALARS = f"""
booland(1, 0)|boolor(1, 0)|boolxor(1, 0)|boolnot(1)|coalesce(NULL, 1)|equal_null(1, 1)|greatest(1, 2)|least(1, 2)|iff(true, 1, 2)|ifnull(NULL, 1)|nullif(1, 2)|nullifzero(1)|nullif0(1)|nvl(1, 2)|nvl2(1, 2, 3)|zeroifnull(1)|decode(1, 1, 'a', 'b')
arrow_cast(1, 'Int32')|arrow_typeof(1)|system$typeof(1)|typeof('1')|to_array('a')|to_binary('41')|try_to_binary('4z')|to_boolean('yes')|try_to_boolean('x')|to_char(1)|to_varchar(1.5)|try_to_char(1)|try_to_varchar(1)|to_date('2024-01-01')|try_to_date('x')|date('2024-01-01')|to_decimal('1')|to_number('1')|to_numeric('1')|try_to_decimal('x')|try_to_number('x')|try_to_numeric('x')|to_object({J})|to_time('01:02:03')|try_to_time('x')|time('01:02')|to_timestamp('2024-01-01')|try_to_timestamp('x')|to_timestamp_ltz('2024-01-01')|try_to_timestamp_ltz('x')|to_timestamp_ntz('2024-01-01')|try_to_timestamp_ntz('x')|to_timestamp_tz('2024-01-01')|try_to_timestamp_tz('x')|to_timestamp_micros(1)|to_timestamp_millis(1)|to_timestamp_nanos(1000)|to_timestamp_seconds(1)|to_unixtime({TS})|to_local_time({TS})|to_variant('a')|to_hex(255)|to_double('1')|try_to_double('x')
add_months({D}, 1)|convert_timezone('UTC', 'Asia/Tokyo', {TS})|current_date()|current_time()|current_timestamp()|now()|today()|getdate()|localtimestamp()|date_add(day, 1, {D})|dateadd(week, 1, {TS})|time_add(hour, 1, {TS})|timeadd(minute, 1, {TS})|timestamp_add(second, 1, {TS})|timestampadd(year, 1, {TS})|date_diff(day, {D}, {D})|datediff(week, {D}, {D})|time_diff(second, {TS}, {TS})|timediff(millisecond, {TS}, {TS})|timestamp_diff(microsecond, {TS}, {TS})|timestampdiff(nanosecond, {TS}, {TS})|date_bin('2 hours', {TS})|time_slice({TS}, 2, 'hour')|date_format({TS}, '%Y-%m')|date_from_parts(2024, 1, 1)|datefromparts(2024, 1, 1)|date_part('year', {D})|datepart('epoch_second', {TS})|date_trunc('month', {D})|datetrunc('hour', {TS})|day({D})|dayname({D})|dayofmonth({D})|dayofweek({D})|dayofweekiso({D})|dayofyear({D})|from_unixtime(1)|hour({TS})|last_day({D}, 'quarter')|make_date(2024, 1, 1)|minute({TS})|month({D})|monthname({D})|next_day({D}, 'su')|previous_day({D}, 'su')|quarter({D})|second({TS})|time_from_parts(1, 2, 3)|timefromparts(1, 2, 3, 4000000)|timestamp_from_parts(2024, 1, 1, 1, 1, 1)|timestampfromparts({D}, '01:02:03')|timestamp_ltz_from_parts(2024, 1, 1, 1, 1, 1)|timestampltzfromparts(2024, 1, 1, 1, 1, 1, 5)|timestamp_ntz_from_parts(2024, 1, 1, 1, 1, 1)|timestampntzfromparts(2024, 1, 1, 1, 1, 1)|timestamp_tz_from_parts(2024, 1, 1, 1, 1, 1, 0, 'Asia/Tokyo')|timestamptzfromparts(2024, 1, 1, 1, 1, 1)|week({D})|weekiso({D})|weekofyear({D})|year({D})|yearofweek({D})|yearofweekiso({D})|to_unix_timestamp('2024-01-01 00:00:00')
abs(-1)|acos(1)|acosh(1)|asin(1)|asinh(1)|atan(1)|atan2(1, 2)|atanh(0)|cbrt(8)|ceil(1.2)|ceiling(1.2)|cos(1)|cosh(1)|cot(1)|degrees(1)|div0(1, 0)|div0null(1, 0)|exp(1)|factorial(3)|floor(1.2)|gcd(4, 6)|isnan(1.0::double)|iszero(0)|lcm(4, 6)|ln(1)|log(10)|log10(10)|log2(8)|nanvl(1.0::double, 2.0::double)|pi()|pow(2, 3)|power(2, 3)|radians(1)|random()|round(1.25, 1)|signum(-1)|sign(-1)|sin(1)|sinh(1)|sqrt(4)|tan(1)|tanh(1)|trunc(1.29, 1)|truncate(1.29)|mod(5, 3)|square(2)|width_bucket(5.0, 0.0, 10.0, 5)
ascii('a')|bit_length('a')|btrim('xax', 'x')|char_length('a')|character_length('a')|chr(65)|concat('a', 'b')|concat_ws('-', 'a', 'b')|contains('ab', 'b')|digest('a', 'sha256')|encode('a', 'base64')|ends_with('ab', 'b')|endswith('ab', 'b')|find_in_set('b', 'a,b')|hex_decode_binary('41')|hex_decode_string('41')|hex_encode('A')|initcap('ab cd')|insert('abc', 1, 1, 'z')|instr('abc', 'b')|jarowinkler_similarity('a', 'b')|left('abc', 2)|len('abc')|length('abc')|levenshtein('a', 'b')|editdistance('a', 'b')|lower('A')|lpad('a', 3, 'x')|ltrim(' a')|md5('a')|md5_hex('a')|sha1('a')|sha1_hex('a')|octet_length('a')|overlay('abc' PLACING 'z' FROM 2)|parse_ip('1.2.3.4', 'INET')|position('b', 'ab')|charindex('b', 'ab')|randstr(5, 1)|repeat('a', 2)|replace('a', 'a', 'b')|reverse('ab')|right('abc', 2)|rpad('a', 3, 'x')|rtrim('a ')|rtrimmed_length('a ')|sha2('a')|sha224('a')|sha256('a')|sha2_hex('a', 512)|sha384('a')|sha512('a')|split('a,b', ',')|split_part('a,b', ',', 1)|starts_with('ab', 'a')|startswith('ab', 'a')|strpos('ab', 'b')|strtok('a b')|substr('abc', 2)|substr_index('a.b.c', '.', 2)|substring('abc', 2, 1)|substring_index('a.b.c', '.', 2)|translate('abc', 'a', 'z')|trim(' a ')|try_hex_decode_binary('4')|try_hex_decode_string('41')|upper('a')|ucase('a')|lcase('A')|uuid()|uuid_string()|soundex('a')|space(2)|base64_encode('a')|base64_decode_string('YQ==')
decrypt_raw(unhex('00'), unhex('000102030405060708090A0B0C0D0E0F'), unhex('0102030405060708090A0B0C'), NULL, 'AES-GCM', unhex('00'))~|encrypt_raw(unhex('00'), unhex('000102030405060708090A0B0C0D0E0F'), unhex('0102030405060708090A0B0C'))
regexp_count('aa', 'a')|regexp_extract_all('a1', '[0-9]')|regexp_instr('a1', '[0-9]')|regexp_like('a', 'a')|regexp_match('a1', '[0-9]')|regexp_replace('a1', '[0-9]', 'x')|regexp_substr('a1', '[0-9]')|regexp_substr_all('a1', '([0-9])', 1, 1, 'e')|rlike('a', 'a')
as_array('[1]')|as_object({J})|get({J}, 'a')|get_ignore_case({J}, 'A')|get_path({J}, 'a.b')|is_array('[1]')|is_boolean('true')|is_decimal('1.5')|is_double('1.5')|is_integer('1')|is_null_value('null')|is_object({J})|is_real('1.5')|is_varchar('"a"')|is_char('"a"')|json_as_text({J}, 'a')|json_contains({J}, 'a')|json_extract_path_text({J}, 'c')|json_get({J}, 'a')|json_get_bool('{{"a":true}}', 'a')|json_get_float('{{"a":1.5}}', 'a')|json_get_int('{{"a":1}}', 'a')|json_get_json({J}, 'a')|json_get_str({J}, 'c')|json_keys({J})|json_len({J})|json_length({J}, 'a', 'b')|json_object_keys({J}, 'a')|make_object('a', 1)|object_construct('a', 1)|object_construct_keep_null('a', NULL)|object_delete({J}, 'a')|object_insert({J}, 'z', 1)|object_keys({J})|object_pick({J}, 'a')|parse_json({J})|try_parse_json({J})|check_json('{{')|variant_element({J}, '$.a')
array_any_value({M})|array_append({A}, 4)|array_cat({A}, {B})|array_compact('[1,null]')|array_concat({L}, {L})|array_construct(1)|array_construct_compact(1, NULL)|array_contains(1, {A})|array_dims({L})|array_distance(array(1.0, 2.0), array(1.0, 3.0))|array_distinct({A})|array_element({A}, '$[0]')|array_empty({L})|array_except({A}, {B})|array_extract({L}, 1)|array_flatten([[1]])|array_generate_range(0, 3)|array_has({L}, 1)|array_has_all({L}, {L})|array_has_any({L}, {L})|array_indexof({L}, 2)|array_insert({A}, 0, 1)|array_intersect({L}, {L})|array_intersection({A}, {B})|array_join(array('a'), ',')|array_length({L})|array_max({A})|array_min({A})|array_ndims({L})|array_pop_back({L})|array_pop_front({L})|array_position(2, {A})|array_positions({L}, 2)|array_prepend({A}, 0)|array_push_back({L}, 1)|array_push_front({L}, 1)|array_remove({A}, 1)|array_remove_all({L}, 1)|array_remove_at({A}, 0)|array_remove_n({L}, 1, 1)|array_repeat(1, 2)|array_replace({L}, 1, 2)|array_replace_all({L}, 1, 2)|array_replace_n({L}, 1, 2, 1)|array_resize({L}, 2)|array_reverse({A})|array_size({A})|array_slice({A}, 0, 1)|array_sort({A}, false)|array_to_string({A}, ',')|array_union({L}, {L})|arrays_overlap({A}, {B})|arrays_to_object(['a'], [1])|arrays_zip({A}, {B})|cardinality({L})|element_at({L}, 1)|empty({L})|generate_range(0, 3)|generate_series(1, 3)|get_field(named_struct('f', 1), 'f')|make_array(1)|make_list(1)|map('a', 1)|map_entries(map('a', 1))|map_extract(map('a', 1), 'a')|map_keys(map('a', 1))|map_values(map('a', 1))|map_contains_key(map('a', 1), 'a')|named_struct('a', 1)|range(0, 3)|row(1, 2)|string_to_array('a,b', ',')|string_to_list('a,b', ',', 'b')|strtok_to_array('a b')|struct(1, 2)|union_extract('{{"a":1}}', 'a')
list_any_value({M})|list_append({L}, 1)|list_cat({L}, {L})|list_concat({L}, {L})|list_contains({L}, 1)|list_dims({L})|list_distance(array(1.0), array(2.0))|list_distinct({L})|list_element({L}, 1)|list_empty({L})|list_except({L}, {L})|list_extract({L}, 1)|list_has({L}, 1)|list_has_all({L}, {L})|list_has_any({L}, {L})|list_indexof({L}, 1)|list_intersect({L}, {L})|list_join(array('a'), ',')|list_length({L})|list_max({L})|list_ndims({L})|list_pop_back({L})|list_pop_front({L})|list_position({L}, 1)|list_positions({L}, 1)|list_prepend({L}, 0)|list_push_back({L}, 1)|list_push_front({L}, 1)|list_remove({L}, 1)|list_remove_all({L}, 1)|list_remove_n({L}, 1, 1)|list_repeat(1, 2)|list_replace({L}, 1, 2)|list_replace_all({L}, 1, 2)|list_replace_n({L}, 1, 2, 1)|list_resize({L}, 2, 0)|list_reverse({L})|list_slice({L}, 1, 2)|list_sort({L}, false)|list_to_string(array('a'), ',')|list_union({L}, {L})
current_client()|current_database()|current_ip_address()|current_role()|current_role_type()|current_schema()|current_schemas()|current_session()|current_version()|current_warehouse()|current_user()|last_query_id()|sleep(0)|version()
"""
#: Named elsewhere in the tests, with the clauses they need.
ELSEWHERE = {"grouping", "grouping_id", "percentile_cont", "percentile_disc"}


@pytest.fixture(scope="module")
def session(spark):
    s = Session(spark)
    spark.sql("SELECT 1 x, 2.5D y, 'a' s, true b, '[1,2]' j UNION ALL SELECT 3, 1.5D, 'b', false, '[2,3]'").createOrReplaceTempView("every_fn")
    return s


def calls(text):
    return [c.strip() for line in text.strip().splitlines() for c in line.split("|")]


def test_no_name_is_left_out():
    scalar = {lex(c)[0].text for c in calls(SCALARS)}
    aggregate = {w.split("(")[0] for w in AGGREGATES.replace(", ", ",").split()}
    windows = {w.split("(")[0] for w in WINDOWS}
    assert set(FUNCTIONS) - scalar - aggregate - windows - ELSEWHERE == set()


def test_scalars(session):
    wrong = []
    for line in SCALARS.strip().splitlines():
        group = [c.strip() for c in line.split("|") if not c.strip().endswith("~")]
        try:
            session.execute("SELECT " + ", ".join(f"{c} AS c{i}" for i, c in enumerate(group))).collect()
        except Exception:
            for c in group:
                try:
                    session.execute(f"SELECT {c} AS c").collect()
                except Exception as e:
                    wrong.append((c, str(e)[:200]))
    assert not wrong


def test_aggregates(session):
    group = AGGREGATES.replace(", ", ",").split()
    session.execute("SELECT " + ", ".join(f"{c} AS c{i}" for i, c in enumerate(group)) + " FROM every_fn").collect()


def test_windows(session):
    over = [f"{w if w.endswith(')') else w + ')'} OVER (ORDER BY x)" for w in [*WINDOWS, "listagg(s, ',')", "array_agg(x)", "object_agg(s, x)", "sum(x)"]]
    assert session.execute("SELECT " + ", ".join(f"{w} AS c{i}" for i, w in enumerate(over)) + " FROM every_fn").count() == 2


def test_decimal_division_and_null_inputs(session):
    out = session.execute("SELECT 1 / 2 AS half, array_append(NULL, 1) AS a, split(NULL, ',') AS s, datediff(day, NULL, current_date()) AS d, object_keys(NULL) AS o").first()
    assert float(out.half) == 0.5 and out.a is None and out.s is None and out.d is None and out.o is None
