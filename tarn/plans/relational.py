"""Queries of relational operators: (dialect SQL, the same in DuckDB's SQL).

Sums of doubles are rounded, and every result column has a name."""

QUERIES: dict[str, tuple[str, str | None]] = {}


def add(name: str, sql: str, oracle: str | None = "") -> None:
    """oracle: "" if DuckDB runs the same text, None if SQL can't express it."""
    QUERIES[name] = (sql, sql if oracle == "" else oracle)


add(
    "top_priority_by_nation",
    """SELECT n_name, o_orderpriority, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       GROUP BY n_name, o_orderpriority
       QUALIFY row_number() OVER (PARTITION BY n_name ORDER BY revenue DESC, o_orderpriority) = 1""",
)
add(
    "pricing_summary",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
              round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
       FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
)
add("scan_filter_project", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem WHERE l_quantity < 10 AND l_discount BETWEEN 0.02 AND 0.05 AND l_returnflag IN ('A', 'R')")
add("select_exclude", "SELECT * EXCLUDE (c_name, c_acctbal) FROM customer", "SELECT * EXCLUDE (c_name, c_acctbal) FROM customer")
add("alias_in_where", "SELECT o_orderkey, o_totalprice / 1000 AS thousands FROM orders WHERE thousands > 400")
add("like_any", "SELECT p_partkey, p_name FROM part WHERE p_type LIKE ANY ('%BRASS', 'SMALL%') OR p_name ILIKE ANY ('part 1%', '%99')", "SELECT p_partkey, p_name FROM part WHERE p_type LIKE '%BRASS' OR p_type LIKE 'SMALL%' OR p_name ILIKE 'part 1%' OR p_name ILIKE '%99'")
add("rlike_whole_text", "SELECT c_custkey FROM customer WHERE c_name RLIKE '.*[13579]' AND NOT c_mktsegment RLIKE 'B.*'", "SELECT c_custkey FROM customer WHERE regexp_full_match(c_name, '.*[13579]') AND NOT regexp_full_match(c_mktsegment, 'B.*')")
add("case_coalesce_distinct_from", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'small' END AS size, coalesce(nullif(o_orderstatus, 'F'), 'none') AS st FROM orders WHERE o_orderstatus IS DISTINCT FROM 'P'")
add("in_subquery", "SELECT count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
add("exists_correlated", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)")
add("scalar_subquery", "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > (SELECT avg(s_acctbal) FROM supplier)")
add("correlated_scalar", "SELECT o_orderkey FROM orders o WHERE o_totalprice >= (SELECT max(p.o_totalprice) FROM orders p WHERE p.o_custkey = o.o_custkey)")
add("nested_cte", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey), ranked AS (SELECT b.*, rank() OVER (ORDER BY total DESC) AS rk FROM big b) SELECT o_custkey, round(total, 2) AS total, rk FROM ranked WHERE rk <= 20")
add("recursive_cte", "WITH RECURSIVE steps(n, f) AS (SELECT 1, 1 UNION ALL SELECT n + 1, f * 2 FROM steps WHERE n < 12) SELECT cast(n AS bigint) AS n, cast(f AS bigint) AS f FROM steps")
# Joins
add("join_inner", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
add("join_left", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_custkey")
add("join_right", "SELECT s_suppkey, n_name FROM nation RIGHT JOIN supplier ON s_nationkey = n_nationkey AND n_regionkey = 1")
add("join_full", "SELECT coalesce(a.k, b.k) AS k, a.n AS customers, b.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) a FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k")
add("join_cross", "SELECT r.r_name, x.t FROM region r CROSS JOIN (SELECT 'a' AS t UNION ALL SELECT 'b') x")
add("join_theta", "SELECT a.r_name AS low, b.r_name AS high FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey")
add("join_semi", "SELECT c_custkey, c_name FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 450000", "SELECT c_custkey, c_name FROM customer SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 450000")
add("join_anti", "SELECT c_custkey, c_name FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey, c_name FROM customer ANTI JOIN orders ON c_custkey = o_custkey")
add("join_using", "SELECT k, count(*) AS n FROM (SELECT o_orderkey AS k FROM orders) o JOIN (SELECT l_orderkey AS k FROM lineitem) l USING (k) GROUP BY k")
add("join_natural", "SELECT n_name, r_name FROM (SELECT n_name, n_regionkey AS rk FROM nation) a NATURAL JOIN (SELECT r_name, r_regionkey AS rk FROM region) b")
# Aggregation
add("group_having_distinct", "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY l_suppkey HAVING count(*) > 10")
add("global_aggregate_empty", "SELECT count(*) AS n, sum(l_quantity) AS s, max(l_shipdate) AS m FROM lineitem WHERE l_quantity < 0")
add("grouping_sets", "SELECT l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus) AS g, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
add("cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
add("rollup", "SELECT c_nationkey, c_mktsegment, grouping(c_mktsegment) AS g, count(*) AS n FROM customer GROUP BY ROLLUP (c_nationkey, c_mktsegment)")
add(
    "ordered_aggregates",
    "SELECT l_returnflag, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY l_quantity), 4) AS p50, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY l_extendedprice DESC), 4) AS p90 FROM lineitem GROUP BY l_returnflag",
    "SELECT l_returnflag, round(quantile_cont(l_quantity, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.1), 4) AS p90 FROM lineitem GROUP BY l_returnflag",
)
add("listagg", "SELECT n_regionkey, listagg(n_name, '|') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, coalesce(string_agg(n_name, '|' ORDER BY n_name), '') AS names FROM nation GROUP BY n_regionkey")
add("listagg_empty", "SELECT listagg(n_name, ',') AS names FROM nation WHERE n_nationkey < 0", "SELECT '' AS names")
add(
    "boolean_aggregates",
    "SELECT c_nationkey, booland_agg(c_acctbal > 0) AS every, boolor_agg(c_acctbal > 9000) AS some, boolxor_agg(c_acctbal > 9900) AS one FROM customer GROUP BY c_nationkey",
    "SELECT c_nationkey, bool_and(c_acctbal > 0) AS every, bool_or(c_acctbal > 9000) AS some, count_if(c_acctbal > 9900) = 1 AS one FROM customer GROUP BY c_nationkey",
)
add(
    "statistics_aggregates",
    "SELECT l_returnflag, round(variance(l_quantity), 6) AS v, round(var_population(l_quantity), 6) AS vp, round(stddev(l_discount), 8) AS sd, round(stddev_pop(l_discount), 8) AS sp, round(median(l_tax), 6) AS md, round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_samp(l_quantity, l_discount), 6) AS cs, round(covar_pop(l_quantity, l_discount), 6) AS cp FROM lineitem GROUP BY l_returnflag",
    "SELECT l_returnflag, round(var_samp(l_quantity), 6) AS v, round(var_pop(l_quantity), 6) AS vp, round(stddev_samp(l_discount), 8) AS sd, round(stddev_pop(l_discount), 8) AS sp, round(median(l_tax), 6) AS md, round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_samp(l_quantity, l_discount), 6) AS cs, round(covar_pop(l_quantity, l_discount), 6) AS cp FROM lineitem GROUP BY l_returnflag",
)
add("regression_aggregates", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS icpt, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, regr_count(l_extendedprice, l_quantity) AS n, round(regr_avgx(l_extendedprice, l_quantity), 6) AS ax, round(regr_avgy(l_extendedprice, l_quantity), 4) AS ay, round(regr_sxx(l_extendedprice, l_quantity) / 1000, 2) AS sxx, round(regr_sxy(l_extendedprice, l_quantity) / 1000000, 2) AS sxy FROM lineitem")
add("bit_aggregates", "SELECT l_returnflag, bit_and(l_orderkey) AS a, bit_or(l_orderkey) AS o, bit_xor(l_orderkey) AS x FROM lineitem GROUP BY l_returnflag")
add(
    "array_aggregates",
    "SELECT n_regionkey, array_agg(n_nationkey) WITHIN GROUP (ORDER BY n_nationkey DESC) AS ks, array_unique_agg(n_regionkey) AS rs, object_agg(n_name, n_nationkey) AS o FROM nation WHERE n_nationkey < 10 GROUP BY n_regionkey",
    "SELECT n_regionkey, replace(CAST(list(n_nationkey ORDER BY n_nationkey DESC) AS VARCHAR), ', ', ',') AS ks, '[' || n_regionkey || ']' AS rs, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' ORDER BY n_name) || '}' AS o FROM nation WHERE n_nationkey < 10 GROUP BY n_regionkey",
)
add("approximate_aggregates", "SELECT l_returnflag, approx_distinct(l_orderkey) AS d, approx_median(l_quantity) AS m, approx_percentile_cont(l_extendedprice, 0.9) AS p FROM lineitem GROUP BY l_returnflag", None)
# Windows
add("window_ranks", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS dr, ntile(3) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nt, round(percent_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 6) AS pr, round(cume_dist() OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 6) AS cd FROM orders")
add("window_offsets", "SELECT o_orderkey, lag(o_orderkey, 1, 0) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nxt, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS f, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, nth_value(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS n2 FROM orders")
add("window_frames", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s3, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 1000 PRECEDING AND 1000 FOLLOWING) AS near FROM orders")
add("conditional_true_event", "SELECT event_id, conditional_true_event(event_type = 'click') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS e FROM events", "SELECT event_id, CAST(count_if(event_type = 'click') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e FROM events")
add("qualify_top_per_group", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
# Order and limits
add("top_n", "SELECT TOP 10 o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
add("fetch_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 5 ROWS FETCH NEXT 7 ROWS ONLY", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7 OFFSET 5")
add("limit_offset", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10 OFFSET 3")
add("null_ordering", "SELECT k, row_number() OVER (ORDER BY k) AS up, row_number() OVER (ORDER BY k DESC) AS down FROM (SELECT nullif(r_regionkey, 2) AS k FROM region)", "SELECT k, row_number() OVER (ORDER BY k NULLS LAST) AS up, row_number() OVER (ORDER BY k DESC NULLS FIRST) AS down FROM (SELECT nullif(r_regionkey, 2) AS k FROM region)")
# Set operations
add("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier")
add("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier")
add("intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier")
add("except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey AS k FROM supplier")
add("intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey AS k FROM supplier")
add("except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey AS k FROM supplier")
add("select_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
add("values_source", "SELECT column1 AS a, column2 AS b FROM VALUES (1, 'x'), (2, 'y'), (3, NULL)", "SELECT * FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) t(a, b)")
# Pivot
_STATUS = "SELECT o_orderpriority, o_orderstatus, o_totalprice FROM orders"
add("pivot_list", f"SELECT o_orderpriority, round(F, 2) AS f, round(O, 2) AS o FROM ({_STATUS}) PIVOT (sum(o_totalprice) FOR o_orderstatus IN ('F', 'O'))", "SELECT o_orderpriority, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 2) AS f, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 2) AS o FROM orders GROUP BY o_orderpriority")
add("pivot_any", "SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_orderkey FROM orders) PIVOT (count(o_orderkey) FOR o_orderstatus IN (ANY ORDER BY o_orderstatus))", 'SELECT o_orderpriority, nullif(count(*) FILTER (WHERE o_orderstatus = \'F\'), 0) AS "F", nullif(count(*) FILTER (WHERE o_orderstatus = \'O\'), 0) AS "O", nullif(count(*) FILTER (WHERE o_orderstatus = \'P\'), 0) AS "P" FROM orders GROUP BY o_orderpriority')
add("pivot_subquery_default", "SELECT * FROM (SELECT c_nationkey, c_mktsegment, c_custkey FROM customer) PIVOT (max(c_custkey) FOR c_mktsegment IN (SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')) DEFAULT ON NULL (0))", "SELECT c_nationkey, coalesce(max(c_custkey) FILTER (WHERE c_mktsegment = 'BUILDING'), 0) AS \"BUILDING\", coalesce(max(c_custkey) FILTER (WHERE c_mktsegment = 'MACHINERY'), 0) AS \"MACHINERY\" FROM customer GROUP BY c_nationkey")
_PARTS = "SELECT p_partkey, nullif(p_size, 1) AS size, cast(p_partkey % 7 AS int) AS rest FROM part"
add("unpivot", f"SELECT p_partkey, name, v FROM ({_PARTS}) UNPIVOT (v FOR name IN (size, rest))", f"WITH p AS ({_PARTS}) SELECT * FROM (SELECT p_partkey, 'size' AS name, size AS v FROM p UNION ALL SELECT p_partkey, 'rest', rest FROM p) WHERE v IS NOT NULL")
add("unpivot_include_nulls", f"SELECT p_partkey, name, v FROM ({_PARTS}) UNPIVOT INCLUDE NULLS (v FOR name IN (size, rest))", f"WITH p AS ({_PARTS}) SELECT p_partkey, 'size' AS name, size AS v FROM p UNION ALL SELECT p_partkey, 'rest', rest FROM p")
# Flatten and time buckets
add("lateral_flatten", "SELECT e.event_id, f.key, f.value FROM events e, LATERAL FLATTEN(INPUT => e.props) f", "SELECT event_id, j.key AS key, CAST(j.value AS VARCHAR) AS value FROM events, json_each(props) j")
add("flatten_array", "SELECT v.vec_id, f.index, round(cast(f.value AS double), 4) AS x FROM (SELECT vec_id, to_json(slice(embedding, 1, 4)) AS j FROM embeddings) v, LATERAL FLATTEN(INPUT => v.j) f", "SELECT vec_id, CAST(i AS BIGINT) AS index, round(CAST(CAST(embedding[i + 1] AS VARCHAR) AS DOUBLE), 4) AS x FROM embeddings, range(4) r(i) WHERE i < len(embedding)")
add("flatten_outer", "SELECT r_regionkey, f.index, f.value FROM region, LATERAL FLATTEN(INPUT => iff(r_regionkey % 2 = 0, array_construct(r_regionkey, 7), '[]'), OUTER => true) f", "SELECT r_regionkey, CAST(0 AS BIGINT) AS index, CAST(r_regionkey AS VARCHAR) AS value FROM region WHERE r_regionkey % 2 = 0 UNION ALL SELECT r_regionkey, 1, '7' FROM region WHERE r_regionkey % 2 = 0 UNION ALL SELECT r_regionkey, NULL, NULL FROM region WHERE r_regionkey % 2 = 1")
_NESTED = "object_construct('a', array_construct(r_regionkey, 2), 'b', 5)"
add(
    "flatten_recursive",
    f"SELECT r_regionkey, f.key, f.path, f.index, f.value FROM region, LATERAL FLATTEN(INPUT => {_NESTED}, RECURSIVE => true) f",
    "SELECT r_regionkey, 'a' AS key, 'a' AS path, CAST(NULL AS BIGINT) AS index, '[' || r_regionkey || ',2]' AS value FROM region UNION ALL SELECT r_regionkey, NULL, 'a[0]', 0, CAST(r_regionkey AS VARCHAR) FROM region UNION ALL SELECT r_regionkey, NULL, 'a[1]', 1, '2' FROM region UNION ALL SELECT r_regionkey, 'b', 'b', NULL, '5' FROM region",
)
add("flatten_mode", f"SELECT r_regionkey, f.key FROM region, LATERAL FLATTEN(INPUT => {_NESTED}, MODE => 'OBJECT') f UNION ALL SELECT r_regionkey, f.key FROM region, LATERAL FLATTEN(INPUT => {_NESTED}, MODE => 'ARRAY') f", "SELECT r_regionkey, unnest(['a', 'b']) AS key FROM region")
add("flatten_path", f"SELECT r_regionkey, f.path, f.index, f.value, f.this FROM region, LATERAL FLATTEN(INPUT => {_NESTED}, PATH => 'a') f", "SELECT r_regionkey, 'a[0]' AS path, CAST(0 AS BIGINT) AS index, CAST(r_regionkey AS VARCHAR) AS value, '[' || r_regionkey || ',2]' AS this FROM region UNION ALL SELECT r_regionkey, 'a[1]', 1, '2', '[' || r_regionkey || ',2]' FROM region")
add("flatten_cte", f"WITH c AS (SELECT r_name, {_NESTED} AS j FROM region) SELECT c.r_name, f.key FROM c, TABLE(FLATTEN(c.j)) f", "SELECT r_name, unnest(['a', 'b']) AS key FROM region")
add("flatten_star", "SELECT f.* EXCLUDE (seq) FROM TABLE(FLATTEN(INPUT => '[1,null,\"x\"]')) f", """SELECT * FROM (VALUES (CAST(NULL AS VARCHAR), '[0]', 0::BIGINT, '1', '[1,null,"x"]'), (NULL, '[1]', 1, NULL, '[1,null,"x"]'), (NULL, '[2]', 2, '"x"', '[1,null,"x"]')) t(key, path, index, value, this)""")
add("approximate_close", "SELECT l_returnflag, abs(approx_distinct(l_orderkey) - count(DISTINCT l_orderkey)) <= 0.15 * count(DISTINCT l_orderkey) AS d, abs(approx_median(l_quantity) - median(l_quantity)) <= 1 AS m, abs(approx_percentile_cont(l_extendedprice, 0.9) / percentile_cont(0.9) WITHIN GROUP (ORDER BY l_extendedprice) - 1) < 0.02 AS p FROM lineitem GROUP BY l_returnflag", "SELECT DISTINCT l_returnflag, true AS d, true AS m, true AS p FROM lineitem")
add("json_path", "SELECT event_id, props:k::int AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
add("time_buckets", "SELECT date_trunc('hour', ts) AS h, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1, 2")
add("session_gaps", "WITH g AS (SELECT user_id, ts, event_id, iff(datediff('minute', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) > 30, 1, 0) AS cut FROM events) SELECT user_id, sum(cut) + 1 AS sessions FROM g GROUP BY user_id", "WITH g AS (SELECT user_id, ts, event_id, CASE WHEN date_diff('minute', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) > 30 THEN 1 ELSE 0 END AS cut FROM events) SELECT user_id, CAST(sum(cut) + 1 AS BIGINT) AS sessions FROM g GROUP BY user_id")
