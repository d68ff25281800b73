"""Queries in the language over the star-schema tables, each with SQL that gives the same rows.

key -> (query text, SQL)
"""

QUERIES: dict[str, tuple[str, str]] = {
    "scan_star": ("SELECT * FROM region", "SELECT * FROM region"),
    "scan_large": ("SELECT * FROM lineitem", "SELECT * FROM lineitem"),
    "project_positional": ("SELECT a1 AS k, a2 AS name FROM nation", "SELECT n_nationkey AS k, n_name AS name FROM nation"),
    "project_expr": ("SELECT a.o_orderkey AS k, a.o_totalprice * 2 AS dbl FROM orders", "SELECT o_orderkey AS k, o_totalprice * 2 AS dbl FROM orders"),
    "project_subscript": ("SELECT a['c_name'] AS nm, a[4] AS bal FROM customer", "SELECT c_name AS nm, c_acctbal AS bal FROM customer"),
    "project_header_inference": ("SELECT a2, a.n_regionkey, a['n_nationkey'], NF, a1 + 1 FROM nation", "SELECT n_name, n_regionkey, n_nationkey, CAST(3 AS BIGINT) AS NF, CAST(n_nationkey + 1 AS BIGINT) AS col5 FROM nation"),
    "star_mixed": ("SELECT a1 AS k, a.*, b.r_name AS r FROM nation JOIN region ON a3 == b1", "SELECT n_nationkey AS k, nation.*, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "star_b": ("SELECT b.*, a.n_name FROM nation JOIN region ON a.n_regionkey == b.r_regionkey", "SELECT region.*, n_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "select_except": ("SELECT * EXCEPT a.c_acctbal FROM customer", "SELECT * EXCLUDE (c_acctbal) FROM customer"),
    "select_except_two": ("SELECT * EXCEPT a1, a['o_orderdate'] FROM orders WHERE a.o_orderstatus == 'F'", "SELECT * EXCLUDE (o_orderkey, o_orderdate) FROM orders WHERE o_orderstatus = 'F'"),
    "filter_and_or": (
        "SELECT a.o_orderkey AS k FROM orders WHERE a.o_totalprice > 1000 and a.o_orderstatus == 'F' or a.o_orderpriority == '5-LOW'",
        "SELECT o_orderkey AS k FROM orders WHERE o_totalprice > 1000 AND o_orderstatus = 'F' OR o_orderpriority = '5-LOW'",
    ),
    "filter_in_list": ("SELECT a.p_partkey AS k FROM part WHERE a.p_type in ['ECONOMY', 'PROMO']", "SELECT p_partkey AS k FROM part WHERE p_type IN ('ECONOMY', 'PROMO')"),
    "filter_truthiness": ("SELECT a.l_orderkey AS k, a.l_linenumber AS l FROM lineitem WHERE a.l_tax and not a.l_discount", "SELECT l_orderkey AS k, l_linenumber AS l FROM lineitem WHERE l_tax <> 0 AND l_discount = 0"),
    "filter_chain": ("SELECT a1 AS k FROM orders WHERE 1000 < a.o_totalprice <= 50000 and 'LOW' in a.o_orderpriority", "SELECT o_orderkey AS k FROM orders WHERE o_totalprice > 1000 AND o_totalprice <= 50000 AND contains(o_orderpriority, 'LOW')"),
    "filter_none": ("SELECT a.doc_id AS d FROM documents WHERE a.lang is None", "SELECT doc_id AS d FROM documents WHERE lang IS NULL"),
    "filter_empty_result": ("SELECT a2, a1, NR FROM part WHERE int(a.p_size) % 2 == 3", "SELECT p_name, p_partkey, CAST(1 AS BIGINT) AS NR FROM part WHERE false"),
    "like_fn": ("SELECT a.p_partkey AS k FROM part WHERE like(a.p_name, '%small_widget%')", "SELECT p_partkey AS k FROM part WHERE p_name LIKE '%small_widget%'"),
    "record_number": ("SELECT NR AS nr, a.n_name AS nm FROM nation", "SELECT row_number() OVER (ORDER BY n_nationkey) AS nr, n_name AS nm FROM nation"),
    "record_number_large": ("SELECT a.l_returnflag AS f, MAX(NR) AS last, MIN(NR) AS first FROM lineitem GROUP BY a.l_returnflag", "SELECT l_returnflag AS f, max(r) AS last, min(r) AS first FROM (SELECT l_returnflag, row_number() OVER () AS r FROM lineitem) GROUP BY 1"),
    "field_count": ("SELECT NF AS nf, a1 AS k FROM region", "SELECT CAST(2 AS BIGINT) AS nf, r_regionkey AS k FROM region"),
    "top_n": ("SELECT TOP 10 a.o_orderkey AS k, a.o_totalprice AS p FROM orders ORDER BY a.o_totalprice, a.o_orderkey DESC", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 10"),
    "limit_desc_ties": ("SELECT a.n_nationkey AS k FROM nation ORDER BY a.n_regionkey DESC LIMIT 7", "SELECT n_nationkey AS k FROM nation ORDER BY n_regionkey DESC, n_nationkey DESC LIMIT 7"),
    "limit_asc_ties": ("SELECT a.n_nationkey AS k FROM nation ORDER BY a.n_regionkey LIMIT 7", "SELECT n_nationkey AS k FROM nation ORDER BY n_regionkey, n_nationkey LIMIT 7"),
    "limit_unsorted": ("SELECT a1 AS k FROM customer WHERE a.c_nationkey == 3 LIMIT 12", "SELECT c_custkey AS k FROM customer WHERE c_nationkey = 3 ORDER BY c_custkey LIMIT 12"),
    "limit_wins_over_top": ("SELECT TOP 9 a1 AS k FROM nation ORDER BY a1 LIMIT 4", "SELECT n_nationkey AS k FROM nation ORDER BY 1 LIMIT 4"),
    "order_by_expression": ("SELECT a.c_custkey AS k FROM customer ORDER BY len(a.c_name), -a.c_acctbal LIMIT 20", "SELECT c_custkey AS k FROM customer ORDER BY length(c_name), -c_acctbal LIMIT 20"),
    "distinct": ("SELECT DISTINCT a.o_orderpriority AS p FROM orders", "SELECT DISTINCT o_orderpriority AS p FROM orders"),
    "distinct_sort_limit": ("SELECT TOP 3 DISTINCT a.o_orderpriority AS p FROM orders ORDER BY a.o_orderpriority", "SELECT DISTINCT o_orderpriority AS p FROM orders ORDER BY p LIMIT 3"),
    "distinct_first_limit": ("SELECT DISTINCT a.n_regionkey AS r FROM nation LIMIT 3", "SELECT n_regionkey AS r FROM nation GROUP BY 1 ORDER BY min(n_nationkey) LIMIT 3"),
    "distinct_count": ("SELECT DISTINCT COUNT a.l_returnflag AS f FROM lineitem", "SELECT count(*) AS count, l_returnflag AS f FROM lineitem GROUP BY l_returnflag"),
    "group_count_sum": ("SELECT a.l_returnflag AS f, COUNT(*) AS n, SUM(a.l_quantity) AS q FROM lineitem GROUP BY a.l_returnflag", "SELECT l_returnflag AS f, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1"),
    "group_min_max": ("SELECT a.o_orderstatus AS s, MIN(a.o_totalprice) AS mn, MAX(a.o_totalprice) AS mx, COUNT(*) AS n FROM orders GROUP BY a.o_orderstatus", "SELECT o_orderstatus AS s, min(o_totalprice) AS mn, max(o_totalprice) AS mx, count(*) AS n FROM orders GROUP BY 1"),
    "group_avg": ("SELECT a.l_linestatus AS s, AVG(a.l_quantity) AS m FROM lineitem GROUP BY a.l_linestatus | SELECT a.s AS s, round(a.m, 6) AS m", "SELECT l_linestatus AS s, round_even(avg(l_quantity), 6) AS m FROM lineitem GROUP BY 1"),
    "group_variance": ("SELECT a.l_linestatus AS s, VARIANCE(a.l_quantity) AS v FROM lineitem GROUP BY a.l_linestatus | SELECT a.s AS s, round(a.v, 4) AS v", "SELECT l_linestatus AS s, round_even(var_pop(l_quantity), 4) AS v FROM lineitem GROUP BY 1"),
    "group_median": ("SELECT a.l_returnflag AS f, MEDIAN(a.l_quantity) AS m FROM lineitem GROUP BY a.l_returnflag", "SELECT l_returnflag AS f, median(l_quantity) AS m FROM lineitem GROUP BY 1"),
    "group_any_value": ("SELECT a.n_regionkey AS r, ANY_VALUE(a.n_name) AS nm FROM nation GROUP BY a.n_regionkey", "SELECT n_regionkey AS r, arg_min(n_name, n_nationkey) AS nm FROM nation GROUP BY 1"),
    "group_array_agg": ("SELECT a.n_regionkey AS r, ARRAY_AGG(a.n_name, lambda v: '|'.join(v)) AS l FROM nation GROUP BY a.n_regionkey", "SELECT n_regionkey AS r, string_agg(n_name, '|' ORDER BY n_nationkey) AS l FROM nation GROUP BY 1"),
    "group_array_agg_sorted": ("SELECT a.n_regionkey AS r, ARRAY_AGG(a.n_name, lambda v: '/'.join(sorted(v)[:2])) AS l FROM nation GROUP BY a.n_regionkey", "SELECT n_regionkey AS r, array_to_string(list_slice(list_sort(list(n_name)), 1, 2), '/') AS l FROM nation GROUP BY 1"),
    "group_multi_key": ("SELECT a.l_returnflag AS f, a.l_linestatus AS s, COUNT(*) AS n FROM lineitem GROUP BY a.l_returnflag, a.l_linestatus", "SELECT l_returnflag AS f, l_linestatus AS s, count(*) AS n FROM lineitem GROUP BY 1, 2"),
    "group_by_expression": ("SELECT a.p_size % 10 AS d, COUNT(*) AS n, SUM(1 if a.p_retailprice > 1000 else 0) AS dear FROM part GROUP BY a.p_size % 10", "SELECT CAST(p_size % 10 AS BIGINT) AS d, count(*) AS n, count(*) FILTER (p_retailprice > 1000) AS dear FROM part GROUP BY 1"),
    "group_constant_column": ("SELECT a.n_regionkey AS r, b.r_name AS nm, COUNT(1) AS n FROM nation JOIN region ON a.n_regionkey == b.r_regionkey GROUP BY a.n_regionkey", "SELECT n_regionkey AS r, r_name AS nm, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2"),
    "group_limit": ("SELECT TOP 3 a.p_size AS z, COUNT(*) AS n FROM part GROUP BY a.p_size", "SELECT p_size AS z, count(*) AS n FROM part GROUP BY 1 ORDER BY 1 LIMIT 3"),
    "group_text_numbers": ("SELECT str(a.p_size) AS num, a.p_brand AS br FROM part | SELECT a.br AS br, MAX(a.num) AS mx, SUM(a.num) AS s GROUP BY a.br", "SELECT p_brand AS br, CAST(max(p_size) AS BIGINT) AS mx, CAST(sum(p_size) AS BIGINT) AS s FROM part GROUP BY 1"),
    "global_agg": ("SELECT COUNT(*) AS n, MAX(a.o_totalprice) AS mx FROM orders", "SELECT count(*) AS n, max(o_totalprice) AS mx FROM orders"),
    "global_agg_empty": ("SELECT COUNT(*) AS n FROM orders WHERE a.o_totalprice < 0", "SELECT count(*) AS n FROM orders WHERE o_totalprice < 0 HAVING count(*) > 0"),
    "builtin_overload": ("SELECT a1 AS k, max(a.p_size, 10) AS m, min([a.p_size, 7]) AS s, sum([a.p_size, 1, 2]) AS t FROM part", "SELECT p_partkey AS k, CAST(greatest(p_size, 10) AS BIGINT) AS m, CAST(least(p_size, 7) AS BIGINT) AS s, CAST(p_size + 3 AS BIGINT) AS t FROM part"),
    "join_inner": ("SELECT a.n_name AS n, b.r_name AS r FROM nation JOIN region ON a.n_regionkey == b.r_regionkey", "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "join_inner_large": ("SELECT a.l_orderkey AS k, a.l_linenumber AS l, b.o_orderpriority AS p FROM lineitem INNER JOIN orders ON a.l_orderkey == b.o_orderkey", "SELECT l_orderkey AS k, l_linenumber AS l, o_orderpriority AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey"),
    "join_left": ("SELECT a.c_custkey AS c, b.o_orderkey AS o FROM customer LEFT JOIN orders ON a.c_custkey == b.o_custkey", "SELECT c_custkey AS c, o_orderkey AS o FROM customer LEFT JOIN orders ON c_custkey = o_custkey"),
    "join_left_field_count": ("SELECT a.n_name AS n, bNF AS f, bNR AS r FROM nation LEFT OUTER JOIN region ON a.n_nationkey == b.r_regionkey", "SELECT n_name AS n, CAST(2 AS BIGINT) AS f, CAST(r_regionkey + 1 AS BIGINT) AS r FROM nation LEFT JOIN region ON n_nationkey = r_regionkey"),
    "join_anti_emulated": ("SELECT a.p_partkey AS k FROM part LEFT JOIN supplier ON a.p_partkey == b.s_suppkey WHERE b.s_suppkey is None", "SELECT p_partkey AS k FROM part ANTI JOIN supplier ON p_partkey = s_suppkey"),
    "join_strict_left": ("SELECT a.c_custkey AS c, b.n_name AS n FROM customer STRICT LEFT JOIN nation ON a.c_nationkey == b.n_nationkey", "SELECT c_custkey AS c, n_name AS n FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"),
    "join_on_nr": ("SELECT a.n_name AS n, b.r_name AS r FROM nation JOIN region ON NR == b.NR", "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_nationkey = r_regionkey"),
    "join_null_key": ("SELECT a.item_id AS a, b.item_id AS b FROM eval_items JOIN eval_items ON a.lang == b.lang", "SELECT x.item_id AS a, y.item_id AS b FROM eval_items x JOIN eval_items y ON x.lang IS NOT DISTINCT FROM y.lang"),
    "join_unlike_types": ("SELECT a.n_name AS n, b.r_name AS r FROM nation LEFT JOIN region ON a.n_name == b.r_regionkey", "SELECT n_name AS n, CAST(NULL AS VARCHAR) AS r FROM nation"),
    "join_multi_key": ("SELECT a.l_orderkey AS k, a.l_linenumber AS l, b.l_quantity AS q FROM lineitem JOIN lineitem ON a.l_orderkey == b.l_orderkey and a.l_linenumber == b.l_linenumber", "SELECT x.l_orderkey AS k, x.l_linenumber AS l, y.l_quantity AS q FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber = y.l_linenumber"),
    "join_pipe_three": ("SELECT a.c_custkey AS c, b.n_regionkey AS rk FROM customer JOIN nation ON a.c_nationkey == b.n_nationkey | SELECT a.c AS c, b.r_name AS r JOIN region ON a.rk == b.r_regionkey", "SELECT c_custkey AS c, r_name AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "join_unnest": ("SELECT a.n_name AS n, UNNEST(b.r_name.split('A')) AS p FROM nation JOIN region ON a.n_regionkey == b.r_regionkey", "SELECT n_name AS n, unnest(string_split(r_name, 'A')) AS p FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "update_where": ("UPDATE SET a.n_name = a.n_name.lower() WHERE a.n_regionkey == 1 FROM nation", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN lower(n_name) ELSE n_name END AS n_name, n_regionkey FROM nation"),
    "update_swap": ("UPDATE SET a1 = a3, a3 = a1 FROM nation", "SELECT n_regionkey AS n_nationkey, n_name, n_nationkey AS n_regionkey FROM nation"),
    "update_limit_ignored": ("UPDATE SET a2 = 'x' FROM nation LIMIT 2", "SELECT n_nationkey, 'x' AS n_name, n_regionkey FROM nation"),
    "update_join_inner": ("UPDATE SET a.n_name = b.r_name JOIN region ON a.n_nationkey == b.r_regionkey FROM nation", "SELECT n_nationkey, CASE WHEN r_regionkey IS NOT NULL THEN r_name ELSE n_name END AS n_name, n_regionkey FROM nation LEFT JOIN region ON n_nationkey = r_regionkey"),
    "update_join_left": ("UPDATE SET a.n_name = b.r_name LEFT JOIN region ON a.n_nationkey == b.r_regionkey FROM nation", "SELECT n_nationkey, r_name AS n_name, n_regionkey FROM nation LEFT JOIN region ON n_nationkey = r_regionkey"),
    "unnest": ("SELECT a.p_partkey AS k, UNNEST(a.p_name.split(' ')) AS w FROM part", "SELECT p_partkey AS k, unnest(string_split(p_name, ' ')) AS w FROM part"),
    "pipe_having": ("SELECT a.o_custkey AS c, COUNT(*) AS n FROM orders GROUP BY a.o_custkey | SELECT * WHERE a.n > 12", "SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12"),
    "pipe_word_count": ("SELECT UNNEST(a.p_name.split(' ')) AS w FROM part | SELECT a.w AS w, COUNT(*) AS n GROUP BY a.w", "SELECT w, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1"),
    "pipe_order_record_number": ("SELECT a1 AS k, a2 AS p FROM part ORDER BY a.p_retailprice, a1 |> SELECT NR AS nr, a.k AS k", "SELECT row_number() OVER (ORDER BY p_retailprice, p_partkey) AS nr, p_partkey AS k FROM part"),
    "json_loads": ("SELECT a.event_id AS e, int(json.loads(a.props)['k']) AS k FROM events", "SELECT event_id AS e, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events"),
    "str_methods": ("SELECT a.c_custkey AS c, a.c_name.upper() AS u, len(a.c_name) AS n, a.c_name.find('#') AS f, a.c_name[:4] AS p, a.c_name[-3:] AS t FROM customer", "SELECT c_custkey AS c, upper(c_name) AS u, length(c_name) AS n, strpos(c_name, '#') - 1 AS f, c_name[1:4] AS p, right(c_name, 3) AS t FROM customer"),
    "str_replace_split": ("SELECT a1 AS k, a.p_name.replace(' ', '_') AS r, a.p_name.split(' ')[0] AS f, '-'.join(a.p_name.split(' ')) AS j, a.p_name.startswith('b') AS s FROM part", "SELECT p_partkey AS k, replace(p_name, ' ', '_') AS r, split_part(p_name, ' ', 1) AS f, replace(p_name, ' ', '-') AS j, starts_with(p_name, 'b') AS s FROM part"),
    "regex": ("SELECT a1 AS k, re.sub('[aeiou]', '*', a.p_name) AS r FROM part WHERE re.search('^[b-d].*t$', a.p_name)", "SELECT p_partkey AS k, regexp_replace(p_name, '[aeiou]', '*', 'g') AS r FROM part WHERE regexp_matches(p_name, '^[b-d].*t$')"),
    "list_comprehension": ("SELECT a1 AS k, '+'.join([w.upper() for w in a.p_name.split(' ') if len(w) > 4]) AS l FROM part", "SELECT p_partkey AS k, array_to_string(list_transform(list_filter(string_split(p_name, ' '), lambda w: length(w) > 4), lambda w: upper(w)), '+') AS l FROM part"),
    "int_division": ("SELECT a.l_orderkey AS k, a.l_linenumber AS l, (a.l_linenumber - 4) // 3 AS d, (a.l_linenumber - 4) % 3 AS m FROM lineitem", "SELECT l_orderkey AS k, l_linenumber AS l, CAST(floor((l_linenumber - 4) / 3) AS BIGINT) AS d, CAST((l_linenumber - 4) - 3 * floor((l_linenumber - 4) / 3) AS BIGINT) AS m FROM lineitem"),
    "conditional": ("SELECT a.o_orderkey AS k, 'big' if a.o_totalprice > 100000 else 'small' AS z FROM orders", "SELECT o_orderkey AS k, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS z FROM orders"),
    "f_string": ("SELECT f'{a.n_nationkey}: {a[\"n_name\"]}' AS t FROM nation", "SELECT n_nationkey || ': ' || n_name AS t FROM nation"),
    "format_in_python": ("SELECT a1 AS k, format(a.n_nationkey / 4, '.2f') AS t FROM nation", "SELECT n_nationkey AS k, format('{:.2f}', n_nationkey / 4.0) AS t FROM nation"),
    "date_parts": ("SELECT a.o_orderdate.year AS y, COUNT(*) AS n FROM orders GROUP BY a.o_orderdate.year", "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1"),
    "math_functions": ("SELECT a1 AS k, math.floor(a.p_retailprice) AS f, math.ceil(a.p_retailprice) AS c, round(math.sqrt(a.p_size), 6) AS s, abs(a.p_size - 20) AS d FROM part", "SELECT p_partkey AS k, CAST(floor(p_retailprice) AS BIGINT) AS f, CAST(ceil(p_retailprice) AS BIGINT) AS c, round_even(sqrt(p_size), 6) AS s, CAST(abs(p_size - 20) AS BIGINT) AS d FROM part"),
    "comments_and_semicolon": ("# a comment\nSELECT a1 AS k\n# another\nFROM region\nWHERE a1 > 1;", "SELECT r_regionkey AS k FROM region WHERE r_regionkey > 1"),
    "bench_filter_empty": ("SELECT a.l_returnflag AS f, a.l_quantity AS q, NR AS nr FROM lineitem WHERE int(a.l_quantity) % 2 == 3", "SELECT l_returnflag AS f, l_quantity AS q, CAST(1 AS BIGINT) AS nr FROM lineitem WHERE false"),
    "bench_select": ("SELECT a.l_returnflag AS f, a.l_quantity AS q, a.l_returnflag AS f2, NR AS nr FROM lineitem WHERE int(a.l_quantity) % 2 == 0", "SELECT f, q, f2, nr FROM (SELECT l_returnflag AS f, l_quantity AS q, l_returnflag AS f2, row_number() OVER () AS nr FROM lineitem) WHERE CAST(q AS BIGINT) % 2 = 0"),
    "bench_group": ("SELECT MAX(a.l_quantity) AS m, COUNT(*) AS n, a.l_returnflag AS f FROM lineitem WHERE int(a.l_quantity) > 15 GROUP BY a.l_returnflag", "SELECT max(l_quantity) AS m, count(*) AS n, l_returnflag AS f FROM lineitem WHERE l_quantity >= 16 GROUP BY 3"),
    "university_top_scores": ("SELECT TOP 20 a.ranking_id AS r, a.university_name AS u, a.total_score AS s FROM university_ranking WHERE a.university_name is not None and a.total_score is not None and a.total_score <= 100 ORDER BY a.total_score, a.ranking_id DESC", "SELECT ranking_id AS r, university_name AS u, total_score AS s FROM university_ranking WHERE university_name IS NOT NULL AND total_score <= 100 ORDER BY total_score DESC, ranking_id DESC LIMIT 20"),
    "country_capitals_join": ("SELECT a.country AS c, b.capital AS p FROM countries LEFT JOIN country_capitals ON a.country == b.country", "SELECT c.country AS c, p.capital AS p FROM countries c LEFT JOIN country_capitals p ON c.country = p.country"),
}
