"""The registered queries: name, input table, join table, query text, and equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .api import query
from .catalog_text import TEXT

#: name: (input, join table or None, query, SQL). Queries with TOP sort by a unique key.
CATALOG: dict[str, tuple[str, str | None, str, str]] = {
    "select_cols": ("orders", None, "select a.o_orderkey, a.o_totalprice / 1000 as k", "SELECT o_orderkey, o_totalprice / 1000 AS k FROM orders"),
    "select_ordinals": ("orders", None, "select a1 as x, a[3] as y, a['o_custkey'] as z", "SELECT o_orderkey AS x, o_orderstatus AS y, o_custkey AS z FROM orders"),
    "select_star": ("nation", None, "select *", "SELECT * FROM nation"),
    "star_join": ("nation", "region", "select *, a.n_name as again join b on a.n_regionkey == b.r_regionkey", "SELECT n.*, r.*, n_name AS again FROM nation n JOIN region r ON n_regionkey = r_regionkey"),
    "star_sides": ("nation", "region", "select b.*, a.* join b on a.n_regionkey == b.r_regionkey", "SELECT r.*, n.* FROM nation n JOIN region r ON n_regionkey = r_regionkey"),
    "unpack": ("part", None, "select a.p_partkey, *a.p_name.split(' ')", "SELECT p_partkey, split_part(p_name, ' ', 1) AS col2, split_part(p_name, ' ', 2) AS col3 FROM part"),
    "except_cols": ("lineitem", None, "select * except a.l_tax, a.l_discount", "SELECT * EXCLUDE (l_tax, l_discount) FROM lineitem"),
    "where_bool": ("events", None, "select a.event_id, a.value where a.event_type == 'click' and a.value > 50 or a.user_id == 7", "SELECT event_id, value FROM events WHERE event_type = 'click' AND value > 50 OR user_id = 7"),
    "where_in": ("customer", None, "select a.c_custkey where a.c_mktsegment in ['BUILDING', 'FURNITURE'] and a.c_nationkey not in [1, 2, 3]", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'FURNITURE') AND c_nationkey NOT IN (1, 2, 3)"),
    "where_not_equal": ("events", None, "select a.event_id where a.event_type != 'click' and not a.value < 20", "SELECT event_id FROM events WHERE event_type IS DISTINCT FROM 'click' AND NOT value < 20"),
    "where_truthy": ("lineitem", None, "select a.l_orderkey, a.l_linenumber where a.l_tax and a.l_returnflag", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_tax <> 0 AND l_returnflag <> ''"),
    "where_chained": ("part", None, "select a.p_partkey where 10 <= a.p_size < 20", "SELECT p_partkey FROM part WHERE p_size >= 10 AND p_size < 20"),
    "like": ("part", None, "select a.p_partkey, a.p_name where like(a.p_name, '%ring') or LIKE(a.p_name, '_ed%')", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring' OR p_name LIKE '_ed%'"),
    "nr_enum": ("region", None, "select NR, NF, *", "SELECT row_number() OVER () AS NR, 2 AS NF, * FROM region"),
    "nr_filter": ("orders", None, "select NR, a.o_orderkey where NR > 5", "SELECT * FROM (SELECT row_number() OVER () AS NR, o_orderkey FROM orders) WHERE NR > 5"),
    "update": ("customer", None, "update a.c_mktsegment = 'X'", "SELECT * REPLACE ('X' AS c_mktsegment) FROM customer"),
    "update_where": ("customer", None, "update set a.c_mktsegment = a.c_name, a.c_name = a.c_mktsegment + '?' where a.c_acctbal < 0", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN c_mktsegment || '?' ELSE c_name END AS c_name, c_nationkey, c_acctbal, CASE WHEN c_acctbal < 0 THEN c_name ELSE c_mktsegment END AS c_mktsegment FROM customer"),
    "update_join": ("nation", "region", "update a.n_name = b.r_name + '/' + a.n_name join b on a.n_regionkey == b.r_regionkey where b.r_name != 'ASIA'", "SELECT n_nationkey, CASE WHEN r_name <> 'ASIA' THEN r_name || '/' || n_name ELSE n_name END AS n_name, n_regionkey FROM nation LEFT JOIN region ON n_regionkey = r_regionkey"),
    "unnest": ("part", None, "select a.p_partkey, unnest(a.p_name.split(' ')) as word", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part"),
    "unnest_chars": ("region", None, "select a.r_regionkey, UNNEST(a.r_name) as c", "SELECT r_regionkey, unnest(string_split(r_name, '')) AS c FROM region"),
    "inner_join": ("orders", "customer", "select a.o_orderkey, b.c_name join b on a.o_custkey == b.c_custkey where b.c_acctbal > 0", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey IS NOT DISTINCT FROM c_custkey WHERE c_acctbal > 0"),
    "left_join": ("customer", "orders", "select a.c_custkey, b.o_orderkey, bNF left join b on a.c_custkey == b.o_custkey", "SELECT c_custkey, o_orderkey, 6 AS bNF FROM customer LEFT JOIN orders ON c_custkey IS NOT DISTINCT FROM o_custkey"),
    "strict_left_join": ("nation", "region", "select a.n_name, b.r_name strict left join b on b.r_regionkey == a.n_regionkey", "SELECT n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey"),
    "multi_key_join": ("customer", "supplier", "select a.c_custkey, b.s_suppkey join b on a.c_nationkey = b.s_nationkey and a.c_custkey == b.s_suppkey", "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_custkey = s_suppkey"),
    "text_never_equals_number": ("nation", "region", "select a.n_name, b.r_name left join b on a.n_name == b.r_regionkey", "SELECT n_name, NULL::VARCHAR AS r_name FROM nation"),
    "nr_join": ("nation", "region", "select a.n_name, b.r_name join b on NR == bNR", "SELECT n_name, r_name FROM (SELECT *, row_number() OVER () AS k FROM nation) JOIN (SELECT *, row_number() OVER () AS k FROM region) USING (k)"),
    "join_agg": ("orders", "customer", "select b.c_mktsegment, sum(a.o_totalprice) as revenue, count(*) as n join b on a.o_custkey == b.c_custkey group by b.c_mktsegment", "SELECT c_mktsegment, sum(o_totalprice) AS revenue, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"),
    "count": ("lineitem", None, "select a.l_returnflag, COUNT(*) as n, count(a.l_tax) as m group by a.l_returnflag", "SELECT l_returnflag, count(*) AS n, count(*) AS m FROM lineitem GROUP BY 1"),
    "sum": ("lineitem", None, "select a.l_returnflag, sum(a.l_quantity) as q, SUM(a.l_linenumber) as k, sum(a.l_extendedprice * (1 - a.l_discount)) as revenue group by a.l_returnflag", "SELECT l_returnflag, sum(l_quantity) AS q, sum(l_linenumber)::BIGINT AS k, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem GROUP BY 1"),
    "min": ("lineitem", None, "select a.l_returnflag, min(a.l_extendedprice) as low, MIN(a.l_orderkey) as k group by a.l_returnflag", "SELECT l_returnflag, min(l_extendedprice) AS low, min(l_orderkey) AS k FROM lineitem GROUP BY 1"),
    "max": ("lineitem", None, "select a.l_returnflag, max(a.l_extendedprice) as high, MAX(a.l_orderkey) as k group by a.l_returnflag", "SELECT l_returnflag, max(l_extendedprice) AS high, max(l_orderkey) AS k FROM lineitem GROUP BY 1"),
    "avg": ("lineitem", None, "select a.l_linestatus, avg(a.l_quantity) as q group by a.l_linestatus", "SELECT l_linestatus, avg(l_quantity) AS q FROM lineitem GROUP BY 1"),
    "variance": ("lineitem", None, "select a.l_returnflag, VARIANCE(a.l_quantity) as v group by a.l_returnflag", "SELECT l_returnflag, var_pop(l_quantity) AS v FROM lineitem GROUP BY 1"),
    "median": ("lineitem", None, "select a.l_returnflag, MEDIAN(a.l_quantity) as m, median(a.l_extendedprice) as p group by a.l_returnflag", "SELECT l_returnflag, median(l_quantity) AS m, median(l_extendedprice) AS p FROM lineitem GROUP BY 1"),
    "array_agg": ("nation", None, "select a.n_regionkey, ARRAY_AGG(a.n_name) as names group by a.n_regionkey", "SELECT n_regionkey, list(n_name ORDER BY n_nationkey) AS names FROM nation GROUP BY 1"),
    "array_agg_callback": ("nation", None, "select a.n_regionkey, array_agg(a.n_name, lambda v: ';'.join(sorted(v)[:3])) as names group by a.n_regionkey", "SELECT n_regionkey, array_to_string(list_sort(list(n_name))[1:3], ';') AS names FROM nation GROUP BY 1"),
    "const_col": ("lineitem", None, "select a.l_returnflag, a.l_linestatus, count(1) as n group by a.l_returnflag, a.l_linestatus", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2"),
    "group_expr": ("orders", None, "select a.o_orderdate.year as y, a.o_orderpriority[0] as p, count(1) as n group by a.o_orderdate.year, a.o_orderpriority[0]", "SELECT year(o_orderdate) AS y, o_orderpriority[1] AS p, count(*) AS n FROM orders GROUP BY 1, 2"),
    "group_top": ("customer", None, "select top 5 a.c_nationkey, count(1) as n group by a.c_nationkey", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1 ORDER BY 1 LIMIT 5"),
    "global_agg": ("lineitem", None, "select count(*) as n, max(a.l_shipdate) as last, avg(a.l_tax) as t", "SELECT count(*) AS n, max(l_shipdate) AS last, avg(l_tax) AS t FROM lineitem"),
    "global_agg_empty": ("lineitem", None, "select count(*) as n where a.l_quantity < 0", "SELECT count(*) AS n FROM lineitem WHERE l_quantity < 0 HAVING count(*) > 0"),
    "group_noagg": ("region", None, "select a.r_name group by a.r_regionkey", "SELECT r_name FROM region"),
    "agg_of_text": ("orders", None, "select sum(a.o_orderpriority[0]) as s, max(a.o_orderpriority[:1]) as m, avg(a.o_orderpriority[0]) as v", "SELECT sum(o_orderpriority[1]::INT)::BIGINT AS s, max(o_orderpriority[1]::INT)::BIGINT AS m, avg(o_orderpriority[1]::INT) AS v FROM orders"),
    "order_asc": ("orders", None, "select a.o_orderkey, a.o_totalprice order by a.o_totalprice, a.o_orderkey asc", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY 2, 1"),
    "order_desc_top": ("orders", None, "select top 10 a.o_orderpriority, a.o_orderkey, a.o_totalprice where a.o_orderstatus == 'F' order by a.o_totalprice, a.o_orderkey desc", "SELECT o_orderpriority, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY 3 DESC, 2 DESC LIMIT 10"),
    "order_desc_ties": ("nation", None, "select top 7 a.n_name, a.n_regionkey order by a.n_regionkey desc", "SELECT n_name, n_regionkey FROM nation ORDER BY n_regionkey DESC, n_nationkey DESC LIMIT 7"),
    "limit_over_top": ("orders", None, "select top 50 a.o_orderkey order by a.o_orderkey limit 20", "SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 20"),
    "top_in_file_order": ("orders", None, "select top 25 a.o_orderkey, a.o_custkey", "SELECT o_orderkey, o_custkey FROM orders LIMIT 25"),
    "distinct": ("lineitem", None, "select distinct a.l_returnflag, a.l_linestatus", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem"),
    "distinct_count": ("lineitem", None, "select distinct count a.l_returnflag, a.l_linestatus", "SELECT count(*) AS count, l_returnflag, l_linestatus FROM lineitem GROUP BY 2, 3"),
    "distinct_top": ("orders", None, "select top 3 distinct a.o_orderpriority order by a.o_totalprice desc", "SELECT o_orderpriority FROM orders GROUP BY 1 ORDER BY max(o_totalprice) DESC LIMIT 3"),
    "floor_mod": ("part", None, "select a.p_partkey, (a.p_size - 25) // 7 as q, (a.p_size - 25) % 7 as r, (a.p_size - 25) // -7 as s", "SELECT p_partkey, floor((p_size - 25) / 7.0)::BIGINT AS q, (p_size - 25) - 7 * floor((p_size - 25) / 7.0)::BIGINT AS r, floor((p_size - 25) / -7.0)::BIGINT AS s FROM part"),
    "round_even": ("part", None, "select a.p_partkey, round(a.p_size / 2) as h, round(a.p_retailprice, 1) as p", "SELECT p_partkey, round_even(p_size / 2, 0)::BIGINT AS h, round_even(p_retailprice, 1) AS p FROM part"),
    "casts": ("orders", None, "select int(a.o_orderpriority[0]) + 1 as i, float(str(a.o_orderkey)) as f, int(a.o_totalprice) as t, str(a.o_orderkey) + '!' as s", "SELECT o_orderpriority[1]::BIGINT + 1 AS i, o_orderkey::DOUBLE AS f, trunc(o_totalprice)::BIGINT AS t, o_orderkey::VARCHAR || '!' AS s FROM orders"),
    "string_fns": ("part", None, "select a.p_name.upper() as u, len(a.p_name) as n, a.p_name.find('i') as f, a.p_name.replace('e', 'E') as r, a.p_name.startswith('s') as s, '-'.join(a.p_name.split(' ')) as j, a.p_name.count('e') as c", "SELECT upper(p_name) AS u, length(p_name) AS n, instr(p_name, 'i') - 1 AS f, replace(p_name, 'e', 'E') AS r, starts_with(p_name, 's') AS s, replace(p_name, ' ', '-') AS j, length(p_name) - length(replace(p_name, 'e', '')) AS c FROM part"),
    "slices": ("part", None, "select a.p_name[:3] as x, a.p_name[-3:] as y, a.p_name[1:4] as z, a.p_name.split(' ')[-1] as w", "SELECT left(p_name, 3) AS x, right(p_name, 3) AS y, substr(p_name, 2, 3) AS z, split_part(p_name, ' ', -1) AS w FROM part"),
    "regex": ("part", None, "select a.p_partkey, re.sub('[aeiou]', '*', a.p_name) as s, len(re.findall('[aeiou]', a.p_name)) as n where re.search('r[ie]', a.p_name)", "SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '*', 'g') AS s, len(regexp_extract_all(p_name, '[aeiou]')) AS n FROM part WHERE regexp_matches(p_name, 'r[ie]')"),
    "conditional": ("customer", None, "select a.c_custkey, 'debt' if a.c_acctbal < 0 else 'rich' if a.c_acctbal > 5000 else 'fair' as class_", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal > 5000 THEN 'rich' ELSE 'fair' END AS class_ FROM customer"),
    "fstrings": ("nation", None, "select f'{a.n_nationkey}:{a.n_name}' as label", "SELECT n_nationkey::VARCHAR || ':' || n_name AS label FROM nation"),
    "math_fns": ("part", None, "select a.p_partkey, math.floor(a.p_retailprice) as f, math.ceil(a.p_retailprice) as c, abs(a.p_size - 25) as d, a.p_size ** 2 as s, min(a.p_size, 10) as m", "SELECT p_partkey, floor(p_retailprice)::BIGINT AS f, ceil(p_retailprice)::BIGINT AS c, abs(p_size - 25) AS d, p_size * p_size AS s, least(p_size, 10) AS m FROM part"),
    "python_fallback": ("part", None, "select a.p_partkey, ' '.join(w.title() for w in reversed(a.p_name.split(' '))) as t", "SELECT p_partkey, upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] || ' ' || upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] AS t FROM part"),
    "json_fallback": ("events", None, "select a.event_id, len(json.loads(a.props)) as n", "SELECT event_id, len(json_keys(props)) AS n FROM events"),
    "update_count": ("customer", None, "update a.c_name = str(NU) + ':' + a.c_name where a.c_acctbal < 0", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN count(*) FILTER (c_acctbal < 0) OVER (ORDER BY k) || ':' || c_name ELSE c_name END AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM (SELECT *, row_number() OVER () AS k FROM customer)"),
    "numbers": ("part", None, "select a.p_partkey, a.p_size ** 9 as p, (a.p_retailprice - 1000) // 0.1 as q, a.p_retailprice % -7.5 as r", "SELECT p_partkey, (p_size::HUGEINT * p_size * p_size * p_size * p_size * p_size * p_size * p_size * p_size)::BIGINT AS p, floor((p_retailprice - 1000 - m1) / 0.1::DOUBLE + 0.5) AS q, CASE WHEN m2 > 0 THEN m2 - 7.5::DOUBLE ELSE m2 END AS r FROM (SELECT *, CASE WHEN fmod(p_retailprice - 1000, 0.1::DOUBLE) < 0 THEN fmod(p_retailprice - 1000, 0.1::DOUBLE) + 0.1::DOUBLE ELSE fmod(p_retailprice - 1000, 0.1::DOUBLE) END AS m1, fmod(p_retailprice, 7.5::DOUBLE) AS m2 FROM part)"),
    "unicode_text": ("part", None, "select a.p_partkey, len(re.findall('\\\\w', a.p_name + 'é٣')) as n, ('\u00a0 ' + a.p_name + '\u2003').strip() as s, re.search('z', a.p_name) is None as none", "SELECT p_partkey, length(replace(p_name, ' ', '')) + 2 AS n, p_name AS s, NOT contains(p_name, 'z') AS \"none\" FROM part"),
    "null_tests": ("customer", "orders", "select a.c_custkey, b.o_orderkey is None as lone left join b on a.c_custkey == b.o_custkey where b.o_orderkey is None or b.o_orderkey is not None", "SELECT c_custkey, o_orderkey IS NULL AS lone FROM customer LEFT JOIN orders ON c_custkey = o_custkey"),
    "unnest_function": ("part", None, "select a.p_partkey, UNNEST(pairs(a.p_name)) as w", "SELECT p_partkey, unnest([split_part(p_name, ' ', 1) || '!', split_part(p_name, ' ', 2) || '!']) AS w FROM part"),
}


#: Functions that queries of the catalogue call.
INIT = "def pairs(text):\n    return [w + '!' for w in text.split(' ')[:2]]\n"


def _run(name: str) -> Callable[[SparkSession, str], DataFrame]:
    a, b, text, _ = CATALOG[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = {side: spark.read.parquet(f"{sf_dir}/{t}.parquet") for side, t in (("a", a), ("b", b)) if t}
        return query(spark, text, tables, init_code=INIT).df

    run.__name__ = name
    return run


def user_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An expression that calls a function of the init code."""
    init = "def initials(text):\n    return ''.join(w[0] for w in text.split())\n"
    tables = {"a": spark.read.parquet(f"{sf_dir}/part.parquet")}
    return query(spark, "select a.p_partkey, initials(a.p_name) as i", tables, init_code=init).df


def from_clause(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FROM and JOIN name tables; columns are used by their bare names."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region")}
    return query(spark, "select n_name, r_name from nation join region on n_regionkey == r_regionkey where r_name != 'ASIA'", tables, bare_names=True).df


EXTRA = {
    "user_function": (user_function, "SELECT p_partkey, p_name[1] || split_part(p_name, ' ', 2)[1] AS i FROM part"),
    "from_clause": (from_clause, "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _run(name) for name in CATALOG} | {name: f for name, (f, _) in (EXTRA | TEXT).items()}


def oracle_sql() -> dict[str, str]:
    return {name: row[3] for name, row in CATALOG.items()} | {name: sql for name, (_, sql) in (EXTRA | TEXT).items()}
