"""The registered queries over the demo model, each with an independent DuckDB formulation."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.demo import dim, engine, metric
from sparkloom.session import Engine
from sparkloom.sources.seed import cardinality

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
KEY = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice)"


def rounded(df: DataFrame, digits: int = 2) -> DataFrame:
    """Doubles rounded, so that the order of floating-point sums doesn't show."""
    return df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def add(name: str, sql: str | None, request: dict | None = None, digits: int = 2, user: dict | None = None, now: datetime | None = None, build=None, **options) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir, **({"now": now} if now else {}), **options)
        e.set_user(user)
        return rounded(build(e) if build else e.query(**request), digits)

    QUERIES[name] = run
    if sql:
        SQL[name] = sql


def q(metrics="", dimensions="", **more) -> dict:
    return {"metrics": metrics.split(), "dimensions": dimensions.split(), **more}


def R(x: str, n: int = 2) -> str:  # noqa: N802
    return f"round(({x})::DOUBLE, {n})"


LO = "lineitem LEFT JOIN orders ON l_orderkey = o_orderkey"
LOC = f"{LO} LEFT JOIN customer ON o_custkey = c_custkey"

# ---- aggregates
add("simple_sum_by_dim", f"SELECT l_returnflag AS lineitem_returnflag, {R('sum(l_extendedprice)')} AS lineitem_revenue FROM lineitem WHERE l_quantity > 25 GROUP BY 1", q("lineitem.revenue", "lineitem.returnflag", where=[{"field": "lineitem.quantity", "expression": "greater_than", "value": 25}]))
add("simple_all_aggs", f"SELECT l_returnflag AS lineitem_returnflag, count(*) AS lineitem_lines, count(DISTINCT l_partkey) AS lineitem_parts_sold, {R('sum(l_extendedprice)')} AS lineitem_revenue, {R('avg(l_extendedprice)')} AS lineitem_avg_price, {R('min(l_extendedprice)')} AS lineitem_min_price, {R('max(l_extendedprice)')} AS lineitem_max_price FROM lineitem GROUP BY 1", q("lineitem.lines lineitem.parts_sold lineitem.revenue lineitem.avg_price lineitem.min_price lineitem.max_price", "lineitem.returnflag"))
add("median_percentile", f"SELECT l_returnflag AS lineitem_returnflag, {R('median(l_extendedprice)', 4)} AS lineitem_median_price, {R('quantile_cont(l_extendedprice, 0.75)', 4)} AS lineitem_p75_price FROM lineitem GROUP BY 1", q("lineitem.median_price lineitem.p75_price", "lineitem.returnflag"), digits=4)
add("global_agg", f"SELECT {R('sum(l_extendedprice)')} AS lineitem_revenue, count(*) AS lineitem_lines FROM lineitem", q("lineitem.revenue lineitem.lines"))
add("distinct_dims", "SELECT DISTINCT l_returnflag AS lineitem_returnflag, l_linestatus AS lineitem_linestatus FROM lineitem", q("", "lineitem.returnflag lineitem.linestatus"))
add("raw_rows", f"SELECT {KEY.replace('l_shipdate', 'l_shipdate').replace('l_extendedprice)', 'l_extendedprice)')} IS NOT NULL AS ok, l_returnflag AS lineitem_returnflag, {R('l_extendedprice')} AS lineitem_revenue, {R('l_quantity')} AS lineitem_total_quantity FROM lineitem", build=lambda e: e.query(**q("lineitem.revenue lineitem.total_quantity", "lineitem.line_id lineitem.returnflag")).selectExpr("lineitem_line_id is not null as ok", "lineitem_returnflag", "lineitem_revenue", "lineitem_total_quantity"))
add("raw_rows_order", f"SELECT o_orderkey AS orders_orderkey, o_orderstatus AS orders_status, {R('o_totalprice')} AS orders_total_price FROM orders", q("orders.total_price", "orders.orderkey orders.status"))
add("derived_table_view", "SELECT o_orderstatus AS big_orders_status, count(*) AS big_orders_orders FROM orders WHERE o_totalprice > 150000 AND o_orderstatus <> 'P' GROUP BY 1", q("big_orders.orders", "big_orders.status"), user={"least": 150000})
add("tier_dim", "SELECT CASE WHEN l_extendedprice < 1000 THEN 'Below 1000' WHEN l_extendedprice < 20000 THEN '[1000,20000)' WHEN l_extendedprice < 50000 THEN '[20000,50000)' WHEN l_extendedprice >= 50000 THEN '[50000,inf)' ELSE 'Unknown' END AS lineitem_price_tier, count(*) AS lineitem_lines FROM lineitem GROUP BY 1", q("lineitem.lines", "lineitem.price_tier"))
add("case_dim", "SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' WHEN o_orderpriority = '3-MEDIUM' THEN 'medium' ELSE 'low' END AS orders_priority_group, count(*) AS orders_orders FROM orders GROUP BY 1", q("orders.orders", "orders.priority_group"))
add("yesno_dim", "SELECT l_discount > 0.05 AS lineitem_is_discounted, count(*) AS lineitem_lines FROM lineitem GROUP BY 1", q("lineitem.lines", "lineitem.is_discounted"))
add("dim_filter", "SELECT CASE WHEN l_quantity > 25 THEN l_returnflag END AS lineitem_flag_of_big, count(*) AS lineitem_lines FROM lineitem GROUP BY 1", q("lineitem.lines", "lineitem.flag_of_big"))
add("measure_filters", f"SELECT l_linestatus AS lineitem_linestatus, {R('sum(CASE WHEN l_returnflag = $$R$$ THEN l_extendedprice END)').replace('$$R$$', chr(39) + 'R' + chr(39))} AS lineitem_returned_revenue, count(CASE WHEN l_quantity >= 40 AND l_discount > 0.05 THEN l_orderkey END) AS lineitem_big_lines FROM lineitem GROUP BY 1", q("lineitem.returned_revenue lineitem.big_lines", "lineitem.linestatus"))
add("formula_measure", f"SELECT l_returnflag AS lineitem_returnflag, {R('sum(l_extendedprice) / nullif(count(*), 0)')} AS lineitem_avg_line, {R('sum(l_extendedprice * l_discount) / sum(l_extendedprice)', 6)} AS lineitem_discount_share FROM lineitem GROUP BY 1", None, build=lambda e: e.query(**q("lineitem.avg_line lineitem.discount_share", "lineitem.returnflag")).selectExpr("lineitem_returnflag", "cast(round(lineitem_avg_line, 2) as double) lineitem_avg_line", "round(lineitem_discount_share, 6) lineitem_discount_share"), digits=6)
add("typed_measures", "SELECT l_linestatus AS lineitem_linestatus, max(l_shipdate) AS lineitem_last_ship, max(l_quantity) > 49 AS lineitem_any_big, string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS lineitem_flags FROM lineitem GROUP BY 1", q("lineitem.last_ship lineitem.any_big lineitem.flags", "lineitem.linestatus"))
add("select_raw_sql", "SELECT l_returnflag AS lineitem_returnflag, l_linenumber % 2 AS odd, count(*) AS lineitem_lines FROM lineitem GROUP BY 1, 2", {**q("lineitem.lines", "lineitem.returnflag"), "select_raw_sql": ["lineitem.l_linenumber % 2 as odd"]})
add("topk_desc_nulls_last", f"SELECT o_orderkey AS orders_orderkey, {R('sum(o_totalprice)')} AS orders_total_price FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC NULLS LAST, 1 LIMIT 10", {**q("orders.total_price", "orders.orderkey", order_by=[{"field": "orders.total_price", "sort": "desc"}, {"field": "orders.orderkey"}], limit=10), "force_group_by": True})
add("order_text_limit", "SELECT o_orderstatus AS orders_status, count(*) AS orders_orders FROM orders GROUP BY 1 ORDER BY 1 LIMIT 2", q("orders.orders", "orders.status", order_by="orders.status asc nulls first", limit=2))

# ---- filters
_flag, _prio = "l_returnflag", "o_orderpriority"
for _name, _value, _test in [
    ("less_than", 10, "l_quantity < 10"), ("less_or_equal_than", 10, "l_quantity <= 10"), ("equal_to", 10, "l_quantity = 10"), ("not_equal_to", 10, "l_quantity <> 10"), ("greater_or_equal_than", "40", "l_quantity >= 40"), ("greater_than", 40, "l_quantity > 40"), ("isin", [1, 2, "3"], "l_quantity IN (1, 2, 3)"), ("isnotin", [1, 2, 3], "l_quantity NOT IN (1, 2, 3)"),
]:
    add(f"filter_expr_{_name}", f"SELECT l_returnflag AS lineitem_returnflag, count(*) AS lineitem_lines FROM lineitem WHERE {_test} GROUP BY 1", q("lineitem.lines", "lineitem.returnflag", where=[{"field": "lineitem.quantity", "expression": _name, "value": _value}]))
for _name, _value, _test in [
    ("like", "%-H%", "LIKE '%-H%'"), ("contains", "HIGH", "LIKE '%HIGH%'"), ("does_not_contain", "HIGH", "NOT LIKE '%HIGH%'"), ("contains_case_insensitive", "high", "ILIKE '%high%'"), ("does_not_contain_case_insensitive", "high", "NOT ILIKE '%high%'"),
    ("starts_with", "1", "LIKE '1%'"), ("ends_with", "LOW", "LIKE '%LOW'"), ("does_not_start_with", "1", "NOT LIKE '1%'"), ("does_not_end_with", "LOW", "NOT LIKE '%LOW'"),
    ("starts_with_case_insensitive", "1-u", "ILIKE '1-u%'"), ("ends_with_case_insensitive", "low", "ILIKE '%low'"), ("does_not_start_with_case_insensitive", "1-u", "NOT ILIKE '1-u%'"), ("does_not_end_with_case_insensitive", "low", "NOT ILIKE '%low'"),
    ("is_null", None, "IS NULL"), ("is_not_null", None, "IS NOT NULL"),
]:
    add(f"filter_expr_{_name}", f"SELECT o_orderstatus AS orders_status, count(*) AS orders_orders FROM orders WHERE o_orderpriority {_test} GROUP BY 1", q("orders.orders", "orders.status", where=[{"field": "orders.priority", "expression": _name, "value": _value}]))
for _name, _test in (("boolean_true", "l_discount > 0.05"), ("is_true", "l_discount > 0.05"), ("boolean_false", "NOT l_discount > 0.05"), ("is_false", "NOT l_discount > 0.05")):
    add(f"filter_expr_{_name}", f"SELECT count(*) AS lineitem_lines FROM lineitem WHERE {_test}", q("lineitem.lines", where=[{"field": "lineitem.is_discounted", "expression": _name}]))
for _name, _field, _value, _test in [
    ("empty", "orders.priority", "", "TRUE"), ("null", "orders.priority", "NULL", "o_orderpriority IS NULL"), ("not_null", "orders.priority", "-NULL", "o_orderpriority IS NOT NULL"), ("in", "orders.status", "F, O", "o_orderstatus IN ('F', 'O')"), ("not_in", "orders.status", "-F, -O", "o_orderstatus NOT IN ('F', 'O')"),
    ("compare", "orders.price", "<=100000", "o_totalprice <= 100000"), ("not_equal", "orders.status", "-F", "o_orderstatus <> 'F'"), ("contains", "orders.priority", "%high%", "o_orderpriority ILIKE '%high%'"), ("not_contains", "orders.priority", "-%high%", "o_orderpriority NOT ILIKE '%high%'"), ("starts", "orders.priority", "1%", "o_orderpriority ILIKE '1%'"), ("ends", "orders.priority", "%low", "o_orderpriority ILIKE '%low'"), ("equal", "orders.status", "F", "o_orderstatus = 'F'"),
    ("after", "orders.order_date", "after 1997-01-01", "date_trunc('day', o_orderdate) >= DATE '1997-01-01'"), ("phrase_last_month", "orders.order_date", "last month", "o_orderdate >= DATE '1998-07-01' AND o_orderdate < DATE '1998-08-01'"), ("phrase_2_quarters", "orders.order_date", "2 quarters", "o_orderdate >= DATE '1998-04-01' AND o_orderdate < DATE '1998-10-01'"),
    ("phrase_ago_for", "orders.order_date", "2 years ago for 3 months", "o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1996-04-01'"), ("phrase_to_date", "orders.order_date", "last year to date", "o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1997-08-15'"), ("phrase_until", "orders.order_date", "1996-03-01 until last week", "o_orderdate >= DATE '1996-03-01' AND o_orderdate < DATE '1998-08-10'"),
]:
    add(f"filter_lang_{_name}", f"SELECT o_orderstatus AS orders_status, count(*) AS orders_orders FROM orders WHERE {_test} GROUP BY 1", q("orders.orders", "orders.status", where=[{"field": _field, "value": _value}]))
add("filter_matches", "SELECT count(*) AS orders_orders FROM orders WHERE o_orderdate >= DATE '1998-08-10' AND o_orderdate < DATE '1998-08-17'", q("orders.orders", where=[{"field": "orders.order_raw", "expression": "matches", "value": "this week"}]))
add("filter_or_nested", "SELECT count(*) AS lineitem_lines FROM lineitem WHERE l_returnflag = 'R' OR (l_quantity > 30 AND l_linestatus = 'O')", q("lineitem.lines", where=[{"conditions": [{"field": "lineitem.returnflag", "expression": "equal_to", "value": "R"}, {"conditions": [{"field": "lineitem.quantity", "expression": "greater_than", "value": 30}, {"field": "lineitem.linestatus", "expression": "equal_to", "value": "O"}], "logical_operator": "AND"}], "logical_operator": "OR"}]))
add("filter_literal", "SELECT count(*) AS lineitem_lines FROM lineitem WHERE l_quantity > 30 AND l_returnflag = 'A'", q("lineitem.lines", where=["${lineitem.quantity} > 30 and ${lineitem.returnflag} = 'A'"]))
add("filter_field_to_field", f"SELECT count(*) AS lineitem_lines FROM {LO} WHERE l_extendedprice > o_totalprice", q("lineitem.lines", where=[{"field": "lineitem.price", "expression": "greater_than", "value": "orders.price"}]))
add("having_selected", "SELECT o_custkey AS orders_custkey, count(*) AS orders_orders FROM orders GROUP BY 1 HAVING count(*) > 12", q("orders.orders", "orders.custkey", having=[{"field": "orders.orders", "expression": "greater_than", "value": 12}]))
add("having_unselected", "SELECT o_custkey AS orders_custkey, count(*) AS orders_orders FROM orders GROUP BY 1 HAVING sum(o_totalprice) > 1500000", q("orders.orders", "orders.custkey", having=[{"field": "orders.total_price", "expression": "greater_than", "value": 1500000}]))
add("always_filter", "SELECT count(*) AS big_orders_orders FROM orders WHERE o_totalprice > 200000 AND o_orderstatus <> 'P'", q("big_orders.orders"), user={"least": 200000})
add("access_filter", "SELECT c_mktsegment AS customers_segment, count(*) AS customers_customers FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1", q("customers.customers", "customers.segment"), user={"segments": "BUILDING, MACHINERY"})
add("entity_filter", "SELECT count(*) AS orders_orders FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING sum(o_totalprice) > 1000000)", q("orders.orders", where=[{"field": "orders.total_price", "group_by": "orders.custkey", "expression": "greater_than", "value": 1000000}]))
_sub = {"query": {"metrics": [], "dimensions": ["orders.custkey"], "where": [{"field": "orders.priority", "expression": "equal_to", "value": "1-URGENT"}]}, "field": "orders.custkey"}
add("is_in_query", "SELECT c_mktsegment AS customers_segment, count(*) AS customers_customers FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1", q("customers.customers", "customers.segment", where=[{"field": "customers.custkey", "expression": "is_in_query", "value": _sub}]))
add("is_not_in_query", "SELECT c_mktsegment AS customers_segment, count(*) AS customers_customers FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1", q("customers.customers", "customers.segment", where=[{"field": "customers.custkey", "expression": "is_not_in_query", "value": _sub}]))
add("nested_subquery_filter", "SELECT count(*) AS customers_customers FROM customer WHERE c_mktsegment = 'BUILDING' OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')", q("customers.customers", where=[{"conditions": [{"field": "customers.segment", "expression": "equal_to", "value": "BUILDING"}, {"field": "customers.custkey", "expression": "is_in_query", "value": _sub}], "logical_operator": "OR"}]))

# ---- dates
_O = "o_orderdate"
_FRAMES = {
    "raw": _O, "time": _O, "second": f"date_trunc('second', {_O})", "minute": f"date_trunc('minute', {_O})", "hour": f"date_trunc('hour', {_O})", "date": f"date_trunc('day', {_O})", "week": f"date_trunc('week', {_O})", "month": f"date_trunc('month', {_O})", "quarter": f"concat(year({_O}), '-Q', quarter({_O}))", "year": f"date_trunc('year', {_O})",
    "fiscal_month": f"date_trunc('month', {_O} + INTERVAL 1 MONTH)", "fiscal_quarter": f"concat(year({_O} + INTERVAL 1 MONTH), '-Q', quarter({_O} + INTERVAL 1 MONTH))", "fiscal_year": f"date_trunc('year', {_O} + INTERVAL 1 MONTH)", "week_index": f"week({_O})", "week_of_year": f"week({_O})", "week_of_month": f"week({_O}) - week(date_trunc('month', {_O})) + 1",
    "month_of_year_index": f"month({_O})", "month_index": f"month({_O})", "fiscal_month_of_year_index": f"month({_O} + INTERVAL 1 MONTH)", "fiscal_month_index": f"month({_O} + INTERVAL 1 MONTH)", "month_of_year": f"strftime({_O}, '%b')", "month_name": f"strftime({_O}, '%b')", "month_of_year_full_name": f"strftime({_O}, '%B')", "quarter_of_year": f"quarter({_O})", "fiscal_quarter_of_year": f"quarter({_O} + INTERVAL 1 MONTH)",
    "hour_of_day": f"hour({_O})", "day_of_week": f"strftime({_O}, '%a')", "day_of_month": f"day({_O})", "day_of_year": f"dayofyear({_O})",
}
for _f, _x in _FRAMES.items():
    _x = f"({_x})::TIMESTAMP" if _x.startswith("date_trunc") else _x
    add(f"timeframe_{_f}", f"SELECT {_x} AS orders_order_{_f}, count(*) AS orders_orders FROM orders GROUP BY 1", q("orders.orders", f"orders.order_{_f}"), fiscal_offset=1)
for _day, _k in (("sunday", 1), ("saturday", 2), ("friday", 3), ("thursday", 4), ("wednesday", 5), ("tuesday", 6)):
    add(f"week_start_{_day}", f"SELECT (date_trunc('week', o_orderdate + INTERVAL {_k} DAY) - INTERVAL {_k} DAY)::TIMESTAMP AS orders_order_week, count(*) AS orders_orders FROM orders GROUP BY 1", q("orders.orders", "orders.order_week"), week_start=_day)
add("timezone_hour", "SELECT date_trunc('hour', (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')::TIMESTAMP AS events_event_hour, count(*) AS events_events FROM events GROUP BY 1", q("events.events", "events.event_hour"), timezone="America/New_York")
_DUR = {"days": "datediff('day', o_orderdate, l_shipdate)", "weeks": "datediff('day', date_trunc('week', o_orderdate), date_trunc('week', l_shipdate)) // 7", "months": "datediff('month', o_orderdate, l_shipdate)", "quarters": "datediff('quarter', o_orderdate, l_shipdate)", "years": "datediff('year', o_orderdate, l_shipdate)", "hours": "datediff('hour', o_orderdate, l_shipdate)", "minutes": "datediff('minute', o_orderdate, l_shipdate)", "seconds": "datediff('second', o_orderdate, l_shipdate)"}
for _u, _x in _DUR.items():
    add(f"duration_{_u}", f"SELECT {_x} AS lineitem_{_u}_to_ship, count(*) AS lineitem_lines FROM {LO} GROUP BY 1", q("lineitem.lines", f"lineitem.{_u}_to_ship"))

# ---- joins and fan-out
add("join_many_to_one", f"SELECT o_orderstatus AS orders_status, {R('sum(l_extendedprice)')} AS lineitem_revenue FROM {LO} GROUP BY 1", q("lineitem.revenue", "orders.status"))
add("join_multi_hop", f"SELECT r_name AS regions_name, {R('sum(l_extendedprice)')} AS lineitem_revenue FROM {LOC} LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1", q("lineitem.revenue", "regions.name", where=[{"field": "customers.segment", "expression": "equal_to", "value": "BUILDING"}, {"field": "customer_nations.name", "expression": "is_not_null"}]))
add("join_as_twice", f"SELECT c.n_name AS customer_nations_name, s.n_name AS supplier_nations_name, {R('sum(l_extendedprice)')} AS lineitem_revenue FROM {LOC} LEFT JOIN nation c ON c_nationkey = c.n_nationkey LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation s ON s_nationkey = s.n_nationkey GROUP BY 1, 2", q("lineitem.revenue", "customer_nations.name supplier_nations.name"))
add("join_theta", "SELECT s_name AS suppliers_name, count(*) AS buckets_parts FROM part JOIN supplier ON p_size = s_suppkey AND s_suppkey > 2 GROUP BY 1", q("buckets.parts", "suppliers.name"))
add("fanout_sum_count_avg", f"WITH r AS (SELECT DISTINCT c_mktsegment, o_orderkey, o_totalprice FROM {LOC}), o AS (SELECT c_mktsegment, sum(o_totalprice) a, count(*) b, avg(o_totalprice) c FROM r GROUP BY 1), l AS (SELECT c_mktsegment, sum(l_extendedprice) x FROM {LOC} GROUP BY 1) SELECT o.c_mktsegment AS customers_segment, {R('a')} AS orders_total_price, b AS orders_orders, {R('c')} AS orders_avg_price, {R('x')} AS lineitem_revenue FROM o JOIN l ON o.c_mktsegment = l.c_mktsegment", q("lineitem.revenue orders.total_price orders.orders orders.avg_price", "customers.segment"))
add("fanout_two_views", f"WITH c AS (SELECT DISTINCT l_returnflag, c_custkey, c_acctbal FROM {LOC}), o AS (SELECT DISTINCT l_returnflag, o_orderkey, o_totalprice FROM {LOC}) SELECT a.l_returnflag AS lineitem_returnflag, a.n AS lineitem_lines, {R('b.x')} AS customers_avg_balance, {R('d.y')} AS orders_total_price FROM (SELECT l_returnflag, count(*) n FROM lineitem GROUP BY 1) a JOIN (SELECT l_returnflag, avg(c_acctbal) x FROM c GROUP BY 1) b USING (l_returnflag) JOIN (SELECT l_returnflag, sum(o_totalprice) y FROM o GROUP BY 1) d USING (l_returnflag)", q("lineitem.lines customers.avg_balance orders.total_price", "lineitem.returnflag"))
add("fanout_empty_group", "SELECT c_mktsegment AS customers_segment, count(DISTINCT o_orderkey) AS orders_orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey WHERE l_quantity > 49 GROUP BY 1", q("orders.orders", "customers.segment", where=[{"field": "lineitem.quantity", "expression": "greater_than", "value": 49}]))
add("sum_distinct_key", f"WITH r AS (SELECT DISTINCT l_returnflag, o_orderkey, o_totalprice FROM {LO}) SELECT l_returnflag AS lineitem_returnflag, {R('sum(o_totalprice)')} AS lineitem_order_price_once, {R('avg(o_totalprice)')} AS lineitem_avg_order_price_once FROM r GROUP BY 1", q("lineitem.order_price_once lineitem.avg_order_price_once", "lineitem.returnflag"))

# ---- windows, non-additive
add("window_dim", "WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS s FROM orders) SELECT s AS orders_order_sequence, count(*) AS orders_orders FROM o WHERE o_orderstatus = 'F' GROUP BY 1", build=lambda e: e.query(**q("orders.orders", "orders.order_sequence", where=[{"field": "orders.status", "expression": "equal_to", "value": "F"}])).selectExpr("cast(orders_order_sequence as bigint) orders_order_sequence", "orders_orders"))
add("window_filter_on_dim", "WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS s FROM orders) SELECT o_orderstatus AS orders_status, count(*) AS orders_orders, count(CASE WHEN s = 1 THEN 1 END) AS orders_first_orders FROM o WHERE s <= 2 GROUP BY 1", q("orders.orders orders.first_orders", "orders.status", where=[{"field": "orders.order_sequence", "expression": "less_or_equal_than", "value": 2}]))
add("window_measure_ratio", f"SELECT l_returnflag AS lineitem_returnflag, {R('sum(l_extendedprice) / sum(sum(l_extendedprice)) OVER ()', 6)} AS lineitem_revenue_share FROM lineitem GROUP BY 1", q("lineitem.revenue_share", "lineitem.returnflag"), digits=6)
add("window_having", f"SELECT * FROM (SELECT o_orderstatus AS orders_status, {R('sum(o_totalprice) / sum(sum(o_totalprice)) OVER ()', 6)} AS orders_price_rank_share FROM orders GROUP BY 1) WHERE orders_price_rank_share > 0.3", q("orders.price_rank_share", "orders.status", having=[{"field": "orders.price_rank_share", "expression": "greater_than", "value": 0.3}]), digits=6)
_na = "WITH m AS (SELECT event_type, max(ts) t FROM events GROUP BY 1) SELECT e.event_type AS events_event_type, {} AS events_last_value FROM events e JOIN m ON e.event_type = m.event_type GROUP BY 1"
add("nonadd_max", _na.format(R("sum(CASE WHEN ts = t THEN value ELSE 0 END)")), q("events.last_value", "events.event_type"))
add("nonadd_grouping", f"WITH m AS (SELECT event_type, user_id, min(ts) t FROM events GROUP BY 1, 2) SELECT e.event_type AS events_event_type, {R('sum(CASE WHEN ts = t THEN value ELSE 0 END)')} AS events_first_value_of_user FROM events e JOIN m ON e.event_type = m.event_type AND e.user_id = m.user_id GROUP BY 1", q("events.first_value_of_user", "events.event_type"))
add("nonadd_ignore_dims", "WITH m AS (SELECT max(date_trunc('day', ts)) t FROM events) SELECT event_type AS events_event_type, count(CASE WHEN date_trunc('day', ts) = t THEN event_id END) AS events_last_events_overall FROM events, m GROUP BY 1", q("events.last_events_overall", "events.event_type"))

# ---- merged
_lm = "SELECT date_trunc('month', l_shipdate)::TIMESTAMP m, sum(l_extendedprice) v FROM lineitem GROUP BY 1"
_om = "SELECT date_trunc('month', o_orderdate)::TIMESTAMP m, sum(o_totalprice) v, count(*) n FROM orders GROUP BY 1"
add("merged_two", f"SELECT coalesce(l.m, o.m) AS lineitem_ship_month, coalesce(l.m, o.m) AS orders_order_month, {R('l.v')} AS lineitem_revenue, {R('o.v')} AS orders_total_price FROM ({_lm}) l FULL JOIN ({_om}) o ON l.m = o.m", {**q("lineitem.revenue orders.total_price", "orders.order_month"), "merged_result": True})
add("merged_formula", f"SELECT coalesce(l.m, o.m) AS lineitem_ship_month, coalesce(l.m, o.m) AS orders_order_month, {R('l.v')} AS lineitem_revenue, {R('o.v')} AS orders_total_price, {R('l.v / nullif(o.v, 0)', 2)} AS lineitem_revenue_per_order_value FROM ({_lm}) l FULL JOIN ({_om}) o ON l.m = o.m", q("lineitem.revenue_per_order_value", "orders.order_month"))
add("merged_no_dims", f"SELECT {R('(SELECT sum(l_extendedprice) FROM lineitem)')} AS lineitem_revenue, {R('(SELECT sum(o_totalprice) FROM orders)')} AS orders_total_price", {**q("lineitem.revenue orders.total_price"), "merged_result": True})
add("merged_three_star", f"WITH l AS (SELECT strftime(l_shipdate, '%b') m, sum(l_extendedprice) v FROM lineitem GROUP BY 1), o AS (SELECT strftime(o_orderdate, '%b') m, sum(o_totalprice) v FROM orders GROUP BY 1), e AS (SELECT strftime(ts, '%b') m, count(*) n FROM events GROUP BY 1) SELECT coalesce(e.m, l.m, o.m) AS orders_order_month_of_year, coalesce(e.m, l.m, o.m) AS lineitem_ship_month_of_year, coalesce(e.m, l.m, o.m) AS events_event_month_of_year, {R('l.v')} AS lineitem_revenue, {R('o.v')} AS orders_total_price, e.n AS events_events FROM e FULL JOIN l ON e.m = l.m FULL JOIN o ON e.m = o.m", {**q("lineitem.revenue orders.total_price events.events", "orders.order_month_of_year"), "merged_result": True})
add("merged_where_having", f"SELECT coalesce(l.m, o.m) AS lineitem_ship_month, coalesce(l.m, o.m) AS orders_order_month, {R('l.v')} AS lineitem_revenue, o.n AS orders_orders FROM (SELECT date_trunc('month', l_shipdate)::TIMESTAMP m, sum(l_extendedprice) v FROM {LOC} WHERE c_mktsegment = 'BUILDING' GROUP BY 1) l FULL JOIN (SELECT date_trunc('month', o_orderdate)::TIMESTAMP m, count(*) n FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1) o ON l.m = o.m WHERE o.n > 3", {**q("lineitem.revenue orders.orders", "orders.order_month", where=[{"field": "customers.segment", "expression": "equal_to", "value": "BUILDING"}], having=[{"field": "orders.orders", "expression": "greater_than", "value": 3}]), "merged_result": True})
add("mapping_date", "SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS orders_order_month, count(*) AS orders_orders FROM orders GROUP BY 1", q("orders.orders", "month"))
add("mapping_dim", "SELECT c_mktsegment AS customers_segment, count(*) AS orders_orders FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1", q("orders.orders", "segment"))
add("mapping_date_merged", f"SELECT coalesce(l.m, o.m) AS lineitem_ship_month, coalesce(l.m, o.m) AS orders_order_month, {R('l.v')} AS lineitem_revenue, {R('o.v')} AS orders_total_price FROM ({_lm}) l FULL JOIN ({_om}) o ON l.m = o.m", q("orders.total_price lineitem.revenue", "month"))
add("auto_merge_fallback", f"SELECT coalesce(e.m, o.m) AS events_event_day_of_week, coalesce(e.m, o.m) AS orders_order_day_of_week, e.n AS events_events, {R('o.v')} AS orders_total_price FROM (SELECT strftime(ts, '%a') m, count(*) n FROM events GROUP BY 1) e FULL JOIN (SELECT strftime(o_orderdate, '%a') m, sum(o_totalprice) v FROM orders GROUP BY 1) o ON e.m = o.m", q("orders.total_price events.events", "orders.order_day_of_week"))

_a = {"metrics": ["orders.orders"], "dimensions": ["orders.status"]}
_b = {"metrics": ["lineitem.revenue"], "dimensions": ["lineitem.linestatus"], "join_fields": [{"field": "lineitem.linestatus", "source_field": "orders.status"}]}
for _how, _join in (("left_outer", "LEFT"), ("inner", "INNER"), ("full_outer", "FULL")):
    add(f"arb_merge_{_how.split('_')[0]}", f"SELECT o_orderstatus AS orders_status, n AS orders_orders, {R('v')} AS lineitem_revenue FROM (SELECT o_orderstatus, count(*) n FROM orders GROUP BY 1) {_join} JOIN (SELECT l_linestatus, sum(l_extendedprice) v FROM lineitem GROUP BY 1) ON o_orderstatus = l_linestatus", {"merged_queries": [_a, {**_b, "join_type": _how}]})
add("arb_merge_three", f"SELECT o_orderstatus AS orders_status, n AS orders_orders, {R('v')} AS lineitem_revenue, p AS orders_priority_group, {R('w')} AS orders_total_price FROM (SELECT o_orderstatus, count(*) n FROM orders GROUP BY 1) LEFT JOIN (SELECT l_linestatus, sum(l_extendedprice) v FROM lineitem GROUP BY 1) ON o_orderstatus = l_linestatus LEFT JOIN (SELECT o_orderstatus s, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' WHEN o_orderpriority = '3-MEDIUM' THEN 'medium' ELSE 'low' END p, sum(o_totalprice) w FROM orders GROUP BY 1, 2) ON o_orderstatus = s", {"merged_queries": [_a, _b, {"metrics": ["orders.total_price"], "dimensions": ["orders.status", "orders.priority_group"], "join_fields": [{"field": "orders.status", "source_field": "orders.status"}]}]})
add("arb_merge_post_filters", f"SELECT o_orderstatus AS orders_status, n AS orders_orders, {R('v')} AS lineitem_revenue FROM (SELECT o_orderstatus, count(*) n FROM orders GROUP BY 1) LEFT JOIN (SELECT l_linestatus, sum(l_extendedprice) v FROM lineitem GROUP BY 1) ON o_orderstatus = l_linestatus WHERE v IS NOT NULL ORDER BY n DESC LIMIT 1", {"merged_queries": [_a, _b], "where": [{"field": "lineitem.revenue", "expression": "is_not_null"}], "order_by": [{"field": "orders.orders", "sort": "desc"}], "limit": 1})

# ---- cumulative
_ASOF = "DATE '1998-08-15'"
_SPM = f"(SELECT DISTINCT date_trunc('month', d)::TIMESTAMP AS d FROM range(DATE '2000-01-01' - INTERVAL 0 DAY, DATE '2001-09-01', INTERVAL 1 DAY) t(d))"
_cum = "SELECT {g} s.d AS orders_order_month, {v} FROM " + _SPM + " s JOIN orders ON date_trunc('month', o_orderdate) <= s.d GROUP BY {n}"
_LATE = datetime(2001, 8, 31, 12, 0, 0)
add("cumulative_month", _cum.format(g="", v=f"{R('sum(o_totalprice)')} AS orders_running_price, count(DISTINCT o_custkey) AS orders_running_buyers, {R('avg(o_totalprice)')} AS orders_running_avg", n="1"), q("orders.running_price orders.running_buyers orders.running_avg", "orders.order_month"), now=_LATE)
add("cumulative_by_dim", _cum.format(g="o_orderstatus AS orders_status,", v=f"{R('sum(o_totalprice)')} AS orders_running_price", n="1, 2"), q("orders.running_price", "orders.status orders.order_month"), now=_LATE)
add("cumulative_count_distinct", _cum.format(g="o_orderstatus AS orders_status,", v="count(DISTINCT o_custkey) AS orders_running_buyers", n="1, 2"), q("orders.running_buyers", "orders.status orders.order_month"), now=_LATE)
add("cumulative_total", f"SELECT {R('sum(o_totalprice)')} AS orders_running_price FROM orders WHERE o_orderdate < DATE '2001-09-01'", q("orders.running_price"), now=_LATE)
add("cumulative_where", f"SELECT s.d AS orders_order_date, {R('sum(o_totalprice)')} AS orders_recent_price FROM (SELECT d::TIMESTAMP d FROM range(DATE '2000-01-01', DATE '2001-09-01', INTERVAL 1 DAY) t(d)) s JOIN orders ON date_trunc('day', o_orderdate) <= s.d AND date_trunc('day', o_orderdate) > s.d - INTERVAL 365 DAY GROUP BY 1", q("orders.recent_price", "orders.order_date"), now=_LATE)
add("cumulative_mixed_formula", f"WITH c AS (SELECT s.d, sum(o_totalprice) p, count(*) n FROM {_SPM} s JOIN orders ON date_trunc('month', o_orderdate) <= s.d GROUP BY 1), o AS (SELECT date_trunc('month', o_orderdate)::TIMESTAMP m, count(*) k FROM orders GROUP BY 1) SELECT m AS orders_order_month, k AS orders_orders, {R('p / nullif(n, 0)')} AS orders_running_per_order FROM o LEFT JOIN c ON o.m = c.d", q("orders.orders orders.running_per_order", "orders.order_month"), now=_LATE)

# ---- funnels
_step = lambda t: [{"field": "events.event_type", "expression": "equal_to", "value": t}]
_F = "WITH s1 AS (SELECT *, ts AS t1 FROM events WHERE event_type = 'view'), s2 AS (SELECT DISTINCT e.*, s1.t1 FROM events e JOIN s1 ON e.user_id = s1.user_id AND s1.ts < e.ts AND datediff('day', s1.t1, e.ts) <= 3 WHERE e.event_type = 'click'), s3 AS (SELECT DISTINCT e.* FROM events e JOIN s2 ON e.user_id = s2.user_id AND s2.ts < e.ts AND datediff('day', s2.t1, e.ts) <= 3 WHERE e.event_type = 'purchase'), d2 AS (SELECT DISTINCT * EXCLUDE (t1) FROM s2) "
_fun = {"steps": [_step("view"), _step("click")], "within": {"value": 3, "unit": "day"}}
_fun3 = {**_fun, "steps": [*_fun["steps"], _step("purchase")]}
_st = "SELECT 'Step {i}' AS step, {i} AS step_order, count(*) AS events_events, {v} AS events_value{d} FROM {t}{g}"


def _steps(tables: list[str], d: str = "", g: str = "", h: str = "") -> str:
    body = " UNION ALL ".join(_st.format(i=i, v=R("coalesce(sum(value), 0)"), t=t, d=d, g=g) for i, t in enumerate(tables, 1))
    return f"{_F}SELECT * FROM ({body}){h}"


add("funnel_two", _steps(["s1", "d2"]), {**q("events.events events.value"), "funnel": _fun})
add("funnel_three_dims", _steps(["s1", "d2", "s3"], ", date_trunc('week', ts)::TIMESTAMP AS events_event_week", " GROUP BY date_trunc('week', ts)"), {**q("events.events events.value", "events.event_week"), "funnel": _fun3})
add("funnel_having", _steps(["s1", "d2", "s3"], ", date_trunc('week', ts)::TIMESTAMP AS events_event_week", " GROUP BY date_trunc('week', ts)", " WHERE events_events > 10"), {**q("events.events events.value", "events.event_week", having=[{"field": "events.events", "expression": "greater_than", "value": 10}]), "funnel": _fun3})
add("funnel_filter_converted", f"{_F}SELECT count(*) AS events_events FROM events WHERE user_id IN (SELECT user_id FROM s2)", q("events.events", where=[{"field": "events.user_id", "expression": "converted", "value": {**_fun, "from": 1, "to": 2, "view_name": "events"}}]))
add("funnel_filter_dropped_off", f"{_F}SELECT count(*) AS events_events FROM events WHERE user_id IN (SELECT user_id FROM s1) AND user_id NOT IN (SELECT user_id FROM s3)", q("events.events", where=[{"field": "events.user_id", "expression": "dropped_off", "value": {**_fun3, "from": 1, "to": 3, "view_name": "events"}}]))

# ---- topics, MQL, tooling
add("topic_default", f"SELECT c_mktsegment AS customers_segment, {R('sum(l_extendedprice)')} AS lineitem_revenue FROM {LOC} GROUP BY 1", {**q("lineitem.revenue", "customers.segment"), "topic": "lineitem_topic"})
add("topic_override_join", f"SELECT p_brand AS parts_brand, {R('sum(l_extendedprice)')} AS lineitem_revenue FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1", {**q("lineitem.revenue", "parts.brand"), "topic": "lineitem_topic"})
add("topic_from_alias", f"SELECT o_orderpriority AS buyer_orders_priority, {R('sum(l_extendedprice)')} AS lineitem_revenue FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus = 'F' GROUP BY 1", {**q("lineitem.revenue", "buyer_orders.priority"), "topic": "lineitem_topic"})
add("topic_fanout", f"WITH r AS (SELECT DISTINCT c_mktsegment, o_orderkey, o_totalprice FROM {LOC}) SELECT c_mktsegment AS customers_segment, {R('sum(o_totalprice)')} AS orders_total_price FROM r GROUP BY 1", {**q("orders.total_price", "customers.segment", where=[{"field": "lineitem.returnflag", "expression": "is_not_null"}]), "topic": "lineitem_topic"})
add("mql_simple", f"SELECT l_returnflag AS lineitem_returnflag, {R('sum(l_extendedprice)')} AS lineitem_revenue FROM lineitem WHERE l_quantity > 30 GROUP BY 1", build=lambda e: e.query(sql="SELECT * FROM MQL(lineitem.revenue BY lineitem.returnflag WHERE lineitem.quantity > 30) AS m;"))
add("mql_joined_outer", "SELECT n_name, k FROM (SELECT c_nationkey, count(*) k FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1) JOIN nation ON c_nationkey = n_nationkey", build=lambda e: (e.tables("nation").createOrReplaceTempView("nation"), e.tables("customer").createOrReplaceTempView("customer"), e.query(sql="SELECT n.n_name, sum(m.orders_orders) AS k FROM MQL(orders.orders BY orders.custkey) m JOIN customer c ON m.orders_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name"))[-1])
add("mql_funnel", _steps(["s1", "d2"]), build=lambda e: e.query(sql="SELECT * FROM MQL(events.events, events.value FOR events FUNNEL events.event_type = 'view' THEN events.event_type = 'click' WITHIN 3 days) f"))
add("secure_view", "SELECT count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')", build=lambda e: e.secure("customers").groupBy().agg(F.count(F.lit(1)).alias("n")), user={"segments": "BUILDING, MACHINERY"})
add("date_spine", "SELECT d::TIMESTAMP AS period FROM range(DATE '2000-01-01', DATE '2000-03-02', INTERVAL 1 DAY) t(d)", build=lambda e: __import__("sparkloom.operators.cumulative", fromlist=["spine"]).spine(e, "date").select("period"), now=datetime(2000, 3, 1))
_CLASS = "SELECT '{c}' AS column_name, count(DISTINCT {c}) < 100 AS searchable FROM customer"
add(
    "seed_cardinality",
    " UNION ALL ".join(_CLASS.format(c=c) for c in ("c_name", "c_mktsegment")),  # the classes of the approximate counts
    build=lambda e: cardinality(e.tables("customer")).select("column_name", (F.col("n") < 100).alias("searchable")),
)

# ---- further joins, windows and filters; each changes the demo project for itself


def changed(e: Engine, **objects) -> Engine:
    """An engine over the demo project with some objects added or replaced."""
    return Engine(e.spark, e.project.replaced(**objects), e.tables, e.clock)


def view_with(e: Engine, view: str, *fields: dict, **more) -> dict:
    """A view's definition with further fields."""
    d = next(v for v in e.project.views_data if v["name"] == view)
    return {**d, "fields": [*d["fields"], *fields], **more}


add(
    "join_inner",
    "SELECT c_mktsegment AS customers_segment, count(*) AS paid_orders FROM orders JOIN customer ON o_custkey = c_custkey AND c_acctbal > 5000 GROUP BY 1",
    build=lambda e: changed(
        e,
        views=[{
            "name": "paid", "model_name": "shop", "sql_table_name": "orders",
            "identifiers": [{"name": "to_customers", "type": "join", "reference": "customers", "relationship": "many_to_one", "join_type": "inner", "sql_on": "${paid.custkey} = ${customers.custkey} and ${customers.balance} > 5000"}],
            "fields": [dim("orderkey", "${TABLE}.o_orderkey", "number", primary_key=True), dim("custkey", "${TABLE}.o_custkey", "number"), metric("orders", "count")],
        }],
    ).query(**q("paid.orders", "customers.segment")),
)
add(
    "join_full_outer",
    "SELECT r_name AS regions_name, count(s_suppkey) AS depots_depots FROM supplier FULL JOIN region ON s_suppkey * 2 = r_regionkey GROUP BY 1",
    build=lambda e: changed(
        e,
        views=[{
            "name": "depots", "model_name": "shop", "sql_table_name": "supplier",
            "identifiers": [{"name": "to_regions", "type": "join", "reference": "regions", "relationship": "many_to_one", "join_type": "full_outer", "sql_on": "${depots.suppkey} * 2 = ${regions.regionkey}"}],
            "fields": [dim("suppkey", "${TABLE}.s_suppkey", "number", primary_key=True), metric("depots", "count")],
        }],
    ).query(**q("depots.depots", "regions.name")),
)
_STATUS = "SELECT o_custkey, CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END AS st, count(*) AS n FROM orders GROUP BY 1, 2"
add(
    "join_composite_key",
    f"SELECT s.n AS habits_n, count(*) AS own_orders FROM orders o LEFT JOIN ({_STATUS}) s ON o.o_custkey = s.o_custkey AND o.o_orderstatus = s.st GROUP BY 1",
    build=lambda e: changed(
        e,
        views=[
            {
                "name": "habits", "model_name": "shop", "derived_table": {"sql": _STATUS},
                "identifiers": [{"name": "habit", "type": "primary", "identifiers": [{"name": "custkey", "sql": "${TABLE}.o_custkey"}, {"name": "status", "sql": "${TABLE}.st"}]}],
                "fields": [dim("key", "concat_ws('|', ${TABLE}.o_custkey, ${TABLE}.st)", primary_key=True), dim("n", "${TABLE}.n", "number")],
            },
            {
                "name": "own", "model_name": "shop", "sql_table_name": "orders",
                "identifiers": [{"name": "habit", "type": "foreign", "identifiers": [{"name": "custkey", "sql": "${TABLE}.o_custkey"}, {"name": "status", "sql": "${TABLE}.o_orderstatus"}]}],
                "fields": [dim("orderkey", "${TABLE}.o_orderkey", "number", primary_key=True), metric("orders", "count")],
            },
        ],
    ).query(**q("own.orders", "habits.n")),
)
add(
    "join_allowed_fanouts",
    "SELECT o_orderstatus AS orders_status, count(DISTINCT event_id) AS events_events FROM events LEFT JOIN customer ON user_id = c_custkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    build=lambda e: changed(e, views=[view_with(e, "customers", identifiers=[{"name": "customer_id", "type": "primary", "sql": "${custkey}", "allowed_fanouts": ["orders"]}])]).query(**q("events.events", "orders.status")),
)
_KIND = "SELECT *, CASE WHEN event_type <> 'error' THEN event_type END AS kind FROM events"
_LAST = {"name": "event_raw", "window_choice": "max", "window_groupings": ["kind"]}
_KINDS = "WITH e AS ({k}), m AS (SELECT kind, max(ts) t FROM e GROUP BY 1) SELECT {v} AS events_last_of_kind FROM e JOIN m ON {on}"


def _last_of_kind(e: Engine, **more) -> DataFrame:
    kind = dim("kind", "CASE WHEN ${TABLE}.event_type <> 'error' THEN ${TABLE}.event_type END")
    last = metric("last_of_kind", "sum", "${TABLE}.value", non_additive_dimension={**_LAST, **more})
    return changed(e, views=[view_with(e, "events", kind, last)]).query(**q("events.last_of_kind"))


_VALUE = R("sum(CASE WHEN ts = t THEN value ELSE 0 END)")
add("nonadd_nulls_equal", _KINDS.format(k=_KIND, v=_VALUE, on="e.kind IS NOT DISTINCT FROM m.kind"), build=lambda e: _last_of_kind(e, nulls_are_equal=True))
add("nonadd_nulls_differ", _KINDS.format(k=_KIND, v=_VALUE, on="e.kind = m.kind"), build=_last_of_kind)
add(
    "nonadd_min_count",
    "WITH m AS (SELECT event_type, min(date_trunc('day', ts)) t FROM events GROUP BY 1) SELECT e.event_type AS events_event_type, count(CASE WHEN date_trunc('day', ts) = t THEN event_id END) AS events_first_events FROM events e JOIN m USING (event_type) GROUP BY 1",
    build=lambda e: changed(e, views=[view_with(e, "events", metric("first_events", "count", "${event_id}", non_additive_dimension={"name": "event_date", "window_choice": "min"}))]).query(**q("events.first_events", "events.event_type")),
)
add(
    "merged_mapped_dim",
    "SELECT coalesce(e.k, o.k) AS events_letter, coalesce(e.k, o.k) AS orders_status, e.n AS events_events, o.n AS orders_orders FROM (SELECT upper(event_type[1]) k, count(*) n FROM events GROUP BY 1) e FULL JOIN (SELECT o_orderstatus k, count(*) n FROM orders GROUP BY 1) o ON e.k = o.k",
    build=lambda e: changed(
        e,
        models=[{**e.project.model, "mappings": {"letter": {"fields": ["events.letter", "orders.status"]}}}],
        views=[view_with(e, "events", dim("letter", "upper(substr(${TABLE}.event_type, 1, 1))"))],
    ).query(**q("orders.orders events.events", "orders.status"), merged_result=True),
)
add(
    "window_two_views",
    "WITH o AS (SELECT orders.*, lag(o_orderpriority) OVER (PARTITION BY c_custkey ORDER BY o_orderdate, o_orderkey) p FROM orders LEFT JOIN customer ON o_custkey = c_custkey), c AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) s FROM customer) "
    "SELECT p AS orders_previous_priority, s = 1 AS customers_is_nation_first, count(*) AS orders_orders FROM o LEFT JOIN c ON o_custkey = c_custkey GROUP BY 1, 2",
    build=lambda e: changed(
        e,
        views=[
            view_with(e, "orders", dim("previous_priority", "lag(${priority}) over (partition by ${customers.custkey} order by ${order_raw}, ${orderkey})", window=True)),
            view_with(e, "customers", dim("nation_sequence", "row_number() over (partition by ${TABLE}.c_nationkey order by ${custkey})", "number", window=True), dim("is_nation_first", "${nation_sequence} = 1", "yesno")),
        ],
    ).query(**q("orders.orders", "orders.previous_priority customers.is_nation_first")),
)


def _two_models(e: Engine) -> Engine:
    shop = {**e.project.model, "mappings": {"kind": {"fields": ["orders.status"]}}}
    return changed(e, models=[shop, {"name": "web", "mappings": {"kind": {"fields": ["events.event_type"]}}}], views=[view_with(e, "events", model_name="web")])


add("model_of_fields", "SELECT event_type AS events_event_type, count(*) AS events_events FROM events GROUP BY 1", build=lambda e: _two_models(e).query(**q("events.events", "kind")))
add("model_by_name", "SELECT o_orderstatus AS orders_status, count(*) AS orders_orders FROM orders GROUP BY 1", build=lambda e: _two_models(e).query(**q("orders.orders", "kind"), model_name="shop"))
_SEEN = "WITH ev AS (SELECT e.*, c_mktsegment g FROM events e LEFT JOIN customer ON user_id = c_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')), s1 AS (SELECT *, ts AS t1 FROM ev WHERE event_type = 'view' AND g IN ('BUILDING', 'AUTOMOBILE')), s2 AS (SELECT DISTINCT e.* FROM ev e JOIN s1 ON e.user_id = s1.user_id AND s1.ts < e.ts AND datediff('day', s1.t1, e.ts) <= 3 WHERE e.event_type = 'click') "
_seen_steps = [[*_step("view"), {"field": "customers.segment", "expression": "isin", "value": ["BUILDING", "AUTOMOBILE"]}], _step("click")]
add(
    "funnel_access_filter",
    f"{_SEEN}SELECT 'Step 1' AS step, 1 AS step_order, count(*) AS events_events FROM s1 UNION ALL SELECT 'Step 2', 2, count(*) FROM s2",
    {**q("events.events"), "funnel": {"steps": _seen_steps, "within": {"value": 3, "unit": "day"}}},
    user={"segments": "BUILDING, MACHINERY"},
)
add(
    "funnel_empty_step",
    f"{_F}SELECT 'Step 1' AS step, 1 AS step_order, count(*) AS events_events, {R('sum(value)')} AS events_value FROM s1 UNION ALL SELECT 'Step 2', 2, NULL, 0",
    {**q("events.events events.value"), "funnel": {"steps": [_step("view"), _step("none such")], "within": {"value": 3, "unit": "day"}}},
)
_OF_F = f"SELECT DISTINCT o_orderkey, o_totalprice, date_trunc('month', o_orderdate)::TIMESTAMP m FROM {LO} WHERE o_orderstatus = 'F'"
add(
    "merged_topic_filter",
    f"SELECT coalesce(l.m, o.m) AS lineitem_ship_month, coalesce(l.m, o.m) AS orders_order_month, {R('l.v')} AS lineitem_revenue, {R('o.v')} AS orders_total_price FROM (SELECT date_trunc('month', l_shipdate)::TIMESTAMP m, sum(l_extendedprice) v FROM {LO} WHERE o_orderstatus = 'F' GROUP BY 1) l FULL JOIN (SELECT m, sum(o_totalprice) v FROM ({_OF_F}) GROUP BY 1) o ON l.m = o.m",
    build=lambda e: changed(e, topics=[{"name": "finished", "base_view": "lineitem", "views": {"orders": {}}, "always_filter": [{"field": "orders.status", "value": "F"}]}]).query(**q("lineitem.revenue orders.total_price", "orders.order_month"), merged_result=True, topic="finished"),
)
add(
    "cumulative_early_clock",
    f"SELECT s.y AS orders_order_year, {R('sum(o_totalprice)')} AS orders_running_price FROM (SELECT make_timestamp(y, 1, 1, 0, 0, 0) y FROM range(1995, 1999) t(y)) s JOIN orders ON date_trunc('year', o_orderdate) <= s.y GROUP BY 1",
    q("orders.running_price", "orders.order_year"),
    now=datetime(1998, 8, 15, 12),
)
_RANGE = [{"field": "orders.order_month", "expression": "greater_or_equal_than", "value": "2000-06-01"}, {"field": "orders.order_month", "expression": "less_than", "value": "2000-10-01"}]
add(
    "cumulative_range",
    _cum.format(g="o_orderstatus AS orders_status,", v=f"{R('sum(o_totalprice)')} AS orders_running_price, count(DISTINCT o_custkey) AS orders_running_buyers", n="1, 2").replace("GROUP BY", "WHERE s.d >= DATE '2000-06-01' AND s.d < DATE '2000-10-01' GROUP BY", 1),
    q("orders.running_price orders.running_buyers", "orders.status orders.order_month", where=_RANGE),
    now=_LATE,
)
add(
    "filter_expr_contains_backslash",
    "SELECT o_orderstatus AS orders_status, count(*) AS orders_orders FROM orders WHERE NOT o_orderpriority LIKE '%\\U_%' GROUP BY 1",
    q("orders.orders", "orders.status", where=[{"field": "orders.priority", "expression": "does_not_contain", "value": "\\U_"}]),
)
