from datetime import datetime

import duckdb
import pandas as pd
import pytest

from sparkloom import queries
from sparkloom.demo import engine, project
from sparkloom.errors import AccessDeniedOrDoesNotExistException, ConfigError, JoinError, ParseError, QueryError
from sparkloom.functions.dates import date_phrase
from sparkloom.functions.filters import parse_value, predicate
from sparkloom.plans.joins import functional_key
from sparkloom.plans.project import Project
from sparkloom.session import Engine

SF = "/root/testdata/sf0.001"
NOW = datetime(1998, 8, 15, 12)
SOME = [
    "simple_all_aggs", "median_percentile", "tier_dim", "measure_filters", "filter_or_nested", "is_not_in_query", "nested_subquery_filter", "entity_filter", "join_multi_hop", "join_as_twice", "join_theta", "fanout_sum_count_avg", "fanout_two_views",
    "sum_distinct_key", "window_dim", "window_measure_ratio", "nonadd_max", "nonadd_grouping", "merged_two", "merged_three_star", "merged_formula", "mapping_date_merged", "arb_merge_three", "cumulative_month", "cumulative_where", "funnel_three_dims", "funnel_filter_dropped_off",
    "topic_from_alias", "topic_fanout", "mql_funnel", "mql_joined_outer", "timezone_hour", "week_start_sunday", "duration_weeks", "access_filter",
    "join_inner", "join_full_outer", "join_composite_key", "join_allowed_fanouts", "nonadd_nulls_equal", "nonadd_nulls_differ", "nonadd_min_count", "nonadd_ignore_dims", "merged_mapped_dim", "window_two_views", "model_of_fields", "model_by_name", "funnel_access_filter", "funnel_empty_step", "funnel_two",
    "merged_topic_filter", "cumulative_early_clock", "cumulative_range", "cumulative_total", "cumulative_by_dim", "filter_expr_contains_backslash", "seed_cardinality",
]


def norm(df):
    df = df[sorted(df.columns)]
    cell = lambda v: "NULL" if pd.isna(v) else f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(cell(v.item() if hasattr(v, "item") else v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", SOME)
def test_query_matches_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert norm(got) == norm(con.execute(queries.SQL[name]).df())


@pytest.mark.parametrize(
    ("text", "start", "end"),
    [
        ("today", "1998-08-15 00:00:00", "1998-08-15 23:59:59"), ("yesterday", "1998-08-14 00:00:00", "1998-08-14 23:59:59"), ("this quarter", "1998-07-01 00:00:00", "1998-09-30 23:59:59"), ("last year", "1997-01-01 00:00:00", "1997-12-31 23:59:59"),
        ("3 months", "1998-06-01 00:00:00", "1998-08-31 23:59:59"), ("2 weeks ago", "1998-07-27 00:00:00", "1998-08-02 23:59:59"), ("month to date", "1998-08-01 00:00:00", "1998-08-14 23:59:59"), ("1 year ago to date", "1997-01-01 00:00:00", "1997-08-14 23:59:59"), ("1 year ago for 1 quarter", "1997-01-01 00:00:00", "1997-03-31 23:59:59"),
    ],
)
def test_date_phrases(text, start, end):
    assert tuple(map(str, date_phrase(text, NOW))) == (start, end)


def test_filter_language():
    assert parse_value("") == []
    assert parse_value("-a, -b") == [("isnotin", ["a", "b"])]
    assert parse_value(">= 3") == [("greater_or_equal_than", 3)]
    assert parse_value("-%x") == [("does_not_end_with_case_insensitive", "x")]
    assert predicate("c", "equal_to", "it's") == "c = 'it\\'s'"
    with pytest.raises(QueryError):
        parse_value("a, -b")
    with pytest.raises(QueryError):
        predicate("c", "nearly", 1)


def test_join_planning():
    g = project().graph
    base, joins = g.plan(["orders", "lineitem", "customers"])
    assert base == "lineitem" and [e.right for e in joins] == ["orders", "customers"]
    assert functional_key(base, joins) == "lineitem"
    with pytest.raises(JoinError):
        g.plan(["orders", "big_orders"])
    assert "customers" in g.joinable("orders")


def test_access_and_lookup():
    p = project()
    p.set_user({"department": "sales"})
    assert not p.has_field("customers.balance")
    with pytest.raises(AccessDeniedOrDoesNotExistException):
        p.get_field("customers.balance")
    p.set_user({"department": "finance"})
    assert p.has_field("customers.balance")
    with pytest.raises(QueryError, match="several views"):
        p.get_field("avg_balance")
    assert p.get_field("nations.count").type == "count"
    assert p.all_views["lineitem"].expand(["prices*", "-avg_price"]) == ["lineitem.price_tier", "lineitem.revenue"]


def test_null_semantics(spark):
    """NULL keys in outer joins and NOT IN lists, empty groups under fan-out."""
    frames = {
        "a": spark.createDataFrame([(1, "x", 5.0), (2, None, 7.0), (3, "y", None)], "id int, g string, v double"),
        "b": spark.createDataFrame([(1, 1), (2, 1), (3, None), (4, 3)], "id int, a_id int"),
    }
    views = [
        {"name": "a", "sql_table_name": "a", "identifiers": [{"name": "a", "type": "primary", "sql": "${id}"}], "fields": [{"name": "id", "field_type": "dimension", "type": "number", "sql": "${TABLE}.id", "primary_key": True}, {"name": "g", "field_type": "dimension", "sql": "${TABLE}.g"}, {"name": "total", "field_type": "measure", "type": "sum", "sql": "${TABLE}.v"}, {"name": "n", "field_type": "measure", "type": "count", "sql": "${TABLE}.v"}]},
        {"name": "b", "sql_table_name": "b", "identifiers": [{"name": "a", "type": "foreign", "sql": "${a_id}"}], "fields": [{"name": "id", "field_type": "dimension", "type": "number", "sql": "${TABLE}.id", "primary_key": True}, {"name": "a_id", "field_type": "dimension", "type": "number", "sql": "${TABLE}.a_id"}, {"name": "rows", "field_type": "measure", "type": "count"}]},
    ]
    e = Engine(spark, Project([{"name": "m"}], views), frames.__getitem__, clock=lambda: NOW)
    got = {r.a_g: (r.b_rows, r.a_total, r.a_n) for r in e.query(["b.rows", "a.total", "a.n"], ["a.g"]).collect()}
    assert got == {"x": (2, 5.0, 1), "y": (1, 0.0, None), None: (1, 0.0, None)}  # no value: SUM is 0, COUNT is NULL
    sub = {"field": "a.id", "expression": "is_not_in_query", "value": {"query": {"metrics": [], "dimensions": ["b.a_id"]}, "field": "b.a_id"}}
    assert e.query(["a.n"], [], where=[sub]).collect()[0].a_n == 0  # the list holds NULL


def test_errors(spark):
    e = engine(spark, SF)
    for bad in (
        {"metrics": ["orders.orders", "orders.orders"]}, {"metrics": ["orders.status"]}, {"metrics": ["orders.orders"], "dimensions": ["orders.orderkey"], "having": [{"field": "orders.orders", "expression": "greater_than", "value": 1}]},
        {"metrics": ["orders.orders"], "where": [{"field": "orders.orders", "expression": "greater_than", "value": 1}]}, {"metrics": ["orders.running_price"], "funnel": {"steps": [], "within": {"value": 1, "unit": "day"}}},
        {"metrics": ["events.events"], "funnel": {"steps": []}}, {"merged_queries": [{"metrics": ["orders.orders"]}]},
    ):
        with pytest.raises(QueryError):
            e.query(**bad)
    with pytest.raises(ParseError):
        e.query(sql="SELECT * FROM MQL(orders.orders BY orders.status")
    with pytest.raises(ConfigError):
        Project([{"name": "m"}], [{"name": "x", "fields": []}, {"name": "X", "fields": []}]).all_views  # noqa: B018


def test_filters_reach_the_scan(spark):
    plan = engine(spark, SF).explain(metrics=["lineitem.revenue"], dimensions=["lineitem.returnflag"], where=[{"field": "lineitem.quantity", "expression": "greater_than", "value": 25}])
    assert "GreaterThan(l_quantity,25.0)" in plan and "l_comment" not in plan


def test_quantiles_are_exact_and_dealt_out(spark):
    """The same values as Spark's own functions, which take a group's values into one task, and none of these in the plan."""
    sql = """
        SELECT id, g, if(g = 'nulls', null, v) v, cast(v AS decimal(20, 3)) d, cast(cast(v AS decimal(20, 3)) AS string) s, make_dt_interval(0, 0, 0, round(v)) i, timestamp_ntz'1998-08-01 00:00:00' + make_dt_interval(cast(id % 9 AS int)) t FROM (
            SELECT id, CASE WHEN id < 20000 THEN 'large' WHEN id < 21000 THEN 'ties' WHEN id < 21002 THEN 'two' WHEN id < 21003 THEN 'one' WHEN id < 21010 THEN 'nulls' WHEN id < 21100 THEN 'nan' END g,
                CASE WHEN id < 20000 THEN round((xxhash64(id) % 1000000) / 7, 3) * if(id % 10 = 0, 1e6, 1) WHEN id < 21000 THEN id % 3 WHEN id >= 21010 AND id % 2 = 0 THEN null ELSE id * 0.25 END v FROM range(21200))
        UNION ALL SELECT 30000, 'nan', double('nan'), null, null, null, null"""
    rows = spark.sql(sql).localCheckpoint()
    field = lambda n, t, x, **more: {"name": n, "field_type": "measure", "type": t, "sql": x, **more}
    measures = [field(f"{c}{p}", "percentile", f"${{TABLE}}.{c}", percentile=p) for c in "vsi" for p in (1, 99)] + [field(f"{c}50", "median", f"${{TABLE}}.{c}") for c in "vdsi"]
    spread = field("spread", "number", "${v99} - ${v50} + count(${TABLE}.v) + nullif(${d50}, 0)")
    running = {"name": "running", "field_type": "measure", "type": "cumulative", "measure": "v50"}
    view = {"name": "a", "sql_table_name": "a", "default_date": "t", "fields": [{"name": "id", "field_type": "dimension", "type": "number", "sql": "${TABLE}.id", "primary_key": True}, {"name": "g", "field_type": "dimension", "sql": "${TABLE}.g"}, {"name": "t", "field_type": "dimension_group", "type": "time", "sql": "${TABLE}.t"}, *measures, spread, running]}
    e = Engine(spark, Project([{"name": "m"}], [view]), lambda _: rows, clock=lambda: NOW)
    names = [f"a.{m['name']}" for m in measures] + ["a.spread"]
    own = lambda c, p: f"percentile({c}, {p / 100!r}D)"
    columns = ", ".join(f"{own(m['name'][0], m.get('percentile', 50))} a_{m['name']}" for m in measures)
    spread = f"{own('v', 99)} - {own('v', 50)} + count(v) + nullif({own('d', 50)}, 0) a_spread"
    text = lambda df: sorted(str(r) for r in df.collect())
    rows.createOrReplaceTempView("quantile_rows")
    assert text(e.query(names, ["a.g"])) == text(spark.sql(f"SELECT g a_g, {columns}, {spread} FROM quantile_rows GROUP BY 1"))
    assert text(e.query(names)) == text(spark.sql(f"SELECT {columns}, {spread} FROM quantile_rows"))
    assert text(e.query(["a.v50"], where=["${a.id} < 0"])) == ["Row(a_v50=None)"]
    assert text(e.query(["a.running"], ["a.g"])) == text(spark.sql("SELECT g a_g, median(v) a_running FROM quantile_rows WHERE t IS NOT NULL GROUP BY 1"))
    high = e.query(["a.v50"], ["a.g"], having=[{"field": "a.v99", "expression": "greater_than", "value": 5000}])
    assert text(high) == text(spark.sql(f"SELECT g a_g, median(v) a_v50 FROM quantile_rows GROUP BY 1 HAVING {own('v', 99)} > 5000"))
    for request in ({"metrics": ["a.v50", "a.v99", "a.d50"]}, {"metrics": ["a.spread"]}, {"metrics": ["a.running"]}):
        assert "percentile(" not in e.explain(**request, dimensions=["a.g"])
