"""A semantic model over the star-schema tables, used by the registered queries and the bench."""

from __future__ import annotations

import copy
from datetime import datetime

from pyspark.sql import SparkSession

from sparkloom.plans.project import Project
from sparkloom.session import Engine

NOW = datetime(1998, 8, 15, 12, 0, 0)
LINE_KEY = "concat_ws('-', ${TABLE}.l_orderkey, ${TABLE}.l_linenumber, ${TABLE}.l_partkey, ${TABLE}.l_suppkey, ${TABLE}.l_shipdate, ${TABLE}.l_extendedprice)"


def dim(name, sql, type="string", **more):
    return {"name": name, "field_type": "dimension", "type": type, "sql": sql, **more}


def metric(name, type, sql=None, **more):
    return {"name": name, "field_type": "measure", "type": type, "sql": sql, **more}


def group(name, sql, **more):
    return {"name": name, "field_type": "dimension_group", "type": "time", "sql": sql, **more}


MODEL = {
    "name": "shop", "connection": "spark", "week_start_day": "monday",
    "mappings": {"segment": {"fields": ["customers.segment"]}, "status": {"fields": ["orders.status", "lineitem.linestatus"]}},
    "access_grants": [{"name": "finance", "user_attribute": "department", "allowed_values": ["finance", "executive"]}],
}

VIEWS = [
    {
        "name": "lineitem", "model_name": "shop", "sql_table_name": "lineitem", "default_date": "ship",
        "identifiers": [{"name": "line_id", "type": "primary", "sql": "${line_id}"}, {"name": "order_id", "type": "foreign", "sql": "${orderkey}"}, {"name": "part_id", "type": "foreign", "sql": "${TABLE}.l_partkey"}, {"name": "supplier_id", "type": "foreign", "sql": "${TABLE}.l_suppkey"}],
        "sets": [{"name": "prices", "fields": ["price_tier", "revenue", "avg_price"]}],
        "fields": [
            dim("line_id", LINE_KEY, primary_key=True, hidden=True), dim("orderkey", "${TABLE}.l_orderkey", "number"), dim("returnflag", "${TABLE}.l_returnflag"), dim("linestatus", "${TABLE}.l_linestatus"), dim("quantity", "${TABLE}.l_quantity", "number"),
            dim("price", "${TABLE}.l_extendedprice", "number"), dim("price_tier", "${TABLE}.l_extendedprice", "tier", tiers=[1000, 20000, 50000]), dim("is_discounted", "${TABLE}.l_discount > 0.05", "yesno"),
            dim("flag_of_big", "${TABLE}.l_returnflag", filters=[{"field": "quantity", "value": ">25"}]),
            group("ship", "${TABLE}.l_shipdate"),
            {"name": "to_ship", "field_type": "dimension_group", "type": "duration", "sql_start": "${orders.order_raw}", "sql_end": "${ship_raw}"},
            metric("lines", "count"), metric("revenue", "sum", "${TABLE}.l_extendedprice"), metric("total_quantity", "sum", "${TABLE}.l_quantity"), metric("avg_price", "average", "${TABLE}.l_extendedprice"), metric("min_price", "min", "${TABLE}.l_extendedprice"), metric("max_price", "max", "${TABLE}.l_extendedprice"),
            metric("parts_sold", "count_distinct", "${TABLE}.l_partkey"), metric("median_price", "median", "${TABLE}.l_extendedprice"), metric("p75_price", "percentile", "${TABLE}.l_extendedprice", percentile=75),
            metric("returned_revenue", "sum", "${TABLE}.l_extendedprice", filters=[{"field": "returnflag", "value": "R"}]), metric("big_lines", "count", "${TABLE}.l_orderkey", filters=[{"field": "quantity", "value": ">=40"}, {"field": "is_discounted", "value": True}]),
            metric("avg_line", "number", "${revenue} / nullif(${lines}, 0)"), metric("discount_share", "number", "sum(${TABLE}.l_extendedprice * ${TABLE}.l_discount) / ${revenue}"), metric("last_ship", "time", "max(${TABLE}.l_shipdate)"), metric("any_big", "yesno", "max(${quantity}) > 49"), metric("flags", "string", "listagg(distinct ${returnflag}, '|') within group (order by ${returnflag})"),
            metric("revenue_share", "number", "ratio_to_report(${revenue}) over ()", window=True),
            metric("order_price_once", "sum_distinct", "${orders.price}", sql_distinct_key="${orders.orderkey}"), metric("avg_order_price_once", "average_distinct", "${orders.price}", sql_distinct_key="${orders.orderkey}"),
            metric("revenue_per_order_value", "number", "${revenue} / nullif(${orders.total_price}, 0)", is_merged_result=True),
        ],
    },
    {
        "name": "orders", "model_name": "shop", "sql_table_name": "orders", "default_date": "order",
        "identifiers": [{"name": "order_id", "type": "primary", "sql": "${orderkey}"}, {"name": "customer_id", "type": "foreign", "sql": "${TABLE}.o_custkey"}],
        "fields": [
            dim("orderkey", "${TABLE}.o_orderkey", "number", primary_key=True), dim("custkey", "${TABLE}.o_custkey", "number"), dim("status", "${TABLE}.o_orderstatus"), dim("priority", "${TABLE}.o_orderpriority"), dim("price", "${TABLE}.o_totalprice", "number"),
            {"name": "priority_group", "field_type": "dimension", "type": "string", "case": {"whens": [{"sql": "${priority} in ('1-URGENT', '2-HIGH')", "label": "high"}, {"sql": "${priority} = '3-MEDIUM'", "label": "medium"}], "else": "low"}},
            dim("order_sequence", "row_number() over (partition by ${custkey} order by ${order_raw}, ${orderkey})", "number", window=True), dim("is_first_order", "${order_sequence} = 1", "yesno"),
            group("order", "${TABLE}.o_orderdate"),
            metric("orders", "count", "${orderkey}"), metric("total_price", "sum", "${TABLE}.o_totalprice"), metric("avg_price", "average", "${TABLE}.o_totalprice"), metric("buyers", "count_distinct", "${custkey}"),
            metric("first_orders", "count", "${orderkey}", filters=[{"field": "is_first_order", "value": True}]),
            metric("running_price", "cumulative", measure="total_price"), metric("running_buyers", "cumulative", measure="buyers"), metric("running_orders", "cumulative", measure="orders"), metric("running_avg", "cumulative", measure="avg_price"),
            metric("recent_price", "cumulative", measure="total_price", cumulative_where="${order_raw} > ${cumulative_date} - interval 365 day"),
            metric("running_per_order", "number", "${running_price} / nullif(${running_orders}, 0)"),
            metric("price_rank_share", "number", "${total_price} / sum(${total_price}) over ()", window=True),
        ],
    },
    {
        "name": "customers", "model_name": "shop", "sql_table_name": "customer",
        "identifiers": [{"name": "customer_id", "type": "primary", "sql": "${custkey}"}, {"name": "customer_nation", "type": "foreign", "sql": "${TABLE}.c_nationkey"}],
        "access_filters": [{"field": "segment", "user_attribute": "segments"}],
        "fields": [dim("custkey", "${TABLE}.c_custkey", "number", primary_key=True, tags=["customer"]), dim("name", "${TABLE}.c_name"), dim("segment", "${TABLE}.c_mktsegment"), dim("balance", "${TABLE}.c_acctbal", "number", required_access_grants=["finance"]), metric("customers", "count", canon_date="orders.order"), metric("avg_balance", "average", "${TABLE}.c_acctbal", canon_date="orders.order")],
    },
    {
        "name": "suppliers", "model_name": "shop", "sql_table_name": "-- if prod -- supplier -- if dev -- supplier_dev",
        "identifiers": [{"name": "supplier_id", "type": "primary", "sql": "${suppkey}"}, {"name": "supplier_nation", "type": "foreign", "sql": "${TABLE}.s_nationkey"}],
        "fields": [dim("suppkey", "${TABLE}.s_suppkey", "number", primary_key=True), dim("name", "${TABLE}.s_name"), metric("avg_balance", "average", "${TABLE}.s_acctbal"), metric("suppliers", "count")],
    },
    {
        "name": "parts", "model_name": "shop", "sql_table_name": "ref('parts')", "identifiers": [{"name": "part_id", "type": "primary", "sql": "${partkey}"}],
        "fields": [dim("partkey", "${TABLE}.p_partkey", "number", primary_key=True), dim("brand", "${TABLE}.p_brand"), dim("type", "${TABLE}.p_type"), dim("size_tier", "${TABLE}.p_size", "tier", tiers=[10, 30]), metric("avg_retail", "average", "${TABLE}.p_retailprice")],
    },
    {
        "name": "nations", "model_name": "shop", "sql_table_name": "nation",
        "identifiers": [{"name": "customer_nation", "type": "primary", "sql": "${nationkey}", "join_as": "customer_nations"}, {"name": "supplier_nation", "type": "primary", "sql": "${nationkey}", "join_as": "supplier_nations"}, {"name": "region_id", "type": "foreign", "sql": "${TABLE}.n_regionkey"}],
        "fields": [dim("nationkey", "${TABLE}.n_nationkey", "number", primary_key=True), dim("name", "${TABLE}.n_name"), metric("nations", "count")],
    },
    {"name": "regions", "model_name": "shop", "sql_table_name": "region", "identifiers": [{"name": "region_id", "type": "primary", "sql": "${regionkey}"}], "fields": [dim("regionkey", "${TABLE}.r_regionkey", "number", primary_key=True), dim("name", "${TABLE}.r_name")]},
    {
        "name": "events", "model_name": "shop", "sql_table_name": "events", "default_date": "event",
        "identifiers": [{"name": "event_id", "type": "primary", "sql": "${event_id}"}, {"name": "customer_id", "type": "foreign", "sql": "${TABLE}.user_id"}],
        "fields": [
            dim("event_id", "${TABLE}.event_id", "number", primary_key=True), dim("user_id", "${TABLE}.user_id", "number"), dim("event_type", "${TABLE}.event_type"), group("event", "${TABLE}.ts"),
            metric("events", "count", "${event_id}"), metric("users", "count_distinct", "${user_id}"), metric("value", "sum", "${TABLE}.value"),
            metric("last_value", "sum", "${TABLE}.value", non_additive_dimension={"name": "event_raw", "window_choice": "max"}),
            metric("first_value_of_user", "sum", "${TABLE}.value", non_additive_dimension={"name": "event_raw", "window_choice": "min", "window_groupings": ["user_id"]}),
            metric("last_events_overall", "count", "${event_id}", non_additive_dimension={"name": "event_date", "window_choice": "max", "window_aware_of_query_dimensions": False}),
        ],
    },
    {
        "name": "big_orders", "model_name": "shop", "derived_table": {"sql": "select * from orders where o_totalprice > {{ user_attributes['least'] }}"}, "always_filter": [{"field": "status", "value": "-P"}],
        "fields": [dim("orderkey", "${TABLE}.o_orderkey", "number", primary_key=True), dim("status", "${TABLE}.o_orderstatus"), metric("orders", "count")],
    },
    {
        "name": "buckets", "model_name": "shop", "sql_table_name": "part",
        "identifiers": [{"name": "bucket_join", "type": "join", "reference": "suppliers", "relationship": "many_to_one", "join_type": "inner", "sql_on": "${buckets.size} = ${suppliers.suppkey} and ${suppliers.suppkey} > 2"}],
        "fields": [dim("partkey", "${TABLE}.p_partkey", "number", primary_key=True), dim("size", "${TABLE}.p_size", "number"), metric("parts", "count")],
    },
]

TOPICS = [
    {"name": "lineitem_topic", "label": "Line items", "base_view": "lineitem", "views": {"orders": {}, "customers": {}, "parts": {"join": {"join_type": "inner", "relationship": "many_to_one", "sql_on": "${lineitem.parts_key} = ${parts.partkey}"}}, "suppliers": {}, "buyer_orders": {"from": "orders", "join": {"join_type": "left_outer", "relationship": "many_to_one", "sql_on": "${lineitem.orderkey} = ${buyer_orders.orderkey} and ${buyer_orders.status} = 'F'"}}}},
]


def project(timezone: str | None = None, week_start: str = "monday", fiscal_offset: int = 0) -> Project:
    views = copy.deepcopy(VIEWS)
    views[0]["fields"].append(dim("parts_key", "${TABLE}.l_partkey", "number"))
    model = {**copy.deepcopy(MODEL), "week_start_day": week_start, "fiscal_month_offset": fiscal_offset}
    return Project([model], views, copy.deepcopy(TOPICS), refs={"parts": "part"}, timezone=timezone)


def engine(spark: SparkSession, sf_dir: str, now: datetime = NOW, **options) -> Engine:
    """The demo project over Parquet tables of a folder; derived tables read temp views of the same names."""
    tables = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    tables("orders").createOrReplaceTempView("orders")
    return Engine(spark, project(**options), tables, clock=lambda: now)
