"""Join trees, access filters, models and the shape of physical plans."""

from datetime import datetime

import pytest

from sparkloom.demo import engine
from sparkloom.errors import AccessDeniedOrDoesNotExistException, JoinError, QueryError
from sparkloom.operators.funnel import _query
from sparkloom.plans.joins import Edge, functional_key
from sparkloom.queries import changed, q, view_with

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def shop(spark):
    return engine(spark, SF)


@pytest.mark.parametrize(
    ("joins", "key"),
    [
        ([], "a"),
        ([("a", "b", "many_to_one"), ("b", "c", "many_to_one")], "a"),
        ([("a", "b", "one_to_many")], "b"),
        ([("a", "b", "one_to_many"), ("b", "c", "one_to_many")], "c"),
        ([("a", "b", "one_to_many"), ("a", "c", "one_to_many")], None),
        ([("a", "b", "many_to_one"), ("b", "c", "one_to_many")], None),
        ([("a", "b", "many_to_one"), ("b", "c", "one_to_one"), ("c", "d", "one_to_many")], None),
        ([("a", "b", "many_to_one"), ("a", "c", "one_to_many")], "c"),
        ([("a", "b", "many_to_many")], None),
    ],
)
def test_the_view_that_no_join_repeats(joins, key):
    assert functional_key("a", [Edge(left, right, "TRUE", kind) for left, right, kind in joins]) == key


def test_access_filters_of_funnel_steps_hold_once(shop):
    shop.set_user({"segments": "BUILDING"})
    step = {"field": "customers.segment", "expression": "equal_to", "value": "AUTOMOBILE"}
    funnel = {"steps": [step, {"field": "events.event_type", "expression": "equal_to", "value": "click"}], "within": {"value": 3, "unit": "day"}}
    query, _, _ = _query(shop, funnel, metrics=["events.events"])
    assert [c["field"] for c in query.where] == ["customers.segment"]
    assert all(not r.events_events for r in shop.query(**q("events.events"), funnel=funnel).collect())
    shop.set_user(None)


def test_only_join_and_explicit_types(shop):
    lineitem = view_with(shop, "lineitem")
    only = [{**i, "only_join": ["orders"]} if i["name"] == "part_id" else i for i in lineitem["identifiers"]]
    with pytest.raises(JoinError):
        changed(shop, views=[{**lineitem, "identifiers": only}]).query(**q("lineitem.lines", "parts.brand"), single_query=True)
    kinds = {(r["from_view"], r["join_view"]): (r["relationship"], r["join_type"]) for r in shop.project.graph.relationships()}
    assert kinds["lineitem", "orders"] == ("many_to_one", "left_outer") and kinds["buckets", "suppliers"] == ("many_to_one", "inner")
    assert "lineitem.revenue" in shop.project.graph.joinable_fields("orders")


def test_models(shop):
    two = changed(shop, models=[{"name": "web"}], views=[view_with(shop, "events", model_name="web")])
    with pytest.raises(QueryError):
        two.query(**q("events.events orders.orders"))
    with pytest.raises(AccessDeniedOrDoesNotExistException):
        two.query(**q("events.events"), model_name="none such")


def test_having_may_be_a_value_alone(shop):
    request = q("lineitem.revenue orders.orders", "orders.order_month", having=[{"field": "orders.orders", "value": ">3"}])
    assert all(r.orders_orders > 3 for r in shop.query(**request, merged_result=True).collect())


def test_mql_leaves_no_views(spark, shop):
    n = shop.query(sql="SELECT count(*) AS n FROM MQL(orders.orders BY orders.status) AS m")
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("mql_")]
    assert n.first().n == 3


def test_plans_bring_no_whole_table_to_one_task(shop):
    """Partial sums may meet in one task, rows may not: semi-additive and as-of values need no window."""
    for request in (q("events.last_value"), q("events.last_value", "events.event_type")):
        plan = shop.explain(**request)
        assert "Window" not in plan
        assert "BroadcastNestedLoopJoin" not in plan or not request["dimensions"]  # with one row, where there is no dimension
    late = engine(shop.spark, SF, datetime(2001, 8, 31))
    assert "Window" not in late.explain(**q("orders.running_price"))


def test_days_are_summed_before_they_meet_the_spine(shop):
    lines = engine(shop.spark, SF, datetime(2001, 8, 31)).explain(**q("orders.recent_price", "orders.order_date")).split("\n\n")[0]
    join = lines.index("BroadcastNestedLoopJoin")
    assert "HashAggregate" in lines[join : lines.index("BroadcastExchange")]
