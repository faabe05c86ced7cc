from datetime import datetime

from sparkloom.cli import main
from sparkloom.demo import engine, project
from sparkloom.plans.dashboards import requests
from sparkloom.plans.validate import validate
from sparkloom.sources.loader import dump, load
from sparkloom.sources.seed import view_of
from sparkloom.sources.semantic import convert
from sparkloom.streaming.aggregates import windowed

SF = "/root/testdata/sf0.001"


def test_dump_load_validate(tmp_path, capsys):
    p = project()
    dump(p, tmp_path)
    again = load(tmp_path, refs={"parts": "part"})
    assert {f.id for f in again.fields()} == {f.id for f in p.fields()}
    assert validate(again) == []
    assert main(["validate", str(tmp_path)]) == 0 and main(["list", str(tmp_path), "metrics"]) == 0
    assert "lineitem.revenue" in capsys.readouterr().out
    broken = p.replaced(views=[{"name": "orders", "sql_tabel_name": "x", "fields": [{"name": "a b", "field_type": "measure", "type": "summ", "sql": "1"}]}])
    text = "\n".join(f["message"] for f in validate(broken))
    assert "Did you mean sql_table_name?" in text and "Did you mean sum" in text and "invalid name" in text


def test_seed_and_dashboards(spark):
    v = view_of(spark.read.parquet(f"{SF}/customer.parquet"), "customer", "customer", "shop")
    kinds = {f["name"]: (f["field_type"], f["type"], f.get("searchable")) for f in v["fields"]}
    assert kinds["c_mktsegment"] == ("dimension", "string", True) and kinds["count"] == ("measure", "count", None)
    found = requests(project(), {"filters": [{"field": "orders.status", "value": "F, O"}], "elements": [{"metric": "orders.orders", "slice_by": ["orders.priority"]}]}, datetime(1998, 8, 15))
    assert found[0]["where"] == [{"field": "orders.status", "expression": "isin", "value": ["F", "O"]}]
    assert engine(spark, SF).query(**found[0]).count() == 5


def test_semantic_models(spark):
    docs = [
        {"semantic_models": [{"name": "orders", "model": "orders", "defaults": {"agg_time_dimension": "ordered"}, "entities": [{"name": "order", "type": "primary", "expr": "o_orderkey"}], "dimensions": [{"name": "ordered", "type": "time", "expr": "o_orderdate"}, {"name": "status", "type": "categorical", "expr": "o_orderstatus"}], "measures": [{"name": "total", "agg": "sum", "expr": "o_totalprice"}, {"name": "n", "agg": "count", "expr": "o_orderkey"}]}]},
        {"metrics": [{"name": "total", "type": "simple", "type_params": {"measure": "total"}}, {"name": "finished", "type": "simple", "type_params": {"measure": "n"}, "filter": "{{ Dimension('order__status') }} = 'F'"}, {"name": "per", "type": "ratio", "type_params": {"numerator": "total", "denominator": "finished"}}]},
    ]
    from sparkloom.plans.project import Project
    from sparkloom.session import Engine

    e = Engine(spark, Project(*convert(docs)), lambda t: spark.read.parquet(f"{SF}/{t}.parquet"))
    r = e.query(["orders.total", "orders.finished", "orders.per"]).first()
    assert abs(r.orders_per - r.orders_total / r.orders_finished) < 1e-6


def test_stream(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    e = engine(spark, SF)
    df = windowed(e, spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ["events.events", "events.value"], ["events.event_type"], "1 day")
    q = df.writeStream.outputMode("complete").format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    want = e.query(["events.events"], ["events.event_date", "events.event_type"])
    assert spark.table("streamed").count() == want.count()
    assert spark.table("streamed").agg({"events_events": "sum"}).first()[0] == 1000
