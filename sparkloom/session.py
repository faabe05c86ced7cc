"""The engine: answers metric requests with DataFrames."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.errors import JoinError, QueryError
from sparkloom.operators.arbitrary import build_arbitrary
from sparkloom.operators.cumulative import build_cumulative
from sparkloom.operators.funnel import build_funnel
from sparkloom.operators.merged import build_merged
from sparkloom.operators.single import SingleQuery, parse_order, walk
from sparkloom.plans.mappings import resolve_mappings
from sparkloom.plans.mql import Mql, split_mql
from sparkloom.plans.project import Project, View, template
from sparkloom.sources.tables import resolve_table


class Engine:
    """project: what can be asked; tables: table name -> DataFrame (by default the catalog); clock: now, for date phrases and as-of dates."""

    def __init__(self, spark: SparkSession, project: Project, tables: Callable[[str], DataFrame] | None = None, clock: Callable[[], datetime] = datetime.now, query_attributes: dict | None = None):
        self.spark, self.project, self.clock = spark, project, clock
        self.tables = tables or spark.table
        self.query_attributes = query_attributes or {}

    def now(self) -> datetime:
        return self.clock()

    # ---- scans

    def scan(self, view: str | View) -> DataFrame:
        """A view's table or derived table, under the view's name."""
        v = self.project.all_views[view] if isinstance(view, str) else view
        derived = (v.data.get("derived_table") or {}).get("sql")
        if derived:
            return self.spark.sql(template(derived, self.project.user, self.query_attributes)).alias(v.name)
        return self.tables(resolve_table(self.project, v, self.query_attributes)).alias(v.name)

    def secure(self, view: str) -> DataFrame:
        """A view's rows under its access and always filters, for free SQL; the filters must be on the view itself."""
        v = self.project.view(view)
        q = SingleQuery.__new__(SingleQuery)
        from sparkloom.operators.render import Scope

        q.engine, q.project, q.topic, q.metrics, q.dims = self, self.project, None, [], []
        q.scope = Scope(self.project, self.now())
        conditions = [*q.access_filters([v.name]), *[{**c, "field": c["field"] if "." in c["field"] else f"{v.name}.{c['field']}", "_mini": True} for c in v.data.get("always_filter") or []]]
        for c in conditions:
            if q.field_of(c).view.name != v.name:
                raise QueryError(f"the filter on {c['field']} is not on view {v.name}")
        q.base = v.name
        return self.scan(v).where(F.expr(q.sql_of(conditions))).alias(v.name)

    def register(self, view: str, name: str | None = None) -> str:
        name = name or view
        self.secure(view).createOrReplaceTempView(name)
        return name

    # ---- queries

    def query(self, metrics=(), dimensions=(), where=None, having=None, order_by=None, limit=None, *, funnel=None, merged_queries=None, sql=None, topic=None, merged_result=None, single_query=False, force_group_by=False, select_raw_sql=None, model_name=None) -> DataFrame:
        """Exactly one of: metrics and dimensions, merged_queries, sql (with MQL).

        model_name: whose mappings hold; by default that of the fields' views.
        """
        if sql is not None:
            return self.mql(sql)
        if merged_queries:
            return build_arbitrary(self, merged_queries, where, having, order_by, limit)
        args = {"metrics": list(metrics), "dimensions": list(dimensions), "where": where, "having": having, "order_by": order_by, "limit": limit, "topic": topic}
        p = self.project
        args, forced = resolve_mappings(p, args, p.model_for([*args["metrics"], *args["dimensions"]], model_name))
        chosen = [p.get_field(m, topic=p.topic(topic) if isinstance(topic, str) else topic) for m in args["metrics"]]
        if not single_query and (merged_result or forced or any(m.is_merged() and not m.is_cumulative() for m in chosen)):
            return build_merged(self, **args, funnel=funnel)
        try:
            return self._one(args, chosen, funnel, force_group_by, select_raw_sql)
        except JoinError as e:
            if single_query or funnel or e.location == "topic" or len(chosen) < 2:
                raise
            return build_merged(self, **args)

    def _one(self, args: dict, chosen, funnel, force_group_by, raw) -> DataFrame:
        conditions = [args["having"]] if isinstance(args["having"], dict) else args["having"] or []
        later = [self.project.get_field(c["field"]) for c in walk(conditions) if isinstance(c, dict) and "field" in c]
        ordered = [self.project.get_field(n) for n, _ in parse_order(args["order_by"]) if self.project.has_field(n)]
        if any(m.is_cumulative() for m in (*chosen, *later, *ordered)):
            return build_cumulative(self, **args, funnel=funnel)
        if funnel:
            return build_funnel(self, funnel, **args)
        return SingleQuery(self, **args, force_group_by=force_group_by, select_raw_sql=raw).build()

    def explain(self, **request) -> str:
        """The physical plan of a request, as text."""
        return self.query(**request)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def mql(self, sql: str) -> DataFrame:
        """SQL in which FROM MQL(...) stands for a metric request."""
        text, names = sql, []
        try:
            while (found := split_mql(text)) is not None:
                before, inner, after = found
                names.append(name := f"mql_{uuid.uuid4().hex[:12]}")
                self.query(**Mql(inner, self.project).request()).createOrReplaceTempView(name)
                text = f"{before}{name}{after}"
            return self.spark.sql(text.rstrip().rstrip(";"))  # analysed here, so the views can go
        finally:
            for name in names:
                self.spark.catalog.dropTempView(name)

    # ---- listings

    def list_metrics(self, view: str | None = None) -> list:
        return self.project.metrics(view)

    def list_dimensions(self, view: str | None = None) -> list:
        return self.project.dimensions(view)

    def list_views(self) -> list:
        return self.project.views()

    def list_models(self) -> list[dict]:
        return self.project.models_data

    def list_topics(self) -> list:
        return self.project.topics()

    def list_dashboards(self) -> list[dict]:
        return self.project.dashboards()

    def get_metric(self, name: str):
        f = self.project.get_field(name)
        if not f.is_measure:
            raise QueryError(f"{name} is not a metric")
        return f

    def get_dimension(self, name: str):
        f = self.project.get_field(name)
        if f.is_measure:
            raise QueryError(f"{name} is not a dimension")
        return f

    def set_user(self, user: dict | None) -> None:
        self.project.set_user(user)
