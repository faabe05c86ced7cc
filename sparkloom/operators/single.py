"""One query over one join tree: scan, join, filter, window, aggregate, sort, limit."""

from __future__ import annotations

import re
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from sparkloom.errors import QueryError
from sparkloom.functions.filters import parse_value, predicate
from sparkloom.operators.quantiles import aggregated, with_quantiles
from sparkloom.operators.render import Scope, window_column
from sparkloom.plans.joins import protected_views
from sparkloom.plans.project import REFERENCE, Field, as_list

if TYPE_CHECKING:
    from sparkloom.session import Engine

SUBQUERIES = ("is_in_query", "is_not_in_query")
FUNNELS = ("converted", "dropped_off")


def walk(conditions) -> list[dict]:
    """All leaf conditions of a nested list."""
    out = []
    for c in conditions or []:
        if isinstance(c, dict) and "conditional_filter_logic" in c:
            c = c["conditional_filter_logic"]
        if isinstance(c, dict) and "conditions" in c:
            out += walk(c["conditions"])
        else:
            out.append(c)
    return out


class SingleQuery:
    """Binds names, plans joins, and builds the DataFrame of one query."""

    def __init__(self, engine: Engine, metrics=(), dimensions=(), where=None, having=None, order_by=None, limit=None, topic=None, force_group_by=False, select_raw_sql=None, protect_all=False, **_):
        self.engine, self.project = engine, engine.project
        self.topic = engine.project.topic(topic) if isinstance(topic, str) else topic
        get = lambda n: self.project.get_field(n, topic=self.topic)
        self.metrics, self.dims = [get(m) for m in metrics], [get(d) for d in dimensions]
        ids = [f.id for f in (*self.metrics, *self.dims)]
        if len(set(ids)) < len(ids):
            raise QueryError(f"fields are named twice: {', '.join(sorted(i for i in set(ids) if ids.count(i) > 1))}")
        for f in self.metrics:
            if not f.is_measure:
                raise QueryError(f"{f.id} is not a metric")
        for f in self.dims:
            if f.is_measure:
                raise QueryError(f"{f.id} is not a dimension")
        self.where = [where] if isinstance(where, (str, dict)) else list(where or [])
        self.having = [having] if isinstance(having, (str, dict)) else list(having or [])
        self.order_by, self.limit = parse_order(order_by), limit
        self.raw = list(select_raw_sql or [])
        self.scope = Scope(self.project, engine.now(), query_attributes=engine.query_attributes)
        self.scope.dimension_fields = self.dims
        self.where += self.always_filters()
        pk = self.metrics[0].view.primary_key if self.metrics else None
        self.row_level = bool(pk and any(d.id == pk.id for d in self.dims) and not force_group_by)
        if self.row_level and (self.having or self.order_by):
            raise QueryError("a row-level query takes neither having nor order_by")
        self.given = self.where
        self.plan()
        self.scope.protected = None if protect_all else protected_views(self.base, self.joins, self.topic) if self.joins else set()
        self.scope.dims = [self.scope.row(d) for d in self.dims] + [strip_alias(r) for r in self.raw]

    # ---- binding

    def field_of(self, c: dict, view=None) -> Field:
        return self.project.get_field(c["field"], view, topic=self.topic)

    def always_filters(self) -> list[dict]:
        """always_filter of the views of metrics and dimensions, of the topic, and row-level access filters."""
        out, seen = [], set()
        for f in (*self.metrics, *self.dims):
            if f.view.name not in seen:
                seen.add(f.view.name)
                for c in f.view.data.get("always_filter") or (f.view.data.get("always_filters") or []):
                    out.append({**c, "field": c["field"] if "." in c["field"] else f"{f.view.name}.{c['field']}", "_mini": True})
        if self.topic:
            out += [{**c, "_mini": True} for c in self.topic.data.get("always_filter") or []]
        return out

    def access_filters(self, views: list[str]) -> list[dict]:
        user, out = self.project.user or {}, []
        topic_filters = (self.topic.data.get("access_filters") or []) if self.topic else []
        covered = {a["user_attribute"] for a in topic_filters}
        for a in topic_filters:
            if a["user_attribute"] in user:
                out.append({"field": a["field"], "value": user[a["user_attribute"]], "_mini": True})
        for v in views:
            override = self.topic and (self.topic.joins.get(v) or {}).get("override_access_filters")
            for a in self.project.all_views[v].data.get("access_filters") or []:
                if a["user_attribute"] in user and not (override and a["user_attribute"] in covered):
                    name = a["field"] if "." in a["field"] else f"{v}.{a['field']}"
                    out.append({"field": name, "value": user[a["user_attribute"]], "_mini": True})
        return out

    def plan(self, extra: list[str] = ()) -> None:
        """Join all views that the query needs, `extra` ones included, under the access filters of every one of them."""
        views = self.required() | dict.fromkeys(extra)
        found = self.access_filters(list(views))
        for c in found:
            views |= dict.fromkeys(self.field_of(c).views())
        self.where = [*self.given, *found]
        self.base, self.joins = self.project.graph.plan(list(views), self.topic)

    def required(self) -> dict[str, None]:
        """Names of the views that the query's fields depend on."""
        views: dict[str, None] = {}
        for f in (*self.metrics, *self.dims):
            views |= dict.fromkeys(f.views())
        for c in (*walk(self.where), *walk(self.having)):
            if isinstance(c, str):
                for n in REFERENCE.findall(c):
                    views |= dict.fromkeys(self.project.get_field(n, topic=self.topic).views())
            elif "field" in c:
                if c.get("expression") in FUNNELS:
                    from sparkloom.operators.funnel import link_of

                    views |= dict.fromkeys(link_of(self, self.field_of(c).view.name).views())
                elif c.get("group_by"):
                    views |= dict.fromkeys(self.project.get_field(c["group_by"], topic=self.topic).views())
                else:
                    views |= dict.fromkeys(self.field_of(c).views())
                if isinstance(c.get("value"), str) and "." in c["value"] and not c.get("_mini") and self.project.has_field(c["value"]):
                    views |= dict.fromkeys(self.project.get_field(c["value"]).views())
        for name, _ in self.order_by:
            if self.project.has_field(name):
                views |= dict.fromkeys(self.project.get_field(name, topic=self.topic).views())
        if not views:
            raise QueryError("a query needs metrics or dimensions")
        return views

    # ---- predicates

    def sql_of(self, conditions, join: str = "AND", having: bool = False, nested: bool = False, flags: list | None = None) -> str:
        parts = []
        for c in conditions:
            if isinstance(c, dict) and "conditional_filter_logic" in c:
                c = c["conditional_filter_logic"]
            if isinstance(c, str):
                parts.append(self.scope.text(c, self.project.all_views[self.base], measures=having))
            elif "conditions" in c:
                how = c.get("logical_operator", "AND").upper()
                if how not in ("AND", "OR"):
                    raise QueryError(f"unknown logical operator {how}")
                kinds = {self.field_of(x).is_measure for x in walk(c["conditions"]) if isinstance(x, dict) and "field" in x and not x.get("group_by")}
                if len(kinds) > 1:
                    raise QueryError("a group of conditions can't mix metrics and dimensions")
                parts.append(self.sql_of(c["conditions"], how, having, True, flags))
            elif "field" not in c:
                parts.append("TRUE" if c.get("value") else "FALSE")
            elif flags is not None and (c.get("expression") in (*SUBQUERIES, *FUNNELS) or c.get("group_by")):
                flags.append(c)
                parts.append(f"`__in{len(flags) - 1}`")
            else:
                parts.append(self.condition(c, having, nested))
        return f" {join} ".join(f"({p})" for p in parts) or "TRUE"

    def condition(self, c: dict, having: bool = False, nested: bool = False) -> str:
        f = self.field_of(c)
        if f.is_measure != having:
            raise QueryError(f"{f.id} can't be used in {'having' if having else 'where'}")
        if having and f.data.get("window") and nested:
            raise QueryError(f"the window metric {f.id} can't be part of a nested condition")
        week = self.project.model_of(f.view).get("week_start_day", "monday")
        sql = f"`{f.column}`" if having else self.scope.row(f)
        value, expression = c.get("value"), c.get("expression")
        if c.get("_mini") or expression is None:
            return " AND ".join(predicate(sql, e, x, f.value_type, self.scope.now, week) for e, x in parse_value(value, self.scope.now, week)) or "TRUE"
        if isinstance(value, str) and "." in value and self.project.has_field(value):
            other = self.project.get_field(value)
            return predicate(sql, expression, f"`{other.column}`" if other.is_measure else self.scope.row(other), raw=True)
        return predicate(sql, expression, value, f.value_type, self.scope.now, week)

    def keys_of(self, c: dict) -> DataFrame:
        """One column `__key` of the values that a subquery, entity or funnel condition selects."""
        if c.get("group_by"):
            entity, f = self.project.get_field(c["group_by"]), self.field_of(c)
            inner = {k: v for k, v in c.items() if k != "group_by"}
            args = {"having": [inner]} if f.is_measure else {"where": [inner]}
            df = self.engine.query(metrics=[f.id] if f.is_measure else [], dimensions=[entity.id], **args, force_group_by=True)
            return df.select(F.col(entity.column).alias("__key")).distinct()
        if c["expression"] in FUNNELS:
            from sparkloom.operators.funnel import converted

            return converted(self, c)
        v = c["value"]
        inner = dict(v["query"])
        if v.get("apply_limit") is False:
            inner.pop("limit", None)
        link = self.project.get_field(v.get("field") or c["field"])
        if link.id not in [self.project.get_field(d).id for d in inner.get("dimensions", [])]:
            raise QueryError(f"{link.id} must be a dimension of the subquery")
        return self.engine.query(**inner).select(F.col(link.column).alias("__key")).distinct()

    def probe(self, c: dict) -> str:
        if c.get("expression") in FUNNELS and not c.get("group_by"):
            from sparkloom.operators.funnel import link_of

            return self.scope.row(link_of(self, self.field_of(c).view.name))
        return self.scope.row(self.project.get_field(c["group_by"]) if c.get("group_by") else self.field_of(c))

    def filtered(self, df: DataFrame) -> DataFrame:
        """WHERE. Subquery conditions at the top level are semi or null-aware anti joins, nested ones flag columns."""
        rest = []
        if sum(isinstance(c, dict) and c.get("expression") in FUNNELS for c in walk(self.where)) > 1:
            raise QueryError("a query takes one funnel condition at most")
        for c in self.where:
            if isinstance(c, dict) and "conditions" not in c and "conditional_filter_logic" not in c and (c.get("expression") in (*SUBQUERIES, *FUNNELS) or c.get("group_by")):
                keys, probe = self.keys_of(c), F.expr(self.probe(c))
                if c.get("expression") not in ("is_not_in_query", "dropped_off") or c.get("group_by"):
                    df = df.join(keys, probe == F.col("__key"), "left_semi")
                else:
                    state = keys.agg(F.max(F.col("__key").isNull()).alias("__null"), F.count(F.lit(1)).alias("__n"))  # one row
                    df = df.join(keys.where("__key is not null"), probe == F.col("__key"), "left_anti").crossJoin(F.broadcast(state))
                    df = df.where(~F.coalesce(F.col("__null"), F.lit(False)) & (probe.isNotNull() | (F.col("__n") == 0))).drop("__null", "__n")
            else:
                rest.append(c)
        if not rest:
            return df
        flags: list[dict] = []
        sql = self.sql_of(rest, flags=flags)
        for i, c in enumerate(flags):
            keys = self.keys_of(c).where("__key is not null").select(F.col("__key").alias(f"__key{i}"), F.lit(True).alias(f"__hit{i}"))
            negative = c.get("expression") in ("is_not_in_query", "dropped_off") and not c.get("group_by")
            hit = F.coalesce(F.col(f"__hit{i}"), F.lit(False))
            df = df.join(keys, F.expr(self.probe(c)) == F.col(f"__key{i}"), "left").withColumn(f"__in{i}", ~hit if negative else hit)
        return df.where(F.expr(sql))

    # ---- rows

    def view_frame(self, name: str) -> DataFrame:
        """A view's rows under its alias, with window dimensions computed before any filter."""
        df = self.engine.scan(name)
        windows = [f for f in {f.id: f for f in self._windows()}.values() if f.view.name == name]
        if not windows:
            return df
        for e in self.project.graph.plan_from(name, [v for f in windows for v in f.views()]):
            df = df.join(self.engine.scan(e.right), F.expr(self.scope.text(e.on, self.project.all_views[e.left])), e.how)
        columns = [F.expr(self.scope.text(f.sql, f.view)).alias(window_column(f)) for f in windows]
        return df.select(f"{name}.*", *columns).alias(name)

    def _windows(self) -> list[Field]:
        found: dict[str, Field] = {}

        def visit(f: Field):
            if f.data.get("window") and not f.is_measure:
                found[f.id] = f
            for g in f.references():
                visit(g)

        leaves = [self.field_of(c) for c in (*walk(self.where), *walk(self.having)) if isinstance(c, dict) and "field" in c and not c.get("group_by")]
        leaves += [self.project.get_field(n) for c in walk(self.where) if isinstance(c, str) for n in REFERENCE.findall(c)]
        for f in (*self.metrics, *self.dims, *leaves):
            visit(f)
        return list(found.values())

    def joined(self) -> DataFrame:
        df = self.view_frame(self.base)
        for e in self.joins:
            right = self.view_frame(e.right)
            df = df.crossJoin(right) if e.how == "cross" else df.join(right, F.expr(self.scope.text(e.on, self.project.all_views[e.left])), e.how)
        return df

    def rows(self) -> DataFrame:
        return self.filtered(self.joined())

    def helpers(self, df: DataFrame) -> DataFrame:
        """Adds the columns that rendering asked for: non-additive dates and first-row markers."""
        for (choice, date, groups), column in self.scope.windows.items():
            chosen = (F.min if choice == "min" else F.max)(F.expr(date)).alias(column)
            if not groups:
                df = df.crossJoin(F.broadcast(df.agg(chosen)))  # one row
                continue
            names = [f"{column}_{i}" for i in range(len(groups))]
            dates = df.groupBy(*[F.expr(g).alias(n) for g, n in zip(groups, names, strict=True)]).agg(chosen)
            same = reduce(Column.__and__, [F.expr(g).eqNullSafe(F.col(n)) for g, n in zip(groups, names, strict=True)])
            df = df.join(dates, same, "left").drop(*names)
        for partition, column in self.scope.markers.items():
            w = Window.partitionBy(*[F.expr(d) for d in self.scope.dims], *[F.expr(p) for p in partition]).orderBy(F.lit(1))
            df = df.withColumn(column, F.row_number().over(w))
        return df

    def grouped(self, df: DataFrame, extra: list[Field] = ()) -> DataFrame:
        """Aggregates the metrics, and `extra` ones that later filters or sorts need."""
        metrics = [(m.column, self.scope.aggregate(m)) for m in {m.id: m for m in (*self.metrics, *extra)}.values()]
        df = self.helpers(df)
        by = {**{d.column: F.expr(self.scope.row(d)) for d in self.dims}, **{alias_of(r): F.expr(strip_alias(r)) for r in self.raw}}
        own = {f"MAX(`{c}`)": q for q, c in self.scope.quantiles.items()}  # metrics that are a quantile, not made of some
        try:
            if not metrics:
                return df.select(*[c.alias(n) for n, c in by.items()]).distinct()
            rest = [(name, sql) for name, sql in metrics if sql not in own]
            df = with_quantiles(df, list(by.values()), {c: q for q, c in self.scope.quantiles.items() if any(f"`{c}`" in sql for _, sql in rest)})
            return aggregated(df, list(by.values()), list(by), [F.expr(sql).alias(name) for name, sql in rest], {name: own[sql] for name, sql in metrics if sql in own})
        except AnalysisException as e:
            raise QueryError(str(e).split("\n")[0]) from e

    def build(self) -> DataFrame:
        if self.row_level:
            return self.row_result()
        later = [f for n, _ in self.order_by if self.project.has_field(n) and (f := self.project.get_field(n, topic=self.topic)).is_measure]
        having = [self.field_of(c) for c in walk(self.having) if isinstance(c, dict) and "field" in c]
        text = [self.project.get_field(n, topic=self.topic) for c in walk(self.having) if isinstance(c, str) for n in REFERENCE.findall(c)]
        df = self.grouped(self.rows(), [*having, *text, *later])
        for c in self.having:
            sql = REFERENCE.sub(lambda m: f"`{self.project.get_field(m[1]).column}`", c) if isinstance(c, str) else self.sql_of([c], having=True)
            df = df.where(F.expr(sql))
        df = self.sorted(df)
        return df.select(*[f"`{f.column}`" for f in (*self.dims, *self.metrics)], *[f"`{alias_of(r)}`" for r in self.raw])

    def row_result(self) -> DataFrame:
        """Without GROUP BY: dimensions, and the columns that the metrics are made of."""
        parts: dict[str, Field] = {}
        for m in self.metrics:
            for a in m.measures():
                parts[a.id] = a
        columns = {d.column: F.expr(self.scope.row(d)) for d in self.dims}
        for i in sorted(parts):
            x = self.scope.argument(parts[i])
            columns.setdefault(parts[i].column, F.lit(1) if x == "*" else F.expr(x))
        df = self.helpers(self.rows()).select(*[c.alias(n) for n, c in columns.items()], *[F.expr(r) for r in self.raw])
        return df.limit(self.limit) if self.limit else df

    def sorted(self, df: DataFrame) -> DataFrame:
        order = self.order_by
        if not order and self.limit:
            order = [(self.metrics[0].id, "desc")] if self.metrics else [(self.dims[0].id, "asc")]
        return ordered(df, [(self.project.get_field(n, topic=self.topic).column if self.project.has_field(n) else n.replace(".", "_"), way) for n, way in order], self.limit)


def ordered(df: DataFrame, order: list[tuple[str, str]], limit: int | None) -> DataFrame:
    if order:
        df = df.orderBy(*[F.col(f"`{c}`").desc_nulls_last() if way == "desc" else F.col(f"`{c}`").asc_nulls_last() for c, way in order])
    return df.limit(int(limit)) if limit else df


def parse_order(order_by) -> list[tuple[str, str]]:
    """[(field, asc or desc)] from a list of {field, sort} or from text; nulls always come last."""
    if not order_by:
        return []
    if isinstance(order_by, str):
        out = []
        for part in order_by.lower().split(","):
            words = re.sub(r"\bnulls (first|last)\b", "", part).split()
            out.append((words[0].strip("${}"), words[1] if len(words) > 1 else "asc"))
        return out
    return [(o, "asc") if isinstance(o, str) else (o["field"], (o.get("sort") or "asc").lower()) for o in order_by]


def strip_alias(raw: str) -> str:
    return re.sub(r"\s+as\s+`?\w+`?\s*$", "", raw, flags=re.I)


def alias_of(raw: str) -> str:
    m = re.search(r"\s+as\s+`?(\w+)`?\s*$", raw, re.I)
    return m[1] if m else raw


__all__ = ["SingleQuery", "alias_of", "as_list", "ordered", "parse_order", "strip_alias", "walk"]
