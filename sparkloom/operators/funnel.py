"""Funnels: ordered steps of one entity within a time window.

Instead of joining steps, one window pass per step over (entity, time) carries the latest start of a run of
the steps so far: a row takes step n if it fits the step and some earlier row took step n - 1 whose run
began within the window. The latest start is the best one, so each row is kept once, without fan-out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.errors import QueryError
from sparkloom.functions.dates import duration
from sparkloom.operators.merged import having_text
from sparkloom.operators.single import SingleQuery, ordered, parse_order
from sparkloom.plans.project import Field


def link_of(q: SingleQuery, view: str | None = None) -> Field:
    """The field tagged `customer` that the query's base (or another view) reaches."""
    reach = q.project.graph.reach(view or q.base)
    f = q.project.field_by_tag("customer", sorted(reach))
    if f is None:
        raise QueryError("a funnel needs a field with the tag customer in reach of its views")
    return f


def event_date(q: SingleQuery, funnel: dict) -> Field:
    views = {m.view.name for m in q.metrics}
    name = funnel.get("view_name") or (next(iter(views)) if len(views) == 1 else None)
    if name is None:
        raise QueryError("a funnel over metrics of several views needs view_name")
    date = q.project.view(name).default_date
    if not date:
        raise QueryError(f"view {name} needs a default_date for a funnel")
    return q.project.get_field(f"{date}_raw" if "." in date else f"{name}.{date}_raw")


def checked(funnel: dict) -> dict:
    for k in ("steps", "within"):
        if k not in funnel:
            raise QueryError(f"a funnel needs {k}")
    if not {"value", "unit"} <= set(funnel["within"]):
        raise QueryError("within needs value and unit")
    return funnel


def conditions(step) -> list:
    return [step] if isinstance(step, (dict, str)) else list(step)


def stepped(q: SingleQuery, funnel: dict, date: Field, link: Field) -> DataFrame:
    """The query's rows with __s1, __s2, ...: the start of the latest run with which a row takes the step, or null."""
    rows = q.rows()
    ts, key = q.scope.row(date), q.scope.row(link)
    rows = rows.withColumn("__ts", F.expr(f"cast({ts} as timestamp_ntz)")).withColumn("__at", F.expr("unix_micros(cast(__ts as timestamp))")).withColumn("__link", F.expr(key))
    # a null entity follows no other, so such rows are dealt out by time
    dealt = F.when(F.col("__link").isNull(), F.xxhash64("__at"))
    earlier = Window.partitionBy("__link", dealt).orderBy("__at").rangeBetween(Window.unboundedPreceding, -1)
    steps = [F.expr(q.sql_of(conditions(s))) for s in funnel["steps"]]
    rows = rows.withColumn("__s1", F.when(steps[0], F.col("__ts")))
    within = int(funnel["within"]["value"])
    for i, test in enumerate(steps[1:], 2):
        rows = rows.withColumn("__run", F.max(f"__s{i - 1}").over(earlier))
        ok = test & F.col("__link").isNotNull() & F.expr(f"{duration('__run', '__ts', funnel['within']['unit'])} <= {within}")
        rows = rows.withColumn(f"__s{i}", F.when(ok, F.col("__run"))).drop("__run")
    return rows


def _query(engine, funnel: dict, **args) -> tuple[SingleQuery, Field, Field]:
    leaves = [c for s in funnel["steps"] for c in conditions(s) if isinstance(c, dict)]
    q = SingleQuery(engine, protect_all=True, force_group_by=True, **args)
    date, link = event_date(q, funnel), link_of(q)
    from sparkloom.operators.single import walk

    views = [v for c in walk(leaves) if "field" in c for v in q.project.get_field(c["field"]).views()]
    q.plan([*date.views(), *link.views(), *views])
    return q, date, link


def build_funnel(engine, funnel: dict, metrics=(), dimensions=(), where=None, having=None, order_by=None, limit=None, topic=None, **_) -> DataFrame:
    """step, step_order, metrics and dimensions: one group of rows per step."""
    funnel = checked(funnel)
    q, date, link = _query(engine, funnel, metrics=metrics, dimensions=dimensions, where=where, topic=topic)
    extra = [q.project.get_field(c["field"]) for c in ([having] if isinstance(having, dict) else having or []) if isinstance(c, dict) and "field" in c]
    out = by_step(q, stepped(q, funnel, date, link), len(funnel["steps"]), extra).withColumn("step", F.concat(F.lit("Step "), F.col("step_order")))
    for c in [having] if isinstance(having, (dict, str)) else having or []:
        out = out.where(F.expr(having_text(q.project, c)))
    named = [(n if n in ("step", "step_order") else q.project.get_field(n).column, way) for n, way in parse_order(order_by)]
    return ordered(out, named, limit).select("step", "step_order", *[f"`{m.column}`" for m in q.metrics], *[f"`{d.column}`" for d in q.dims])


def by_step(q: SingleQuery, rows: DataFrame, steps: int, extra: list[Field]) -> DataFrame:
    """The query's groups for each step, with step_order: a row is repeated for the steps it took, and all are aggregated at once."""
    taken = F.array(*[F.when(F.col(f"__s{i}").isNotNull(), F.lit(i)) for i in range(1, steps + 1)])
    rows = rows.withColumn("step_order", F.explode(F.array_compact(taken)))
    none = None if q.dims else q.grouped(rows.where(F.lit(False)), extra)
    q.raw, q.scope.dims = ["step_order"], [*q.scope.dims, "step_order"]
    out = q.grouped(rows, extra)
    if none is None:
        return out
    # without dimensions a step that no row took has its row too: that of an aggregate of nothing
    every = q.engine.spark.range(1, steps + 1).select(F.col("id").cast("int").alias("step_order"))
    missing = every.join(out.select("step_order"), "step_order", "left_anti").crossJoin(F.broadcast(none))  # one row
    return out.unionByName(missing)


def converted(outer: SingleQuery, c: dict) -> DataFrame:
    """Entities that took step `from` (whether they took step `to` decides): column __key.

    `converted`: those with both; `dropped_off` is read as NOT IN, so it gives those with `to`.
    """
    steps = c["value"]["steps"] if isinstance(c.get("value"), dict) and "steps" in c["value"] else c["steps"]
    funnel = checked({"steps": steps, "within": c.get("within") or c["value"]["within"], "view_name": c.get("view_name") or (c["value"] if isinstance(c.get("value"), dict) else {}).get("view_name")})
    first, last = int(c.get("from") or c["value"].get("from", 1)), int(c.get("to") or c["value"].get("to", len(steps)))
    q, date, link = _query(outer.engine, funnel, metrics=[m.id for m in outer.metrics])
    rows = stepped(q, funnel, date, link)
    took = rows.groupBy("__link").agg(F.max(F.col(f"__s{first}").isNotNull()).alias("a"), F.max(F.col(f"__s{last}").isNotNull()).alias("b"))
    if c["expression"] == "converted":
        return took.where("a and b").select(F.col("__link").alias("__key"))
    # dropped_off keeps entities that took `from` but not `to`; the caller removes these keys
    return took.where("(not a or b) and __link is not null").select(F.col("__link").alias("__key"))
