"""Cumulative metrics: running values over a date spine.

Sums, counts, minima, maxima and averages run over per-period partial aggregates; distinct counts over
first-seen dates. The spine is cut to the asked dates first, and what lies before them is in the first one's
starting value. Only with cumulative_where are events, aggregated by period where the rule allows it, met with the
spine in a range join. Without a date dimension the value is that of the as-of date, by one aggregation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.errors import QueryError
from sparkloom.functions.filters import parse_value, predicate
from sparkloom.operators.merged import having_text
from sparkloom.operators.quantiles import aggregated
from sparkloom.operators.single import SingleQuery, ordered, parse_order, walk
from sparkloom.plans.project import FORMULAS, REFERENCE, Field

#: The spine's first day, and that of spines for as-of dates before it.
SPINE_START, EARLY_START = "2000-01-01", "1900-01-01"
FRAMES = ("date", "week", "month", "quarter", "year", "fiscal_month", "fiscal_quarter", "fiscal_year")


def first_day(engine) -> str:
    return SPINE_START if f"{engine.now():%Y-%m-%d}" >= SPINE_START else EARLY_START


def spine(engine, frame: str, start: str | None = None) -> DataFrame:
    """Days up to the as-of date, and the period of the timeframe that each lies in: (day, period), one row per period."""
    from sparkloom.functions.dates import timeframe

    model, start = engine.project.model, start or first_day(engine)
    days = engine.spark.range(1).select(F.explode(F.expr(f"sequence(date'{start}', date'{engine.now():%Y-%m-%d}', interval 1 day)")).alias("d"))
    period = timeframe("d", "date" if frame == "raw" else frame, model.get("week_start_day", "monday"), model.get("fiscal_month_offset", 0))
    return days.groupBy(F.expr(period).alias("period")).agg(F.max(F.col("d").cast("timestamp_ntz")).alias("day"))


def build_cumulative(engine, metrics, dimensions=(), where=None, having=None, order_by=None, limit=None, funnel=None, **rest) -> DataFrame:
    if funnel:
        raise QueryError("cumulative metrics can't be part of a funnel")
    p = engine.project
    wanted = [p.get_field(m) for m in metrics]
    having = [having] if isinstance(having, (str, dict)) else list(having or [])
    for c in walk(having):
        if isinstance(c, dict) and p.get_field(c["field"]).id not in [w.id for w in wanted]:
            wanted.append(p.get_field(c["field"]))
    running: dict[str, Field] = {}
    plain: dict[str, Field] = {}
    for m in wanted:
        for a in m.measures() if m.is_cumulative() and m.type in FORMULAS else [m]:
            (running if a.type == "cumulative" else plain)[a.id] = a
    dims = [p.get_field(d) for d in dimensions]
    where = [where] if isinstance(where, (str, dict)) else list(where or [])
    frames = []
    if plain:
        frames.append(engine.query(metrics=list(plain), dimensions=[d.id for d in dims], where=where, force_group_by=True, **rest))
    frames += [one(engine, m, dims, where, rest) for m in running.values()]
    out = frames[0]
    for i, f in enumerate(frames[1:]):
        if dims:
            right = f.select(*[F.col(f"`{d.column}`").alias(f"__{i}_{j}") for j, d in enumerate(dims)], *[f"`{c}`" for c in f.columns if c not in [d.column for d in dims]])
            on = reduce(lambda a, b: a & b, [F.col(f"`{d.column}`") == F.col(f"__{i}_{j}") for j, d in enumerate(dims)])
            out = out.join(right, on, "left").drop(*[f"__{i}_{j}" for j in range(len(dims))])
        else:
            out = out.crossJoin(F.broadcast(f))  # one row each
    for m in wanted:
        if m.column not in out.columns:
            out = out.withColumn(m.column, F.expr(formula(p, m)))
    for c in having:
        out = out.where(F.expr(having_text(p, c)))
    order = [(p.get_field(n).column, way) for n, way in parse_order(order_by)]
    return ordered(out, order, limit).select(*[f"`{d.column}`" for d in dims], *[f"`{m.column}`" for m in wanted])


def formula(p, m: Field) -> str:
    def one_ref(match):
        f = p.get_field(match[1], m.view, check=False)
        return f"({formula(p, f)})" if f.is_measure and f.type in FORMULAS else f"`{f.column}`"

    return REFERENCE.sub(one_ref, m.sql)


def one(engine, m: Field, dims: list[Field], where: list, rest: dict) -> DataFrame:
    """One cumulative metric by the dimensions."""
    p = engine.project
    inner = p.get_field(m.data["measure"], m.view, check=False)
    parts = inner.measures()
    date = p.get_field(f"{inner.canon_date or m.canon_date}_raw", check=False)
    same = lambda f: f.is_group and f.type != "duration" and f.view.name == date.view.name and f.name == date.name
    on_date = [c for c in where if isinstance(c, dict) and "field" in c and same(p.get_field(c["field"]))]
    others = [c for c in where if c not in on_date]
    time = next((d for d in dims if same(d)), None)
    by = [d for d in dims if d is not time]
    frame = time.variant if time else "date"
    if frame == "raw":
        frame = "date"
    if frame not in FRAMES:
        raise QueryError(f"{m.id} can't run over {frame}; valid are: {', '.join(FRAMES)}")
    event = p.get_field(f"{date.view.name}.{date.name}_{frame}", check=False)
    q = SingleQuery(engine, metrics=[a.id for a in parts], dimensions=[d.id for d in by], where=others, force_group_by=True, **rest)
    q.dims = [*by, event]
    s = q.scope
    args = {a.id: s.argument(a) for a in parts}
    rows = q.helpers(q.rows()).select(
        *[F.expr(s.row(d)).alias(f"__d{i}") for i, d in enumerate(by)], F.expr(s.row(event)).alias("__t"),
        *[(F.lit(1) if x == "*" else F.expr(x)).alias(f"__x{i}") for i, x in enumerate(args.values())],
    )
    if any(e.relationship == "one_to_many" for e in q.joins):  # rows of the measures' views must not be counted twice
        raise QueryError(f"{m.id} can't be joined through a fan-out")
    keys = [f"__d{i}" for i in range(len(by))]
    rows = rows.where("__t is not null")
    periods = spine(engine, frame)
    for c in on_date if time else ():
        found = [(c["expression"], c.get("value"))] if c.get("expression") and not c.get("_mini") else parse_value(c.get("value"), engine.now())
        for e, x in found:
            periods = periods.where(F.expr(predicate("period", e, x, "time", engine.now())))
    rule = m.data.get("cumulative_where")
    if rule:
        test = s.text(rule, m.view).replace("${cumulative_date}", "day")
        # the rule speaks of the event's date as a field: it is the rows' own
        test = test.replace(s.row(p.get_field(f"{date.view.name}.{date.name}_raw", check=False)), "__t").replace(s.row(event), "__t")
        if time is None:
            periods = periods.where(F.col("period") == F.lit(f"{engine.now():%Y-%m-%d}").cast("timestamp_ntz"))
        on_rows = any(f"{v}." in test for v in (q.base, *(e.right for e in q.joins)))
        partial = rows if on_rows or not all(a.type in PARTIAL for a in parts) else per_period(rows, keys, parts)
        met = partial.join(F.broadcast(periods), F.expr(f"__t <= period AND ({test})"))  # the spine has a fixed number of days
        out = over_rows(met, [*keys, "period"], parts) if partial is rows else met.groupBy(*keys, "period").agg(*[total(a, i).alias(f"__v{i}") for i, a in enumerate(parts)])
    elif time is None:
        now = F.lit(f"{engine.now():%Y-%m-%d}").cast("timestamp_ntz")
        out = over_rows(rows.where(F.col("__t") <= now), keys, parts)
    else:
        bounds = periods.agg(F.min("period").alias("__lo"), F.max("period").alias("__hi"))  # one row
        inside = rows.crossJoin(F.broadcast(bounds)).where("__t <= __hi").withColumn("__t", F.greatest("__t", "__lo")).drop("__lo", "__hi")
        out = running(inside, keys, parts, periods)
    values = {a.id: f"`__v{i}`" for i, a in enumerate(parts)}
    value = values[inner.id] if inner.id in values else REFERENCE.sub(lambda x: values[p.get_field(x[1], inner.view, check=False).id], inner.sql)
    named = [F.col(k).alias(d.column) for k, d in zip(keys, by, strict=True)] + ([F.col("period").alias(time.column)] if time else [])
    return out.select(*named, F.expr(value).alias(m.column))


#: Measures that can be put together from partial aggregates.
PARTIAL = ("sum", "count", "average", "min", "max")


def over_rows(rows: DataFrame, by: list[str], parts: list[Field]) -> DataFrame:
    """The measures over rows, as __v0, __v1, ..."""
    kinds = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "average": F.avg, "count_distinct": F.count_distinct}
    if bad := next((a for a in parts if a.type not in (*kinds, "median")), None):
        raise QueryError(f"{bad.id}: a {bad.type} can't be cumulative")
    aggregates = [kinds[a.type](F.col(f"__x{i}")).alias(f"__v{i}") for i, a in enumerate(parts) if a.type in kinds]
    return aggregated(rows, [F.col(k) for k in by], by, aggregates, {f"__v{i}": (f"__x{i}", 0.5) for i, a in enumerate(parts) if a.type == "median"})


def total(a: Field, i: int):
    """Measure number i over the rows of per_period."""
    s, c = F.col(f"__s{i}"), F.col(f"__c{i}")
    return {"sum": lambda: F.sum(s), "min": lambda: F.min(s), "max": lambda: F.max(s), "count": lambda: F.sum(c), "average": lambda: F.sum(s) / F.nullif(F.sum(c), F.lit(0))}[a.type]()


def per_period(rows: DataFrame, keys: list[str], parts: list[Field]) -> DataFrame:
    """Partial aggregates by keys and __t: sums, minima and maxima as __s, counts as __c."""
    aggs = []
    for i, a in enumerate(parts):
        x = F.col(f"__x{i}")
        if a.type in ("sum", "average"):
            aggs.append(F.sum(x).alias(f"__s{i}"))
        if a.type in ("count", "average"):
            aggs.append(F.count(x).alias(f"__c{i}"))
        if a.type in ("min", "max"):
            aggs.append((F.min if a.type == "min" else F.max)(x).alias(f"__s{i}"))
    return rows.groupBy(*keys, "__t").agg(F.count(F.lit(1)).alias("__n"), *aggs)


def running(rows: DataFrame, keys: list[str], parts: list[Field], periods: DataFrame) -> DataFrame:
    """Per-period partial aggregates, spread over each group's spine from its first event on, then running windows."""
    if bad := next((a for a in parts if a.type not in (*PARTIAL, "count_distinct")), None):
        raise QueryError(f"{bad.id}: a {bad.type} can't be cumulative")
    per = per_period(rows, keys, parts)
    for i, a in enumerate(parts):
        if a.type == "count_distinct":  # a value counts from its first period on
            first = rows.where(F.col(f"__x{i}").isNotNull()).groupBy(*keys, f"__x{i}").agg(F.min("__t").alias("__t")).groupBy(*keys, "__t").agg(F.count(F.lit(1)).alias(f"__s{i}"))
            on = reduce(lambda u, v: u & v, [per[c].eqNullSafe(first[c]) for c in (*keys, "__t")])
            per = per.join(first, on, "left").select(per["*"], first[f"__s{i}"])
    groups = per.groupBy(*keys).agg(F.min("__t").alias("__from")) if keys else per.agg(F.min("__t").alias("__from"))
    grid = groups.join(F.broadcast(periods), F.col("period") >= F.col("__from"))  # the spine has a fixed number of days
    g, e = grid.alias("g"), per.alias("e")
    on = reduce(lambda u, v: u & v, [F.col("g.period") == F.col("e.__t"), *[F.col(f"g.{k}").eqNullSafe(F.col(f"e.{k}")) for k in keys]])
    full = g.join(e, on, "left").select(*[F.col(f"g.{k}").alias(k) for k in keys], F.col("g.period").alias("period"), *[f"e.{c}" for c in per.columns if c.startswith(("__s", "__c"))])
    w = Window.partitionBy(*keys).orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    for i, a in enumerate(parts):
        s, c = f"__s{i}", f"__c{i}"
        value = {
            "sum": lambda s=s: F.sum(s).over(w), "count": lambda c=c: F.coalesce(F.sum(c).over(w), F.lit(0)),
            "average": lambda s=s, c=c: F.sum(s).over(w) / F.expr(f"nullif(sum({c}) over (partition by {', '.join(keys) or '1'} order by period rows between unbounded preceding and current row), 0)"),
            "min": lambda s=s: F.min(s).over(w), "max": lambda s=s: F.max(s).over(w), "count_distinct": lambda s=s: F.coalesce(F.sum(s).over(w), F.lit(0)),
        }[a.type]()
        full = full.withColumn(f"__v{i}", value)
    return full
