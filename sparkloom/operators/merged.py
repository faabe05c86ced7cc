"""Merged results: metrics on different dates or join trees, each aggregated on its own, then full-outer joined."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.errors import JoinError, QueryError
from sparkloom.operators.single import ordered, parse_order, walk
from sparkloom.plans.project import REFERENCE, Field


def build_merged(engine, metrics, dimensions, where=None, having=None, order_by=None, limit=None, funnel=None, topic=None, **_) -> DataFrame:
    """Sub-queries are joined to the first, in order of their names, on equal dimensions (NULLs never match).

    A topic holds in the sub-queries, with its filters, unless a metric is itself a merged one or a field is not in the topic.
    """
    if funnel:
        raise QueryError("a merged result can't have a funnel")
    p = engine.project
    get = lambda n: p.get_field(n)
    having = [having] if isinstance(having, (str, dict)) else list(having or [])
    wanted = [get(m) for m in metrics]
    for c in walk(having):
        for n in REFERENCE.findall(c) if isinstance(c, str) else [c["field"]]:
            if get(n).id not in [w.id for w in wanted]:
                wanted.append(get(n))
    parts: dict[str, Field] = {}
    for m in wanted:
        for a in m.measures() if m.is_merged() else [m]:
            parts[a.id] = a
    groups: dict[str, list[Field]] = {}
    for a in parts.values():
        if not a.canon_date:
            raise QueryError(f"{a.id} has no date to merge on; give its view a default_date or it a canon_date")
        date = p.get_field(f"{a.canon_date}_raw", check=False)
        key = f"{a.canon_date.replace('.', '_')}__{'_'.join(sorted(p.graph.graphs(date.view.name) & p.graph.field_graphs(a))) or a.view.name}"
        groups.setdefault(key, []).append(a)
    keys = sorted(groups)
    dims = [get(d) for d in dimensions]
    chosen = (p.topic(topic) if isinstance(topic, str) else topic) if topic and not any(m.is_merged() for m in wanted) else None
    frames, names = [], []
    for k in keys:
        own = [translate(p, d, groups[k], [g for j in keys for g in groups[j]]) for d in dims]
        conditions = [condition_for(p, c, groups[k]) for c in ([where] if isinstance(where, (str, dict)) else where or [])]
        unique = list({repr(c): c for c in conditions}.values())
        views = {v for f in (*groups[k], *own, *(p.get_field(c["field"]) for c in walk(unique) if isinstance(c, dict) and "field" in c)) for v in f.views()}
        inside = topic if chosen and views <= set(chosen.views()) else None
        frames.append(engine.query(metrics=[a.id for a in groups[k]], dimensions=[d.id for d in own], where=unique, topic=inside, single_query=True, force_group_by=True))
        names.append([d.column for d in own])
    if not dims:
        out = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), frames)  # one row each
    else:
        keyed = [f.select(*[F.col(f"`{c}`").alias(f"__{i}_{j}") for j, c in enumerate(n)], *[f"`{c}`" for c in f.columns if c not in n]) for i, (f, n) in enumerate(zip(frames, names, strict=True))]
        out = keyed[0]
        for i, f in enumerate(keyed[1:], 1):
            out = out.join(f, reduce(lambda a, b: a & b, [F.col(f"__0_{j}") == F.col(f"__{i}_{j}") for j in range(len(dims))]), "full")
        for j in range(len(dims)):
            value = F.coalesce(*[F.col(f"__{i}_{j}") for i in range(len(keyed))])
            for name in dict.fromkeys(n[j] for n in names):
                out = out.withColumn(name, value)
    for m in wanted:
        if m.is_merged() and m.column not in out.columns:
            out = out.withColumn(m.column, F.expr(formula(p, m)))
    for c in having:
        out = out.where(F.expr(having_text(p, c)))
    columns = [a.column for k in keys for a in groups[k]] + list(dict.fromkeys(n[j] for j in range(len(dims)) for n in names)) + [m.column for m in wanted if m.is_merged()]
    order = [(get(n).column, way) for n, way in parse_order(order_by) if p.has_field(n) and get(n).column in out.columns]
    return ordered(out.select(*[f"`{c}`" for c in dict.fromkeys(columns)]), order, limit)


def having_text(p, c) -> str:
    if isinstance(c, str):
        return REFERENCE.sub(lambda m: f"`{p.get_field(m[1]).column}`", c)
    if "conditions" in c:
        return f" {c.get('logical_operator', 'AND')} ".join(f"({having_text(p, x)})" for x in c["conditions"])
    f = p.get_field(c["field"])
    return leaf_text(f"`{f.column}`", c, f.value_type)


def leaf_text(column: str, c: dict, kind: str) -> str:
    """One condition on a column: an expression with its value, or a value in the filters' own language."""
    from sparkloom.functions.filters import parse_value, predicate

    found = [(c["expression"], c.get("value"))] if c.get("expression") else parse_value(c.get("value"))
    return " AND ".join(predicate(column, e, x, kind) for e, x in found) or "TRUE"


def formula(p, m: Field) -> str:
    """A merged formula over the columns of its parts."""

    def one(match):
        f = p.get_field(match[1], m.view, check=False)
        return f"`{f.column}`" if not f.is_measure or f.type not in ("number", "string", "yesno", "time") else f"({formula(p, f)})"

    return REFERENCE.sub(one, m.sql)


def reaches(p, d: Field, measures: list[Field]) -> bool:
    try:
        p.graph.plan([*dict.fromkeys(v for m in measures for v in m.views()), *d.views()])
    except JoinError:
        return False
    return True


def translate(p, d: Field, measures: list[Field], everything: list[Field]) -> Field:
    """The dimension that stands for d in the sub-query of these measures."""
    if d.is_group:
        own = f"{d.view.name}.{d.name}"
        if any(own == m.canon_date for m in everything):  # a date that some metric trends on becomes this one's
            return p.get_field(f"{measures[0].canon_date}_{d.variant}")
    if reaches(p, d, measures):
        return d
    for other in p.mapped(d):
        f = p.get_field(other)
        if reaches(p, f, measures):
            return f
    raise QueryError(f"Could not find mapping of {d.id} for {', '.join(m.id for m in measures)}")


def condition_for(p, c, measures: list[Field]):
    if isinstance(c, str):
        return c
    if "conditions" in c:
        return {**c, "conditions": [condition_for(p, x, measures) for x in c["conditions"]]}
    if "field" not in c or not p.has_field(c["field"]):
        return c
    f = p.get_field(c["field"])
    if f.is_group and f.type != "duration" and not reaches(p, f, measures):
        return {**c, "field": f"{measures[0].canon_date}_{f.variant}"}
    try:
        dates = {m.canon_date for m in measures}
        if f.is_group and f"{f.view.name}.{f.name}" not in dates and f.view.default_date and f.view.default_date.lower() == f.name and f.view.name not in {m.view.name for m in measures}:
            return {**c, "field": f"{measures[0].canon_date}_{f.variant}"}
        return {**c, "field": translate(p, f, measures, measures).id}
    except QueryError:
        return c
