"""Arbitrary merged queries: complete queries joined on named fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.errors import QueryError
from sparkloom.operators.merged import leaf_text
from sparkloom.operators.single import ordered, parse_order
from sparkloom.plans.joins import HOW

INNER = ("metrics", "dimensions", "where", "having", "order_by", "limit", "topic", "funnel", "model_name")


def build_arbitrary(engine, merged_queries: list[dict], where=None, having=None, order_by=None, limit=None, **_) -> DataFrame:
    """The first query is the base; each later one joins it on join_fields [{field, source_field}]."""
    p = engine.project
    if len(merged_queries) < 2:
        raise QueryError("merged_queries needs two queries at least")
    if merged_queries[0].get("join_fields"):
        raise QueryError("the first of merged_queries can't have join_fields")
    out, owner = None, []
    for i, q in enumerate(merged_queries):
        df = engine.query(**{k: v for k, v in q.items() if k in INNER})
        if out is None:
            out, owner = df, list(df.columns)
            continue
        how = q.get("join_type", "left_outer")
        if how not in HOW:
            raise QueryError(f"unknown join_type {how}; valid are: {', '.join(HOW)}")
        fields = q.get("join_fields") or []
        if not fields and how != "cross":
            raise QueryError(f"query {i + 1} of merged_queries needs join_fields")
        pairs = []
        for j in fields:
            a, b = p.get_field(j["source_field"]).column, p.get_field(j["field"]).column
            if a not in out.columns:
                raise QueryError(f"source_field {j['source_field']} is in none of the queries before")
            if b not in df.columns:
                raise QueryError(f"join field {j['field']} is not in its query")
            pairs.append((a, b))
        right = df.select(*[F.col(f"`{c}`").alias(f"__{i}_{c}") for c in df.columns])
        if how == "cross":
            out = out.crossJoin(right)
        else:
            on = reduce(lambda x, y: x & y, [F.col(f"`{a}`") == F.col(f"`__{i}_{b}`") for a, b in pairs])
            out = out.join(right, on, HOW[how])
        fresh = [c for c in df.columns if c not in owner and c not in [b for _, b in pairs]]
        out = out.select(*[f"`{c}`" for c in owner], *[F.col(f"`__{i}_{c}`").alias(c) for c in fresh])
        owner += fresh
    for c in [*(where or []), *(having or [])]:
        out = out.where(F.expr(post(p, c, out.columns)))
    order = [(column(p, n, out.columns), way) for n, way in parse_order(order_by)]
    return ordered(out, order, limit)


def column(p, name: str, columns: list[str]) -> str:
    c = p.get_field(name).column
    if c not in columns:
        raise QueryError(f"{name} is in none of the merged queries")
    return c


def post(p, c, columns: list[str]) -> str:
    if "conditions" in c:
        return f" {c.get('logical_operator', 'AND')} ".join(f"({post(p, x, columns)})" for x in c["conditions"])
    f = p.get_field(c["field"])
    return leaf_text(f"`{column(p, c['field'], columns)}`", c, f.value_type)
