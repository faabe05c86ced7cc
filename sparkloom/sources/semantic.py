"""Conversion of MetricFlow-style semantic models and metrics."""

from __future__ import annotations

import re

from sparkloom.errors import ConfigError

AGGREGATES = {"sum": "sum", "count": "count", "count_distinct": "count_distinct", "average": "average", "min": "min", "max": "max", "median": "median", "percentile": "percentile", "sum_boolean": "sum"}
_FILTER = re.compile(r"\{\{\s*(\w+)\(\s*'([^']+)'(?:\s*,\s*'(\w+)')?\s*\)\s*\}\}")


def _filter(text: str) -> str:
    def one(m):
        if m[1] not in ("Dimension", "TimeDimension"):
            raise ConfigError(f"{m[1]}() is not supported in filters")
        return f"${{{m[2].split('__')[-1]}{'_' + m[3] if m[1] == 'TimeDimension' else ''}}}"

    return _FILTER.sub(one, text)


def convert(docs: list[dict], model: str = "semantic_model") -> tuple[list[dict], list[dict], list[dict]]:
    """models, views, topics; cumulative and conversion metrics are errors."""
    views, measures = [], {}
    for m in (m for d in docs for m in d.get("semantic_models") or []):
        date = (m.get("defaults") or {}).get("agg_time_dimension")
        view = {"type": "view", "name": m["name"], "model_name": model, "sql_table_name": m["model"], "identifiers": [], "fields": [], **({"default_date": date} if date else {})}
        for d in m.get("dimensions") or []:
            sql = d.get("expr") or f"${{TABLE}}.{d['name']}"
            sql = sql if "$" in sql or not re.fullmatch(r"\w+", sql) else f"${{TABLE}}.{sql}"
            if d["type"] == "time":
                view["fields"].append({"name": d["name"], "field_type": "dimension_group", "type": "time", "sql": sql, "timeframes": ["raw", "date", "week", "month", "quarter", "year"]})
            else:
                view["fields"].append({"name": d["name"], "field_type": "dimension", "type": "string", "sql": sql})
        for e in m.get("entities") or []:
            sql = f"${{TABLE}}.{e.get('expr') or e['name']}"
            kind = "primary" if e["type"] in ("primary", "unique") else "foreign"
            if kind == "primary":
                view["fields"].append({"name": e["name"], "field_type": "dimension", "type": "string", "sql": sql, "primary_key": True, "hidden": True})
            view["identifiers"].append({"name": e["name"], "type": kind, "sql": sql})
        for x in m.get("measures") or []:
            if x["agg"] not in AGGREGATES:
                raise ConfigError(f"aggregate {x['agg']} of {x['name']} is not supported")
            sql = x.get("expr", x["name"])
            sql = f"${{TABLE}}.{sql}" if re.fullmatch(r"[A-Za-z_]\w*", str(sql)) else str(sql)
            f = {"name": f"_{x['name']}", "field_type": "measure", "type": AGGREGATES[x["agg"]], "sql": f"cast({sql} as int)" if x["agg"] == "sum_boolean" else sql, "hidden": not x.get("create_metric")}
            if x["agg"] == "percentile":
                f["percentile"] = int(float(x["agg_params"]["percentile"]) * 100)
            if x.get("agg_time_dimension"):
                f["canon_date"] = x["agg_time_dimension"]
            if n := x.get("non_additive_dimension"):
                f["non_additive_dimension"] = {"name": f"{n['name']}_raw", "window_choice": n.get("window_choice", "min"), "window_groupings": n.get("window_groupings") or []}
            view["fields"].append(f)
            measures[x["name"]] = view, f
        views.append(view)
    metrics = {m["name"]: m for d in docs for m in d.get("metrics") or []}
    for name, m in metrics.items():
        p = m["type_params"]
        if m["type"] == "simple":
            ref = p["measure"] if isinstance(p["measure"], str) else p["measure"]["name"]
            view, f = measures[ref]
            own = {**f, "name": name, "hidden": False, "label": m.get("label")}
            if m.get("filter"):
                own["sql"] = f"case when {_filter(m['filter'])} then {f['sql']} end"
            view["fields"].append(own)
            m["_view"] = view["name"]
        elif m["type"] not in ("ratio", "derived"):
            raise ConfigError(f"metric {name}: type {m['type']} is not supported")
    for name, m in metrics.items():
        p = m["type_params"]
        get = lambda x: x if isinstance(x, str) else x.get("name")
        full = lambda n: f"${{{metrics[n].get('_view')}.{n}}}" if metrics[n].get("_view") else f"${{{n}}}"
        if m["type"] == "ratio":
            a, b = get(p["numerator"]), get(p["denominator"])
            sql, owner = f"{full(a)} / nullif({full(b)}, 0)", metrics[a].get("_view")
        elif m["type"] == "derived":
            sql, owner = p["expr"], None
            for x in p["metrics"]:
                sql = re.sub(rf"\b{x.get('alias') or x['name']}\b", full(x["name"]).replace("\\", ""), sql)
                owner = owner or metrics[x["name"]].get("_view")
        else:
            continue
        view = next(v for v in views if v["name"] == owner)
        view["fields"].append({"name": name, "field_type": "measure", "type": "number", "sql": sql, "label": m.get("label")})
        m["_view"] = owner
    topics = [{"type": "topic", "name": v["name"], "label": v["name"], "base_view": v["name"], "views": {w["name"]: {} for w in views if w is not v and {i["name"] for i in v["identifiers"] if i["type"] == "foreign"} & {i["name"] for i in w["identifiers"] if i["type"] == "primary"}}} for v in views]
    return [{"type": "model", "name": model, "connection": "spark"}], views, topics
