"""Project validation: every finding as {message, reference_type, reference_id}."""

from __future__ import annotations

import difflib
import re

from sparkloom.errors import EngineError
from sparkloom.functions.dates import INTERVALS, TIMEFRAMES, WEEK_SHIFT
from sparkloom.functions.filters import EXPRESSIONS
from sparkloom.plans.joins import HOW, WEIGHT
from sparkloom.plans.project import DATE_NAMES, MEASURE_TYPES, Project

NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")
DIMENSION_TYPES = ("string", "number", "yesno", "tier", "time")
KNOWN = {
    "view": ("type", "name", "label", "description", "model_name", "sql_table_name", "derived_table", "default_date", "identifiers", "sets", "fields", "always_filter", "access_filters", "required_access_grants", "event_dimension", "fields_for_analysis", "hidden", "row_label", "version"),
}


def suggestion(word: str, among) -> str:
    near = difflib.get_close_matches(word, list(among), 1)
    return f" Did you mean {near[0]}?" if near else ""


def validate(project: Project, parse=None) -> list[dict]:
    """parse(sql): raises if an expression can't be parsed, e.g. Catalyst's parser."""
    out: dict[str, dict] = {}

    def say(message: str, kind: str, ref: str) -> None:
        out.setdefault(message, {"message": message, "reference_type": kind, "reference_id": ref})

    for m in project.models_data:
        if not NAME.match(str(m.get("name", ""))):
            say(f"model name {m.get('name')} is not valid", "model", str(m.get("name")))
        if m.get("week_start_day") and str(m["week_start_day"]).lower() not in WEEK_SHIFT:
            say(f"model {m['name']}: week_start_day {m['week_start_day']} is not a day", "model", m["name"])
        if not isinstance(m.get("fiscal_month_offset") or 0, int):
            say(f"model {m['name']}: fiscal_month_offset must be a whole number", "model", m["name"])
        for g in m.get("access_grants") or []:
            if not {"name", "user_attribute", "allowed_values"} <= set(g) or not isinstance(g.get("allowed_values"), list):
                say(f"model {m['name']}: access grant {g.get('name')} needs name, user_attribute and a list allowed_values", "model", m["name"])
        for k, v in (m.get("mappings") or {}).items():
            if k in DATE_NAMES:
                say(f"model {m['name']}: mapping {k} has a reserved name", "model", m["name"])
            kinds = set()
            for f in v.get("fields", []):
                try:
                    x = project.get_field(f, check=False)
                    kinds.add(x.type)
                    if x.is_group:
                        say(f"model {m['name']}: mapping {k} can't hold the dimension group {f}", "model", m["name"])
                except EngineError as e:
                    say(f"model {m['name']}: mapping {k}: {e}", "model", m["name"])
            if len(kinds) > 1:
                say(f"model {m['name']}: mapping {k} mixes types {sorted(kinds)}", "model", m["name"])
    try:
        views = list(project.all_views.values())
        project.graph  # noqa: B018
    except EngineError as e:
        say(str(e), "project", "project")
        return list(out.values())
    for v in views:
        ref = v.name
        for k in v.data:
            if k not in KNOWN["view"]:
                say(f"view {ref}: property {k} is unknown.{suggestion(k, KNOWN['view'])}", "view", ref)
        if not v.data.get("sql_table_name") and not v.data.get("derived_table"):
            say(f"view {ref} has neither sql_table_name nor derived_table", "view", ref)
        if v.data.get("sql_table_name") and v.data.get("derived_table"):
            say(f"Warning: view {ref} has both sql_table_name and derived_table; derived_table is used", "view", ref)
        if v.default_date and "." not in v.default_date and not v.find(f"{v.default_date}_raw"):
            say(f"view {ref}: default_date {v.default_date} is not a time group", "view", ref)
        for i in v.data.get("identifiers") or []:
            if i.get("type") not in ("primary", "foreign", "join"):
                say(f"view {ref}: identifier {i.get('name')} has type {i.get('type')}", "view", ref)
            if i.get("type") == "join" and (i.get("join_type", "left_outer") not in HOW or i.get("relationship", "many_to_one") not in WEIGHT):
                say(f"view {ref}: identifier {i.get('name')} has an unknown join_type or relationship", "view", ref)
            for w in (*(i.get("allowed_fanouts") or []), *(i.get("only_join") or [])):
                if w.lower() not in project.all_views:
                    say(f"view {ref}: identifier {i.get('name')} names unknown view {w}", "view", ref)
        for c in (*(v.data.get("always_filter") or []), *(v.data.get("access_filters") or [])):
            try:
                project.get_field(c["field"], v, check=False)
            except (EngineError, KeyError) as e:
                say(f"view {ref}: filter: {e}", "view", ref)
        for name, fields in v.sets().items():
            try:
                v.expand(fields)
            except EngineError as e:
                say(f"view {ref}: set {name}: {e}", "view", ref)
        for d in v.declared:
            _field(project, v, d, say)
        try:
            v.lookup  # noqa: B018
        except EngineError as e:
            say(str(e), "view", ref)
            continue
        for f in v.fields():
            try:
                if any(x.id == f.id for x in f.references()):
                    say(f"field {f.id} refers to itself", "field", f.id)
                elif not f.is_measure and any(x.is_measure for x in f.references()):
                    say(f"dimension {f.id} refers to a measure", "field", f.id)
                else:
                    f.views()
            except (EngineError, RecursionError) as e:
                say(f"field {f.id}: {e}", "field", f.id)
            if parse and f.sql and "${" not in f.sql:
                try:
                    parse(f.sql)
                except Exception as e:  # the parser's own error types
                    say(f"field {f.id}: SQL can't be parsed: {str(e).splitlines()[0]}", "field", f.id)
    for t in project.topics_data:
        name = t.get("label") or t.get("name")
        for w in (t.get("base_view", ""), *(t.get("views") or {})):
            if w.lower() not in project.all_views:
                say(f"topic {name} names unknown view {w}", "topic", str(name))
    for b in project.dashboards_data:
        for e in b.get("elements") or []:
            for n in (*(e.get("metrics") or []), *([e["metric"]] if e.get("metric") else []), *(e.get("slice_by") or [])):
                if not project.has_field(n):
                    say(f"dashboard {b.get('name')}: field {n} is unknown", "dashboard", str(b.get("name")))
    return list(out.values())


def _field(project: Project, v, d: dict, say) -> None:
    ref = f"{v.name}.{d.get('name')}"
    kind = d.get("field_type")
    if not NAME.match(str(d.get("name", ""))):
        say(f"field {ref} has an invalid name", "field", ref)
    if kind not in ("dimension", "dimension_group", "measure"):
        say(f"field {ref} has field_type {kind}", "field", ref)
        return
    if kind == "measure" and d.get("type") not in MEASURE_TYPES:
        say(f"field {ref}: measure type {d.get('type')} is unknown.{suggestion(str(d.get('type')), MEASURE_TYPES)}", "field", ref)
    if kind == "dimension" and d.get("type", "string") not in DIMENSION_TYPES:
        say(f"field {ref}: dimension type {d.get('type')} is unknown.{suggestion(str(d.get('type')), DIMENSION_TYPES)}", "field", ref)
    if kind == "measure" and d.get("primary_key"):
        say(f"field {ref}: a measure can't be a primary key", "field", ref)
    if d.get("type") == "percentile" and not 1 <= int(d.get("percentile") or 0) <= 99:
        say(f"field {ref}: percentile must be from 1 to 99", "field", ref)
    if d.get("type") == "cumulative" and not d.get("measure"):
        say(f"field {ref}: a cumulative measure needs measure", "field", ref)
    if d.get("type") in ("sum_distinct", "average_distinct") and not d.get("sql_distinct_key"):
        say(f"field {ref} needs sql_distinct_key", "field", ref)
    if kind == "dimension_group":
        for x in d.get("timeframes") or []:
            if x not in TIMEFRAMES:
                say(f"field {ref}: timeframe {x} is unknown.{suggestion(x, TIMEFRAMES)}", "field", ref)
        for x in d.get("intervals") or []:
            if x.rstrip("s") not in INTERVALS:
                say(f"field {ref}: interval {x} is unknown", "field", ref)
        if d.get("type") == "duration" and not (d.get("sql_start") and d.get("sql_end")):
            say(f"field {ref} needs sql_start and sql_end", "field", ref)
    elif not d.get("sql") and not d.get("case") and d.get("type") not in ("count", "cumulative"):
        say(f"field {ref} needs sql", "field", ref)
    for c in d.get("filters") or []:
        if c.get("expression") and c["expression"] not in EXPRESSIONS:
            say(f"field {ref}: filter expression {c['expression']} is unknown", "field", ref)
    if na := d.get("non_additive_dimension"):
        if na.get("window_choice", "max") not in ("min", "max"):
            say(f"field {ref}: window_choice must be min or max", "field", ref)
