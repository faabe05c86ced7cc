"""Dashboards: saved queries with filters in the string mini-language."""

from __future__ import annotations

from datetime import datetime

from sparkloom.functions.filters import parse_value
from sparkloom.plans.project import Project


def requests(project: Project, dashboard: dict, now: datetime) -> list[dict]:
    """The query of each element, with the dashboard's and the element's filters parsed."""
    out = []
    for e in dashboard.get("elements") or []:
        where = []
        for c in (*(dashboard.get("filters") or []), *(e.get("filters") or [])):
            f = project.get_field(c["field"])
            week = project.model_of(f.view).get("week_start_day", "monday")
            where += [{"field": f.id, "expression": x, "value": v} for x, v in parse_value(c.get("value"), now, week)]
        out.append({"metrics": e.get("metrics") or [e["metric"]], "dimensions": e.get("slice_by") or [], "where": where})
    return out
