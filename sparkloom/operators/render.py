"""Fields as Spark SQL text."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime

from sparkloom.errors import QueryError
from sparkloom.functions.dates import duration, timeframe
from sparkloom.functions.filters import parse_value, predicate, quoted
from sparkloom.plans.project import FORMULAS, REFERENCE, Field, Project, template


@dataclass
class Scope:
    """What rendering depends on, and the helper columns it asks for."""

    project: Project
    now: datetime
    protected: set[str] | None = field(default_factory=set)  # views to guard; None: all
    dims: list[str] = field(default_factory=list)  # SQL of the query's dimensions
    query_attributes: dict = field(default_factory=dict)
    markers: dict[tuple[str, ...], str] = field(default_factory=dict)  # partition columns -> first-row marker
    windows: dict[tuple[str, str, tuple[str, ...]], str] = field(default_factory=dict)  # (function, date, partition) -> column
    quantiles: dict[tuple[str, float], str] = field(default_factory=dict)  # (values, fraction) -> column
    dimension_fields: list[Field] = field(default_factory=list)
    overrides: dict[str, str] = field(default_factory=dict)  # field id -> SQL, instead of its own

    # ---- rows

    def text(self, sql: str, view, measures: bool = False) -> str:
        """Fill in ${...}; measures: references to measures are inlined as aggregates."""

        def one(m: re.Match) -> str:
            ref = m[1].strip()
            if ref == "TABLE":
                return view.name
            if ref == "cumulative_date":
                return m[0]
            f = self.project.get_field(ref, view, check=False)
            if f.is_measure:
                if not measures:
                    raise QueryError(f"{f.id} is a measure and can't be used in rows")
                return f"({self.aggregate(f)})"
            return self.row(f)

        sql = template(sql, self.project.user, self.query_attributes)
        if "{%" in sql:
            raise QueryError(f"the fragment holds a foreign parameter: {sql}")
        return rewritten(REFERENCE.sub(one, sql))

    def row(self, f: Field) -> str:
        """A dimension's row-level SQL."""
        if f.id in self.overrides:
            return self.overrides[f.id]
        d, v = f.data, f.view
        if f.is_measure:
            return self.argument(f)
        if d.get("window"):
            return f"{v.name}.`{window_column(f)}`"
        if f.is_group and f.type == "duration":
            return duration(self.text(d["sql_start"], v), self.text(d["sql_end"], v), f.variant)
        if f.is_group:
            model = self.project.model_of(v)
            convert = d.get("convert_tz", d.get("convert_timezone", model.get("default_convert_tz", True)))
            zone = self.project.timezone if convert and f.variant != "raw" else None
            return timeframe(self.text(d["sql"], v), f.variant, model.get("week_start_day", "monday"), model.get("fiscal_month_offset", 0), zone)
        if d.get("case"):
            whens = " ".join(f"WHEN {self.text(w['sql'], v)} THEN {quoted(w['label'])}" for w in d["case"]["whens"])
            other = d["case"].get("else")
            return f"CASE {whens}{f' ELSE {quoted(other)}' if other is not None else ''} END"
        sql = self.text(d["sql"].replace('"', "'") if d.get("sql") and "case when" in d["sql"].lower() and '"' in d["sql"] else d["sql"], v)
        if f.type == "tier":
            t = d["tiers"]
            parts = [f"WHEN {sql} < {t[0]} THEN 'Below {t[0]}'", *(f"WHEN {sql} >= {a} AND {sql} < {b} THEN '[{a},{b})'" for a, b in zip(t, t[1:], strict=False)), f"WHEN {sql} >= {t[-1]} THEN '[{t[-1]},inf)'"]
            return f"CASE {' '.join(parts)} ELSE 'Unknown' END"
        if d.get("filters"):
            sql = f"CASE WHEN {self.conditions(d['filters'], v)} THEN {sql} END"
        return f"({sql})" if f.type == "yesno" else sql

    def conditions(self, filters: list[dict], view, skip: str | None = None) -> str:
        """The mini-language's filters, as one predicate."""
        out = []
        for c in filters:
            f = self.project.get_field(c["field"], view, check=False)
            if f.id == skip:
                continue
            week = self.project.model_of(f.view).get("week_start_day", "monday")
            if "expression" in c:
                out.append(predicate(self.row(f), c["expression"], c.get("value"), f.value_type, self.now, week))
            else:
                out += [predicate(self.row(f), e, x, f.value_type, self.now, week) for e, x in parse_value(c.get("value"), self.now, week)]
        return " AND ".join(f"({x})" for x in out) or "TRUE"

    # ---- aggregates

    def argument(self, m: Field) -> str:
        """What an aggregate is taken of: the measure's SQL under its filters and non-additive date."""
        d, v = m.data, m.view
        if m.id in self.overrides:
            return self.overrides[m.id]
        sql = d.get("sql")
        if sql:
            x = self.text(sql, v)
        elif v.primary_key:
            x = self.row(v.primary_key)
        else:
            x = "*"
        tests = []
        if d.get("filters"):
            if x == "*":
                raise QueryError(f"{m.id} is filtered, so its view needs a primary key")
            tests.append(self.conditions(d["filters"], v, m.id))
        other = None
        if na := d.get("non_additive_dimension"):
            tests.append(self.non_additive(m, na))
            other = None if m.type in ("count", "count_distinct") else "0"
        if tests:
            x = f"CASE WHEN {' AND '.join(tests)} THEN {x}{f' ELSE {other}' if other else ''} END"
        return x

    def non_additive(self, m: Field, na: dict) -> str:
        date = self.project.get_field(na["name"] if not na["name"].endswith("_raw") else na["name"], m.view, check=False) if self._has(na["name"], m.view) else self.project.get_field(f"{na['name']}_raw", m.view, check=False)
        groups = [self.row(self.project.get_field(g, m.view, check=False)) for g in na.get("window_groupings") or []]
        if na.get("window_aware_of_query_dimensions", True):
            groups += self.dims
        else:  # variations of the same date group are always part of the grouping
            groups += [self.row(f) for f in self.dimension_fields if f.is_group and f.view.name == date.view.name and f.name == date.name]
        key = (na.get("window_choice", "max").lower(), self.row(date), tuple(dict.fromkeys(groups)))
        column = self.windows.setdefault(key, f"__na{len(self.windows)}")
        test = f"{key[1]} = `{column}`"
        if not na.get("nulls_are_equal"):
            test += "".join(f" AND {g} IS NOT NULL" for g in key[2])
        return f"({test})"

    def _has(self, name: str, view) -> bool:
        return bool(view.find(name)) if "." not in name else self.project.has_field(name)

    def marker(self, *partition: str) -> str:
        """A column that is 1 in one row of each group of the partition columns within the query's dimensions."""
        return self.markers.setdefault(partition, f"__first{len(self.markers)}")

    def aggregate(self, m: Field) -> str:
        """A measure's aggregate SQL."""
        if m.id in self.overrides:
            return self.overrides[m.id]
        kind, d, v = m.type, m.data, m.view
        if kind in FORMULAS:
            x = self.text(d["sql"], v, measures=True)
            return f"({x})" if kind == "yesno" else x
        if kind == "cumulative":
            raise QueryError(f"{m.id} is cumulative and can't be part of this query")
        x = self.argument(m)
        if kind in ("sum_distinct", "average_distinct"):
            key = self.text(d["sql_distinct_key"], v)
            one = f"CASE WHEN `{self.marker(key, f'({x}) IS NULL')}` = 1 THEN {x} END"
            return f"{'SUM' if kind == 'sum_distinct' else 'AVG'}({one})"
        if kind in ("sum", "count", "average") and (self.protected is None or v.name in self.protected):
            pk = v.primary_key
            if pk is None:
                raise QueryError(f"{m.id} needs protection against join fan-out, so view {v.name} needs a primary key")
            key = self.row(pk)
            if kind == "count":
                return f"COUNT(DISTINCT {key})" if x == key and d.get("primary_key_count") else f"NULLIF(COUNT(DISTINCT CASE WHEN {x} IS NOT NULL THEN {key} END), 0)"
            # a value that depends on other views is not fixed by the key: it counts once for each (key, value)
            mark = self.marker(key) if len(m.views()) == 1 else self.marker(key, x)
            one = f"CASE WHEN `{mark}` = 1 AND {key} IS NOT NULL THEN {x} END"
            return f"COALESCE(SUM({one}), 0)" if kind == "sum" else f"AVG({one})"
        simple = {"count": "COUNT({})", "count_distinct": "COUNT(DISTINCT {})", "sum": "SUM({})", "average": "AVG({})", "min": "MIN({})", "max": "MAX({})"}
        if kind in simple:
            return simple[kind].format(x)
        if kind in ("median", "percentile"):
            fraction = 0.5 if kind == "median" else float(d["percentile"]) / 100
            if not 0 <= fraction <= 1:
                raise QueryError(f"the percentile of {m.id} must lie between 0 and 100")
            return f"MAX(`{self.quantiles.setdefault((x, fraction), f'__q{len(self.quantiles)}')}`)"
        raise QueryError(f"unknown measure type {kind} of {m.id}")


def window_column(f: Field) -> str:
    return f"__window_{f.alias}"


def _closing(text: str, at: int) -> int:
    """Index of the parenthesis that closes the one at `at`."""
    depth = 0
    for i in range(at, len(text)):
        depth += {"(": 1, ")": -1}.get(text[i], 0)
        if not depth:
            return i
    raise QueryError(f"unbalanced parentheses: {text}")


def rewritten(sql: str) -> str:
    """Functions of other dialects that Spark lacks."""
    while m := re.search(r"\bratio_to_report\s*\(", sql, re.I):
        end = _closing(sql, m.end() - 1)
        over = re.match(r"\s*over\s*\(", sql[end + 1 :], re.I)
        if not over:
            raise QueryError(f"ratio_to_report needs OVER: {sql}")
        last = _closing(sql, end + over.end())
        inner, window = sql[m.end() : end], sql[end + 1 : last + 1]
        sql = f"{sql[: m.start()]}(({inner}) / SUM({inner}){window}){sql[last + 1 :]}"
    return sql
