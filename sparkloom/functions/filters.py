"""Filter expressions and the string mini-language, as Spark SQL predicates."""

from __future__ import annotations

import re
from datetime import date, datetime

from sparkloom.errors import QueryError
from sparkloom.functions.dates import date_phrase, literal

EXPRESSIONS = (
    "less_than", "less_or_equal_than", "equal_to", "not_equal_to", "greater_or_equal_than", "greater_than", "like",
    "contains", "does_not_contain", "contains_case_insensitive", "does_not_contain_case_insensitive",
    "starts_with", "ends_with", "does_not_start_with", "does_not_end_with",
    "starts_with_case_insensitive", "ends_with_case_insensitive", "does_not_start_with_case_insensitive", "does_not_end_with_case_insensitive",
    "is_null", "is_not_null", "isin", "isnotin", "boolean_true", "is_true", "boolean_false", "is_false", "is_in_query", "is_not_in_query", "matches", "converted", "dropped_off",
)
_COMPARE = {"less_than": "<", "less_or_equal_than": "<=", "equal_to": "=", "not_equal_to": "<>", "greater_or_equal_than": ">=", "greater_than": ">"}
_PATTERN = {"contains": "%{}%", "does_not_contain": "%{}%", "starts_with": "{}%", "ends_with": "%{}", "does_not_start_with": "{}%", "does_not_end_with": "%{}"}


def quoted(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, datetime):
        return literal(value)
    if isinstance(value, date):
        return f"date'{value:%Y-%m-%d}'"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def pattern(value) -> str:
    """A LIKE pattern in which a backslash stands for itself."""
    return quoted(str(value).replace("\\", "\\\\"))


def number(value):
    """The value as a number if it is one."""
    if isinstance(value, str):
        try:
            return float(value) if re.search(r"[.eE]", value) else int(value)
        except ValueError:
            return value
    return value


def predicate(sql: str, expression: str, value=None, kind: str = "string", now: datetime | None = None, week_start: str = "monday", raw: bool = False) -> str:
    """SQL text of one condition. kind: the field's type; raw: value is SQL text already."""
    if kind == "yesno" and expression == "equal_to" and str(value).lower() in ("true", "false"):
        expression = f"boolean_{str(value).lower()}"
    lit = (lambda v: v) if raw else (lambda v: quoted(number(v) if kind == "number" else datetime.fromisoformat(v) if kind == "time" and isinstance(v, str) and re.match(r"\d{4}-\d\d-\d\d", v) else v))
    if expression in _COMPARE:
        return f"{sql} {_COMPARE[expression]} {lit(value)}"
    if expression == "like":
        return f"{sql} LIKE {pattern(value)}"
    plain, insensitive = expression.removesuffix("_case_insensitive"), expression.endswith("_case_insensitive")
    if plain in _PATTERN:
        like = pattern(_PATTERN[plain].format(value))
        test = f"LOWER({sql}) LIKE LOWER({like})" if insensitive else f"{sql} LIKE {like}"
        return f"NOT ({test})" if plain.startswith("does_not") else test
    if expression == "is_null":
        return f"{sql} IS NULL"
    if expression == "is_not_null":
        return f"NOT {sql} IS NULL"
    if expression in ("isin", "isnotin"):
        values = ", ".join(lit(v) for v in value)
        if not values:
            return "FALSE" if expression == "isin" else "TRUE"
        return f"{'NOT ' * (expression == 'isnotin')}{sql} IN ({values})"
    if expression in ("boolean_true", "is_true"):
        return f"({sql})"
    if expression in ("boolean_false", "is_false"):
        return f"NOT ({sql})"
    if expression == "matches":
        bounds = date_phrase(str(value), now or datetime.now(), week_start)
        if not bounds:
            raise QueryError(f"'{value}' is not a date phrase")
        return " AND ".join(f"{sql} {op} {literal(t)}" for op, t in zip((">=", "<="), bounds, strict=True) if t)
    raise QueryError(f"unknown filter expression '{expression}'; valid are: {', '.join(EXPRESSIONS)}")


def parse_value(value, now: datetime | None = None, week_start: str = "monday") -> list[tuple[str, object]]:
    """The string mini-language: (expression, value) pairs, all of which must hold; empty if the filter is skipped."""
    if isinstance(value, bool) or (isinstance(value, int) and value in (0, 1)):
        return [(f"boolean_{str(bool(value)).lower()}", None)]
    if isinstance(value, (int, float)):
        return [("equal_to", value)]
    if value is None:
        return [("is_null", None)]
    text = str(value).strip()
    if not text:
        return []
    if text in ("NULL", "None"):
        return [("is_null", None)]
    if text == "-NULL":
        return [("is_not_null", None)]
    if text.lower() in ("true", "false"):
        return [(f"boolean_{text.lower()}", None)]
    if bounds := date_phrase(text, now or datetime.now(), week_start):
        return [(e, t) for e, t in zip(("greater_or_equal_than", "less_or_equal_than"), bounds, strict=True) if t]
    if m := re.match(r"^(after|before|on|not on) (.+)$", text):
        return [({"after": "greater_or_equal_than", "before": "less_or_equal_than", "on": "equal_to", "not on": "not_equal_to"}[m[1]], m[2])]
    if "," in text:
        parts = [p.strip() for p in text.split(",") if p.strip()]
        against = [p.startswith("-") for p in parts]
        if all(against):
            return [("isnotin", [p[1:] for p in parts])]
        if any(against):
            raise QueryError(f"'{text}' mixes values to include and to exclude")
        return [("isin", parts)]
    if m := re.match(r"^(<=|>=|<>|!=|=|>|<)\s*(.+)$", text):
        names = {"<=": "less_or_equal_than", ">=": "greater_or_equal_than", "<>": "not_equal_to", "!=": "not_equal_to", "=": "equal_to", ">": "greater_than", "<": "less_than"}
        return [(names[m[1]], number(m[2]))]
    against = text.startswith("-")
    body = text[against:]
    for test, name, cut in ((body.startswith("%") and body.endswith("%") and len(body) > 1, "contain", slice(1, -1)), (body.startswith("%"), "end", slice(1, None)), (body.endswith("%"), "start", slice(None, -1))):
        if test:
            plain = {"contain": "contains", "end": "ends_with", "start": "starts_with"}[name]
            minus = {"contain": "does_not_contain", "end": "does_not_end_with", "start": "does_not_start_with"}[name]
            return [(f"{minus if against else plain}_case_insensitive", body[cut])]
    return [("not_equal_to" if against else "equal_to", body)]
