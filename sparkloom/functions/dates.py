"""Timeframes, durations and date phrases.

Durations count boundary crossings (from Dec 31 to Jan 1 is one year). Phrases are evaluated on the
driver against an injectable clock.
"""

from __future__ import annotations

import calendar
import re
from datetime import datetime, timedelta

from sparkloom.errors import QueryError

TIMEFRAMES = (
    "raw", "time", "second", "minute", "hour", "date", "week", "month", "quarter", "year", "fiscal_month", "fiscal_quarter", "fiscal_year",
    "week_index", "week_of_year", "week_of_month", "month_of_year_index", "month_index", "fiscal_month_of_year_index", "fiscal_month_index",
    "month_of_year", "month_name", "month_of_year_full_name", "quarter_of_year", "fiscal_quarter_of_year", "hour_of_day", "day_of_week", "day_of_month", "day_of_year",
)
INTERVALS = ("second", "minute", "hour", "day", "week", "month", "quarter", "year")
WEEK_SHIFT = {"monday": 0, "sunday": 1, "saturday": 2, "friday": 3, "thursday": 4, "wednesday": 5, "tuesday": 6}


def timeframe(sql: str, frame: str, week_start: str = "monday", fiscal_offset: int = 0, timezone: str | None = None) -> str:
    """SQL text of one timeframe of a timestamp expression."""
    if frame == "raw":
        return sql
    ts = f"cast({sql} as timestamp_ntz)"
    if timezone:
        ts = f"convert_timezone('UTC', '{timezone}', {ts})"
    k = WEEK_SHIFT[(week_start or "monday").lower()]
    fiscal = f"({ts} + make_ym_interval(0, {int(fiscal_offset or 0)}))"
    trunc = lambda unit, x=ts: f"cast(date_trunc('{unit}', {x}) as timestamp_ntz)"
    big = lambda x: f"cast({x} as bigint)"
    quarter = lambda x: f"concat(year({x}), '-Q', quarter({x}))"
    shifted = f"({ts} + interval {k} day)" if k else ts
    week = trunc("WEEK", shifted)
    table = {
        "time": lambda: ts,
        "second": lambda: trunc("SECOND"),
        "minute": lambda: trunc("MINUTE"),
        "hour": lambda: trunc("HOUR"),
        "date": lambda: trunc("DAY"),
        "week": lambda: f"({week} - interval {k} day)" if k else week,
        "month": lambda: trunc("MONTH"),
        "quarter": lambda: quarter(ts),
        "year": lambda: trunc("YEAR"),
        "fiscal_month": lambda: trunc("MONTH", fiscal),
        "fiscal_quarter": lambda: quarter(fiscal),
        "fiscal_year": lambda: trunc("YEAR", fiscal),
        "week_index": lambda: big(f"extract(week from date_trunc('DAY', {shifted}))"),
        "week_of_month": lambda: big(f"extract(week from {ts}) - extract(week from date_trunc('MONTH', {ts})) + 1"),
        "month_of_year_index": lambda: big(f"month({ts})"),
        "fiscal_month_of_year_index": lambda: big(f"month({fiscal})"),
        "month_of_year": lambda: f"date_format({ts}, 'MMM')",
        "month_of_year_full_name": lambda: f"date_format({ts}, 'MMMM')",
        "quarter_of_year": lambda: big(f"quarter({ts})"),
        "fiscal_quarter_of_year": lambda: big(f"quarter({fiscal})"),
        "hour_of_day": lambda: big(f"hour({ts})"),
        "day_of_week": lambda: f"date_format({ts}, 'E')",
        "day_of_month": lambda: big(f"day({ts})"),
        "day_of_year": lambda: big(f"dayofyear({ts})"),
    }
    same = {"week_of_year": "week_index", "month_index": "month_of_year_index", "fiscal_month_index": "fiscal_month_of_year_index", "month_name": "month_of_year"}
    frame = same.get(frame, frame)
    if frame not in table:
        raise QueryError(f"unknown timeframe {frame}")
    return table[frame]()


def duration(start: str, end: str, interval: str) -> str:
    """SQL text of the boundaries crossed from start to end; interval in the singular or plural."""
    unit = interval.rstrip("s")
    s, e = f"cast({start} as timestamp_ntz)", f"cast({end} as timestamp_ntz)"
    months = f"((year({e}) - year({s})) * 12 + month({e}) - month({s}))"
    seconds = lambda u, n: f"cast((unix_timestamp(date_trunc('{u}', {e})) - unix_timestamp(date_trunc('{u}', {s}))) / {n} as bigint)"
    table = {
        "second": seconds("SECOND", 1), "minute": seconds("MINUTE", 60), "hour": seconds("HOUR", 3600),
        "day": f"cast(datediff(to_date({e}), to_date({s})) as bigint)",
        "week": f"cast(datediff(to_date(date_trunc('WEEK', {e})), to_date(date_trunc('WEEK', {s}))) / 7 as bigint)",
        "month": f"cast({months} as bigint)",
        "quarter": f"cast((year({e}) - year({s})) * 4 + quarter({e}) - quarter({s}) as bigint)",
        "year": f"cast(year({e}) - year({s}) as bigint)",
    }
    if unit not in table:
        raise QueryError(f"unknown interval {interval}")
    return table[unit]


# ------------------------------------------------------------------ phrases

_UNIT = r"(day|week|month|quarter|year)s?"
_LITERAL = re.compile(r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?)?$")


def start_of(unit: str, t: datetime, week_start: str = "monday") -> datetime:
    day = t.replace(hour=0, minute=0, second=0, microsecond=0)
    if unit == "week":
        first = (7 - WEEK_SHIFT[week_start]) % 7  # Python's weekday of the week's first day
        return day - timedelta(days=(day.weekday() - first) % 7)
    if unit == "month":
        return day.replace(day=1)
    if unit == "quarter":
        return day.replace(month=3 * ((day.month - 1) // 3) + 1, day=1)
    return day.replace(month=1, day=1) if unit == "year" else day


def shift(t: datetime, unit: str, n: int) -> datetime:
    if unit in ("day", "week"):
        return t + timedelta(days=n * (7 if unit == "week" else 1))
    months = t.year * 12 + t.month - 1 + n * {"month": 1, "quarter": 3, "year": 12}[unit]
    year, month = divmod(months, 12)
    return t.replace(year=year, month=month + 1, day=min(t.day, calendar.monthrange(year, month + 1)[1]))


def end_of(unit: str, t: datetime, week_start: str = "monday") -> datetime:
    return shift(start_of(unit, t, week_start), unit, 1) - timedelta(seconds=1)


def date_phrase(text: str, now: datetime, week_start: str = "monday") -> tuple[datetime | None, datetime | None] | None:
    """Inclusive bounds of a date phrase; None if the text holds none."""
    t = text.strip().lower()
    ws = (week_start or "monday").lower()
    if " until " in t:
        left, right = t.split(" until ", 1)
        bound = lambda s: (datetime.fromisoformat(s),) * 2 if _LITERAL.match(s) else date_phrase(s, now, ws)
        a, b = bound(left.strip()), bound(right.strip())
        return (a[0], b[1]) if a and b else None
    if t in ("today", "yesterday"):
        day = now - timedelta(days=t == "yesterday")
        return start_of("day", day), end_of("day", day)
    if m := re.search(rf"(\d+) {_UNIT} ago for (\d+) {_UNIT}", t):
        begin = start_of(m[2], shift(start_of(m[2], now, ws), m[2], -int(m[1])), ws)
        return begin, end_of(m[4], shift(begin, m[4], int(m[3]) - 1), ws)
    if m := re.search(rf"(?:(this|last|\d+) )?{_UNIT}( ago)? to date", t):
        n = int(m[1]) if m[1] and m[1].isdigit() else 0
        lag = {None: 0, "this": 0, "last": 1}.get(m[1], n if m[3] else n - 1)
        current = start_of(m[2], now, ws)
        elapsed = (start_of("day", now) - current).days
        begin = shift(current, m[2], -lag)
        return begin, end_of("day", begin + timedelta(days=max(elapsed - 1, 0)))
    if m := re.search(rf"(\d+) {_UNIT} ago", t):
        begin = shift(start_of(m[2], now, ws), m[2], -int(m[1]))
        return begin, end_of(m[2], begin, ws)
    if m := re.search(rf"(this|last|\d+) {_UNIT}", t):
        lag = {"this": 0, "last": 1}.get(m[1]) if not m[1].isdigit() else int(m[1]) - 1
        begin = shift(start_of(m[2], now, ws), m[2], -lag)
        return begin, end_of(m[2], begin if m[1] == "last" else now, ws)
    return None


def literal(t: datetime) -> str:
    return f"timestamp_ntz'{t:%Y-%m-%d %H:%M:%S}'"
