"""Project objects: models, views, fields, topics, dashboards; lookups, access, sets, virtual views."""

from __future__ import annotations

import copy
import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

from sparkloom.errors import AccessDeniedOrDoesNotExistException, ConfigError, QueryError
from sparkloom.functions.dates import INTERVALS, TIMEFRAMES

REFERENCE = re.compile(r"\$\{(.*?)\}")
AGGREGATES = ("count", "count_distinct", "sum", "average", "min", "max", "median", "percentile", "sum_distinct", "average_distinct")
FORMULAS = ("number", "string", "yesno", "time")
MEASURE_TYPES = (*AGGREGATES, *FORMULAS, "cumulative")
DATE_NAMES = ("date", "week", "month", "quarter", "year", "day_of_year", "week_of_year", "month_of_year")
_TEMPLATE = re.compile(r"\{\{\s*(user_attributes|query_attributes)\[['\"](\w+)['\"]\]\s*\}\}")


def template(text: str, user: dict | None = None, query: dict | None = None) -> str:
    """Fill in attributes; where one is missing, the whole text stays as it is."""
    found = {"user_attributes": user or {}, "query_attributes": query or {}}
    if any(m[2] not in found[m[1]] for m in _TEMPLATE.finditer(text)):
        return text
    return _TEMPLATE.sub(lambda m: str(found[m[1]][m[2]]), text)


def as_list(value) -> list:
    if value is None or value == "":
        return []
    if isinstance(value, str):
        return [x.strip() for x in value.split(",")]
    return list(value)


@dataclass(frozen=True)
class Field:
    """A field in one variant: a plain dimension, a timeframe or interval of a group, or a measure."""

    view: View = field(repr=False, compare=False)
    data: dict = field(repr=False, compare=False)
    key: str = ""
    variant: str | None = None

    @property
    def name(self) -> str:
        return self.data["name"].lower()

    @property
    def kind(self) -> str:
        return self.data["field_type"]

    @property
    def type(self) -> str:
        return self.data.get("type", "string")

    @property
    def sql(self) -> str | None:
        return self.data.get("sql")

    @property
    def alias(self) -> str:
        if not self.variant:
            return self.name
        return f"{self.variant}_{self.name}" if self.type == "duration" else f"{self.name}_{self.variant}"

    @property
    def id(self) -> str:
        return f"{self.view.name}.{self.alias}"

    @property
    def column(self) -> str:
        return f"{self.view.name}_{self.alias}"

    @property
    def is_measure(self) -> bool:
        return self.kind == "measure"

    @property
    def is_group(self) -> bool:
        return self.kind == "dimension_group"

    @property
    def label(self) -> str:
        return self.data.get("label") or self.alias.replace("_", " ").title()

    @property
    def value_type(self) -> str:
        """The type for filters: what a value is compared with."""
        if self.is_group:
            return "number" if self.type == "duration" else "time" if self.variant in ("raw", "time", "second", "minute", "hour", "date", "week", "month", "year", "fiscal_month", "fiscal_year") else "string"
        if self.is_measure and self.type not in ("string", "yesno", "time"):
            return "number"
        return self.type

    @property
    def sql_hash(self) -> str:
        return hashlib.md5(json.dumps(self.data, sort_keys=True, default=str).encode()).hexdigest()

    def references(self) -> list[Field]:
        """Fields that this field's fragments name directly."""
        d = self.data
        texts = [d.get("sql"), d.get("sql_start"), d.get("sql_end"), d.get("sql_distinct_key"), d.get("cumulative_where")]
        texts += [w.get("sql") for w in (d.get("case") or {}).get("whens", [])]
        names = [m for t in texts if t for m in REFERENCE.findall(str(t)) if m not in ("TABLE", "cumulative_date")]
        names += [f["field"] for f in d.get("filters") or [] if self.is_measure or self.kind == "dimension"]
        names += [d["measure"]] if d.get("type") == "cumulative" and d.get("measure") else []
        return [self.view.project.get_field(n, self.view, check=False) for n in dict.fromkeys(names)]

    def views(self) -> list[str]:
        """Names of all views that the field's value depends on, its own first."""
        out = dict.fromkeys([self.view.name])
        for f in self.references():
            out |= dict.fromkeys(f.views())
        return list(out)

    def measures(self) -> list[Field]:
        """The aggregates that a formula is made of; an aggregate itself."""
        if not self.is_measure or self.type not in FORMULAS:
            return [self]
        return list({m.id: m for f in self.references() if f.is_measure for m in f.measures()}.values())

    @property
    def canon_date(self) -> str | None:
        """id of the date group that a measure trends on."""
        date = self.data.get("canon_date") or self.view.default_date
        return None if not date else date.lower() if "." in date else f"{self.view.name}.{date.lower()}"

    def is_merged(self) -> bool:
        """Whether a formula needs measures of several dates."""
        if self.data.get("is_merged_result"):
            return True
        return self.is_measure and self.type in FORMULAS and len({m.canon_date for m in self.measures()}) > 1

    def is_cumulative(self) -> bool:
        return self.is_measure and (self.type == "cumulative" or (self.type in FORMULAS and any(m.type == "cumulative" for m in self.measures())))


class View:
    def __init__(self, project: Project, data: dict, source: str | None = None):
        self.project, self.data = project, data
        self.name = data["name"].lower()
        #: The view whose table this is, when it is a second alias.
        self.source = source or self.name

    def __getattr__(self, name):
        if name in ("data", "project"):
            raise AttributeError(name)
        return self.data.get(name)

    @cached_property
    def declared(self) -> list[dict]:
        return [{**f, "name": f["name"].lower()} for f in self.data.get("fields", [])]

    def fields(self, expand: bool = True) -> Iterator[Field]:
        for d in self.declared:
            if d["field_type"] == "dimension_group" and expand:
                for v in self.variants(d):
                    yield Field(self, d, f"{self.name}.{d['name']}.{v}", v)
            else:
                yield Field(self, d, f"{self.name}.{d['name']}")

    @staticmethod
    def variants(d: dict) -> list[str]:
        if d.get("type") == "duration":
            return [i if i.endswith("s") else f"{i}s" for i in d.get("intervals") or [f"{i}s" for i in INTERVALS]]
        frames = list(d.get("timeframes") or TIMEFRAMES)
        return frames if "raw" in frames else ["raw", *frames]

    @cached_property
    def lookup(self) -> dict[str, Field]:
        out = {}
        for f in self.fields():
            if f.alias in out:
                raise ConfigError(f"view {self.name} has two fields named {f.alias}")
            out[f.alias] = f
        return out

    def find(self, alias: str) -> Field | None:
        f = self.lookup.get(alias.lower())
        if f is None and alias.lower() == "count":
            f = Field(self, {"name": "count", "field_type": "measure", "type": "count", "sql": None}, f"{self.name}.count")
        return f

    @cached_property
    def primary_key(self) -> Field | None:
        for f in self.fields():
            if f.data.get("primary_key") and (not f.is_group or f.variant == "raw"):
                return f
        return None

    def sets(self) -> dict[str, list[str]]:
        return {s["name"]: s.get("fields", []) for s in self.data.get("sets") or []}

    def expand(self, names: list[str]) -> list[str]:
        """Field ids of a set's list: ALL_FIELDS*, set*, -set*, -field."""
        out: dict[str, None] = {}
        for n in names:
            minus, body = n.startswith("-"), n.lstrip("-")
            view, _, rest = body.rpartition(".")
            owner = self.project.view(view) if view else self
            if rest.endswith("*"):
                key = rest[:-1]
                if key == "ALL_FIELDS":
                    got = [f.id for f in owner.fields()]
                elif key in owner.sets():
                    got = owner.expand(owner.sets()[key])
                else:
                    raise ConfigError(f"view {owner.name} has no set {key}")
            else:
                got = [self.project.get_field(rest, owner, check=False).id]
            for g in got:
                out.pop(g, None) if minus else out.setdefault(g)
        return list(out)

    @property
    def sql_hash(self) -> str:
        return hashlib.md5(json.dumps(self.data, sort_keys=True, default=str).encode()).hexdigest()


class Topic:
    def __init__(self, project: Project, data: dict):
        self.project, self.data = project, data
        self.label = data.get("label") or data["name"]
        self.name = data.get("name") or data["label"]
        self.base = data["base_view"].lower()
        self.joins = {k.lower(): v or {} for k, v in (data.get("views") or {}).items()}

    def views(self) -> list[str]:
        return [self.base, *self.joins]


class Project:
    """Models, views, topics and dashboards as dictionaries; the user decides what can be seen."""

    def __init__(self, models: list[dict], views: list[dict], topics: list[dict] | None = None, dashboards: list[dict] | None = None, env: str = "prod", refs: dict[str, str] | None = None, timezone: str | None = None):
        self.models_data, self.views_data = models, views
        self.topics_data, self.dashboards_data = topics or [], dashboards or []
        self.env, self.refs, self._timezone = env, refs or {}, timezone
        self.user: dict | None = None
        self._views: dict[str, View] | None = None

    # ---- objects

    def refresh(self) -> None:
        self._views = None
        self.__dict__.pop("graph", None)

    def set_user(self, user: dict | None) -> None:
        self.user = user

    @property
    def model(self) -> dict:
        return self.models_data[0] if self.models_data else {}

    def model_of(self, view: View | str) -> dict:
        name = (view if isinstance(view, View) else self.view(view)).data.get("model_name")
        return next((m for m in self.models_data if m["name"] == name), self.model)

    @property
    def timezone(self) -> str | None:
        zones = {m["timezone"] for m in self.models_data if m.get("timezone")}
        if len(zones) > 1:
            raise ConfigError(f"models have different timezones: {sorted(zones)}")
        return self._timezone or next(iter(zones), None)

    @property
    def all_views(self) -> dict[str, View]:
        if self._views is None:
            out: dict[str, View] = {}
            for d in self.views_data:
                v = View(self, d)
                if v.name in out:
                    raise ConfigError(f"duplicate view {v.name}")
                out[v.name] = v
            for v in list(out.values()):
                for i in v.data.get("identifiers") or []:
                    if i.get("join_as"):
                        out[i["join_as"].lower()] = self._alias(v, i["join_as"].lower(), i, bool(i.get("include_metrics")))
            for t in self.topics_data:
                for name, j in (t.get("views") or {}).items():
                    if j and j.get("from"):
                        out[name.lower()] = self._alias(out[j["from"].lower()], name.lower(), None, j.get("include_metrics", True))
            self._views = out
        return self._views

    def _alias(self, view: View, name: str, identifier: dict | None, measures: bool) -> View:
        d = copy.deepcopy(view.data)
        d["name"] = name
        if identifier:
            own = {k: v for k, v in identifier.items() if k not in ("join_as", "join_as_label", "include_metrics")}
            d["identifiers"] = [own, *[i for i in d["identifiers"] if i["name"] != identifier["name"] and not i.get("join_as") and i.get("type") != "primary"]]
        d["fields"] = [{**f, "tags": [f"{t} ({name})" for t in f.get("tags") or []]} for f in d["fields"] if measures or f["field_type"] != "measure"]
        return View(self, d, view.source)

    def view(self, name: str) -> View:
        v = self.all_views.get(name.lower())
        if v is None or not self.can_see(v.data, self.model_of_data(v)):
            raise AccessDeniedOrDoesNotExistException(f"Could not find or you do not have access to view {name}", name, "view")
        return v

    def model_of_data(self, v: View) -> dict:
        return next((m for m in self.models_data if m["name"] == v.data.get("model_name")), self.model)

    def views(self) -> list[View]:
        return [v for v in self.all_views.values() if self.can_see(v.data, self.model_of_data(v))]

    def topic(self, name: str) -> Topic:
        for t in self.topics_data:
            if name in (t.get("label"), t.get("name")) and self.can_see(t):
                return Topic(self, t)
        raise AccessDeniedOrDoesNotExistException(f"Could not find or you do not have access to topic {name}", name, "topic")

    def topics(self) -> list[Topic]:
        return [Topic(self, t) for t in self.topics_data if self.can_see(t)]

    def dashboards(self) -> list[dict]:
        return [d for d in self.dashboards_data if self.can_see(d)]

    # ---- access

    def can_see(self, *objects: dict) -> bool:
        """All grants of all objects pass; without a user, or where the attribute is unset, a grant passes."""
        for o in objects:
            for name in o.get("required_access_grants") or []:
                grant = next((g for m in self.models_data for g in m.get("access_grants") or [] if g["name"] == name), None)
                if grant is None:
                    raise ConfigError(f"unknown access grant {name}")
                value = (self.user or {}).get(grant["user_attribute"])
                if value is not None and value not in grant["allowed_values"]:
                    return False
        return True

    # ---- fields

    def fields(self, expand: bool = True, hidden: bool = True) -> list[Field]:
        return [f for v in self.views() for f in v.fields(expand) if self.can_see(f.data) and (hidden or not f.data.get("hidden"))]

    def metrics(self, view: str | None = None) -> list[Field]:
        return [f for f in self.fields() if f.is_measure and view in (None, f.view.name)]

    def dimensions(self, view: str | None = None) -> list[Field]:
        return [f for f in self.fields() if not f.is_measure and view in (None, f.view.name)]

    def get_field(self, name: str, view: View | None = None, check: bool = True, topic: Topic | None = None) -> Field:
        """By `view.alias` or alias; an alias of several views is an error that lists them."""
        name = name.strip()
        owner, _, alias = name.rpartition(".")
        if owner:
            v = self.all_views.get(owner.lower())
            found = [f] if v and (f := v.find(alias)) else []
        elif view is not None and (f := view.find(alias)):
            found = [f]
        else:
            among = [self.all_views[n] for n in topic.views()] if topic else self.all_views.values()
            found = [f for v in among if (f := v.lookup.get(alias.lower()))]
            if check:
                found = [f for f in found if self.can_see(f.data, f.view.data, self.model_of_data(f.view))]
        if len(found) > 1:
            raise QueryError(f"field {name} is in several views: {', '.join(sorted(f.id for f in found))}")
        if not found or (check and not self.can_see(found[0].data, found[0].view.data, self.model_of_data(found[0].view))):
            raise AccessDeniedOrDoesNotExistException(f"Could not find or you do not have access to field {name}", name, "field")
        return found[0]

    def has_field(self, name: str) -> bool:
        try:
            self.get_field(name)
        except (AccessDeniedOrDoesNotExistException, QueryError):
            return False
        return True

    def field_by_tag(self, tag: str, views: list[str] | None = None) -> Field | None:
        for v in self.all_views.values():
            if views is None or v.name in views:
                for f in v.fields():
                    if tag in (f.data.get("tags") or []):
                        return f
        return None

    def add_field(self, view: str, data: dict) -> None:
        self.view(view).data.setdefault("fields", []).append(data)
        self.refresh()

    def remove_field(self, view: str, name: str) -> None:
        d = self.view(view).data
        d["fields"] = [f for f in d["fields"] if f["name"].lower() != name.lower()]
        self.refresh()

    def replace_field(self, view: str, data: dict) -> None:
        self.remove_field(view, data["name"])
        self.add_field(view, data)

    # ---- mappings

    def mappings(self, model: dict | None = None) -> dict[str, list[str]]:
        """Logical names and the fields that they stand for, of one model or of all."""
        return {k: v["fields"] for m in ([model] if model else self.models_data) for k, v in (m.get("mappings") or {}).items()}

    def get_model(self, name: str) -> dict:
        found = next((m for m in self.models_data if m["name"] == name), None)
        if found is None or not self.can_see(found):
            raise AccessDeniedOrDoesNotExistException(f"Could not find or you do not have access to model {name}", name, "model")
        return found

    def model_for(self, names: list[str], model_name: str | None = None) -> dict:
        """The model of a request: the named one, or the one that all its fields belong to. Logical names alone choose the model that maps most of them."""
        if model_name:
            return self.get_model(model_name)
        if len(self.models_data) < 2:
            return self.model
        used = {self.model_of(self.get_field(n).view)["name"] for n in names if self.has_field(n)}
        logical = [n for n in names if not self.has_field(n)]
        maps = {m["name"]: sum(n in (m.get("mappings") or {}) for n in logical) for m in self.models_data}
        if len(used) > 1 or (used and any(maps.values()) and not maps[next(iter(used))]):
            raise QueryError(f"the fields belong to several models ({', '.join(sorted(used | {m for m, n in maps.items() if n}))}); name one as model_name")
        return self.get_model(next(iter(used)) if used else max(maps, key=maps.__getitem__))

    def mapped(self, f: Field) -> list[str]:
        """Fields that stand for the same as f."""
        return [x.lower() for fields in self.mappings().values() if f.id in [y.lower() for y in fields] for x in fields]

    @cached_property
    def graph(self):
        from sparkloom.plans.joins import JoinGraph

        return JoinGraph(self)

    def replaced(self, views: list[dict] | None = None, models: list[dict] | None = None, topics: list[dict] | None = None, dashboards: list[dict] | None = None) -> Project:
        """A copy in which objects of the same name are replaced, to validate an edit."""
        put = lambda old, new: [*[o for o in old if o.get("name") not in {n.get("name") for n in new or []}], *(new or [])]
        p = Project(put(self.models_data, models), put(self.views_data, views), put(self.topics_data, topics), put(self.dashboards_data, dashboards), self.env, self.refs, self._timezone)
        p.set_user(self.user)
        return p

    @property
    def id(self) -> str:
        return hashlib.md5(json.dumps([self.models_data, self.views_data, self.topics_data, self.dashboards_data], sort_keys=True, default=str).encode()).hexdigest()
