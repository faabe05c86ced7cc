"""Projects from folders of YAML files, and back."""

from __future__ import annotations

from pathlib import Path

import yaml

from sparkloom.errors import ConfigError
from sparkloom.plans.project import Project

#: Order of keys in written files; others follow as they come.
KEY_ORDER = ("version", "type", "name", "label", "description", "model_name", "sql_table_name", "derived_table", "default_date", "base_view", "identifiers", "sets", "field_type", "sql", "timeframes", "intervals", "primary_key", "hidden", "tags", "views", "fields")


def documents(folder: str | Path) -> list[dict]:
    return [d for f in sorted(Path(folder).rglob("*.y*ml")) for d in yaml.safe_load_all(f.read_text()) if isinstance(d, dict)]


def load(folder: str | Path, env: str = "prod", refs: dict[str, str] | None = None) -> Project:
    """A folder of documents with `type: model | view | topic | dashboard`; semantic models are converted."""
    from sparkloom.sources.semantic import convert

    found: dict[str, list[dict]] = {"model": [], "view": [], "topic": [], "dashboard": []}
    other = []
    for d in documents(folder):
        if d.get("type") in found:
            found[d["type"]].append(d)
        elif "semantic_models" in d or "metrics" in d:
            other.append(d)
    if other:
        models, views, topics = convert(other)
        found["model"] += models if not found["model"] else []
        found["view"] += views
        found["topic"] += topics
    if not found["model"]:
        raise ConfigError(f"no model in {folder}")
    return Project(found["model"], found["view"], found["topic"], found["dashboard"], env, refs)


def arranged(d):
    if isinstance(d, dict):
        return {k: arranged(d[k]) for k in sorted(d, key=lambda k: KEY_ORDER.index(k) if k in KEY_ORDER else len(KEY_ORDER))}
    return [arranged(x) for x in d] if isinstance(d, list) else d


def dump(project: Project, folder: str | Path) -> list[Path]:
    """One file for each object."""
    out = []
    for kind, objects in (("model", project.models_data), ("view", project.views_data), ("topic", project.topics_data), ("dashboard", project.dashboards_data)):
        for o in objects:
            path = Path(folder) / f"{kind}s" / f"{str(o.get('name') or o.get('label')).lower().replace(' ', '_')}.yml"
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(yaml.safe_dump(arranged({"type": kind, **o}), sort_keys=False, allow_unicode=True))
            out.append(path)
    return out
