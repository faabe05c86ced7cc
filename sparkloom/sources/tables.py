"""Physical table names of views."""

from __future__ import annotations

import re

from sparkloom.errors import ConfigError
from sparkloom.plans.project import Project, View, template

_REF = re.compile(r"ref\(\s*['\"](.+?)['\"]\s*\)")
_BRANCH = re.compile(r"--\s*if\s+(\w+)\s*--\s*(.*?)(?=--\s*if\s|\Z)", re.S)


def resolve_table(project: Project, view: View, query_attributes: dict | None = None) -> str:
    """sql_table_name after attributes, environment branches (`-- if prod -- x`) and ref('x')."""
    text = view.data.get("sql_table_name")
    if not text:
        raise ConfigError(f"view {view.name} has neither sql_table_name nor derived_table")
    text = template(text, project.user, query_attributes)
    if branches := _BRANCH.findall(text):
        found = dict((k, v.strip()) for k, v in branches)
        if project.env not in found:
            raise ConfigError(f"view {view.name} has no table for environment {project.env}")
        text = found[project.env]
    if m := _REF.search(text):
        if m[1] not in project.refs:
            raise ConfigError(f"ref('{m[1]}') of view {view.name} is not known")
        text = project.refs[m[1]]
    return text.strip()
