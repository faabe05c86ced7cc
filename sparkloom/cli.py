"""Command line: validate, list, show and dump a project folder; seed one from the catalog."""

from __future__ import annotations

import argparse
import json
import sys

from sparkloom.plans.validate import validate
from sparkloom.sources.loader import dump, load


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sparkloom", description=__doc__)
    p.add_argument("command", choices=("validate", "list", "show", "dump", "seed"))
    p.add_argument("folder")
    p.add_argument("what", nargs="?", default="metrics", help="list: metrics, dimensions, views, models, topics; show: a field; dump: the new folder; seed: the model's name")
    p.add_argument("--database")
    p.add_argument("--table")
    a = p.parse_args(args)
    if a.command == "seed":
        from pyspark.sql import SparkSession

        from sparkloom.plans.project import Project
        from sparkloom.sources.seed import seed

        views = seed(SparkSession.builder.getOrCreate(), a.what, a.database, a.table)
        dump(Project([{"name": a.what, "connection": "spark"}], views), a.folder)
        return 0
    project = load(a.folder)
    if a.command == "validate":
        found = validate(project)
        for f in found:
            print(f["message"])
        return int(any(not f["message"].startswith("Warning") for f in found))
    if a.command == "list":
        listed = {"metrics": lambda: [f.id for f in project.metrics()], "dimensions": lambda: [f.id for f in project.dimensions()], "views": lambda: [v.name for v in project.views()], "models": lambda: [m["name"] for m in project.models_data], "topics": lambda: [t.label for t in project.topics()]}
        print("\n".join(listed[a.what]()))
    elif a.command == "show":
        f = project.get_field(a.what)
        print(json.dumps({"id": f.id, "kind": f.kind, "type": f.type, **f.data}, indent=2, default=str))
    else:
        dump(project, a.what)
    return 0


if __name__ == "__main__":
    sys.exit(main())
