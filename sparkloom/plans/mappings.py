"""Field mappings: logical names that stand for fields of several views, and date names for the metrics' own dates."""

from __future__ import annotations

from sparkloom.errors import JoinError, QueryError
from sparkloom.plans.project import DATE_NAMES, REFERENCE, Project


def _names(conditions) -> list[str]:
    out = []
    for c in conditions or []:
        if isinstance(c, str):
            out += REFERENCE.findall(c)
        elif "conditions" in c:
            out += _names(c["conditions"])
        elif "conditional_filter_logic" in c:
            out += _names([c["conditional_filter_logic"]])
        elif "field" in c:
            out.append(c["field"])
    return out


def _replace(conditions, known: dict[str, str]):
    out = []
    for c in conditions or []:
        if isinstance(c, str):
            c = REFERENCE.sub(lambda m: f"${{{known.get(m[1], m[1])}}}", c)
        elif "conditions" in c:
            c = {**c, "conditions": _replace(c["conditions"], known)}
        elif "conditional_filter_logic" in c:
            c = {**c, "conditional_filter_logic": _replace([c["conditional_filter_logic"]], known)[0]}
        elif "field" in c:
            c = {**c, "field": known.get(c["field"], c["field"])}
        out.append(c)
    return out


def resolve_mappings(p: Project, args: dict, model: dict | None = None) -> tuple[dict, bool]:
    """args with real fields for the logical names of the model (of all, if None), and whether only a merged result can answer."""
    aslist = lambda x: [x] if isinstance(x, (str, dict)) else list(x or [])
    order = args["order_by"] if not isinstance(args["order_by"], str) else None
    used = [*args["dimensions"], *_names(aslist(args["where"])), *[o if isinstance(o, str) else o["field"] for o in order or []]]
    declared = p.mappings(model)
    logical = [n for n in dict.fromkeys(used) if "." not in n and (n in declared or n in DATE_NAMES) and not p.has_field(n)]
    if not logical:
        return args, False
    real = [p.get_field(n) for n in (*args["metrics"], *(d for d in used if d not in logical))]
    metrics = [p.get_field(m) for m in args["metrics"]]
    known: dict[str, str] = {}
    forced = False
    for n in logical:
        if n in declared:
            continue
        if metrics:
            dates = [a.canon_date for m in metrics for a in m.measures()]
            if not dates[0]:
                raise QueryError(f"{metrics[0].id} has no date, so {n} can't be resolved")
            forced |= len(set(dates)) > 1
            known[n] = f"{dates[0]}_{n}"
        else:
            views = [v for f in real for v in f.views()]
            dated = [v for v in dict.fromkeys(views) if p.all_views[v].default_date]
            if not dated:
                raise QueryError(f"{n} can't be resolved without a metric or a view with a default_date")
            best = max(dated, key=lambda v: sum(f["field_type"] == "measure" for f in p.all_views[v].declared))
            date = p.all_views[best].default_date
            known[n] = f"{date if '.' in date else f'{best}.{date}'}_{n}"
    fixed = [v for f in real for v in f.views()]
    for n in logical:
        if n not in declared:
            continue
        options = [f.lower() for f in declared[n] if p.has_field(f)]
        if not options:
            raise QueryError(f"no field of mapping {n} can be seen")
        choice = None
        for o in options:
            try:
                p.graph.plan([*fixed, *p.get_field(o).views()] if fixed else p.get_field(o).views())
            except JoinError:
                continue
            choice = o
            break
        if choice is None:  # each metric takes its own in a merged result
            reach = lambda o: any(v in p.graph.reach(m.view.name) for m in metrics for v in p.get_field(o).views())
            choice = next((o for o in options if reach(o)), None)
            if choice is None:
                raise QueryError(f"no field of mapping {n} ({', '.join(options)}) can be joined to the query")
            forced = True
        known[n] = choice
        fixed += p.get_field(choice).views() if not forced else []
    return {
        **args,
        "dimensions": [known.get(d, d) for d in args["dimensions"]],
        "where": _replace(aslist(args["where"]), known),
        "order_by": [known.get(o, o) if isinstance(o, str) else {**o, "field": known.get(o["field"], o["field"])} for o in order] if order else args["order_by"],
    }, forced
