"""Join graph and join planning."""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import cached_property

from sparkloom.errors import ConfigError, JoinError
from sparkloom.plans.project import REFERENCE, Project, Topic

WEIGHT = {"one_to_one": 1, "many_to_one": 2, "one_to_many": 3, "many_to_many": 4}
INVERSE = {"one_to_one": "one_to_one", "many_to_one": "one_to_many", "one_to_many": "many_to_one", "many_to_many": "many_to_many"}
HOW = {"left_outer": "left", "inner": "inner", "full_outer": "full", "cross": "cross"}


@dataclass(frozen=True)
class Edge:
    left: str
    right: str
    on: str
    relationship: str
    how: str = "left"


class JoinGraph:
    def __init__(self, project: Project):
        self.project = project
        self.edges: dict[tuple[str, str], Edge] = {}
        self.next: dict[str, list[str]] = {v: [] for v in project.all_views}
        holders: dict[str, list[tuple[str, dict]]] = {}
        for v in project.all_views.values():
            for i in v.data.get("identifiers") or []:
                if i.get("join_as"):
                    continue  # the virtual view holds it
                if i.get("type") == "join":
                    self._explicit(v.name, i)
                else:
                    holders.setdefault(i["name"], []).append((v.name, i))
        for found in holders.values():
            for a, i in found:
                for b, j in found:
                    if a != b:
                        self._implied(a, i, b, j)
        for n in self.next.values():
            n.sort()

    def _add(self, e: Edge) -> None:
        if e.right not in self.next:
            raise ConfigError(f"view {e.left} joins unknown view {e.right}")
        old = self.edges.get((e.left, e.right))
        if old is None or WEIGHT[e.relationship] < WEIGHT[old.relationship]:
            if old is None:
                self.next[e.left].append(e.right)
            self.edges[e.left, e.right] = e

    def _explicit(self, view: str, i: dict) -> None:
        other, how = i["reference"].lower(), HOW.get(i.get("join_type", "left_outer"), "left")
        self._add(Edge(view, other, i["sql_on"], i.get("relationship", "many_to_one"), how))
        back = INVERSE[i.get("relationship", "many_to_one")]
        if back in ("one_to_one", "many_to_one"):
            self._add(Edge(other, view, i["sql_on"], back, how))

    def _equal(self, a: str, i: dict, b: str, j: dict) -> str:
        """Equality of two identifiers; of composite ones, part by part, so that a null part joins nothing."""
        left, right = self._parts(a, i), self._parts(b, j)
        if len(left) != len(right):
            raise ConfigError(f"identifier {i['name']} has {len(left)} parts in view {a} and {len(right)} in view {b}")
        return " AND ".join(f"{x}={y}" for x, y in zip(left, right, strict=True))

    def _parts(self, view: str, i: dict) -> list[str]:
        """SQL of an identifier's parts; a part is an identifier of the view or has its own sql."""
        if not i.get("identifiers"):
            return [self._clause(view, i)]
        own = {x["name"]: x for x in self.project.all_views[view].data["identifiers"]}
        return [s for p in i["identifiers"] for s in self._parts(view, p if p.get("sql") else own.get(p["name"], p))]

    def _implied(self, a: str, i: dict, b: str, j: dict) -> None:
        for own, other in ((i, b), (j, a)):
            if own.get("only_join") and other not in [x.lower() for x in own["only_join"]]:
                return
        first, second = i["type"] == "primary", j["type"] == "primary"
        kind = "one_to_one" if first and second else "many_to_one" if second else "one_to_many" if first else "many_to_many"
        if kind in ("one_to_many", "many_to_many") and b not in [x.lower() for x in i.get("allowed_fanouts") or []]:
            return
        self._add(Edge(a, b, self._equal(a, i, b, j), kind))

    def _clause(self, view: str, i: dict) -> str:
        sql = i.get("sql") or f"${{{i['name']}}}"
        return REFERENCE.sub(lambda m: m[0] if "." in m[1] or m[1] == "TABLE" else f"${{{view}.{m[1]}}}", sql.replace("${TABLE}", view))

    # ---- reachability

    def reach(self, view: str) -> set[str]:
        seen, todo = {view}, [view]
        while todo:
            for n in self.next[todo.pop()]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return seen

    @cached_property
    def components(self) -> list[set[str]]:
        """Strongly connected components, by (size, first name) descending: subquery_0, subquery_1, ..."""
        reach = {v: self.reach(v) for v in self.next}
        parts = {frozenset(u for u in reach[v] if v in reach[u]) for v in self.next}
        return [set(p) for p in sorted(parts, key=lambda p: (len(p), min(p)), reverse=True)]

    @cached_property
    def _graphs(self) -> dict[str, set[str]]:
        out: dict[str, set[str]] = {v: set() for v in self.next}
        for i, c in enumerate(self.components):
            for v in self.reach(next(iter(c))):
                out[v].add(f"subquery_{i}")
        return out

    def graphs(self, view: str) -> set[str]:
        """ids of the components from which the view can be reached."""
        return self._graphs[view]

    def joinable(self, view: str) -> list[str]:
        """Views that can stand in one query with `view`."""
        mine = self.graphs(view)
        return sorted(v for v in self.next if v != view and mine & self.graphs(v))

    def joinable_fields(self, view: str) -> list[str]:
        """ids of the fields that can stand in one query with `view`, its own first."""
        views = [view, *self.joinable(view)]
        return [f.id for v in views for f in self.project.all_views[v].fields() if self.project.can_see(f.data, f.view.data) and not f.data.get("hidden")]

    def relationships(self) -> list[dict]:
        """All joins: views, condition, relationship and type."""
        types = {how: name for name, how in HOW.items()}
        return [{"from_view": e.left, "join_view": e.right, "sql_on": e.on, "relationship": e.relationship, "join_type": types[e.how]} for _, e in sorted(self.edges.items())]

    def field_graphs(self, f) -> set[str]:
        """Component ids shared by all views of a field."""
        out = None
        for v in f.views():
            out = self.graphs(v) if out is None else out & self.graphs(v)
        return out or set()

    # ---- planning

    def plan(self, required: list[str], topic: Topic | None = None) -> tuple[str, list[Edge]]:
        """Base view and joins in order. Of the views from which all others are reached, the cheapest by weights; ties by name."""
        required = list(dict.fromkeys(required))
        if topic:
            return self._plan_topic(required, topic)
        if len(required) == 1:
            return required[0], []
        best = None
        for root in [*sorted(required), *sorted(set(self.next) - set(required))]:
            if best and root not in required:
                break  # a view that is not asked for is base only if no other can be
            tree = self._tree(root, required)
            if tree is not None:
                total = sum(WEIGHT[e.relationship] for e in tree)
                if best is None or total < best[0]:
                    best = total, root, tree
        if not best:
            raise JoinError(f"There is no join path between the views {', '.join(sorted(required))}")
        return best[1], best[2]

    def plan_from(self, root: str, required: list[str]) -> list[Edge]:
        """Joins from a given root to all required views."""
        tree = self._tree(root, required)
        if tree is None:
            raise JoinError(f"There is no join path from view {root} to {', '.join(sorted(set(required)))}")
        return tree

    def _tree(self, root: str, required: list[str]) -> list[Edge] | None:
        """Joins from root to all required views: the nearest next, by a shortest path from any view joined so far."""
        joined, out = {root}, []
        left = set(required) - joined
        while left:
            cost, back = self._shortest(joined)
            if not all(v in cost for v in left):
                return None
            v = min(left, key=lambda v: (cost[v], v))
            path = []
            while v not in joined:
                path.append(self.edges[back[v], v])
                v = back[v]
            out += reversed(path)
            joined |= {e.right for e in path}
            left -= joined
        return out

    def _shortest(self, roots: set[str], allowed: set[str] | None = None) -> tuple[dict[str, int], dict[str, str]]:
        cost, back, heap = dict.fromkeys(roots, 0), {}, [(0, r) for r in sorted(roots)]
        while heap:
            c, v = heapq.heappop(heap)
            if c > cost[v]:
                continue
            for n in self.next[v]:
                d = c + WEIGHT[self.edges[v, n].relationship]
                if d < cost.get(n, 1 << 30) and (allowed is None or n in allowed):
                    cost[n], back[n] = d, v
                    heapq.heappush(heap, (d, n))
        return cost, back

    def _plan_topic(self, required: list[str], topic: Topic) -> tuple[str, list[Edge]]:
        missing = [v for v in required if v not in topic.views()]
        if missing:
            raise JoinError(f"views {', '.join(missing)} are not in topic {topic.label}", "topic")
        edges: dict[str, Edge] = {}
        needs: dict[str, set[str]] = {}
        todo = [v for v in required if v != topic.base]
        while todo:
            v = todo.pop()
            if v in edges:
                continue
            override = topic.joins[v].get("join")
            if override:
                edges[v] = Edge(topic.base, v, override["sql_on"], override.get("relationship", "many_to_one"), HOW.get(override.get("join_type", "left_outer"), "left"))
            else:
                plain = {u for u in topic.views() if not (topic.joins.get(u) or {}).get("from")}
                _, back = self._shortest({topic.base}, plain | {v})
                if v not in back:
                    raise JoinError(f"topic {topic.label} has no join for view {v}", "topic")
                edges[v] = self.edges[back[v], v]
            needs[v] = {r.split(".")[0].lower() for r in REFERENCE.findall(edges[v].on) if "." in r} | {edges[v].left}
            needs[v] -= {v, topic.base}
            todo += needs[v]
        order: list[Edge] = []
        done: set[str] = set()
        while len(done) < len(edges):
            ready = sorted(v for v in edges if v not in done and needs[v] <= done)
            if not ready:
                raise JoinError(f"the joins of topic {topic.label} depend on each other", "topic")
            done.add(ready[0])
            order.append(edges[ready[0]])
        return topic.base, order


def functional_key(base: str, joins: list[Edge]) -> str | None:
    """The view whose rows no join repeats, the base if it is one; None if there is none.

    A join repeats the rows of everything on its one-side. So a view is repeated by a join that lies between it and
    some other view if that join, seen from the view outward, leads from one row to many.
    """
    outward: dict[str, list[tuple[str, str]]] = {base: []}  # view -> (neighbour, relationship seen from the view)
    for e in joins:
        outward.setdefault(e.right, []).append((e.left, INVERSE[e.relationship]))
        outward[e.left].append((e.right, e.relationship))

    def repeated(view: str, came_from: str | None = None) -> bool:
        return any(kind.endswith("to_many") or repeated(other, view) for other, kind in outward[view] if other != came_from)

    return next((v for v in outward if not repeated(v)), None)


def protected_views(base: str, joins: list[Edge], topic: Topic | None) -> set[str] | None:
    """Views whose sums, counts and averages must be guarded against fan-out; None: all."""
    views = {base, *(e.right for e in joins)}
    if topic is None:
        key = functional_key(base, joins)
        return None if key is None else views - {key}
    fans = [e for e in joins if e.relationship == "one_to_many"]
    if len(fans) > 1 or any(e.relationship == "many_to_many" for e in joins):
        return None
    if not fans:
        return {e.right for e in joins if e.relationship == "many_to_one"}
    return views - {fans[0].right}
