"""MQL: `FROM MQL(metrics [FOR topic or view] [FUNNEL step THEN step WITHIN n unit] [BY dims] [WHERE ..] [HAVING ..] [ORDER BY ..] [LIMIT n])`."""

from __future__ import annotations

import re

from sparkloom.errors import ParseError
from sparkloom.plans.project import Project

_START = re.compile(r"\bMQL\s*\(", re.I)
_CLAUSES = ("FOR", "FUNNEL", "WITHIN", "BY", "WHERE", "HAVING", "ORDER BY", "LIMIT")
_TOKEN = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"[^\"]*\"|\(|\)|,|\bORDER\s+BY\b|\w[\w.]*|\s+|[^\w\s]", re.I)


def split_mql(sql: str) -> tuple[str, str, str] | None:
    """Text before, inside and after the first top-level MQL(...); None if there is none."""
    depth = 0
    for m in _TOKEN.finditer(sql):
        t = m[0]
        if t == "(":
            depth += 1
        elif t == ")":
            depth -= 1
        elif depth == 0 and t.upper() == "MQL" and (s := _START.match(sql, m.start())):
            inner = 1
            for n in _TOKEN.finditer(sql, s.end()):
                inner += {"(": 1, ")": -1}.get(n[0], 0)
                if inner == 0:
                    return sql[: m.start()], sql[s.end() : n.start()], sql[n.end() :]
            raise ParseError("MQL( has no closing parenthesis")
    return None


class Mql:
    def __init__(self, text: str, project: Project):
        self.project, self.parts = project, {"METRICS": ""}
        depth, clause = 0, "METRICS"
        for m in _TOKEN.finditer(text):
            word = re.sub(r"\s+", " ", m[0]).upper()
            depth += {"(": 1, ")": -1}.get(word, 0)
            if depth == 0 and word in _CLAUSES:
                if word in self.parts:
                    raise ParseError(f"MQL has two {word} clauses")
                clause = word
                self.parts[clause] = ""
            else:
                self.parts[clause] += m[0]

    @staticmethod
    def names(text: str) -> list[str]:
        return [x.strip() for x in text.split(",") if x.strip()]

    def literal(self, text: str) -> str:
        """Field names in a condition become references."""
        out = []
        for m in _TOKEN.finditer(text.strip()):
            t = m[0]
            out.append(f"${{{t}}}" if re.match(r"^[A-Za-z_][\w.]*$", t) and self.project.has_field(t) else t)
        return "".join(out)

    def request(self) -> dict:
        p = self.parts
        out: dict = {"metrics": self.names(p["METRICS"]), "dimensions": self.names(p.get("BY", ""))}
        if p.get("WHERE"):
            out["where"] = [self.literal(p["WHERE"])]
        if p.get("HAVING"):
            out["having"] = [self.literal(p["HAVING"])]
        if p.get("ORDER BY"):
            out["order_by"] = p["ORDER BY"]
        if p.get("LIMIT"):
            out["limit"] = int(p["LIMIT"])
        view = p.get("FOR", "").strip()
        if p.get("FUNNEL"):
            if "WITHIN" not in p:
                raise ParseError("a funnel needs WITHIN")
            value, unit = p["WITHIN"].split()
            out["funnel"] = {"steps": [self.literal(s) for s in re.split(r"\bTHEN\b", p["FUNNEL"], flags=re.I)], "within": {"value": int(value), "unit": unit.lower().rstrip("s")}}
            if view:
                out["funnel"]["view_name"] = view
        elif view and any(view in (t.get("name"), t.get("label")) for t in self.project.topics_data):
            out["topic"] = view
        return out
