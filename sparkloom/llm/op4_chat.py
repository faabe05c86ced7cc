"""Chat formatting by minimum-cost role repair.

Legal conversations follow an automaton: an optional system turn, then user and assistant in
alternation, the assistant last. Each given turn may be kept, relabelled, merged into the turn before it, or
preceded by an inserted empty turn, each at a cost; dynamic programming over the automaton's states
finds the cheapest repair, and the repaired turns are rendered.

Rows are range-partitioned by conversation and turn and sorted, so nearly all conversations stand whole in
one partition and are repaired as the task streams through it. A turn is a min-plus matrix over the states, so
conversations of any length can be split: those at a partition's edges, and those of over `block` turns or
SEGMENT_BYTES of text, go on as segments; a segment's matrix is the product of its turns', a scan over a
conversation's few matrices gives the costs at the cuts, each segment then tells which state before it belongs to
which state after it, a scan back fixes the states at the cuts, and segments are decoded on their own. Where cuts lie
changes nothing in the result. The result has a row for each given turn; the
conversation's rendering is its rows' `rendered`, in order of `position`.

Defined cases: turns are ordered by turn (nulls first), role, text; equal turns and repeated rows are turns of their own; null or
unknown roles fit none, so any label costs a relabel; null and blank texts are turns with empty text; rows
with a null conv_id are one conversation; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import stored, table

ROLES = ("", "system", "user", "assistant")
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "developer": "system"}
#: state -> states that may follow
LEGAL = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
MERGE, RELABEL, INSERT = 1, 2, 3
BLOCK, SEGMENT_BYTES = 4096, 4 << 20
_BIG = 1 << 40
#: cost of ending in each state, and what is inserted
FINISH = {0: (_BIG, ()), 1: (2 * INSERT, (2, 3)), 2: (INSERT, (3,)), 3: (0, ())}


def role_number(role: str | None) -> int:
    """1 to 3, or 0 for none of them."""
    r = (role or "").strip().lower()
    r = ALIASES.get(r, r)
    return ROLES.index(r) if r in ROLES[1:] else 0


def _moves(role: int) -> dict[tuple[int, int], tuple[int, str, tuple[int, ...]]]:
    """(state, next state) -> (cost, action, inserted states), the cheapest; ties: keep, merge, insert."""
    best: dict[tuple[int, int], tuple[int, int, str, tuple[int, ...]]] = {}
    for p in range(4):
        for q in (1, 2, 3):
            change = RELABEL * (q != role)
            name = "relabel" if change else "keep"
            ways = []
            if q in LEGAL[p]:
                ways.append((change, 0, name, ()))
            if q == p:
                ways.append((MERGE + change, 1, "merge", ()))
            ways += [(INSERT + change, 2, f"insert+{name}", (x,)) for x in LEGAL[p] if q in LEGAL[x]]
            if ways:
                best[p, q] = min(ways)
    return {k: (v[0], v[2], v[3]) for k, v in best.items()}


MOVES = [_moves(r) for r in range(4)]
_MATRIX = np.full((4, 4, 4), _BIG, np.int64)
for _r, _m in enumerate(MOVES):
    for (_p, _q), (_c, _, _) in _m.items():
        _MATRIX[_r, _p, _q] = _c


def min_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None]).min(1), _BIG)


def segment_matrix(roles: list[int]) -> np.ndarray:
    m = np.where(np.eye(4, dtype=bool), 0, _BIG).astype(np.int64)
    for r in roles:
        m = min_plus(m, _MATRIX[r])
    return m


#: Costs of the states before the first turn.
START = (0, _BIG, _BIG, _BIG)


def forward(roles: list[int], cost: tuple[int, ...] = START) -> tuple[list[int], list[tuple[int, ...]]]:
    """Cost of each state after all turns, and for each turn and state the state before (the smallest of equally cheap ones)."""
    cost, back = list(cost), []
    for r in roles:
        new, came = [_BIG] * 4, [0] * 4
        for (p, q), (c, _, _) in MOVES[r].items():
            c += cost[p]
            if c < new[q] or c == new[q] and p < came[q]:
                new[q], came[q] = c, p
        cost = new
        back.append(tuple(came))
    return cost, back


def best_path(roles: list[int], cost: tuple[int, ...] = START, end: int | None = None) -> list[tuple[int, int, str, tuple[int, ...]]]:
    """Per turn (state, cost, action, inserted) of the cheapest way to state `end`, or to the cheapest finish; ties go to the smallest states, from the last."""
    cost, back = forward(roles, cost)
    q = min(range(4), key=lambda q: (cost[q] + FINISH[q][0], q)) if end is None else end
    out = []
    for r, came in zip(reversed(roles), reversed(back), strict=True):
        p = came[q]
        c, action, inserted = MOVES[r][p, q]
        out.append((q, c, action, inserted))
        q = p
    return out[::-1]


@functools.lru_cache(1 << 14)
def short_path(roles: tuple[int, ...]) -> list[tuple[int, int, str, tuple[int, ...]]]:
    return best_path(list(roles))


def turn_text(role: int, text: str) -> str:
    return f"<|{ROLES[role]}|>\n{text}\n"


def decoded(path, texts: list, final: bool) -> tuple[list[str], list[int]]:
    """What each turn of a path renders as, and its cost; `final`: the conversation ends here."""
    rendered = ["".join(turn_text(x, "") for x in inserted) + (f"{text or ''}\n" if action == "merge" else turn_text(state, text or "")) for (state, _, action, inserted), text in zip(path, texts, strict=True)]
    costs = [x[1] for x in path]
    if final:
        cost, inserted = FINISH[path[-1][0]]
        rendered[-1] += "".join(turn_text(x, "") for x in inserted)
        costs[-1] += cost
    return rendered, costs


RESULT = "conv_id long, position long, turn long, action string, role string, cost long, rendered string"
_ROWS = pa.schema([
    *(pa.field(n, pa.int64()) for n in ("conv_id", "position", "turn")), pa.field("action", pa.string()), pa.field("role", pa.string()), pa.field("cost", pa.int64()), pa.field("rendered", pa.string()),
    pa.field("text", pa.string()), pa.field("seg", pa.int64()), pa.field("at", pa.int32()), pa.field("number", pa.int32()), pa.field("n", pa.int64()), pa.field("m", pa.list_(pa.int64())),
])


class Segments:
    """One partition's sorted turns: whole conversations are repaired at once, others go on as segments, with their matrices."""

    def __init__(self, part: int, block: int = BLOCK):
        self.part, self.block, self.count = part, block, 0
        self.conv, self.first, self.number = None, True, 0  # the conversation, whether it may have begun before, its segments so far
        self.rows: list[tuple] = []
        self.size = 0
        self.out: list[tuple] = []
        self.held = 0

    def add(self, conv, turn, role, text) -> None:
        if self.rows and conv != self.conv:
            self.close(ended=True)
            self.first, self.number = False, 0
        elif len(self.rows) >= self.block or self.size >= SEGMENT_BYTES:
            self.close(ended=False)
        self.conv = conv
        self.rows.append((turn, text, role_number(role)))
        self.size += len(text or "")

    def close(self, ended: bool) -> None:
        rows, conv = self.rows, self.conv
        roles, texts = [r[2] for r in rows], [r[1] for r in rows]
        if ended and not self.first and not self.number:
            path = short_path(tuple(roles)) if len(roles) <= 32 else best_path(roles)
            rendered, costs = decoded(path, texts, True)
            self.out += [(conv, i, r[0], x[2], ROLES[x[0]], c, t, *[None] * 6) for i, (r, x, c, t) in enumerate(zip(rows, path, costs, rendered, strict=True))]
        else:
            seg, m = (self.part << 32) + self.count, segment_matrix(roles).reshape(-1).tolist()
            self.count += 1
            self.out += [(conv, None, r[0], None, None, None, None, r[1], seg, i, r[2], None if i else len(rows), None if i else m) for i, r in enumerate(rows)]
        self.number += 1
        self.held += self.size
        self.rows, self.size = [], 0

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.out, strict=True))
        self.out, self.held = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ROWS, strict=True)], schema=_ROWS)


def _segments(batches, block: int):
    segments = Segments(TaskContext.get().partitionId(), block)
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            segments.add(*row)
            if len(segments.out) >= 4096 or segments.held >= SEGMENT_BYTES:
                yield segments.batch()
    if segments.rows:
        segments.close(ended=False)  # the next partition may go on with it
    if segments.out:
        yield segments.batch()


def repair(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, position, turn, action, role, cost, rendered: a row for each given turn."""
    spark = turns.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    order = ["conv_id", "turn", "role", "text"]
    rows = turns.select(*order).repartitionByRange(parts, *order, F.rand(4)).sortWithinPartitions(*order)
    schema = f"{RESULT}, text string, seg long, at int, number int, n long, m array<long>"
    rows = stored(rows.mapInArrow(lambda it: _segments(it, block), schema))
    pending = rows.where("seg is not null").select("conv_id", "turn", "text", "seg", "at", "number")
    segments = rows.where("m is not null").select("conv_id", "seg", "n", "m")

    def prefixes(key, pdf):
        """Costs of the states at the beginning of each segment of a conversation; at its last one also the state that finishes it."""
        pdf = pdf.sort_values("seg")
        cost, costs = np.array(START, np.int64), []
        for m in pdf["m"]:
            costs.append(cost.tolist())
            cost = np.minimum((cost[:, None] + np.array(m, np.int64).reshape(4, 4)).min(0), _BIG)
        finish = int((cost + [FINISH[q][0] for q in range(4)]).argmin())
        offset = np.concatenate(([0], np.cumsum(pdf["n"].to_numpy())[:-1]))
        last = [None] * (len(pdf) - 1) + [finish]
        return pd.DataFrame({"s": pdf["seg"].to_numpy(), "c": pd.array([key[0]] * len(pdf), "Int64"), "costs": costs, "offset": offset, "finish": pd.array(last, "Int64")})

    cuts = stored(segments.groupBy("conv_id").applyInPandas(prefixes, "s long, c long, costs array<long>, offset long, finish long"))

    def entries(key, pdf):
        """The state before the segment for each state after it."""
        pdf = pdf.sort_values("at")
        _, back = forward(pdf["number"].tolist(), pdf["costs"].iloc[0])
        states = list(range(4))
        for came in reversed(back):
            states = [came[q] for q in states]
        return pd.DataFrame({"seg": [key[0]], "entry": [states]})

    numbers = pending.select("seg", "at", "number").join(cuts.select("s", "costs"), F.col("seg") == F.col("s"))
    entry = numbers.groupBy("seg").applyInPandas(entries, "seg long, entry array<int>")

    def ends(key, pdf):
        """The state after each segment of a conversation, from its last one back."""
        pdf = pdf.sort_values("s")
        state, out = int(pdf["finish"].iloc[-1]), []
        for e in reversed(pdf["entry"].tolist()):
            out.append(state)
            state = int(e[state])
        return pd.DataFrame({"e": pdf["s"].to_numpy(), "end": out[::-1]})

    ended = cuts.join(entry, F.col("s") == F.col("seg")).groupBy("c").applyInPandas(ends, "e long, end int")
    fixed = cuts.join(ended, F.col("s") == F.col("e")).select("s", "costs", "offset", "end", F.col("finish").isNotNull().alias("final"))

    def decode(key, pdf):
        pdf = pdf.sort_values("at")
        first = pdf.iloc[0]
        path = best_path(pdf["number"].tolist(), first["costs"], int(first["end"]))
        rendered, costs = decoded(path, [t if isinstance(t, str) else "" for t in pdf["text"]], bool(first["final"]))
        columns = {"conv_id": pdf["conv_id"].astype("Int64").array, "position": pdf["at"].to_numpy() + int(first["offset"]), "turn": pdf["turn"].astype("Int64").array}
        return pd.DataFrame({**columns, "action": [x[2] for x in path], "role": [ROLES[x[0]] for x in path], "cost": costs, "rendered": rendered})

    rest = pending.join(fixed, F.col("seg") == F.col("s")).drop("s").groupBy("seg").applyInPandas(decode, RESULT)
    return rows.where("seg is null").select("conv_id", "position", "turn", "action", "role", "cost", "rendered").unionByName(rest)


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))
