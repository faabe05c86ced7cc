"""Personal data: exact base patterns, and a skip-chain conditional random field that adds spans.

Base spans follow fixed patterns. The field's nodes are a text's tokens that hold a digit or '@'. Successive
nodes that are close are chained; all nodes of one normal form (letters and digits in lower case),
at whatever distance, are joined with a node of their form, so repetitions of a token share
potentials across the document, and what one shows reaches all others in two steps. Loopy sum-product
on log messages runs until they settle, at most ROUNDS sweeps; labels whose marginal is at least SURE
become spans where no base span lies. Potentials (node features, chain and skip label pairs) are trained
once, on the driver, by pseudo-likelihood on generated, labelled lines; base matches are features of the nodes.

Defined cases: null and empty texts have no spans; texts without digit and '@' are passed over,
as no pattern or node is possible; very long texts are handled whole, with two edges a node at most;
digit runs of any length are fine; repeated rows and null doc_ids give a row each; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm.common import release_memory, table

KINDS = ("email", "ip", "card", "phone", "secret")
LABELS = ("none", *KINDS)
ROUNDS, SURE, NEAR = 60, 0.95, 2
#: Messages have settled when none changes by more than this.
SETTLED = 1e-3
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"\S+")
_SIGNIFICANT = re.compile(r"[^a-z0-9]+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The fixed patterns' matches, by kind as listed, then by start."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        # the leftmost start is the beginning of the run of local characters before '@'
        begin = at
        while begin > free and _LOCAL.match(text, begin - 1):
            begin -= 1
        m = _DOMAIN.match(text, at) if begin < at else None
        if m:
            out.append(("email", begin, m.end()))
            free = m.end()
        else:
            free = at + 1  # no later match holds this '@'
        at = text.find("@", free)
    if any(c in text for c in "0123456789"):
        for m in _IP.finditer(text):
            parts = [x.lstrip("0") for x in m[0].split(".")]
            if all(len(x) < 3 or len(x) == 3 and int(x) <= 255 for x in parts):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            d = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


# ------------------------------------------------------------------ the field

_CUES = ("password", "passwd", "token", "key", "secret", "mail", "phone", "tel", "card", "ip", "version", "page", "no", "=")
_TRIM = "\"'`.,;:!?#$%&*()[]{}<>|"


def _pieces(text: str) -> list[tuple[int, int, str, str]]:
    """Nodes: start, end, the token, and the two words before it."""
    out, before = [], ("", "")
    for m in _TOKEN.finditer(text):
        raw = m[0]
        if _ANY.search(raw):
            begin, end, context = m.start(), m.end(), " ".join(before)
            cut = raw.find("=")
            if 0 < cut < len(raw) - 1:  # name=value
                begin, context = begin + cut + 1, f"{context} {raw[: cut + 1]}"
            body = text[begin:end]
            begin += len(body) - len(body.lstrip(_TRIM))
            body = body.strip(_TRIM)
            if body:
                out.append((begin, begin + len(body), body, context))
        before = (before[1], raw if len(raw) < 64 else raw[:64])
    return out


def _features(body: str, context: str, base: int) -> np.ndarray:
    d = sum(c.isdigit() for c in body)
    a = sum(c.isalpha() for c in body)
    n = len(body)
    context = context.lower()
    x = [1.0, *(base == k for k in range(len(KINDS))), "@" in body, body.count(".") == 3, d == n, d and a and d + a == n, bool(re.fullmatch(r"[0-9a-fA-F]{12,}", body)) and a > 0, bool(re.fullmatch(r"[A-Z0-9]{16,}", body)) and a > 0]
    x += [n >= 16, 8 <= n < 16, n < 5, d >= 13, 7 <= d < 13, d < 7, body[:1] == "+", "-" in body, d == n and 13 <= n <= 19 and body.isascii() and luhn(body)]
    x += [c in context for c in _CUES]
    return np.array(x, float)


def _edges(nodes: list[tuple[int, int, str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Chain edges as pairs (earlier, later), and skip edges as pairs (node, form); forms that occur again are numbered after the nodes."""
    chain = [(i - 1, i) for i in range(1, len(nodes)) if nodes[i][0] - nodes[i - 1][1] <= NEAR]
    places: dict[str, list[int]] = {}
    for i, x in enumerate(nodes):
        form = _SIGNIFICANT.sub("", x[2].lower())
        if len(form) >= 6:
            places.setdefault(form, []).append(i)
    again = [p for p in places.values() if len(p) > 1]
    skip = [(i, len(nodes) + k) for k, p in enumerate(again) for i in p]
    return np.array(chain, int).reshape(-1, 2), np.array(skip, int).reshape(-1, 2)


def _base_of(nodes, spans) -> list[int]:
    """The kind of the base span that a node overlaps, else -1."""
    out = [-1] * len(nodes)
    order = sorted((s, e, KINDS.index(k)) for k, s, e in spans)
    at = 0
    for i, x in enumerate(nodes):
        while at < len(order) and order[at][1] <= x[0]:
            at += 1
        out[i] = next((k for s, e, k in order[at : at + len(KINDS)] if s < x[1] and e > x[0]), -1)
    return out


def _lines(seed: int, n: int):
    """Generated training lines: text, and [(start, end, label)] of all tokens that are personal data or secrets."""
    g = random.Random(seed)
    digits = lambda k: "".join(g.choice("0123456789") for _ in range(k))
    word = lambda: "".join(g.choice("abcdeghilmnorstuv") for _ in range(g.randint(2, 8)))

    def card() -> str:
        d = digits(15)
        return next(d + c for c in "0123456789" if luhn(d + c))

    def no_card() -> str:
        d = digits(g.randint(12, 18))
        return next(d + c for c in g.sample("0123456789", 2) if not luhn(d + c))

    hexa = lambda: "".join(g.choice("0123456789abcdef") for _ in range(g.randint(16, 40)))
    code = lambda: "".join(g.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(g.randint(16, 24)))
    make = {
        "email": lambda: f"{word()}.{digits(2)}@{word()}{g.randint(1, 9)}.example.{g.choice(('com', 'org'))}",
        "ip": lambda: ".".join(str(g.randint(0, 255)) for _ in range(4)),
        "card": card,
        "phone": lambda: f"+{g.randint(1, 9)} ({digits(3)}) {digits(3)}-{digits(4)}",
    }
    for _ in range(n):
        parts, marks, at, known = [], [], 0, []

        def put(s: str, label: str | None = None, kept: str | None = None):
            nonlocal at
            if label:
                b = at + s.index(kept or s)
                marks.append((b, b + len(kept or s), label))
            parts.append(s)
            at += len(s) + 1

        for _ in range(g.randint(4, 16)):
            r = g.random()
            if r < 0.35:
                put(word())
            elif r < 0.55:
                kind = g.choice(tuple(make))
                put(v := make[kind](), kind)
                known.append((kind, v))
            elif r < 0.7:
                v = hexa() if g.random() < 0.6 else code() + g.choice("234567")
                v = v if any(c.isdigit() for c in v) else v + "7"
                form = g.choice(("{}=%s", '{} = "%s"', "{}: %s")).format(g.choice(("password", "token", "api_key", "secret", "passwd")))
                for s in (form % v).split():
                    put(s, "secret" if v in s else None, v if v in s else None)
                known.append(("secret", v))
            elif r < 0.78 and known:  # said again, somewhat differently
                kind, v = g.choice(known)
                v = v.upper() if kind == "email" and g.random() < 0.5 else v
                put(v, kind)
            elif r < 0.84:
                put(v := code() + "7A", "secret")
                known.append(("secret", v))
            else:
                put(g.choice((no_card(), digits(g.randint(1, 6)), f"{digits(1)}.{digits(1)}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"{word()}{digits(2)}", digits(g.randint(1, 3)) + ",", f"v{digits(1)}.{digits(1)}.{digits(1)}", digits(1) + word(), "4.0.", f"@{word()}")))
        yield " ".join(parts), marks


@functools.lru_cache(1)
def potentials(seed: int = 8, lines: int = 800, steps: int = 300, penalty: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node, chain and skip weights, by pseudo-likelihood: each label given its node and its neighbours' labels."""
    xs, chains, skips, ys = [], [], [], []
    eye = np.eye(len(LABELS))
    for text, marks in _lines(seed, lines):
        nodes = _pieces(text)
        if not nodes:
            continue
        base = _base_of(nodes, base_spans(text))
        y = np.array([next((LABELS.index(k) for s, e, k in marks if s < x[1] and e > x[0]), 0) for x in nodes])
        near, far = np.zeros((2, len(nodes), len(LABELS)))
        chain, skip = _edges(nodes)
        for a, b in chain:
            near[a] += eye[y[b]]
            near[b] += eye[y[a]]
        forms: dict[int, list[int]] = {}
        for i, form in skip.tolist():
            forms.setdefault(form, []).append(i)
        for members in forms.values():  # a form's label, for each member, is that of most others
            counts = eye[y[members]].sum(0)
            for i in members:
                far[i] = eye[(counts - eye[y[i]]).argmax()]
        xs.append(np.array([_features(x[2], x[3], k) for x, k in zip(nodes, base, strict=True)]))
        chains.append(near)
        skips.append(far)
        ys.append(y)
    x = np.hstack((np.vstack(xs), np.vstack(chains), np.vstack(skips)))
    y = eye[np.concatenate(ys)]
    w, v = np.zeros((2, x.shape[1], len(LABELS)))
    f, k = x.shape[1] - 2 * len(LABELS), len(LABELS)
    for _ in range(steps):
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        grad = x.T @ (y - p) / len(x) - penalty * w
        for lo in (f, f + k):  # a pair's potential has no direction
            grad[lo : lo + k] = (grad[lo : lo + k] + grad[lo : lo + k].T) / 2
        v = 0.9 * v + grad
        w = w + 0.5 * v
    return w[:f], w[f : f + k], w[f + k :]


def marginals(unary: np.ndarray, edges: list[tuple[np.ndarray, np.ndarray]], rounds: int = ROUNDS, settled: float = SETTLED) -> np.ndarray:
    """Loopy sum-product. edges: (pairs, symmetric log potential) of each kind."""
    belief = unary.copy()
    messages = [np.zeros((2, len(pairs), unary.shape[1])) for pairs, _ in edges]
    norm = lambda z: z - np.logaddexp.reduce(z, axis=1, keepdims=True)
    for _ in range(rounds if any(len(p) for p, _ in edges) else 0):
        new = []
        for (pairs, pot), m in zip(edges, messages, strict=True):
            out = np.zeros_like(m)
            for way, (src, dst) in enumerate(((0, 1), (1, 0))):
                if len(pairs):
                    cavity = belief[pairs[:, src]] - m[1 - way]
                    out[way] = norm(np.logaddexp.reduce(cavity[:, :, None] + pot[None], axis=1))
            new.append(0.5 * out + 0.5 * m)
        change = max((np.abs(a - b).max() for a, b in zip(new, messages, strict=True) if a.size), default=0.0)
        messages = new
        belief = unary.copy()
        for (pairs, _), m in zip(edges, messages, strict=True):
            if len(pairs):
                np.add.at(belief, pairs[:, 1], m[0])
                np.add.at(belief, pairs[:, 0], m[1])
        if change <= settled:
            break
    return np.exp(norm(belief))


def spans_of(text: str, model: tuple | None = None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans, by kind as listed, then by start."""
    if not _ANY.search(text):
        return [], []
    base = base_spans(text)
    nodes = _pieces(text)
    if not nodes:
        return base, base
    node, chain, skip = model or potentials()
    kinds = _base_of(nodes, base)
    near, far = _edges(nodes)
    unary = np.array([_features(x[2], x[3], k) for x, k in zip(nodes, kinds, strict=True)]) @ node
    forms = np.zeros((int(far[:, 1].max()) + 1 - len(nodes) if len(far) else 0, len(LABELS)))
    p = marginals(np.vstack((unary, forms)), [(near, chain), (far, skip)])[: len(nodes)]
    added: list[tuple[str, int, int]] = []
    for x, k, q in zip(nodes, kinds, p, strict=True):
        best = int(q.argmax())
        if best and k < 0 and q[best] >= SURE:
            if added and added[-1][0] == LABELS[best] and x[0] - added[-1][2] <= NEAR and LABELS[best] in ("phone", "card") and sum(map(str.isdigit, text[added[-1][1] : x[1]])) <= 19:
                added[-1] = (LABELS[best], added[-1][1], x[1])
            else:
                added.append((LABELS[best], x[0], x[1]))
    return base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1]))


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or group of overlapping spans, as a mark."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find_pii(docs: DataFrame) -> DataFrame:
    model = potentials()

    def run(batches):
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            rows = []
            for text in batch.column(1):
                base, all_spans = spans_of(text.as_py() or "", model)
                counts = [sum(k == s[0] for s in base) for k in KINDS[:4]] if base else [0] * 4
                rows.append((*counts, hashlib.sha256(written(base).encode()).hexdigest() if base else nothing, written(all_spans)))
            if rows:
                cols = [batch.column(0), *(pa.array(x, pa.int64() if i < 4 else pa.string()) for i, x in enumerate(zip(*rows, strict=True)))]
                yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def mask_pii(docs: DataFrame) -> DataFrame:
    """docs with every span masked in `text`; n_chars, if there, is counted anew for changed texts.

    Null and empty texts stay as they are; repeated rows, null doc_ids and extra columns are kept; an empty table gives no rows.
    """
    model = potentials()

    def run(batches):
        release_memory()  # what earlier stages' tasks left
        for batch in batches:
            at = batch.schema.get_field_index("text")
            old = [x.as_py() for x in batch.column(at)]
            new = [t if t is None else masked(t, spans_of(t, model)[1]) for t in old]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.column(at).type)
            if (n := batch.schema.get_field_index("n_chars")) >= 0:
                counts = [c if a == b else len(b) for a, b, c in zip(old, new, batch.column(n).to_pylist(), strict=True)]
                columns[n] = pa.array(counts, batch.column(n).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
