"""Main-text extraction with a tree-structured graphical model over the DOM.

Nodes are block-level elements and runs of text (inline markup belongs to its run). Each node has
a unary potential from its features and a parent-child potential with its parent; sum-product
messages pass upward, then downward, and give every run's exact marginal of being content. Runs of
over one half are the main text's blocks, in page order. What follows a heading such as "Comments" or "Related
articles", up to the next heading of its rank, is marked as such for the features. Potentials are trained on generated, labelled
pages by maximum likelihood, as the marginals give exact gradients on trees.

Scripts, styles, title, comments and other markup never become runs; head and body may be left out, and elements
such as svg that the page never closes hide nothing. Character references are
decoded, white space in a block becomes one space, blocks are trimmed and joined by an empty line; nothing else
is dropped or cut, and whole pages are read.

Defined cases: null and empty html gives empty text; broken markup (unclosed, crossed or cut tags, stray '<')
is repaired as browsers do in outline; pages without any block over one half give empty text; repeated rows and
null page_ids give a row each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm.common import row_groups, table, text_buffers

_BLOCK = frozenset("address article aside blockquote body button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead tr ul".split())
_HIDDEN = frozenset("script style noscript template iframe object svg math title textarea select noframes audio video canvas".split())
#: Tags that end an open svg or math, as in browsers.
_BREAKS_OUT = frozenset("b big blockquote body br center code dd div dl dt em h1 h2 h3 h4 h5 h6 head hr i img li menu nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
_HEADING = re.compile(r"h[1-6]")
#: Headings of what is not the article.
_ASIDE_HEADING = re.compile(
    r"\W*(?:\d+ )?(?:(?:reader|user|your|all|recent|latest|related|popular|more|other|similar|recommended|top) )*"
    r"(?:comments?|responses?|repl(?:y|ies)|discussion|related|articles?|posts?|stories|links?|reading|share(?: this)?|follow us|newsletter|subscribe|sign up|log ?in|advertisements?|sponsored|tags|categories|archives?|leave a (?:reply|comment)|(?:join|add to) the (?:conversation|discussion)|you (?:may|might) also like|read (?:more|next)|what others say)"
    r"\W*(?:\d+\W*)?",
    re.I,
)
_RAW = frozenset("script style title textarea iframe noframes noscript".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}
#: A quote opens a string only as the first character of a value; one that no other closes is plain.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[ \t\n\f\r/]++|[^ \t\n\f\r/>][^ \t\n\f\r/>=]*+(?:[ \t\n\f\r]*+=[ \t\n\f\r]*+(?:"[^"]*+"|'[^']*+'|[^ \t\n\f\r>"'][^ \t\n\f\r>]*+|(?=>)))?+)*+)>""")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_AGAINST = re.compile(r"nav|menu|header|foot|side|\bads?\b|\bad[-_]|advert|sponsor|banner|cookie|consent|notice|alert|promo|comment|disqus|repl(?:y|ies)|share|social|related|recommend|widget|popup|modal|form|login|sign|subscri|newsletter|breadcrumb|pager|pagination|toolbar|copyright|legal")
_FOR = re.compile(r"article|content|post|entry|main|story|text|body")
_TAGS = ("nav", "header", "footer", "aside", "form", "article", "main", "section", "div", "p", "li", "ul", "ol", "h1", "h2", "h3", "td", "blockquote", "pre", "button", "label", "dd", "figure", "dialog", "table", "#run")
_TAG_AT = {t: i for i, t in enumerate(_TAGS)}
_FEATURES = len(_TAGS) + 15


class Node:
    __slots__ = ("tag", "names", "parent", "text", "linked", "total", "links", "aside")

    def __init__(self, tag: str, names: str, parent: int, text: str = "", linked: int = 0):
        self.tag, self.names, self.parent, self.text, self.linked = tag, names, parent, text, linked
        self.total = self.links = 0
        self.aside = False


def _letter(c: str) -> bool:
    """Only ASCII letters begin a tag's name; before any other, '<' is text and '</' a comment."""
    return c.isascii() and c.isalpha()


def parse(page: str) -> list[Node]:
    """Nodes in page order, parents before children; runs have the tag '#run'."""
    nodes = [Node("html", "", -1)]
    stack = [0]  # open block elements
    hidden: list[str] = []
    run: list[str] = []
    linked = link = 0

    def close_run():
        nonlocal linked
        text = " ".join(entities.unescape("".join(run)).split()) if run else ""
        if text:
            nodes.append(Node("#run", "", stack[-1], text, min(linked, len(text))))
        run.clear()
        linked = 0

    def pop_to(depth: int):
        nonlocal link
        close_run()
        del stack[depth:]
        link = 0

    @functools.cache
    def last_close(tag: str) -> int:
        return lower().rfind(f"</{tag}")

    @functools.cache
    def lower() -> str:
        return page.lower() if page.isascii() else re.sub("[A-Z]+", lambda m: m[0].lower(), page)  # offsets stay

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at and not hidden:
            run.append(page[at:lt])
            if link:
                linked += lt - at
        if lt >= n:
            break
        nxt = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if nxt in ("!", "?") or (nxt == "/" and not _letter(page[lt + 2 : lt + 3])):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        if not (_letter(nxt) or nxt == "/"):
            if not hidden:
                run.append("<")
            at = lt + 1
            continue
        m = _TAG.match(page, lt) or _PLAIN_TAG.match(page, lt)
        if not m:
            break  # a tag that the page's end cuts
        at = m.end()
        closing, tag, rest = m[1], m[2].lower(), m[3]
        if hidden:
            if closing and tag in hidden:
                while hidden.pop() != tag:
                    pass
                continue
            if not closing and hidden[-1] in ("svg", "math") and tag in _BREAKS_OUT:
                while hidden and hidden[-1] in ("svg", "math"):
                    hidden.pop()
            elif not closing and tag in _HIDDEN and not rest.endswith("/") and last_close(tag) >= at:
                hidden.append(tag)
            if hidden:
                continue
        if closing:
            if tag == "a":
                link = 0
            elif tag in _BLOCK:
                for depth in range(len(stack) - 1, 0, -1):
                    if nodes[stack[depth]].tag == tag:
                        pop_to(depth)
                        break
            continue
        if tag in _HIDDEN:
            if tag in _RAW:
                end = re.compile(f"</{tag}\\b[^>]*>?", re.I).search(page, at)
                at = end.end() if end else n
                run.append(" ")
            elif not rest.endswith("/") and last_close(tag) >= at:  # what is never closed hides nothing
                hidden.append(tag)
            continue
        if tag == "br":
            run.append(" ")
        elif tag == "a":
            link = 1
        elif tag == "hr":
            close_run()
        elif tag in _BLOCK and tag not in ("html", "body"):
            close_run()
            link = 0
            if nodes[stack[-1]].tag == "p" and tag not in ("button", "label"):
                stack.pop()
            if tag in _SAME:
                for depth in range(len(stack) - 1, 0, -1):
                    t = nodes[stack[depth]].tag
                    if t == tag or (tag in ("td", "th") and t in ("td", "th")) or (tag in ("dt", "dd") and t in ("dt", "dd")):
                        del stack[depth:]
                        break
                    if t in _SAME[tag]:
                        break
            names = " ".join(x or y or z for x, y, z in _NAMES.findall(rest)).lower() if "=" in rest else ""
            nodes.append(Node(tag, names, stack[-1]))
            if tag not in _VOID and not rest.endswith("/"):
                stack.append(len(nodes) - 1)
    close_run()
    mark_asides(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        x = nodes[i]
        if x.tag == "#run":
            x.total, x.links = len(x.text), x.linked
        if x.parent >= 0:
            nodes[x.parent].total += x.total
            nodes[x.parent].links += x.links
    return nodes


def mark_asides(nodes: list[Node]) -> None:
    """Set `aside` on headings such as "Comments", and on what follows up to the next heading of the same or a higher rank."""
    under = 9  # the rank of the last such heading; 9: none
    for x in nodes:
        if x.tag == "#run" and _HEADING.fullmatch(nodes[x.parent].tag):
            rank = int(nodes[x.parent].tag[1])
            if _ASIDE_HEADING.fullmatch(x.text):
                under = min(under, rank)
                nodes[x.parent].aside = True
            elif rank <= under:
                under = 9
                nodes[x.parent].aside = False
        x.aside = under < 9


def features(nodes: list[Node]) -> np.ndarray:
    out = np.zeros((len(nodes), _FEATURES))
    f = len(_TAGS)
    for i, x in enumerate(nodes):
        if x.tag in _TAG_AT:
            out[i, _TAG_AT[x.tag]] = 1
        share = x.links / x.total if x.total else 0
        out[i, f : f + 9] = 1, bool(_AGAINST.search(x.names)), bool(_FOR.search(x.names)), share > 0.5, 0.1 < share <= 0.5, x.total < 25, 25 <= x.total < 100, x.total >= 400, x.total == 0
        out[i, f + 13] = x.aside
        if x.tag == "#run":
            tag = nodes[x.parent].tag
            out[i, f + 14] = tag in ("html", "body", "div", "article", "main", "section")
            out[i, f + 9 : f + 13] = tag == "p", tag in ("li", "td", "dd"), tag[:1] == "h" and tag[1:].isdigit(), x.text[-1] in ".!?:;\"'»"
    return out


class Forest:
    """The trees of several pages, level by level, for message passing in numpy."""

    def __init__(self, pages: list[list[Node]]):
        start = np.cumsum([0] + [len(x) for x in pages])
        self.pages = [slice(a, b) for a, b in zip(start, start[1:], strict=False)]
        self.parent = np.array([x.parent + int(a) if x.parent >= 0 else -1 for a, nodes in zip(start, pages, strict=False) for x in nodes], int)
        depth = np.zeros(len(self.parent), int)
        for i, q in enumerate(self.parent.tolist()):
            if q >= 0:
                depth[i] = depth[q] + 1
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.searchsorted(depth[order], np.arange(1, depth.max() + 1)))[1:] if len(depth) else []

    def marginals(self, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum-product up, then down: probability of content of each node, and the sum of all pairs' joint marginals.

        unary: log odds; pair[parent label, child label]: log potentials.
        """
        up = np.stack((np.zeros(len(unary)), unary), 1)
        message = np.zeros_like(up)
        lse = lambda z, axis: np.logaddexp.reduce(z, axis=axis)
        for level in reversed(self.levels):
            message[level] = lse(up[level][:, None, :] + pair[None], 2)
            np.add.at(up, self.parent[level], message[level])
        belief, joint = up.copy(), np.zeros((2, 2))
        for level in self.levels:
            cavity = belief[self.parent[level]] - message[level]
            both = cavity[:, :, None] + pair[None] + up[level][:, None, :]
            both = np.exp(both - lse(lse(both, 2), 1)[:, None, None])
            joint += both.sum(0)
            belief[level] += lse(cavity[:, :, None] + pair[None], 1)
            belief[level] -= belief[level].max(1, keepdims=True)
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), joint


def _page(g: random.Random) -> str:
    """A generated page; content runs are marked by a first word 'zz'. No other word has a z."""
    w = lambda n: " ".join("".join(g.choice("aeinorst") for _ in range(g.randint(2, 8))) for _ in range(n))
    links = lambda n, tag="li": "".join(f'<{tag}><a href="/{w(1)}">{w(g.randint(1, 3))}</a></{tag}>' for _ in range(n))
    named = lambda tags, names: (t := g.choice(tags), f'<{t} {g.choice(("class", "id"))}="{g.choice(names)}">', f"</{t}>")[1:]
    few = lambda: f"<p>{w(g.randint(3, 20))}.</p>" * g.randint(1, 2)

    def box(tags, names, body):
        a, b = named(tags, names)
        return a + body + b

    def menu():
        return g.choice((f"<nav><ul>{links(g.randint(3, 8))}</ul></nav>", box(("div", "ul"), ("menu", "navbar", "nav-main", "breadcrumb"), links(5)), f"<nav>{links(4, 'span')}</nav>"))

    def junk():
        return g.choice((
            lambda: box(("div", "section", "aside"), ("ad", "ads", "advert", "sponsored", "banner-ad"), w(g.randint(3, 25)) + "."),
            lambda: f"<aside>{few()}<ul>{links(4)}</ul></aside>", lambda: box(("div",), ("sidebar", "widget", "related"), f"<h3>{w(2)}</h3>{few()}<ul>{links(4)}</ul>"),
            lambda: box(("div", "dialog"), ("cookie-notice", "consent", "popup", "alert", "newsletter"), few() + f"<button>{w(1)}</button>"),
            lambda: f"<form><label>{w(2)}</label><input><button>{w(1)}</button></form>", lambda: box(("div",), ("share", "social"), links(3, "span")), menu,
        ))()

    def good():
        z = lambda n: "zz " + w(n)
        return g.choice((
            lambda: f"<p>{z(g.randint(8, 120))}.</p>", lambda: f"<p>{z(g.randint(8, 120))}.", lambda: f"<p><b>{z(g.randint(4, 40))}.<br>", lambda: f"<p>{z(g.randint(8, 60))} <a href=x>{w(2)}</a> {w(9)}.</p>", lambda: f"<p>{z(g.randint(1, 6))}.</p>", lambda: f"<p>zz.</p>" if g.random() < 0.3 else f"<p>{z(g.randint(0, 3))}.</p>",
            lambda: f"<h2>{z(g.randint(1, 8))}</h2><p>{z(30)}.</p>", lambda: "<ul>" + "".join(f"<li>{z(g.randint(3, 15))}</li>" for _ in range(3)) + "</ul>", lambda: f"<blockquote>{z(20)}.</blockquote>", lambda: f"<pre>{z(12)}</pre>",
            lambda: f"<table><tr><td>{z(3)}</td><td>{z(4)}</td></tr></table>",
        ))()

    def untold():
        """Comments or links that only a heading names."""
        title = g.choice(("Comments", "3 Comments", "Comments (12)", "Reader comments", "Responses", "Leave a reply", "Discussion", "Related articles", "You may also like", "More stories"))
        said = "".join(f"<p>{w(g.randint(2, 60))}.</p>" for _ in range(g.randint(1, 5)))
        inner = g.choice((said, f"<div>{said}</div>", "<ul>" + "".join(f"<li>{w(g.randint(3, 30))}.</li>" for _ in range(3)) + "</ul>", f"<ul>{links(4)}</ul>"))
        a, b = g.choice((("", ""), ("<div>", "</div>"), ("<section>", "</section>")))
        return f"{a}<{(h := g.choice(('h2', 'h3', 'h4')))}>{title}</{h}>{inner}{b}"

    body = [*([f"<h1>zz {w(g.randint(2, 12))}</h1>"] if g.random() < 0.75 else []), *(good() for _ in range(g.randint(1, 12)))]
    plain = g.choice((("<article>", "</article>"), ("<div>", "</div>"), ("<main>", "</main>"), ("", ""), ("<div><div>", "</div></div>"), ("<section>", "</section>")))
    if g.random() < 0.25:  # a page of little else than a few paragraphs
        few_good = "".join(f"<p>zz{' ' * (k > 0)}{w(k)}{g.choice(('.', '', '!'))}</p>" for k in (g.choice((0, 1, 3, 8, 16, 30)) for _ in range(g.randint(1, 4))))
        return f"<html><head><title>{w(3)}</title></head><body>{g.choice(('', menu()))}{plain[0]}{few_good}{plain[1]}{untold() if g.random() < 0.3 else ''}</body></html>"
    if g.random() < 0.35:
        body.insert(g.randint(1, len(body)), junk())
    wrap = g.choice((("<article>", "</article>"), ("<main>", "</main>"), ('<main><article class="post">', "</article></main>"), ('<div class="content">', "</div>"), ('<div id="main"><div>', "</div></div>"), ("<div>", "</div>"), ('<section class="entry">', "</section>"), ("<article>", ""), ("<article>", ""), ("", "")))
    comments = box(("div", "section"), ("comments", "comment-list", "disqus"), "".join(f'<div class="comment"><p>{w(g.randint(3, 60))}.</p></div>' for _ in range(3)))
    head = g.choice((f"<header><h2>{w(2)}</h2>{menu()}</header>", box(("div",), ("header", "site-header"), w(3)), menu(), ""))
    foot = g.choice((f"<footer>&copy; {w(2)} &middot; {w(g.randint(2, 30))}.</footer>", box(("div",), ("footer", "copyright"), w(8) + "." + links(3, "span")), f"<footer><p>{w(12)}</p><ul>{links(4)}</ul></footer>"))
    parts = [head, *(junk() for _ in range(g.randint(0, 2))), wrap[0] + "".join(body) + wrap[1], *([comments] if g.random() < 0.3 else []), *([untold()] if g.random() < 0.3 else []), *(junk() for _ in range(g.randint(0, 2))), foot]
    return f"<!DOCTYPE html><html><head><title>{w(4)}</title><style>p{{}}</style></head><body>{''.join(parts)}</body></html>"


@functools.lru_cache(1)
def potentials(seed: int = 2, pages: int = 250, steps: int = 250, penalty: float = 2e-5) -> tuple[np.ndarray, np.ndarray]:
    """Unary weights and the parent-child potential: maximum likelihood on generated pages, by exact gradients from the marginals.

    An element is content if any run in it is.
    """
    g = random.Random(seed)
    trees = [parse(_page(g)) for _ in range(pages)]
    forest, nodes = Forest(trees), [x for t in trees for x in t]
    x, y = np.vstack([features(t) for t in trees]), np.array([n.text.startswith("zz") for n in nodes], int)
    for level in reversed(forest.levels):
        np.maximum.at(y, forest.parent[level], y[level])
    inner = forest.parent >= 0
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[forest.parent[inner]], y[inner]), 1)
    w, pair = np.zeros(x.shape[1]), np.zeros((2, 2))
    v, u = np.zeros_like(w), np.zeros_like(pair)
    for _ in range(steps):
        p, joint = forest.marginals(x @ w, pair)
        v = 0.9 * v + x.T @ (y - p) / len(x) - penalty * w
        u = 0.9 * u + (seen - joint) / len(x) - penalty * pair
        w, pair = w + 0.7 * v, pair + 0.7 * u
    return w, pair


def main_blocks(pages: list[str], model: tuple[np.ndarray, np.ndarray] | None = None) -> list[list[str]]:
    """The main text's blocks of each page."""
    w, pair = model or potentials()
    trees = [parse(p) for p in pages]
    if not trees:
        return []
    forest = Forest(trees)
    p, _ = forest.marginals(np.vstack([features(t) for t in trees]) @ w, pair)
    return [[x.text for x, q in zip(t, p[at], strict=True) if x.tag == "#run" and q > 0.5] for t, at in zip(trees, forest.pages, strict=True)]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars. Pages are handled GROUP_BYTES at a time."""
    model = potentials()  # trained once, on the driver

    def run(batches):
        for batch in batches:
            _, offsets = text_buffers(batch.column(2))
            texts = []
            for lo, hi in row_groups(offsets):
                texts += ["\n\n".join(x) for x in main_blocks([h or "" for h in batch.column(2).slice(lo, hi - lo).to_pylist()], model)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
