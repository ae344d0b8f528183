"""Main-text extraction: a tree-structured graphical model over the document tree.

Every block element and every block of text is a node that is content or not. A node's own evidence (tag, class words, length, links, place) and its parent's state bear on it; sum-product messages, once up and once down the tree, give each node's exact marginal. Evidence and parent-child potentials are counted from labelled pages.
"""

from __future__ import annotations

import bisect
import functools
import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import digest, once, whole

#: HTML's element kinds.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
CELLS = frozenset(("td", "th"))
SPACES = frozenset(("br", "td", "th", "option"))
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
DROPPED = frozenset("script style noscript template svg iframe object canvas select textarea button title audio video".split())
RAW = frozenset(("script", "style", "textarea", "title"))
CLOSED_BY = {"li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr",))}
BOUNDS = {"li": frozenset(("ul", "ol", "menu", "dir")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",)), "tr": frozenset(("table",))}

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
BARE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
BEGUN = re.compile(r"<[/!a-zA-Z]")
NAMED = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.IGNORECASE)
MAYBE_HIDDEN = re.compile(r"hidden|style", re.IGNORECASE)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"?|'[^']*'?|[^\s>]+))?""")
NOT_SHOWN = re.compile(r"display\s*:\s*none", re.IGNORECASE)
CLASS_WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Tree:
    """Nodes in page order, the root first; a text block has the tag #text."""

    tag: list[str] = field(default_factory=lambda: ["#root"])
    parent: list[int] = field(default_factory=lambda: [-1])
    attrs: list[str] = field(default_factory=lambda: [""])
    text: list[str] = field(default_factory=lambda: [""])
    linked: list[int] = field(default_factory=lambda: [0])

    def add(self, tag: str, parent: int, attrs: str = "", text: str = "", linked: int = 0) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.attrs.append(attrs)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.tag) - 1


class Open:
    """The elements that are open, the root first, with where each name stands, so that none is searched for."""

    def __init__(self, tree: Tree):
        self.tree, self.nodes = tree, [0]
        self.places: dict[str, list[int]] = {}

    def push(self, node: int) -> None:
        self.places.setdefault(self.tree.tag[node], []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, depth: int) -> None:
        """Closes all from this depth on."""
        for node in self.nodes[depth:]:
            self.places[self.tree.tag[node]].pop()
        del self.nodes[depth:]

    def last(self, names: frozenset[str] | tuple[str, ...]) -> int:
        """Depth of the innermost one of these names; 0: none is open."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)


class Ends:
    """Where elements end, found for all at once when the first is asked for."""

    def __init__(self, source: str):
        self.source = source
        self.ends: dict[int, int] | None = None
        self.closings: dict[str, list[int]] = {}

    def of(self, name: str, at: int) -> int:
        """Where the element whose tag ended at `at` ends; elements of its name may stand in it, but for raw text. -1: nowhere."""
        if self.ends is None:
            self.ends, begun = {}, {}
            for m in BARE_TAG.finditer(self.source, 0, self.source.rfind(">") + 1):
                tag = m[2].lower()
                if m[1]:
                    self.closings.setdefault(tag, []).append(m.end())
                    if begun.get(tag):
                        self.ends[begun[tag].pop()] = m.end()
                else:
                    begun.setdefault(tag, []).append(m.end())
        if name in RAW:
            found = self.closings.get(name, [])
            i = bisect.bisect_right(found, at)
            return found[i] if i < len(found) else -1
        return self.ends.get(at, -1)


def parse(source: str) -> Tree:
    """The tree of block elements and text. Unclosed elements end with their parent; unknown and inline tags only pass their text on.

    Each character is looked at a bounded number of times, however broken the page: from the first comment that never ends on, comments end at the next >, and from the first tag whose quotes never end on, tags do.
    """
    tree = Tree()
    stack, ends = Open(tree), Ends(source)
    parts: list[str] = []
    linked, link_depth, at, size = 0, 0, 0, len(source)
    last, comments, quotes = source.rfind(">"), True, True

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                tree.add("#text", stack.nodes[-1], text=text, linked=min(linked, len(text)))
            parts.clear()
        linked = 0

    def said(raw: str) -> None:
        nonlocal linked
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if link_depth:
            linked += len(text)

    while at < size:
        begin = source.find("<", at)
        if begin < 0 or begin > last:
            rest = source[at:]
            cut = rest.rfind("<")
            said(rest[:cut] if cut >= 0 and BEGUN.match(rest, cut) else rest)  # an unfinished tag at the end is no text
            break
        mark = source[begin + 1]
        m = None
        if mark.isascii() and mark.isalpha() or (mark == "/" and source[begin + 2].isascii() and source[begin + 2].isalpha()):
            m = TAG.match(source, begin) if quotes else None
            if m is None:
                quotes, m = False, BARE_TAG.match(source, begin)
        elif mark not in "!?/":
            said(source[at : begin + 1])
            at = begin + 1
            continue
        if begin > at:
            said(source[at:begin])
        if m is None:
            end = -1
            if source.startswith("<!--", begin) and comments:
                end = begin + 2 if source.startswith(">", begin + 4) else source.find("-->", begin + 4)
                comments = end >= 0
            at = end + 3 if end >= 0 else source.find(">", begin) + 1
            continue
        at = m.end()
        name, closing, attrs = m[2].lower(), m[1], m[3]
        if closing:
            if name == "a":
                link_depth = 0
            elif name in BLOCKS:
                depth = stack.last((name,))
                if depth:
                    flush()
                    stack.cut(depth)
                    if link_depth > len(stack.nodes):
                        link_depth = 0
                elif name == "p":
                    flush()
            elif name in CELLS:
                parts.append(" ")
            continue
        if name in DROPPED or (attrs and name not in VOID and hidden(attrs)):
            end = ends.of(name, at)
            if end >= 0:
                at = end
            elif name in RAW:
                at = size
            if name not in BLOCKS:
                parts.append(" " if name in SPACES else "")
            continue
        if name == "a":
            link_depth = len(stack.nodes)
        elif name in BLOCKS:
            flush()
            if name in CLOSED_BY:
                depth = stack.last(CLOSED_BY[name])
                if depth > stack.last(BOUNDS[name]):
                    stack.cut(depth)
            elif tree.tag[stack.nodes[-1]] == "p":
                stack.cut(len(stack.nodes) - 1)
            node = tree.add(name, stack.nodes[-1], attrs)
            if name not in VOID:
                stack.push(node)
        elif name in SPACES:
            parts.append(" ")
    flush()
    return tree


def hidden(attrs: str) -> bool:
    """Whether an attribute of its own says so: hidden, aria-hidden or a style. Of equal names the first counts."""
    if not MAYBE_HIDDEN.search(attrs):
        return False
    first: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(attrs):
        first.setdefault(m[1].lower(), html.unescape((m[2] or "").strip("\"'")))
    return "hidden" in first or first.get("aria-hidden", "").strip().lower() == "true" or bool(NOT_SHOWN.search(first.get("style", "")))


def bucket(share: float, bounds: tuple[float, ...]) -> int:
    return sum(share >= b for b in bounds)


def class_words(attrs: str) -> dict[str, None]:
    """Words of classes and ids, each once, in order."""
    return dict.fromkeys(w for m in NAMED.finditer(attrs) for w in CLASS_WORD.findall(CAMEL.sub(" ", m[1]).lower())) if attrs else {}


@functools.cache
def beside_words() -> frozenset[str]:
    """Class words by which the templates tell what goes with an article, and never the article."""
    words = lambda specs: {w for x in specs for n in x.split(" ")[1:] for w in class_words(f' class="{n[1:] if n[0] in ".#" else n}"')}
    return frozenset(words(ABOVE + BESIDE + BELOW) - words(HOLDS))


def evidence(tree: Tree) -> list[list[tuple]]:
    """What each node shows."""
    n = len(tree.tag)
    size, linked = [len(t) for t in tree.text], list(tree.linked)
    for i in range(n - 1, 0, -1):
        size[tree.parent[i]] += size[i]
        linked[tree.parent[i]] += linked[i]
    total = max(1, size[0])
    within, aside = [False] * n, [False] * n  # of elements that are named as the article, or as what goes with it
    for i in range(1, n):
        within[i] = within[tree.parent[i]] or tree.tag[i] in ("article", "main")
        aside[i] = aside[tree.parent[i]] or tree.tag[i] in ("nav", "footer", "aside", "form") or not beside_words().isdisjoint(class_words(tree.attrs[i]))
    rest = max(1, sum(len(t) for t, a in zip(tree.text, aside, strict=True) if not a))
    mixed = {p for p, tag in zip(tree.parent, tree.tag, strict=True) if tag != "#text"}
    out: list[list[tuple]] = [[]]
    met = 0
    for i in range(1, n):
        up = tree.parent[i]
        tag = tree.tag[i]
        links = bucket(linked[i] / size[i], (0.01, 0.3, 0.7)) if size[i] else 4
        if tag == "#text":
            text = tree.text[i]
            out.append([("words", min(6, text.count(" ").bit_length())), ("of", tree.tag[up], links), ("stop", text[-1] in ".!?…\"'»”。"), ("mark", "©" in text), ("place", bucket(met / total, (0.05, 0.5, 0.9)))])
            if not aside[i]:
                out[-1].append(("share", bucket(size[i] / rest, (0.1, 0.4, 0.8))))
            if tree.tag[up] == "tr" and up in mixed:  # a cell beside cells that hold blocks: a table for layout
                out[-1].append(("cell", links))
            met += size[i]
            continue
        own = [("tag", tag, within[up]), ("part", kind_of(tag), bucket(size[i] / total, (0.01, 0.05, 0.2, 0.5))), ("full", kind_of(tag), links)]
        out.append(own + [("class", w) for w in class_words(tree.attrs[i])])
    return out


#: Elements that hold others and may differ from them; what is neither these nor text mostly shares its parent's state.
HOLDERS = frozenset("address article aside body center details dialog dir div footer form header html main menu nav section".split())


def kind_of(tag: str) -> str:
    return "#text" if tag == "#text" else "holder" if tag in HOLDERS else "inner"


@dataclass
class Model:
    own: dict[tuple, float]  # log-odds of content that a piece of evidence gives
    child: dict[str, tuple[tuple[float, float], tuple[float, float]]]  # P(state | parent's state) of text and of elements

    def marginals(self, tree: Tree) -> list[float]:
        """P(content) of each node: one pass of messages up, one down."""
        shown, n = evidence(tree), len(tree.tag)
        get = self.own.get
        up = [[1.0, 1.0] for _ in range(n)]  # product of messages from children with own evidence
        to_parent = [(1.0, 1.0)] * n
        for i in range(n - 1, -1, -1):
            odds = math.exp(max(-12.0, min(12.0, sum(get(f, 0.0) for f in shown[i]))))
            no, yes = up[i][0], up[i][1] * odds
            scale = no + yes
            no, yes = no / scale, yes / scale
            up[i] = [no, yes]
            if i:
                table = self.child[kind_of(tree.tag[i])]
                message = (table[0][0] * no + table[0][1] * yes, table[1][0] * no + table[1][1] * yes)
                to_parent[i] = message
                above = up[tree.parent[i]]
                above[0] *= message[0]
                above[1] *= message[1]
                most = max(above)
                if most < 1e-100:
                    above[0] /= most
                    above[1] /= most
        belief = [0.0] * n
        belief[0] = up[0][1]
        for i in range(1, n):
            table = self.child[kind_of(tree.tag[i])]
            p = belief[tree.parent[i]]
            q0, q1 = (1 - p) / max(to_parent[i][0], 1e-300), p / max(to_parent[i][1], 1e-300)  # the parent without this child
            no = up[i][0] * (q0 * table[0][0] + q1 * table[1][0])
            yes = up[i][1] * (q0 * table[0][1] + q1 * table[1][1])
            belief[i] = yes / (no + yes) if no + yes else 0.5
        return belief


def train(pages: list[tuple[Tree, list[int]]]) -> Model:
    """Counts, with half a case added to each."""
    own: dict[tuple, list[float]] = {}
    child = {k: [[0.5, 0.5], [0.5, 0.5]] for k in ("#text", "holder", "inner")}
    totals = {k: [1.0, 1.0] for k in ("#text", "holder", "inner")}
    for tree, labels in pages:
        for i, shown in enumerate(evidence(tree)):
            if not i:
                continue
            kind = kind_of(tree.tag[i])
            child[kind][labels[tree.parent[i]]][labels[i]] += 1
            totals[kind][labels[i]] += 1
            for f in shown:
                own.setdefault((*f, kind), [0.0, 0.0])[labels[i]] += 1
    odds: dict[tuple, float] = {}
    for f, (no, yes) in own.items():
        kind = f[-1]
        weight = 1.0 if f[0] in ("class", "tag", "share", "cell") or f[0] == "of" and f[2] == 3 else 0.4  # the others lean on each other
        odds[f[:-1]] = weight * math.log((yes + 0.5) / (totals[kind][1] + 1) * (totals[kind][0] + 1) / (no + 0.5))
    return Model(odds, {k: tuple(tuple(x / sum(row) for x in row) for row in t) for k, t in child.items()})


#: Templates of the labelled pages: what surrounds and holds the article, as tag and class or id.
ABOVE = ["nav .menu", "nav", "div .navbar nav", "ul .nav", "div #menu", "header", "header .site-header", "div .header", "div #masthead", "div .topbar", "div .breadcrumb", "div .breadcrumbs", "div .banner", "div .ad", "div .ads", "div .advert", "div .advertisement", "div .ad-container", "div .sponsored", "div .cookie-notice", "div .cookie-banner", "div .notice", "div .alert", "div .consent", "div .popup modal", "form .search", "form", "div .search-box", "div .login", "div .skip-links", "div .notification"]
BESIDE = ["aside", "aside .sidebar", "div .sidebar", "div #sidebar", "div .side", "div .related", "div .related-posts", "div .recommended", "div .widget", "div .widgets", "div .promo", "div .promotion", "div .ad", "div .share", "div .social", "div .tags", "div .toc-nav", "section .related", "section .newsletter", "div .newsletter", "div .subscribe", "div .popular", "div .trending", "div .more-links", "div .pagination", "div .pager", "div .rating", "div .sponsor"]
BELOW = ["footer", "footer .site-footer", "div .footer", "div #footer", "div .copyright", "div .legal", "div .disclaimer", "section .comments", "div .comments", "div #comments", "div .comment-list", "div #disqus_thread", "ol .comment-list", "div .responses", "section #respond", "div .reader-comments", "div .discussion", "div .replies", "nav .footer-nav", "form .comment-form", "div .bottom"]
HOLDS = ["article", "article .post", "article .entry", "main", "main #content", "div .article", "div #article", "div .content", "div #content", "div .post", "div .post-content", "div .entry-content", "div .article-body", "div .story", "div .story-body", "div .main", "div #main", "section .article", "section", "div .text", "div .body-text", "div", "div .page-content", "div .prose", "div .post-body", "div .column", "div .main-content", "div .articleText"]
PAGES = 600


def labelled_pages(n: int = PAGES, seed: int = 11) -> list[tuple[Tree, list[int]]]:
    """Pages built from the templates, each block labelled where it is written; n bounds the training."""
    return [labelled(page(random.Random(seed * 100_003 + i))) for i in range(n)]


def page(rng: random.Random) -> str:
    word = lambda: "".join(rng.choices("aeioulnrstdmcpbgvfhé", k=rng.randint(2, 9)))

    def words(low: int, high: int) -> str:
        return " ".join(word() for _ in range(rng.randint(low, high)))

    def sentence() -> str:
        return words(3, 22).capitalize() + rng.choice("....!?")

    def prose(low: int = 1, high: int = 6) -> str:
        return " ".join(sentence() for _ in range(rng.randint(low, high)))

    def element(spec: str, inner: str, y: int | None) -> str:
        tag, *names = spec.split(" ")
        attrs = "".join(f' {"id" if x[0] == "#" else "class"}="{" ".join([x[1:], *names[1:]])}"' for x in names[:1])
        mark = "" if y is None else f' data-y="{y}"'
        return f"<{tag}{attrs}{mark}>{inner}</{tag}>"

    def links() -> str:
        items = [f'<a href="/{word()}">{words(1, 3)}</a>' for _ in range(rng.randint(2, 9))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if rng.random() < 0.6 else " | ".join(items)

    def clutter(spec: str) -> str:
        kind = spec.lower()
        if any(x in kind for x in ("comment", "respon", "repl", "disq", "discussion")):
            each = rng.choice(["div .comment", "li", "article .comment", "div .comment-body", "p", "div .reply"])
            inner = rng.choice(["", f"<h3>{words(1, 3)}</h3>"]) + "".join(element(each, rng.choice([f"<p>{prose(1, 3)}</p>", prose(1, 3), f"<b>{word()}</b><p>{prose(1, 4)}</p>"]), None) for _ in range(rng.randint(1, 5)))
        elif "form" in kind or "search" in kind or "login" in kind or "subscri" in kind or "newsl" in kind:
            inner = rng.choice([f"<label>{words(1, 4)}</label><input>", f"<p>{sentence()}</p><input><button>{word()}</button>", f"<h4>{words(1, 4)}</h4><form><label>{word()}</label><input></form>"])
        elif any(x in kind for x in ("ad", "notice", "alert", "cookie", "promo", "spons", "consent", "banner", "pop", "notif", "copy", "legal", "discl", "footer", "bottom")) and rng.random() < 0.75:
            inner = rng.choice([prose(1, 3), f"<p>{prose(1, 2)}</p>", f"<p>{prose(1, 2)} <a href='#'>{words(1, 3)}</a></p>", f"&copy; {word()}.net &middot; {sentence()}", links()])
        else:
            inner = rng.choice([links(), links(), f"<h3>{words(1, 4)}</h3>{links()}", f"<h3>{words(1, 4)}</h3><p>{sentence()}</p>", words(1, 6), f"<p>{words(2, 8)}</p>"])
        return element(spec, inner, 0)

    def paragraphs() -> str:
        out = []
        for _ in range(rng.choice([1, 2, 4, 8, 14, 20])):
            kind = rng.random()
            if kind < 0.72:
                out.append(f"<p>{prose()}</p>")
            elif kind < 0.78:
                out.append(f"<h{rng.randint(2, 4)}>{words(1, 7)}</h2>".replace("</h2>", "</h3>") if rng.random() < 0.1 else (lambda k, t: f"<h{k}>{t}</h{k}>")(rng.randint(2, 4), words(1, 7)))
            elif kind < 0.84:
                out.append("<ul>" + "".join(f"<li>{words(2, 14)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>")
            elif kind < 0.88:
                out.append(f"<blockquote><p>{prose(1, 2)}</p></blockquote>")
            elif kind < 0.91:
                out.append("<table>" + "".join(f"<tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>")
            elif kind < 0.94:
                out.append(f"<p>{prose(1, 3)} <a href='#'>{words(1, 3)}</a> {sentence()}</p>")
            elif kind < 0.96:
                out.append(f"<p>{word()}.</p>")
            elif kind < 0.98:
                out.append(f"<details><summary>{words(1, 6)}</summary>{rng.choice([f'<p>{prose(1, 3)}</p>', prose(1, 2)])}</details>")
            else:
                out.append(f"<div>{prose(1, 3)}</div>")
        return "".join(out)

    bare = rng.random()
    if bare < 0.15:  # little or nothing but the article
        inner = rng.choice([prose(1, 2), words(1, 12), "<br>".join(words(1, 8) for _ in range(4)), f"<p>{word()}.</p>", f"<p>{words(1, 5)}</p>", f"<p>{prose(1, 2)}</p>", f"<h1>{words(1, 6)}</h1><p>{prose()}</p>", f"<h1>{words(1, 6)}</h1>"])
        held = element(rng.choice([*HOLDS, "body", "div", "body"]), inner, 1)
        return held + (clutter(rng.choice(["footer", "div .footer", "nav .menu"])) if rng.random() < 0.4 else "")
    title = f"<h1>{words(2, 9)}</h1>"
    head = rng.choice([title, title, f"<header>{title}</header>", f"<div class='title'>{title}</div>", ""])
    body = paragraphs()
    if rng.random() < 0.3:
        at = body.find("</p>") + 4 if "</p>" in body else 0
        body = body[:at] + clutter(rng.choice(BESIDE)) + body[at:]
    inner = head + (element(rng.choice(HOLDS[5:]), body, None) if rng.random() < 0.3 else body)
    if rng.random() < 0.25:
        inner += clutter(rng.choice(BESIDE + BELOW[7:]))
    parts = [clutter(x) for x in rng.sample(ABOVE, rng.randint(1, 4))]
    middle = [element(rng.choice(HOLDS), inner, 1), *(clutter(x) for x in rng.sample(BESIDE, rng.randint(0, 2)))]
    if rng.random() < 0.25:
        rng.shuffle(middle)
    held = "".join(middle)
    if rng.random() < 0.12:  # laid out by a table
        cells = [f"<td>{links()}</td>", f"<td>{rng.choice([held, element('div', inner, 1)])}</td>"]
        held = element("table", "<tr>" + "".join(cells[:: rng.choice([1, 1, -1])]) + "</tr>", 0)
    elif rng.random() < 0.4:
        held = element(rng.choice(["div .container", "div .wrapper", "div #page", "div .row", "div", "main"]), held, None)
    parts += [held, *(clutter(x) for x in rng.sample(BELOW, rng.randint(1, 3)))]
    if rng.random() < 0.1:
        parts.insert(rng.randrange(len(parts)), element("div", links(), 0))
    return f"<html><head><title>{words(2, 5)}</title></head><body>{''.join(parts)}</body></html>"


def labelled(source: str) -> tuple[Tree, list[int]]:
    """Text takes the mark of the nearest element that has one, an element the state of most of its text."""
    tree = parse(source)
    n = len(tree.tag)
    mark, weight = [0] * n, [[0, 0] for _ in range(n)]
    for i in range(1, n):
        m = re.search(r'data-y="(\d)"', tree.attrs[i])
        mark[i] = int(m[1]) if m else mark[tree.parent[i]]
    for i in range(n - 1, 0, -1):
        if tree.text[i]:
            weight[i][mark[i]] += len(tree.text[i])
        for y in (0, 1):
            weight[tree.parent[i]][y] += weight[i][y]
    return tree, [mark[i] if tree.text[i] or not sum(weight[i]) else int(weight[i][1] > weight[i][0]) for i in range(n)]


@functools.cache
def trained() -> Model:
    return train(labelled_pages())


def main_text(model: Model, source: str) -> str:
    tree = parse(source)
    return "\n\n".join(t for t, p in zip(tree.text, model.marginals(tree), strict=True) if t and p > 0.5)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: id, url, text and n_chars; the blocks of content in page order, joined by an empty line.

    Null and empty pages, and pages whose text is all of what goes with an article, give an empty text; where nothing competes, a short block or bare text is the article. Broken, unclosed and cut-off markup is read as far as it goes; pages of any length are read whole. A block as likely content as not is left out. Repeated rows stay; other columns are ignored; an empty table gives an empty result. The model, some hundred numbers, is trained on PAGES labelled pages and broadcast.
    """
    model = trained()
    shared, key = pages.sparkSession.sparkContext.broadcast(model), digest(model)

    @F.pandas_udf("string")
    def read(sources: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = once(key, lambda: shared.value)
        for batch in sources:
            yield pd.Series([main_text(own, x) for x in batch], dtype=object)

    out = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), whole(html_col).alias("_html")).select("_id", "_url", read("_html").alias("text"))
    return out.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
