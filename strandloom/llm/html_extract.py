"""Main-text extraction by a tree-structured graphical model over the DOM.

Every block-level element (and every inline one with a class, id or role) is a node with a
hidden label, content or not.  A log-linear potential of the node's own features and a
potential for each parent-child pair of labels make up the model; sum-product messages, up
from the leaves and down from the root, give each node's exact marginal, and the text of
nodes that are content with at least even odds is kept.  All pages of a batch are one
forest and pass messages level by level in numpy.

The parameters are fitted by maximum likelihood (gradients are observed minus expected
features, by the same message passing) to labelled pages.  ``labelled_pages`` makes these:
layouts with articles among menus, headers, footers, sidebars, notices, adverts, forms and
comments, also without any element around the article or without any tag at all.  There each
part carries its label in a ``data-y`` attribute, which is read in fitting only and is neither a
feature nor looked at in other pages.

Scripts, styles, markup comments, head and other elements without visible text never make
text.  Character references are decoded; white space becomes one space; blocks follow in
page order, joined by one space.

Cases: null and empty html give an empty text; text outside every tag belongs to the root,
which is judged as any element is, so a page of plain text or of bare paragraphs is its text;
unclosed, misnested and unknown tags are read as browsers do, roughly; a head without an end
tag ends at the first tag or text that cannot stand in it; pages of any length and depth are
read whole; repeated rows are read each; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import html as _html
import random
import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Pages that pass messages together, and characters at most (a longer page goes alone).
BATCH_PAGES, BATCH_CHARS = 256, 4_000_000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup, and those that never hold main text.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SILENT = frozenset("script style head title template noscript iframe object svg math canvas audio video select option textarea noembed noframes datalist".split())
#: Start tags that may stand in a head; any other one ends it, as text does.
_IN_HEAD = frozenset("html head title base basefont bgsound link meta script style noscript noframes template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Start tags that end an open element of the second set, up to the third.
_CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
_SCOPE = frozenset("table td th caption object template html body".split())

TAG_GROUPS = (
    "article", "main", "section", "div", "p", "h1 h2 h3 h4 h5 h6", "ul ol dl menu", "li dt dd", "table tbody thead tr td th", "nav", "header", "footer",
    "aside", "form fieldset legend input button label", "figure figcaption", "blockquote", "pre", "a", "span", "html body", "address", "dialog",
)
_GROUP = {t: i for i, g in enumerate(TAG_GROUPS) for t in g.split()}
#: Words of class, id and role, by what they hint at.
HINTS = (
    "article content post entry story body text main prose copy",
    "nav menu breadcrumb breadcrumbs pagination pager toolbar navigation navbar",
    "header masthead topbar top head logo",
    "footer foot copyright legal colophon bottom contentinfo",
    "sidebar aside widget rail related recommended popular trending complementary more also teaser",
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner adsbygoogle dfp",
    "cookie cookies consent notice alert gdpr popup modal newsletter subscribe signup paywall overlay disclaimer message warning privacy",
    "comment comments reply replies disqus discussion respond commentlist feedback reviews",
    "form search login register contact",
    "share social sharing follow tags tag",
    "hidden hide invisible",
)
_HINT = {w: i for i, g in enumerate(HINTS) for w in g.split()}
#: Parent-child potentials are kept apart for these kinds of child.
_EDGE_KINDS = 4


@dataclass
class Dom:
    """Nodes in document order (parents first) and text pieces with their nodes."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    hints: list[frozenset] = field(default_factory=list)
    label: list[int] = field(default_factory=list)
    own: list[int] = field(default_factory=list)  # characters of text
    linked: list[int] = field(default_factory=list)  # of these in links
    stops: list[int] = field(default_factory=list)  # sentence ends
    pieces: list[tuple[int, str]] = field(default_factory=list)  # node, text; -1 marks a break


def _hints(attrs: str, labelled: bool) -> tuple[frozenset, int | None, bool]:
    found, label, named = set(), None, False
    for m in _ATTR.finditer(attrs):
        name = m[1].lower()
        value = m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role", "aria-label", "itemprop"):
            named = True
            for w in _WORDS.findall(value):
                k = _HINT.get(w.lower())
                if k is not None:
                    found.add(k)
        elif labelled and name == "data-y" and value in ("0", "1"):
            label = int(value)
        elif name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            found.add(10)
            named = True
    return frozenset(found), label, named


#: Marks the text outside every tag of a labelled page as content.
BARE = "<!--data-y=1-->"


def parse(source: str, labelled: bool = False) -> Dom:
    """Read a page into nodes and text pieces, and labels if it is a ``labelled`` one."""
    dom = Dom()
    stack: list[tuple[str, int]] = []  # open tags and the node that their text goes to
    open_tags: dict[str, int] = {}
    silent = links = 0

    def node(tag, hints, label):
        parent = stack[-1][1] if stack else -1
        dom.tag.append(tag)
        dom.parent.append(parent)
        dom.hints.append(hints)
        dom.label.append(label if label is not None else (dom.label[parent] if parent >= 0 else 0))
        dom.own.append(0)
        dom.linked.append(0)
        dom.stops.append(0)
        return len(dom.tag) - 1

    def pop():
        nonlocal silent, links
        tag, _ = stack.pop()
        open_tags[tag] -= 1
        silent -= tag in SILENT
        links -= tag == "a"
        if tag not in INLINE:
            dom.pieces.append((-1, " "))

    def text(raw):
        if silent or not raw:
            return
        raw = _html.unescape(raw) if "&" in raw else raw
        n = len(raw.strip())
        at = stack[-1][1]
        dom.pieces.append((at, raw))
        if n:
            dom.own[at] += n
            if links:
                dom.linked[at] += n
            dom.stops[at] += raw.count(". ") + raw.count(", ") + raw.rstrip().endswith((".", "!", "?"))

    def shown(raw):
        if stack[-1][0] == "head" and raw.strip(" \t\n\f\r"):
            pop()
        text(raw)

    stack.append(("#root", node("html", frozenset(), int(labelled and source.startswith(BARE)))))
    open_tags["#root"] = 1
    at, end = 0, len(source)
    while at < end:
        m = _TOKEN.search(source, at)
        if m is None:
            shown(source[at:])
            break
        shown(source[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        tag = name.lower()
        if m[1] or m[4]:
            if stack[-1][0] == "head" and tag in ("body", "html", "br"):
                pop()
            if open_tags.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
            elif tag in ("p", "br"):
                dom.pieces.append((-1, " "))
            continue
        if open_tags.get("head"):
            if tag == "body" and not open_tags.get("template"):
                while open_tags["head"]:
                    pop()
            elif stack[-1][0] == "head":
                if tag not in _IN_HEAD:
                    pop()
                elif tag in ("html", "head"):
                    continue
        attrs = m[3] if m[2] else m[6]
        inline = tag in INLINE
        if not inline:
            dom.pieces.append((-1, " "))
            if open_tags.get("p") and tag not in VOID | {"#root", "option", "noscript", "script", "style", "template"}:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "p":
                        while len(stack) > k:
                            pop()
                        break
                    if stack[k][0] in _SCOPE:
                        break
            if tag in _CLOSES:
                ends, scope = _CLOSES[tag]
                if any(open_tags.get(t) for t in ends):
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] in scope:
                            break
                        if stack[k][0] in ends:
                            while len(stack) > k:
                                pop()
                            break
        if tag in VOID or (attrs.endswith("/") and tag in ("svg", "path")):
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            at = close.end() if close else end
            continue
        if tag in ("html", "body") and open_tags.get(tag):
            continue
        hints, label, named = _hints(attrs, labelled) if attrs else (frozenset(), None, False)
        own = stack[-1][1] if inline and not named else node(tag, hints, label)
        stack.append((tag, own))
        open_tags[tag] = open_tags.get(tag, 0) + 1
        silent += tag in SILENT
        links += tag == "a"
    return dom


N_FEATURES = 1 + len(TAG_GROUPS) + 1 + len(HINTS) + 19
#: Kinds of element that hold text themselves, and those that also only hold others.
_BLOCKS, _BOXES = (4, 5, 6, 7, 8, 14, 15, 16), (2, 3)
_BODY = _GROUP["body"]


def features(doms: list[Dom]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, parent, edge kind) of all nodes of a forest."""
    base = np.cumsum([0] + [len(d.tag) for d in doms])
    n = int(base[-1])
    parent = np.asarray([p + b if p >= 0 else -1 for d, b in zip(doms, base) for p in d.parent], np.int64)
    own, linked, stops = (np.asarray([v for d in doms for v in getattr(d, k)], np.float64) for k in ("own", "linked", "stops"))
    whole, whole_linked = own.copy(), linked.copy()
    for level in reversed(_levels(parent)[1:]):
        whole += np.bincount(parent[level], weights=whole[level], minlength=n)
        whole_linked += np.bincount(parent[level], weights=whole_linked[level], minlength=n)
    x = np.zeros((n, N_FEATURES))
    x[:, 0] = 1
    group = np.asarray([_GROUP.get(t, len(TAG_GROUPS)) for d in doms for t in d.tag])
    x[np.arange(n), 1 + group] = 1
    at = 2 + len(TAG_GROUPS)
    for i, h in enumerate(h for d in doms for h in d.hints):
        for k in h:
            x[i, at + k] = 1
    at += len(HINTS)
    density = whole_linked / np.maximum(whole, 1)
    for k, on in enumerate((own == 0, (own > 0) & (own < 25), (own >= 25) & (own < 100), own >= 100, whole < 60, whole >= 400, density > 0.6, (density > 0.25) & (density <= 0.6), stops == 0, stops >= 2)):
        x[:, at + k] = on
    for d, b in zip(doms, base):
        for i, t in d.pieces:
            if "©" in t and i >= 0:
                x[b + i, at + 10] = 1
    x[:, at + 11] = np.asarray([len(h) > 0 for d in doms for h in d.hints])
    plain = x[:, 2 + len(TAG_GROUPS) + 7] == 0  # not a comment
    x[:, at + 12] = (group <= 1) & plain
    x[:, at + 13] = np.isin(group, (3, 4, 5)) & (x[:, at + 11] == 0)
    # text in the body itself, and blocks right below it without a name
    x[:, at + 14] = (group == _BODY) & (own > 0)
    x[:, at + 15] = (group == _BODY) & (own >= 25)
    top = (parent >= 0) & (group[parent] == _BODY) & (x[:, at + 11] == 0)
    x[:, at + 16] = top & (np.isin(group, _BLOCKS) | (np.isin(group, _BOXES) & (own > 0)))
    # the same where nothing but blocks of text makes up the page; this and the next are rare in
    # training, so weighted for the ridge not to hide them
    page = np.repeat(np.arange(len(doms)), np.diff(base))
    boxed = np.bincount(page, weights=~np.isin(group, (*_BLOCKS, _BODY)) | (x[:, at + 11] > 0), minlength=len(doms)) > 0
    # all text in the body itself
    x[:, at + 18] = 4 * ((x[:, at + 14] > 0) & (own == np.bincount(page, weights=own, minlength=len(doms))[page]))
    x[:, at + 17] = 3 * (~boxed[page] & ((x[:, at + 14] > 0) | (x[:, at + 16] > 0)))
    kind = np.where(np.isin(group, (5, 4, 6, 7, 8, 15, 16)), 1, np.where(np.isin(group, (9, 10, 11, 12, 13)), 2, np.where(x[:, at + 11] > 0, 3, 0)))
    return x, parent, kind


def _levels(parent: np.ndarray) -> list[np.ndarray]:
    """Nodes by depth, roots first."""
    order = [np.flatnonzero(parent < 0)]
    kids = np.argsort(parent, kind="stable")
    first = np.searchsorted(parent[kids], np.arange(len(parent)))
    count = np.bincount(parent[parent >= 0], minlength=len(parent))
    while True:
        level = order[-1]
        c = count[level]
        if not c.sum():
            return order
        begin = np.repeat(first[level] - np.concatenate([[0], np.cumsum(c)[:-1]]), c)
        order.append(kids[begin + np.arange(int(c.sum()))])


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def sum_product(phi: np.ndarray, psi: np.ndarray, parent: np.ndarray, kind: np.ndarray, levels: list[np.ndarray] | None = None):
    """Exact marginals of a forest: (nodes, 2) and, for nodes with a parent, (2, 2) of
    (parent's label, own label).  phi: (nodes, 2), psi: (kinds, 2, 2), all logarithms."""
    n = len(phi)
    levels = levels or _levels(parent)
    up = phi.copy()
    message = np.zeros((n, 2))
    for level in reversed(levels[1:]):
        message[level] = _lse(psi[kind[level]] + up[level][:, None, :], 2)
        for y in (0, 1):
            up[:, y] += np.bincount(parent[level], weights=message[level, y], minlength=n)
    total = up
    pair = np.zeros((n, 2, 2))
    for level in levels[1:]:
        cavity = total[parent[level]] - message[level]
        both = cavity[:, :, None] + psi[kind[level]] + up[level][:, None, :]
        pair[level] = both
        total[level] += _lse(cavity[:, :, None] + psi[kind[level]], 1)
    both = pair[parent >= 0]
    both = np.exp(both - _lse(both.reshape(-1, 4), 1)[:, None, None])
    pair[parent >= 0] = both
    return np.exp(total - _lse(total, 1)[:, None]), pair


@dataclass
class Model:
    weights: np.ndarray  # (N_FEATURES,) for the label content
    pairs: np.ndarray  # (_EDGE_KINDS, 2, 2)

    def marginals(self, doms: list[Dom]) -> np.ndarray:
        x, parent, kind = features(doms)
        phi = np.zeros((len(x), 2))
        phi[:, 1] = x @ self.weights
        return sum_product(phi, self.pairs, parent, kind)[0][:, 1]


def fit(pages: list[str], steps: int = 250, rate: float = 0.15, ridge: float = 5e-4) -> Model:
    """Maximum likelihood on pages whose parts carry ``data-y`` labels."""
    doms = [parse(p, True) for p in pages]
    x, parent, kind = features(doms)
    y = np.asarray([v for d in doms for v in d.label])
    has = parent >= 0
    levels = _levels(parent)
    seen = np.bincount(kind[has] * 4 + y[parent[has]] * 2 + y[has], minlength=4 * _EDGE_KINDS).reshape(_EDGE_KINDS, 2, 2)
    model = Model(np.zeros(x.shape[1]), np.zeros((_EDGE_KINDS, 2, 2)))
    m = [np.zeros_like(model.weights), np.zeros_like(model.pairs)]
    v = [np.zeros_like(model.weights), np.zeros_like(model.pairs)]
    for step in range(1, steps + 1):
        phi = np.zeros((len(x), 2))
        phi[:, 1] = x @ model.weights
        node, pair = sum_product(phi, model.pairs, parent, kind, levels)
        want = np.stack([pair[has & (kind == k)].sum(axis=0) for k in range(_EDGE_KINDS)])
        grads = [x.T @ (y - node[:, 1]) / len(x) - ridge * model.weights, (seen - want) / len(x) - ridge * model.pairs]
        for p, g, a, b in zip((model.weights, model.pairs), grads, m, v):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return model


def labelled_pages(n: int = 500, seed: int = 3, bare_pages: int = 0) -> list[str]:
    """Made-up pages whose parts carry their labels; ``bare_pages`` more have no element around
    the article, or no tag at all."""
    rng = random.Random(seed)
    pick = rng.choice

    def words(lo, hi):
        return " ".join("".join(rng.choices("abdeghilmnorstuv", k=rng.randint(2, 9))) for _ in range(rng.randint(lo, hi)))

    def sentence():
        s = words(4, 18)
        return s if bare else s[:1].upper() + s[1:] + pick([".", ".", ".", ",", "!", "?", ""])

    def prose(lo=1, hi=6):
        return " ".join(sentence() for _ in range(rng.randint(lo, hi)))

    def named(tag, names, inner, label=""):
        attr = pick([f' class="{pick(names)}"', f' id="{pick(names)}"', f' class="x-{rng.randint(1, 99)} {pick(names)}"'])
        return f"<{tag}{attr}{label}>{inner}</{tag}>"

    def listing(lo=3, hi=9):
        return "<ul>" + "".join(f'<li><a href="#">{words(1, 3)}</a></li>' for _ in range(rng.randint(lo, hi))) + "</ul>"

    def menu():
        return pick([lambda: f"<nav>{listing()}</nav>", lambda: named("div", ["menu", "main-nav", "navbar", "breadcrumbs"], listing()), lambda: named("nav", ["nav", "pagination"], " ".join(f'<a href="#">{words(1, 2)}</a>' for _ in range(5))), lambda: named("ul", ["menu", "nav"], "".join(f'<li><a href="#">{words(1, 2)}</a></li>' for _ in range(5)))])()

    def header():
        inner = pick([f"<h1>{words(1, 4)}</h1>", f'<a href="/">{words(1, 3)}</a><p>{sentence()}</p>', f"<div>{words(1, 5)}</div>{menu()}"])
        return pick([lambda: f"<header>{inner}</header>", lambda: named("div", ["header", "masthead", "topbar", "site-header"], inner)])()

    def footer():
        inner = pick([f"&copy; {words(1, 3)} &middot; {prose(1, 3)}", f"<p>{prose(1, 2)}</p>{listing(2, 5)}", f"<p>&copy; {words(2, 5)}</p>"])
        return pick([lambda: f"<footer>{inner}</footer>", lambda: named("div", ["footer", "copyright", "site-footer", "legal"], inner)])()

    def advert():
        inner = pick([prose(1, 3), f"<p>{prose(1, 2)}</p>", f'<a href="#">{prose(1, 2)}</a>', f"<h3>{words(2, 5)}</h3><p>{prose(1, 3)}</p>"])
        return named(pick(["div", "div", "aside", "section", "p"]) if "<" not in inner else "div", ["ad", "ads", "advert", "ad-slot", "sponsored", "promo", "banner", "adsbygoogle"], inner, ' data-y="0"')

    def sidebar():
        inner = "".join(pick([lambda: f"<h3>{words(1, 3)}</h3>{listing()}", lambda: f"<p>{prose(1, 4)}</p>", lambda: f"<div>{prose(1, 2)}</div>"])() for _ in range(rng.randint(1, 3)))
        return pick([lambda: f'<aside data-y="0">{inner}</aside>', lambda: named("div", ["sidebar", "widget", "related", "right-rail", "popular"], inner, ' data-y="0"'), lambda: named("section", ["related", "recommended"], inner, ' data-y="0"')])()

    def notice():
        inner = pick([f"<p>{prose(1, 3)}</p>", prose(1, 3), f"<p>{prose(1, 2)}</p><button>{words(1, 1)}</button>"])
        return pick([lambda: named("div", ["cookie-notice", "cookie-banner", "consent", "notice", "alert", "newsletter", "subscribe", "modal", "gdpr"], inner, ' data-y="0"'), lambda: f'<dialog data-y="0">{inner}</dialog>'])()

    def form():
        return f'<form data-y="0" action="#"><label>{words(1, 3)}</label><input name="q"><p>{sentence()}</p><button>{words(1, 2)}</button></form>'

    def comments():
        one = lambda: pick([lambda: f"<li><p>{prose(1, 4)}</p></li>", lambda: named("div", ["comment", "reply"], f"<b>{words(1, 2)}</b><p>{prose(1, 4)}</p>"), lambda: f'<article class="comment"><p>{prose(1, 4)}</p></article>'])()
        inner = f"<h2>{words(1, 2)}</h2>" + "".join(one() for _ in range(rng.randint(1, 6)))
        return named(pick(["section", "div", "ol"]), ["comments", "comment-list", "disqus", "discussion", "responses comments", "user-comments"], inner, ' data-y="0"')

    def part():
        k = rng.random()
        if k < 0.62:
            inner = prose(1, 6)
            if rng.random() < 0.2:
                inner = f"<b>{sentence()}</b> " + inner
            if rng.random() < 0.15:
                inner += f' <a href="#">{words(1, 4)}</a>.'
            return f"<p>{inner}" + ("</p>" if rng.random() < 0.85 else "")
        if k < 0.72:
            return f"<h{(h := rng.randint(2, 4))}>{words(1, 7)}</h{h}>"
        if k < 0.78:
            return "<ul>" + "".join(f"<li>{pick([sentence(), words(1, 3)])}</li>" for _ in range(rng.randint(2, 6))) + "</ul>"
        if k < 0.82:
            return f"<blockquote><p>{prose(1, 3)}</p></blockquote>"
        if k < 0.85:
            return "<table>" + "".join(f"<tr><td>{words(1, 2)}</td><td>{words(1, 4)}</td></tr>" for _ in range(3)) + "</table>"
        if k < 0.88:
            return f'<figure><img src="a.png"><figcaption>{sentence()}</figcaption></figure>'
        if k < 0.91:
            return f"<pre>{words(3, 30)}</pre>"
        if k < 0.95:
            return f"<div>{prose(1, 4)}</div>"
        return f"<section><h3>{words(1, 5)}</h3><p>{prose(1, 4)}</p></section>"

    def article():
        title = pick([f"<h1>{words(1, 9)}</h1>", f"<h1>{words(1, 9)}</h1>", f"<header><h1>{words(1, 9)}</h1></header>", ""])
        parts = [part() for _ in range(rng.randint(1, 9))] if rng.random() < 0.8 else [f"<p>{words(1, 6)}." for _ in range(rng.randint(0, 2))]
        for extra, chance in ((advert, 0.25), (sidebar, 0.1), (notice, 0.08), (form, 0.05), (comments, 0.1)):
            if rng.random() < chance:
                parts.insert(rng.randint(0, len(parts)), extra())
        inner = title + "".join(parts)
        k = rng.random()
        label = ' data-y="1"'
        if k < 0.45:
            return f"<article{label}>{inner}</article>"
        if k < 0.6:
            return f"<main{label}>{inner}</main>"
        if k < 0.9:
            return named("div", ["content", "article-body", "post", "entry-content", "story", "main-content", "text"], inner, label)
        return f"<div{label}>{inner}</div>"

    pages, bare = [], False
    for _ in range(n):
        bare = rng.random() < 0.2  # a page without stops
        before = [f() for f, chance in ((header, 0.5), (menu, 0.7), (notice, 0.3), (advert, 0.5), (sidebar, 0.15), (form, 0.15)) if rng.random() < chance]
        after = [f() for f, chance in ((comments, 0.3), (sidebar, 0.3), (advert, 0.25), (form, 0.15), (menu, 0.15), (footer, 0.75)) if rng.random() < chance]
        rng.shuffle(before)
        inner = article()
        if rng.random() < 0.3:
            inner = f"<div><div>{inner}</div></div>"
        body = "".join(before) + inner + "".join(after)
        if rng.random() < 0.3:
            body = named("div", ["page", "wrapper", "container"], body)
        pages.append(f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><style>p{{margin:0}}</style></head><body>{body}" + ("</body></html>" if rng.random() < 0.9 else ""))

    def other(found):  # everything but the article, labelled throughout
        return "".join(re.sub(r"^(<\w+)((?:(?!data-y)[^>])*)>", r'\1\2 data-y="0">', f()) for f, chance in found if rng.random() < chance)

    for k in range(bare_pages):
        bare = rng.random() < 0.2
        if k % 3 == 0:  # text and line breaks, or text alone
            lines = [prose(1, 6) for _ in range(rng.randint(1, 6))] if rng.random() < 0.7 else [words(1, 3)]
            text = pick(["\n", "<br>", "<br><br>\n", " "]).join(lines)
            pages.append(BARE + text if rng.random() < 0.6 else f'<html><head><title>{words(2, 6)}</title></head><body data-y="1">{text}</body></html>')
            continue
        parts = [f"<h1>{words(1, 9)}</h1>"] * (rng.random() < 0.5) + [part() for _ in range(rng.randint(1, 8))] if rng.random() < 0.8 else [f"<p>{words(1, 4)}</p>"]
        inner = "".join(re.sub(r"^<(\w+)", r'<\1 data-y="1"', p) for p in parts)
        body = other(((header, 0.2), (menu, 0.3), (advert, 0.2))) + inner + other(((comments, 0.15), (sidebar, 0.15), (footer, 0.3)))
        pages.append(body if k % 3 == 1 else f"<html><head><title>{words(2, 6)}</title></head><body>{body}</body></html>")
    return pages


@lru_cache(maxsize=1)
def default_model() -> Model:
    return fit(labelled_pages(bare_pages=120))


def extract(pages: list[str | None], model: Model) -> list[str]:
    """The main text of each page."""
    doms = [parse(p or "") for p in pages]
    if not doms:
        return []
    keep = model.marginals(doms) >= 0.5
    out, at = [], 0
    for d in doms:
        kept = keep[at : at + len(d.tag)]
        at += len(d.tag)
        out.append(" ".join("".join(t if n < 0 or kept[n] else " " for n, t in d.pieces).split()))
    return out


def extract_pages(pages: DataFrame, model: Model | None = None, key: str = "page_id") -> DataFrame:
    """key, url, text and n_chars of every page.  A map: nothing is shuffled."""
    model = model or default_model()

    def run(batches):
        for batch in batches:
            lo = 0
            source = batch.column(2).to_pylist()
            while lo < len(source):
                hi, size = lo, 0
                while hi < len(source) and hi - lo < BATCH_PAGES and (hi == lo or size + len(source[hi] or "") <= BATCH_CHARS):
                    size += len(source[hi] or "")
                    hi += 1
                text = extract(source[lo:hi], model)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=[key, "url", "text", "n_chars"])
                lo = hi

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, "url", "html").mapInArrow(run, f"{key} {kind}, url string, text string, n_chars bigint")
