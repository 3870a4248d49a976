"""HTML extraction: a tree-structured graphical model over the DOM.

Block elements and runs of text are the nodes; each frames the main text, is part of it or is
apart from it. A node has a potential from
its features, and each pair of parent and child has one from a trained table. Sum-product messages
go up and down the tree once and give exact marginals. Weights and tables are trained by maximum
likelihood on labelled pages, whose gradient needs the same marginals.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

#: Elements that start and end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose text is never text of the page, and those of them that hold raw text.
DROPPED = frozenset("script style noscript template textarea select option datalist button svg math iframe object head title audio video canvas map".split())
RAW = frozenset("script style textarea title iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What an element's start ends, up to an element of the second set.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "body": ({"head"}, set()),
}
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|\b(hidden)\b""")
#: A slash that ends an element at once; one that belongs to a value without quotes doesn't.
_EMPTY = re.compile(r"""(?:^|[\s"'])/$""")
_OPEN = re.compile(r"<[!?].*", re.S)
_NAME = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Page:
    """The nodes of a page in page order, parents before children; node 0 is the page itself."""

    def __init__(self) -> None:
        self.parent, self.tag, self.names, self.label = [-1], ["#page"], [()], [0]
        self.text, self.linked = [None], [0]

    def add(self, parent: int, tag: str, names: tuple = (), label: int = 0, text: str | None = None, linked: int = 0) -> int:
        for values, v in ((self.parent, parent), (self.tag, tag), (self.names, names), (self.label, label), (self.text, text), (self.linked, linked)):
            values.append(v)
        return len(self.parent) - 1


def _attributes(raw: str, labelled: bool) -> tuple[tuple[str, ...], int]:
    """Words of class, id, role and itemprop; the label of a training page (``labelled``)."""
    names, label = [], 0
    for m in _ATTR.finditer(raw):
        key = (m[1] or m[3]).lower()
        if key in ("class", "id", "role", "itemprop"):
            names += _NAME.findall(_CAMEL.sub(" ", m[2].strip("\"'")).lower())
        elif key == "hidden":
            names.append("hidden")
        elif labelled and key == "data-y":
            label = int(m[2].strip("\"'"))
    return tuple(dict.fromkeys(names)), label


def parse(source: str, labelled: bool = True) -> Page:
    """The block elements and runs of text of a page; markup that isn't well-formed is taken as browsers do, roughly.
    Labels (data-y) are read from ``labelled`` pages alone, which are generated; other pages may have anything there."""
    # Open elements: tag, node (none if inline) and the innermost node up to there; how many there are of each tag.
    page, stack, run, linked = Page(), [("#page", 0, 0)], [], 0
    count: Counter[str] = Counter()
    dropped, links, at, last = 0, 0, 0, source.rfind(">")

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join("".join(run).split())
            if text:
                top = stack[-1][2]
                page.add(top, "#text", (), page.label[top] or APART, text, min(linked, len(text)))
            run.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if text and not dropped:
            text = entities.unescape(text)
            run.append(text)
            if links:
                linked += len(text)

    def push(tag: str, node: int | None) -> None:
        stack.append((tag, node, stack[-1][2] if node is None else node))
        count[tag] += 1

    def pop(depth: int) -> None:
        nonlocal dropped, links
        if any(node is not None for _, node, _ in stack[depth:]):
            flush()
        for tag, _, _ in stack[depth:]:
            dropped -= tag in DROPPED
            links -= tag == "a"
            count[tag] -= 1
        del stack[depth:]

    def nearest(tags: set | frozenset, until: set | frozenset) -> int:
        if any(count[t] for t in tags):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in tags:
                    return k
                if stack[k][0] in until:
                    return 0
        return 0

    while True:
        m = _TAG.search(source, at) if at <= last else None
        if not m:
            # Without a further > no tag ends; what only begins a comment isn't text.
            say(_OPEN.sub("", source[at:]))
            break
        say(source[at : m.start()])
        at = m.end()
        close, tag, raw = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if close:
            if tag in BLOCKS:
                if k := nearest({tag}, {"table"} if tag in ("p", "div", "li") else frozenset()):
                    pop(k)
            elif tag != "br" and (k := nearest({tag}, frozenset() if tag in DROPPED else BLOCKS)):
                pop(k)
            continue
        if tag in ("br", "wbr", "hr"):
            if tag == "br":
                say(" ")
            elif tag == "hr":
                flush()
            continue
        if tag in VOID:
            continue
        if tag in BLOCKS:
            # A block ends an open paragraph; a paragraph's own inline elements end with it.
            if k := nearest({"p"}, BLOCKS - {"p"}):
                pop(k)
            if tag in IMPLIED:
                ends, until = IMPLIED[tag]
                while k := nearest(ends, until):
                    pop(k)
            flush()
            names, label = _attributes(raw, labelled) if raw else ((), 0)
            if tag in ("html", "body") and count[tag]:
                continue
            push(tag, page.add(stack[-1][2], tag, names, label))
        elif tag in DROPPED:
            if tag in RAW:
                if raw.endswith("/") and tag in ("iframe",):
                    continue
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(source, at)
                at = end.end() if end else len(source)
            elif not raw.endswith("/"):
                push(tag, None)
                dropped += 1
        elif not _EMPTY.search(raw):
            push(tag, None)
            links += tag == "a"
    pop(1)
    flush()
    return page


#: How pages name their parts, as (element, class or id).
CONTENT = "article.;article.;article.;article.;article.;article.;main.;main.;main.;article.post;div.content;div.article;div.article-body;div.post-content;div.entry-content;section.story;div.main-content;div.text;div.body-copy;div.page-content;div.post;div.story-body;section.article-text;div.prose;div.rich-text;main.content;div.entry"
OUTSIDE = {
    "menu": "nav.;ul.menu;div.nav;div.navbar;div.navigation;div.breadcrumbs;ul.links;div.topbar;div.pagination;div.pager;ol.breadcrumb;div.menu-main;div.toc;menu.",
    "header": "header.;div.header;div.masthead;div.site-header;div.logo;div.branding;div.page-header;header.top",
    "footer": "footer.;div.footer;div.site-footer;div.copyright;div.colophon;div.legal;div.page-footer;footer.bottom",
    "sidebar": "aside.;div.sidebar;div.widget;div.related;div.recommended;div.rail;div.popular;div.trending;aside.side;section.related-posts;div.more;div.teaser",
    "notice": "div.notice;div.cookie-banner;div.consent;div.gdpr;div.alert;div.popup;div.modal;div.newsletter;div.subscribe;p.notice;div.warning;div.message;dialog.;div.overlay;div.cookies;section.paywall;div.disclaimer;div.hidden",
    "advert": "div.ad;div.ads;div.advert;div.advertisement;div.sponsor;div.sponsored;div.promo;div.banner;p.ad;aside.ad;section.adverts;div.ad-slot;div.advertising;div.promotion;div.commercial",
    "form": "form.;div.search;div.login;fieldset.;div.signup;form.contact;div.form;div.poll",
    "comments": "section.comments;div.comments;ol.commentlist;div.comment;div.disqus;div.responses;ul.comment-list;article.comment;div.discussion;div.replies;section.reader-comments;div.comment-body;div.reply;div.reviews;div.feedback",
    "social": "div.share;div.social;ul.share-buttons;div.follow",
}
#: The words in these names; others (generated or of the page's own) tell nothing.
KNOWN = frozenset(w for spec in ";".join([CONTENT, *OUTSIDE.values(), ".container", ".wrapper", ".row", ".layout", ".site", ".hidden"]).split(";") for w in re.findall("[a-z]+", spec.split(".")[1]))


def _known(names: tuple[str, ...]) -> list[str]:
    return [n for n in dict.fromkeys(x if x in KNOWN or x[-1] != "s" else x[:-1] for x in names) if n in KNOWN]


def _step(x: float, bounds: tuple[float, ...]) -> int:
    return sum(x >= b for b in bounds)


#: Where shares of a page's text are told apart.
SHARES = (0.02, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8, 0.95)
_SENTENCE = re.compile(r"[.!?;:](?=\s|$)")


def features(page: Page) -> list[list[str]]:
    """Names of each node's features: tags and names; how much text there is, how much of it is in
    links and ends sentences, by itself and for all that an element holds; its place in the page; and
    the runs of text before and after."""
    n = len(page.parent)
    size, linked, runs, ends = (np.zeros(n, np.int64) for _ in range(4))
    begin, seen, order = np.zeros(n, np.int64), 0, []
    for k, text in enumerate(page.text):
        begin[k] = seen
        if text is not None:
            size[k], linked[k], runs[k], ends[k] = len(text), page.linked[k], 1, text[-1] in ".!?:;"
            seen += len(text)
            order.append(k)
    for k in range(n - 1, 0, -1):
        p = page.parent[k]
        size[p], linked[p], runs[p], ends[p] = size[p] + size[k], linked[p] + linked[k], runs[p] + runs[k], ends[p] + ends[k]
    total, most = max(1, seen), max([1, *(int(size[k]) for k in order)])
    bits = lambda x: min(int(x).bit_length(), 10)
    place = {k: i for i, k in enumerate(order)}
    around = lambda i: bits(size[order[i]]) if 0 <= i < len(order) else "none"
    out = []
    for k, (tag, names, text) in enumerate(zip(page.tag, page.names, page.text, strict=True)):
        at = _step(begin[k] / total, (0.02, 0.1, 0.3, 0.7, 0.9))
        if text is not None:
            s, l, stop, i = bits(size[k]), 4 * int(linked[k]) // int(size[k]), bool(ends[k]), place[k]
            out.append([
                "text", f"size {s}", f"linked {l}", f"stop {stop}", f"linked {l} stop {stop}", f"size {s} stop {stop}", f"in {page.tag[page.parent[k]]}", f"in {page.tag[page.parent[k]]} size {s}",
                f"sentences {min(4, len(_SENTENCE.findall(text)))}", f"at {at}", f"before {around(i - 1)}", f"after {around(i + 1)}", f"of largest {_step(size[k] / most, SHARES)}",
                f"notice {'©' in text or text[:9].lower() == 'copyright'}",
            ])
            continue
        known = _known(names)
        own = [f"tag {tag}", "named" if known else f"bare {tag}", *(f"name {x}" for x in known)]
        if runs[k] and k:
            share, l, mean, e = _step(size[k] / total, SHARES), 4 * int(linked[k]) // int(size[k]), bits(size[k] // runs[k]), 4 * int(ends[k]) // int(runs[k])
            own += [f"share {share}", f"links {l}", f"mean {mean}", f"ended {e}", f"runs {min(5, int(runs[k]).bit_length())}", f"from {at}", f"links {l} mean {mean}", f"ended {e} mean {mean}", f"{tag} mean {mean}", f"{tag} links {l}"]
        out.append(own)
    return out


#: The states of a node: around the main text (a page's frame), part of it, or apart from it.
FRAME, MAIN, APART = range(3)


#: Kinds of nodes, which have tables of their own: runs of text in elements of text and in others, elements
#: of text, parts of tables, other elements without and with a name, and elements that say what they are.
TEXT, LOOSE, PARAGRAPH, TABLE, BARE, NAMED, PART = range(7)
_PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre figure figcaption caption details summary".split())
_TABLES = frozenset("table tbody thead tfoot tr td th".split())
_PARTS = frozenset("article main nav aside header footer form fieldset menu dialog address body html".split())


def kinds(page: Page) -> list[int]:
    out = []
    for tag, names, text, parent in zip(page.tag, page.names, page.text, page.parent, strict=True):
        if text is not None:
            out.append(TEXT if page.tag[parent] in _PARAGRAPHS else LOOSE)
        elif tag in _PARTS:
            out.append(PART)
        else:
            out.append(NAMED if _known(names) else PARAGRAPH if tag in _PARAGRAPHS else TABLE if tag in _TABLES else BARE)
    return out


class Model:
    """Weights by feature name and state (none for FRAME), and the tables of (kind of node, parent's
    state, own state)."""

    def __init__(self, names: list[str], weights: np.ndarray, pairs: np.ndarray) -> None:
        self.place = {n: i for i, n in enumerate(names)}
        self.weights, self.pairs = weights, pairs


def _sum(x: np.ndarray, axis: int) -> np.ndarray:
    """The logarithm of a sum of exponentials."""
    most = x.max(axis=axis, keepdims=True)
    return (most + np.log(np.exp(x - most).sum(axis=axis, keepdims=True))).squeeze(axis)


class Forest:
    """The nodes of many pages; ``row``, ``col``: which node has which known feature."""

    def __init__(self, pages: list[Page], place: dict[str, int]) -> None:
        first = np.cumsum([0, *(len(p.parent) for p in pages)])
        self.parent = np.concatenate([np.where(np.asarray(p.parent) >= 0, np.asarray(p.parent) + s, -1) for p, s in zip(pages, first)])
        self.kind = np.asarray([k for p in pages for k in kinds(p)], np.int64)
        self.label = np.asarray([y for p in pages for y in p.label])
        rows, cols = [], []
        for k, f in enumerate(x for p in pages for x in features(p)):
            known = [place[n] for n in f if n in place]
            rows += [k] * len(known)
            cols += known
        self.row, self.col, self.first = np.asarray(rows, np.int64), np.asarray(cols, np.int64), first
        depth = np.zeros(len(self.parent), np.int64)
        for i, p in enumerate(self.parent.tolist()):
            if p >= 0:
                depth[i] = depth[p] + 1
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)

    def marginals(self, weights: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of the states of each node, and of (parent's state, own state) of each pair."""
        n = len(self.parent)
        up, message = np.zeros((n, 3)), np.zeros((n, 3))
        for state in (MAIN, APART):
            up[:, state] = np.bincount(self.row, weights[self.col, state - 1], n)
        tables = pairs[self.kind]
        for level in self.levels[:0:-1]:
            message[level] = _sum(tables[level] + up[level][:, None, :], 2)
            np.add.at(up, self.parent[level], message[level])
        full, joint = up.copy(), np.zeros((n, 3, 3))
        for level in self.levels[1:]:
            x = tables[level] + (full[self.parent[level]] - message[level])[:, :, None]
            full[level] = up[level] + _sum(x, 1)
            j = x + up[level][:, None, :]
            j = np.exp(j - j.max(axis=(1, 2), keepdims=True))
            joint[level] = j / j.sum(axis=(1, 2), keepdims=True)
        p = np.exp(full - full.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True), joint


def train(pages: list[Page], steps: int = 150, decay: float = 0.02) -> Model:
    """Maximum likelihood: what is observed less what the marginals expect, for weights and tables."""
    names = sorted({f for p in pages for x in features(p) for f in x})
    f = Forest(pages, {n: i for i, n in enumerate(names)})
    shape = (len(names), 2)
    w, t = np.zeros(shape), np.zeros((PART + 1, 3, 3))
    child = np.flatnonzero(f.parent >= 0)
    one = np.eye(3)[f.label]

    def sums(p: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(f.col, p[f.row, s], shape[0]) for s in (MAIN, APART)], axis=1)

    seen_w, seen_t = sums(one), np.zeros_like(t)
    np.add.at(seen_t, (f.kind[child], f.label[f.parent[child]], f.label[child]), 1)
    m, v = np.zeros(w.size + t.size), np.zeros(w.size + t.size)
    for step in range(1, steps + 1):
        p, joint = f.marginals(w, t)
        gt = seen_t - np.stack([joint[child[f.kind[child] == k]].sum(0) for k in range(len(t))])
        g = np.concatenate([(seen_w - sums(p) - decay * w).ravel(), (gt - decay * t).ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.25 * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, t = w + move[: w.size].reshape(shape), t + move[w.size :].reshape(t.shape)
    return Model(names, w, t)


_WORDS = "the of and to in river stone market paper winter letter people small large old new green house field answer story morning north public early".split()


#: How pages name their parts: as usual, not at all, by letters that say nothing, or wrongly.
NAMING = ["usual"] * 9 + ["none"] * 4 + ["opaque"] * 4 + ["wrong"] * 3
#: How pages lay out their parts: elements of their own, cells of a table, or the article loose in the body.
LAYOUT = ["parts"] * 13 + ["table"] * 4 + ["loose"] * 3


def _labelled(rng: random.Random) -> str:
    """One labelled page: an article within other parts, some of them within the article."""
    naming, layout = rng.choice(NAMING), rng.choice(LAYOUT)

    # How full the page is of other parts, and how its texts are written.
    full, style = rng.choice([0.0, 0.15, 0.35, 0.55, 0.55]), rng.choice(["plain"] * 7 + ["upper", "shouted", "shouted", "unstopped", "repeated", "numbers"])

    def words(lo: int, hi: int) -> str:
        w = [rng.choice(_WORDS) for _ in range(rng.randrange(lo, hi))]
        if style == "repeated" and rng.random() < 0.5:
            w = w[:1] * len(w)
        if style == "numbers":
            w = [str(rng.randrange(10**6)) if rng.random() < 0.2 else x for x in w]
        text = ("!! " if style == "shouted" else " ").join(w).capitalize()
        return text.upper() if style in ("upper", "shouted") else text

    def named(tag: str, name: str) -> str:
        """The tag's start without its label."""
        if naming == "none" and tag in BLOCKS - {"ul", "ol", "li", "p", "form", "fieldset", "footer"}:
            return f"<{rng.choice(['div', 'div', 'section', tag])}"
        if naming == "none":
            return f"<{tag}"
        if naming == "opaque":
            return f'<{rng.choice([tag, "div"]) if tag not in ("ul", "ol", "p") else tag} {rng.choice(["class", "id"])}="{rng.choice(["css-", "sc-", "u", "x", "b_", "jsx-"])}{rng.randrange(1 << 30):x}"'
        if naming == "wrong" and rng.random() < 0.5:
            other = rng.choice([CONTENT, *OUTSIDE.values()]).split(";")
            name = rng.choice(other).split(".")[1]
        key = rng.choice(["class", "class", "class", "id"])
        return f"<{tag}" + (f' {key}="{name}"' if name else "")

    def open_(spec: str, y: int) -> tuple[str, str]:
        start = named(*spec.split("."))
        return f'{start} data-y="{y}">', f"</{start[1:].split()[0]}>"

    def sentence(lo: int, hi: int) -> str:
        text = words(lo, hi)
        while rng.random() < 0.4 and len(text) > 30:
            text += rng.choice([". ", ". ", "; ", "? "]) + words(3, 14)
        return text if style == "unstopped" else text + rng.choice([".", ".", ".", ".", "?", "!", ""])

    def links(n: int) -> list[str]:
        return [f'<a href="/x">{words(1, 4)}</a>' for _ in range(n)]

    def aside(lo: int, hi: int) -> str:
        """A sentence that may lead elsewhere."""
        return sentence(lo, hi) + (f' <a href="/z">{words(1, 4)}</a>' if rng.random() < 0.25 else "")

    def other(kind: str, inside: bool = False) -> str:
        # A paragraph of an article that no name sets apart is one of its own.
        specs = [x for x in OUTSIDE[kind].split(";") if not (inside and naming != "usual" and x[:2] == "p.")]
        a, z = open_(rng.choice(specs), APART)
        form = rng.random()
        short = kind in ("menu", "sidebar", "footer", "social", "header")
        if a.startswith(("<ul", "<ol")) or (form < 0.35 and short):
            items = "".join(f'<li data-y="2">{x}</li>' for x in links(rng.randrange(2, 8)))
            return a + (items if a.startswith(("<ul", "<ol")) else f'<ul data-y="2">{items}</ul>') + z
        if form < 0.55 and short:
            return a + rng.choice([" | ", " ", " &middot; ", "<br>"]).join(links(rng.randrange(1, 9))) + z
        if kind == "footer" and form < 0.75:
            return a + f"&copy; 2020 {words(1, 5)} &middot; {sentence(2, 14)}" + z
        if kind == "form":
            return a + f'<label>{words(1, 4)}</label><input name="q"><button>Go</button> {sentence(1, 12)}' + z
        if kind == "comments" and not a.startswith("<p"):
            said = "".join(f'<div data-y="2"><p data-y="2">{rng.choice(["", "<b>" + words(1, 3) + "</b> "])}{aside(3, 30)}</p>{rng.choice(["", "<a href=/r>Reply</a>"])}</div>' for _ in range(rng.randrange(1, 6)))
            return a + (f'<h3 data-y="2">{rng.choice(["Comments", "3 comments", "Responses", "Discussion"])}</h3>' if rng.random() < 0.6 else "") + said + z
        if a.startswith("<p") or form < 0.55:
            return a + aside(2, 24) + z
        body = "".join(f'<{t} data-y="2">{aside(2, 24)}</{t}>' for t in rng.choices(["p", "p", "div", "h3", "h4"], k=rng.randrange(1, 4)))
        return a + body + z

    plain = naming in ("none", "opaque") or layout != "parts"
    # Some named articles have many short paragraphs; the same loose on a page would be anything.
    terse = not plain and naming == "usual" and rng.random() < 0.2

    def block() -> str:
        r = rng.random()
        if r < 0.66:
            inner = sentence(1, 7) if terse else sentence(1, 16) if rng.random() < 0.4 else sentence(8, 90)
            if rng.random() < 0.2:
                inner += f' <a href="/y">{words(1, 6)}</a>'
            return f'<p data-y="1">{inner}' + ("</p>" if rng.random() < 0.8 else "")
        if r < 0.76:
            t = rng.choice(["h2", "h3", "h4"])
            return f'<{t} data-y="1">{words(2, 9)}</{t}>'
        if r < 0.83:
            t = rng.choice(["ul", "ol"])
            return f'<{t} data-y="1">' + "".join(f'<li data-y="1">{sentence(2, 15)}</li>' for _ in range(rng.randrange(2, 6))) + f"</{t}>"
        if r < 0.88:
            return f'<blockquote data-y="1"><p data-y="1">{sentence(4, 30)}</p></blockquote>'
        if r < 0.92:
            rows = "".join('<tr data-y="1">' + "".join(f'<td data-y="1">{words(1, 4)}</td>' for _ in range(3)) + "</tr>" for _ in range(3))
            return f'<table data-y="1"><tbody data-y="1">{rows}</tbody></table>'
        if r < 0.95:
            return f'<figure data-y="1"><figcaption data-y="1">{sentence(3, 15)}</figcaption></figure>'
        if r < 0.97:
            return f'<pre data-y="1">{words(3, 30)}</pre>'
        return f'<div data-y="1">{sentence(5, 60)}</div>'

    inner = [f'<h1 data-y="1">{words(2, 10)}</h1>'] * (rng.random() < 0.7) + [block() for _ in range(rng.choice([1, 2, 2, 3, 5, 8] if not terse else [4, 12, 30]))]
    for kind in OUTSIDE:
        # What is set into the article of a page that names nothing can't be told from it, but for links.
        if kind != "header" and rng.random() < (0.22 if not plain else 0.05):
            inner.insert(rng.randrange(len(inner) + 1) if not plain else len(inner), "</p>" + other(kind, True))
    a, z = open_(rng.choice(CONTENT.split(";")), MAIN) if layout != "loose" else ("", "")
    main = a + "".join(inner) + "</p>" * (layout == "loose") + z
    if layout == "parts" and rng.random() < 0.15:
        b, y = open_(rng.choice(["div.row", "div.col", "div.inner", "section."]), MAIN)
        main = a + b + "".join(inner) + y + z
    before, after = [], []
    for kind in OUTSIDE:
        if rng.random() < full:
            early = kind in ("menu", "header") and rng.random() < 0.85 or kind not in ("footer", "comments") and rng.random() < 0.4
            (before if early else after).append(other(kind))
    rng.shuffle(before)
    if layout == "table":
        cell = lambda x, y: f'<td data-y="{y}">{x}</td>'
        before = [x if rng.random() < 0.5 else rng.choice([" | ", " ", "<br>"]).join(links(rng.randrange(1, 7))) for x in before]
        after = [x if rng.random() < 0.5 else rng.choice([f"&copy; 2020 {words(1, 5)}", sentence(2, 14), " ".join(links(3))]) for x in after]
        row = [cell(x, 2) for x in before] + [cell(main, rng.choice([0, 1]))] + [cell(x, 2) for x in after[:1]]
        page = f'<table width="100%"><tr>{"".join(row)}</tr>' + "".join(f'<tr><td data-y="2">{x}</td></tr>' for x in after[1:]) + "</table>"
    else:
        page = "".join([*before, main, *after])
    for name in ("container", "wrapper", "page", "row", "layout", "site", ""):
        if rng.random() < 0.2 and layout != "loose":
            page = f"{named('div', name)}>{page}</div>".replace("<section", "<div", 1)
    return f"<html><head><title>x</title></head><body>{page}</body></html>"


@lru_cache(maxsize=1)
def default_model(pages: int = 1000, seed: int = 2) -> Model:
    """A model trained on labelled pages that name and lay out their parts in the common ways, or without names, or wrongly."""
    rng = random.Random(seed)
    return train([parse(_labelled(rng)) for _ in range(pages)])


def extract_pages(sources: list[str], model: Model, cut: float = 0.5) -> list[str]:
    """The main text of each page: runs of text whose marginal of being part of it is over ``cut``, joined by empty lines."""
    pages = [parse(s, labelled=False) for s in sources]
    if not pages:
        return []
    f = Forest(pages, model.place)
    p, _ = f.marginals(model.weights, model.pairs)
    out = []
    for page, at in zip(pages, f.first):
        out.append("\n\n".join(t for k, t in enumerate(page.text) if t is not None and p[at + k, MAIN] > cut))
    return out


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``, from the whole html.

    Defined cases: null and empty html give an empty text; markup that isn't well-formed is read as
    far as it goes; repeated rows are treated alike; an empty table gives no rows; further columns
    are left out. Nothing is shuffled; the model has some hundred numbers.
    """
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            text = extract_pages([s or "" for s in part.column(2).to_pylist()], model)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
