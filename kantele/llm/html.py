"""Main text of web pages by a tree-structured graphical model.

A page's block elements and text blocks form a tree; each node is content or not.
A node's features give its own potential, parent and child share a potential, and
sum-product messages up and down the tree give every node's marginal. The weights
are trained by exact likelihood on labelled pages, which ``labelled_pages`` makes:
no table has labels for pages.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache
from html import unescape
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .boosting import sigmoid
from .common import columns, sliced, texts

#: Fixed lists of element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea".split())
#: Elements that can stand in a paragraph and hold blocks.
EMBEDDED = frozenset("noscript iframe template svg object canvas audio video select".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small span "
    "strike strong sub sup time tt u var wbr nobr center "
    "math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mpadded mfenced semantics".split()
)
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
}
#: Kinds of nodes; an element of no list is a container.
KINDS = {
    "root": "html body", "article": "article main", "nav": "nav menu", "header": "header hgroup", "footer": "footer",
    "aside": "aside dialog", "form": "form button fieldset input option label", "paragraph": "p pre blockquote figure figcaption address",
    "heading": "h1 h2 h3 h4 h5 h6", "list": "ul ol dl", "item": "li dt dd", "table": "table tr td th thead tbody tfoot caption", "head": "head",
}
KIND = {tag: kind for kind, tags in KINDS.items() for tag in tags.split()}
NODE_KINDS = [*KINDS, "container", "text"]
NUMBER = {kind: i for i, kind in enumerate(NODE_KINDS)}
#: Fixed words of class, id and role values.
HINTS = {
    "good": "article content post entry story main body text prose",
    "page": "nav navbar navigation menu header masthead footer contentinfo banner breadcrumb breadcrumbs pagination pager toolbar topbar skip",
    "side": "sidebar aside side related recommended recommend more widget complementary trending popular tags",
    "ad": "ad ads advert advertisement adsense sponsor sponsored promo promotion",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay dialog subscribe newsletter signup login search form share social",
    "comment": "comment comments reply replies respond disqus discussion feedback",
}
HINT = {word: i for i, words in enumerate(HINTS.values()) for word in words.split()}
EXTRA = ["links", "hidden", "chars_log", "short", "sentence", "sign", "link_all", "plain_list", "marked_text"]
#: Kinds of parent and child that share a potential: an element in the root, in a
#: container or elsewhere, and a text.
PAIRS = 4
N_FEATURES = 1 + len(NODE_KINDS) + len(HINTS) + len(EXTRA)

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: Attributes up to the end of a tag, whose quoted values may hold the sign that ends it.
QUOTED = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
ATTRIBUTE = re.compile(r"""\b(class|id|role|data-content)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@lru_cache(1 << 14)
def hint_of(part: str) -> int | None:
    """The hint of a word, or of the longest fixed word of five letters or more that begins or ends it."""
    if part in HINT or len(part) > 40:
        return HINT.get(part)
    found = [word for word in HINT if len(word) >= 5 and (part.startswith(word) or part.endswith(word))]
    return HINT[max(found, key=len)] if found else None


class Scanner:
    """Tags of a page from left to right, in time linear in its length.

    A search that found no end of a tag, or no closing tag of a name, finds none
    further on either and isn't made again: after a tag whose quotes don't close,
    quotes no longer hide the sign that ends a tag.
    """

    def __init__(self, html: str):
        self.html = html
        self.quotes = True
        self.unclosed: set[str] = set()

    def end_of(self, start: int) -> int:
        """Behind the tag whose name ends at ``start``; -1 if it doesn't end."""
        if self.quotes:
            if found := QUOTED.match(self.html, start):
                return found.end()
            self.quotes = False
        return self.html.find(">", start) + 1 or -1

    def tags(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, closing, name, attributes) of the first tag or comment from ``at`` on.

        A comment, declaration or instruction has no name.
        """
        html = self.html
        while (start := html.find("<", at)) >= 0:
            if html.startswith("<!--", start):
                end = html.find("-->", start + 4)
                return start, (end + 3 if end >= 0 else len(html)), False, "", ""
            closing = html.startswith("/", start + 1)
            name = NAME.match(html, start + 1 + closing)
            if name or html.startswith(("<!", "<?"), start):
                end = self.end_of(name.end()) if name else html.find(">", start) + 1 or -1
                if end < 0:
                    # No tag ends from here on.
                    return None
                return start, end, closing, name.group().lower() if name else "", html[name.end() : end - 1] if name else ""
            at = start + 1
        return None

    def closed(self, name: str, at: int) -> int:
        """Behind the closing tag of that name; -1 if there is none."""
        if name not in self.unclosed:
            found = re.compile(f"</{re.escape(name)}", re.I).search(self.html, at)
            end = self.html.find(">", found.end()) + 1 if found else 0
            if end:
                return end
            self.unclosed.add(name)
        return -1


@dataclass
class Page:
    """Nodes of a page in document order; text nodes have a text."""

    parent: list[int]
    kind: list[int]
    hints: list[int]
    text: list[str | None]
    chars: list[int]
    linked: list[int]
    label: list[int]


def parse(html: str, labelled: bool = True) -> Page:
    """The block tree of a page, tolerant of unclosed and stray tags.

    Only pages of ``labelled_pages`` are ``labelled``: elsewhere ``data-content`` can hold anything.
    """
    page = Page([-1], [NUMBER["root"]], [0], [None], [0], [0], [0])
    stack: list[tuple[str, int]] = [("", 0)]  # name, node; inline elements share their block's node
    open_of: Counter[str] = Counter()  # open elements of each name
    run: list[str] = []
    linked = 0
    link_depth = 0

    def flush() -> None:
        nonlocal linked
        if run:
            joined = " ".join("".join(run).split())
            if joined:
                at = stack[-1][1]
                page.parent.append(at)
                page.kind.append(NUMBER["text"])
                page.hints.append(0)
                page.text.append(joined)
                page.chars.append(len(joined))
                page.linked.append(min(linked, len(joined)))
                page.label.append(page.label[at])
            run.clear()
        linked = 0

    def pop(to: int) -> None:
        nonlocal link_depth
        flush()
        for name, _ in stack[to:]:
            link_depth -= name == "a"
            open_of[name] -= 1
        del stack[to:]

    scanner = Scanner(html)
    at, end = 0, len(html)
    while at < end:
        tag = scanner.tags(at)
        start = tag[0] if tag else end
        if start > at:
            piece = html[at:start]
            piece = unescape(piece) if "&" in piece else piece
            run.append(piece)
            if link_depth > 0:
                linked += len(piece.strip())
        if tag is None:
            break
        _, at, closing, name, rest = tag
        if not name:
            continue
        if closing:
            inline = name in INLINE
            for i in range(len(stack) - 1 if open_of[name] else 0, 0, -1):
                if stack[i][0] == name:
                    if inline:
                        link_depth -= name == "a"
                        open_of[name] -= 1
                        del stack[i]
                    else:
                        pop(i)
                    break
                if inline and stack[i][0] not in INLINE:
                    break
            else:
                if not inline:
                    flush()
            continue
        if name in RAW and not rest.endswith("/"):
            close = scanner.closed(name, at)
            if close >= 0 or name in ("script", "style"):
                at = close if close >= 0 else end
                continue
        if name == "br":
            run.append(" ")
            continue
        if name in VOID:
            if name not in INLINE:
                flush()
            continue
        if name in INLINE:
            stack.append((name, stack[-1][1]))
            open_of[name] += 1
            link_depth += name == "a"
            continue
        # A block ends an open paragraph; items and cells end their like.
        closed, within = CLOSES.get(name, ((), ()))
        ends_some = name not in EMBEDDED and (open_of["p"] or any(open_of[c] for c in closed))
        for i in range(len(stack) - 1 if ends_some else 0, 0, -1):
            if stack[i][0] in closed or stack[i][0] == "p":
                pop(i)
                break
            if stack[i][0] not in INLINE and (not closed or stack[i][0] in within):
                break
        flush()
        parent = stack[-1][1]
        hints, label = 0, page.label[parent]
        if rest and "=" in rest or "hidden" in rest:
            for key, value in ATTRIBUTE.findall(rest):
                value = value.strip("\"'")
                if key.lower() == "data-content":
                    if labelled:
                        label = int(value)
                    continue
                for part in PART.findall(value):
                    hint = hint_of(part.lower())
                    if hint is not None:
                        hints |= 1 << hint
            if HIDDEN.search(rest):
                hints |= 1 << len(HINTS)
        page.parent.append(parent)
        page.kind.append(NUMBER[KIND.get(name, "container")])
        page.hints.append(hints)
        page.text.append(None)
        page.chars.append(0)
        page.linked.append(0)
        page.label.append(label)
        if not (rest.endswith("/") and name not in ("p", "div")):
            stack.append((name, len(page.parent) - 1))
            open_of[name] += 1
    pop(1)
    flush()
    return page


@dataclass
class Forest:
    """Trees of several pages in one set of arrays."""

    parent: np.ndarray
    levels: list[np.ndarray]
    features: np.ndarray
    pair: np.ndarray
    label: np.ndarray
    texts: list[str | None]
    page: np.ndarray


def forest(pages: list[Page]) -> Forest:
    sizes = np.array([len(p.parent) for p in pages])
    base = np.cumsum(sizes) - sizes
    parent = np.concatenate([np.array(p.parent) + b for p, b in zip(pages, base, strict=True)])
    roots = base
    parent[roots] = -1
    n = len(parent)
    kind, hints, chars, linked, label = (np.concatenate([np.array(getattr(p, f)) for p in pages]) for f in ("kind", "hints", "chars", "linked", "label"))
    found = [t for p in pages for t in p.text]
    depth = np.zeros(n, np.int64)
    for p, b in zip(pages, base, strict=True):
        level = [0] * len(p.parent)
        for i, above in enumerate(p.parent):
            if above >= 0:
                level[i] = level[above] + 1
        depth[b : b + len(level)] = level
    order = np.argsort(depth, kind="stable")
    counts = np.bincount(depth)
    levels = np.split(order, np.cumsum(counts)[:-1])
    all_chars, all_linked = chars.astype(float), linked.astype(float)
    for level in reversed(levels[1:]):
        np.add.at(all_chars, parent[level], all_chars[level])
        np.add.at(all_linked, parent[level], all_linked[level])
    is_text = kind == NUMBER["text"]
    share = all_linked / np.maximum(all_chars, 1)
    x = np.zeros((n, N_FEATURES))
    x[:, 0] = 1
    x[np.arange(n), 1 + kind] = 1
    at = 1 + len(NODE_KINDS)
    for i in range(len(HINTS)):
        x[:, at + i] = hints >> i & 1
    at += len(HINTS)
    ends = np.array([bool(t) and t[-1] in ".!?…:;\"'”»" for t in found])
    sign = np.array([bool(t) and ("©" in t or "(c)" in t.lower()) for t in found])
    for i, column in enumerate(
        (share, hints >> len(HINTS) & 1, np.log1p(all_chars) / 6, is_text & (chars < 25), is_text & ends, sign, (share > 0.9) & (all_chars > 0), ((kind == NUMBER["list"]) | (kind == NUMBER["item"])) & (share < 0.3),
         ((kind == NUMBER["paragraph"]) | (kind == NUMBER["heading"])) & (hints & (1 << len(HINTS)) - 1 > 0))
    ):
        x[:, at + i] = column
    above = kind[np.maximum(parent, 0)]
    pair = np.where(is_text, 3, np.where(above == NUMBER["root"], 0, np.where(above == NUMBER["container"], 1, 2)))
    return Forest(parent, levels, x, pair, label, found, np.repeat(np.arange(len(pages)), sizes))


def _joint(a: np.ndarray) -> np.ndarray:
    """log(exp(a0) + exp(a1)) over the last axis."""
    top = a.max(axis=-1)
    return top + np.log1p(np.exp(a.min(axis=-1) - top))


@dataclass
class TreeModel:
    """Weights of a node's own potential, and of parent and child: pairs[kind, parent, child]."""

    own: np.ndarray
    pairs: np.ndarray

    def marginals(self, f: Forest) -> tuple[np.ndarray, np.ndarray]:
        """(P(content) of every node, P(parent, child) of every node but roots)."""
        n = len(f.parent)
        up = np.zeros((n, 2))
        up[:, 1] = f.features @ self.own
        message = np.zeros((n, 2))
        for level in reversed(f.levels[1:]):
            message[level] = _joint(up[level][:, None, :] + self.pairs[f.pair[level]])
            np.add.at(up, f.parent[level], message[level])
        total = up.copy()
        joint = np.zeros((n, 2, 2))
        for level in f.levels[1:]:
            above = total[f.parent[level]] - message[level]
            both = above[:, :, None] + self.pairs[f.pair[level]] + up[level][:, None, :]
            joint[level] = both
            top = both.max(axis=1)
            total[level] = top + np.log(np.exp(both - top[:, None, :]).sum(axis=1))
        content = sigmoid(total[:, 1] - total[:, 0])
        inner = np.concatenate(f.levels[1:]) if len(f.levels) > 1 else np.zeros(0, np.int64)
        flat = joint[inner].reshape(-1, 4)
        flat = np.exp(flat - flat.max(axis=1, keepdims=True)) if len(flat) else flat
        joint[inner] = (flat / flat.sum(axis=1, keepdims=True)).reshape(-1, 2, 2)
        return content, joint


def train(pages: list[Page], steps: int = 1500, rate: float = 1.0, penalty: float = 0.03) -> TreeModel:
    """Maximum likelihood of labelled pages by adaptive gradient steps; exact marginals."""
    f = forest(pages)
    y = f.label.astype(float)
    inner = f.parent >= 0
    model = TreeModel(np.zeros(N_FEATURES), np.zeros((PAIRS, 2, 2)))
    seen = np.zeros((PAIRS, 2, 2))
    np.add.at(seen, (f.pair[inner], f.label[f.parent[inner]], f.label[inner]), 1)
    squares = [np.zeros_like(model.own), np.zeros_like(model.pairs)]
    for _ in range(steps):
        content, joint = model.marginals(f)
        expected = np.zeros((PAIRS, 2, 2))
        np.add.at(expected, f.pair[inner], joint[inner])
        for weights, grad, square in zip((model.own, model.pairs), (f.features.T @ (y - content), seen - expected), squares, strict=True):
            grad = grad - penalty * weights
            square += grad**2
            weights += rate * grad / np.sqrt(square + 1e-9)
    return model


def labelled_pages(n: int = 500, seed: int = 7) -> Iterator[str]:
    """Invented pages whose ``data-content`` attributes say what is content (1) and what not (0).

    They vary in markup: with and without sectioning elements, in wrappers, with
    unclosed tags, and with notices, adverts, forms, related links and comments
    before, inside and after the article.
    """
    draw = np.random.default_rng(seed)
    letters = "ba de ki lo mu ra se ti vo na pe ru".split()

    def chance(p: float) -> bool:
        return bool(draw.random() < p)

    def one(*choices: str) -> str:
        return choices[int(draw.integers(len(choices)))]

    def words(low: int, high: int) -> str:
        found = ["".join(draw.choice(letters, int(draw.integers(1, 4)))) for _ in range(int(draw.integers(low, high)))]
        return " ".join(found)

    def sentence(low: int = 4, high: int = 18) -> str:
        return words(low, high).capitalize() + one(".", ".", ".", "!", "?", "")

    def paragraph() -> str:
        kind = draw.random()
        if kind < 0.15:
            inner = sentence(1, 4)
        elif kind < 0.25:
            inner = words(30, 200)
        else:
            inner = " ".join(sentence() for _ in range(int(draw.integers(1, 6))))
        if chance(0.2):
            inner += f' <a href="/x">{words(1, 4)}</a> {sentence()}'
        if chance(0.15):
            inner = f"<b>{words(1, 3)}</b> {inner}<br>{sentence()}"
        if chance(0.06):
            # Names on single paragraphs say little.
            return f'<p class="{one("lead", "more", "read-more", "story", "text", "share-text", "popular", "side-note")}">{inner}</p>'
        return one(f"<p>{inner}</p>", f"<p>{inner}</p>", f"<p>{inner}", f"<p><b>{inner}<br>")

    def links(low: int = 2, high: int = 9) -> str:
        items = "".join(f'<li><a href="/{words(1, 2)}">{words(1, 4)}</a></li>' for _ in range(int(draw.integers(low, high))))
        return f"<ul>{items}</ul>"

    def off(tag: str, inner: str, *names: str) -> str:
        mark = one(f' class="{one(*names)}"', f' id="{one(*names)}"') if names else ""
        return f'<{tag}{mark} data-content="0">{inner}</{tag}>'

    def nav() -> str:
        return one(off("nav", links()), off("div", links(), "nav", "menu", "main-menu", "navbar", "breadcrumbs"), off("nav", links(), "site-nav"))

    def ad() -> str:
        return one(
            off("div", sentence(), "ad", "ads", "advert", "ad-slot", "sponsored", "promo"), off("aside", sentence(), "ad", "advertisement"),
            off("div", f'<a href="/buy">{words(2, 6)}</a>', "ad", "adBox", "sponsor"), off("section", f"<p>{sentence()}</p>", "advertisement", "promo"),
        )

    def notice() -> str:
        text = f"<p>{sentence(6, 20)}</p>" if chance(0.5) else sentence(6, 20)
        return off(one("div", "section", "aside"), text + f"<button>{words(1, 2)}</button>", "cookie-notice", "notice", "consent", "cookie-banner", "alert", "popup")

    def form() -> str:
        inner = f'<label>{words(1, 3)}</label><input name="q"><button>{words(1, 2)}</button>'
        return one(f'<form data-content="0">{inner}</form>', off("div", f"<p>{sentence()}</p><form>{inner}</form>", "newsletter", "subscribe", "search", "signup"))

    def aside() -> str:
        inner = one(f"<h3>{words(1, 4)}</h3>{links()}", f"<p>{sentence()}</p>{links()}", f"<h2>{words(1, 3)}</h2><p>{sentence()}</p>")
        return one(off("aside", inner), off("aside", inner, "sidebar"), off("div", inner, "sidebar", "side", "related", "widget", "recommended"))

    def comments() -> str:
        each = "".join(
            one(f'<div class="comment"><p>{sentence()} {sentence()}</p></div>', f"<li><b>{words(1, 2)}</b><p>{sentence()}</p></li>", f"<p>{sentence()}</p>")
            for _ in range(int(draw.integers(1, 6)))
        )
        if chance(0.25):
            # A heading of their own beside the list of comments.
            return off("h3", words(1, 4), "comments", "replies") + off("ol", each, "comment-list", "comments")
        return one(off("section", f"<h2>{words(1, 3)}</h2>{each}", "comments", "comment-list", "reader-comments"), off("div", f"<h3>{words(1, 2)}</h3><ol>{each}</ol>", "comments", "responses reply", "disqus"))

    def hidden() -> str:
        how = one('style="display:none"', "hidden", 'aria-hidden="true"')
        return f'<{(tag := one("div", "p"))} {how} data-content="0">{sentence()}</{tag}>'

    def footer() -> str:
        inner = one(f"&copy; {words(1, 3)} &middot; {sentence()}", f"<p>{sentence()}</p>{links()}", f"{links()}<p>&copy; 2020 {words(1, 3)}</p>", sentence())
        return one(off("footer", inner), off("div", inner, "footer", "site-footer"), off("footer", inner, "footer"))

    def body() -> str:
        parts = [f"<h1>{one(words(2, 9), sentence())}</h1>"] if chance(0.85) else []
        if parts and chance(0.12):
            parts = [f"<header>{parts[0]}</header>"]
        for _ in range(int(draw.integers(1, 3) if chance(0.35) else draw.integers(1, 8))):
            kind = draw.random()
            if kind < 0.72:
                parts.append(paragraph())
            elif kind < 0.78:
                parts.append(f"<h2>{words(1, 6)}</h2>")
            elif kind < 0.84:
                # Items may be as short as those of a menu, but are no links.
                short = chance(0.4)
                items = "".join(f"<li>{words(1, 5) if short else sentence()}{one('</li>', '')}" for _ in range(int(draw.integers(2, 8))))
                tag = one("ul", "ul", "ol")
                parts.append((f"<h3>{words(1, 3)}</h3>" if chance(0.3) else "") + f"<{tag}>{items}</{tag}>")
            elif kind < 0.87:
                parts.append(f"<blockquote>{one(paragraph(), sentence())}</blockquote>")
            elif kind < 0.90:
                rows = "".join(f"<tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr>" for _ in range(int(draw.integers(2, 5))))
                parts.append(f"<table>{rows}</table>")
            elif kind < 0.93:
                parts.append(f"<pre>{words(2, 9)}\n  {words(2, 5)}</pre>")
            elif kind < 0.96:
                parts.append(f"<div>{paragraph()}{sentence()}</div>")
            else:
                parts.append(f'<figure><img src="x.png"><figcaption>{sentence()}</figcaption></figure>')
            if chance(0.15):
                parts.append(one(ad, aside, form, notice, hidden, comments)())
        if chance(0.08):
            parts += [f"<p>{sentence(1, 4)}</p>" for _ in range(int(draw.integers(20, 120)))]
        if chance(0.1):
            parts.append(off("div", links(1, 4), "share", "social", "tags", "related"))
        if chance(0.08):
            parts.append(off("footer", one(sentence(2, 6), f"<p>{sentence(2, 6)}</p>", links(1, 4))))
        return "".join(parts)

    def article() -> str:
        kind = draw.random()
        inner = body()
        if kind < 0.6:
            name = one("", "", ' class="post"', ' class="article"', ' id="story"', ' class="entry-content"')
            return f'<article{name} data-content="1">{inner}</article>'
        if kind < 0.75:
            return f'<main data-content="1">{inner}</main>'
        if kind < 0.92:
            return f'<div {one("class", "id")}="{one("content", "post", "article-body", "entry", "main-content", "story", "text")}" data-content="1">{inner}</div>'
        return f'<div data-content="1">{inner}</div>'

    def link_row() -> str:
        return one(" ", " | ", " &middot; ").join(f'<a href="/{i}">{words(1, 3)}</a>' for i in range(int(draw.integers(2, 7))))

    def closing_line() -> str:
        return one(f"&copy; {words(1, 4)}", f"(c) 19{int(draw.integers(90, 99))} {words(1, 3)}", f"Copyright {int(draw.integers(1995, 2020))} {words(1, 3)}", link_row())

    def plain_page() -> str:
        """Blocks without names: only what stands in them tells."""
        heading = one("<h1>{}</h1>", "<h2>{}</h2>", "<div><b>{}</b></div>", "<div>{}</div>").format(words(2, 8))
        tag = one("div", "div", "p", "section")
        texts = "".join(f"<{tag}>{' '.join(sentence() for _ in range(int(draw.integers(1, 6))))}</{tag}>" for _ in range(int(draw.integers(1, 9))))
        before = f'<div data-content="0">{link_row()}</div>' if chance(0.7) else ""
        after = f'<div data-content="0">{closing_line()}</div>' if chance(0.7) else ""
        if chance(0.25):
            return f'<div data-content="1">{before}{heading}{texts}{after}</div>'
        return f'{before}<div data-content="1">{heading}{texts}</div>{after}'

    def table_page() -> str:
        """A table that lays out the page."""

        def off_cell(inner: str, span: str = "") -> str:
            return f'<td{span} data-content="0">{inner}</td>'

        texts = "".join(f"<p>{' '.join(sentence() for _ in range(int(draw.integers(1, 5))))}" for _ in range(int(draw.integers(1, 6))))
        main = f'<td data-content="1">{one("<h1>{}</h1>", "<h2>{}</h2>", "<b>{}</b><br>").format(words(2, 7))}{texts}</td>'
        side = off_cell(one(links(), "<br>".join(f'<a href="/{i}">{words(1, 2)}</a>' for i in range(5))))
        cells = one(side + main, main + side, main)
        top = f"<tr>{off_cell(link_row(), ' colspan=2')}</tr>" if chance(0.7) else ""
        end = f"<tr>{off_cell(closing_line(), ' colspan=2')}</tr>" if chance(0.7) else ""
        return f"<table>{top}<tr>{cells}</tr>{end}</table>"

    for _ in range(n):
        if chance(0.12):
            yield f"<html><head><title>{words(2, 5)}</title></head><body>{one(plain_page, plain_page, table_page)()}" + one("</body></html>", "")
            continue
        before = [f() for f in (notice, nav, ad, form) if chance(0.4)]
        if chance(0.4):
            name = one(f"<h2>{words(1, 3)}</h2>", f'<a href="/">{words(1, 3)}</a>', f'<h1><a href="/">{words(1, 4)}</a></h1>', f"<h1>{words(1, 4)}</h1>")
            top = name + (f"<p>{sentence(2, 6)}</p>" if chance(0.5) else "")
            before.append(one(off("header", top + (nav() if chance(0.5) else "")), off("div", top, "header", "masthead", "topbar")))
        after = [f() for f in (aside, comments, ad, notice, hidden) if chance(0.4)] + ([footer()] if chance(0.8) else [])
        draw.shuffle(before)
        inner = "".join(before) + article() + "".join(after)
        bare = chance(0.08)
        if bare:
            # Content lies in the body itself, between blocks that are none.
            inner = "".join(before) + body() + "".join(after)
        elif chance(0.3):
            inner = f'<div {one("id", "class")}="{one("page", "wrapper", "container")}">{inner}</div>'
        elif chance(0.12):
            inner = "".join(before) + '<main data-content="1">' + article() + "</main>" + "".join(after)
        head = f"<head><title>{words(2, 6)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        mark = ' data-content="1"' if bare else ""
        yield f"<!DOCTYPE html><html>{head}<body{mark}>{inner}" + one("</body></html>", "")


#: Labelled pages on which the model is trained.
TRAINING_PAGES = 600
#: The trained weights, made by ``python -m kantele.llm.html``.
WEIGHTS = Path(__file__).with_name("html_weights.json")


def fitted() -> TreeModel:
    """The model of the labelled pages, trained anew."""
    return train([parse(x) for x in labelled_pages(TRAINING_PAGES)])


@cache
def trained() -> TreeModel:
    """The model of the labelled pages, as it was trained and written to WEIGHTS."""
    found = json.loads(WEIGHTS.read_text())
    return TreeModel(np.array(found["own"]), np.array(found["pairs"]))


def main_texts(column: pa.Array, model: TreeModel) -> list[str]:
    """The main text of every page: content blocks in page order, one on a line."""
    pages = [parse(x, labelled=False) for x in texts(column).to_pylist()]
    if not pages:
        return []
    f = forest(pages)
    content, _ = model.marginals(f)
    out: list[list[str]] = [[] for _ in pages]
    for at in np.flatnonzero(content >= 0.5):
        if f.texts[at] is not None:
            out[f.page[at]].append(f.texts[at])
    return ["\n".join(x) for x in out]


def extract(df: DataFrame, model: TreeModel | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row.

    ``text``: the content blocks, character references decoded, white space within a
    block as one space, blocks joined by a line feed. Null and empty pages, and
    pages without content, have the empty text. Never content: comments, and what
    script, style, title and textarea hold; a script or style that isn't closed runs to
    the end of the page, as in browsers. Null ids and repeated rows are kept;
    other columns take no part; an empty table gives no row. One narrow pass.
    """
    model = model or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "html", 4 << 20):
                found = main_texts(part.column("html"), model)
                arrays = [part.column("page_id"), part.column("url"), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "text", "n_chars"])

    return columns(df, page_id=id_col, url=url_col, html=html_col).mapInArrow(run, "page_id long, url string, text string, n_chars long")


if __name__ == "__main__":
    made = fitted()
    WEIGHTS.write_text(json.dumps({"own": made.own.round(9).tolist(), "pairs": made.pairs.round(9).tolist()}, indent=1) + "\n")
