"""Main text of a web page by tag-path ratios.

Text nodes are grouped by their root-to-leaf tag path. Each path has its text length and its
punctuation per node; both follow the page's node order, are smoothed with a Gaussian, fused by
product and averaged back to paths. Paths above a threshold from their spread are content, and
the element that holds them carries its other paths along, so that short headings and
paragraphs of the article stay. Three kinds of parts are told apart:

* boilerplate by its element or role takes no part;
* comments, adverts, notices, sign-in forms and the like, by their class or id, take no part
  however long they are, unless the page's only article or its main element lies inside;
* parts that only a word of layout, or a form around them, speaks against take no part either,
  unless they hold most of the remaining text and punctuation or of the article: then their
  ratios are lowered.

Paths are nodes of a trie in which children follow their parents, so that sums over parts and
what a part passes on to its inside are one pass each: a page takes time linear in its length,
however deep it is nested.
"""

from __future__ import annotations

import html
import re
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import map_texts

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|textarea|title|noscript|iframe|xmp|noembed|noframes|template)(?=[\s/>])[^>]*+>.*?(?:</\1\s*+>|\Z)"
    r"""|<(/?)([a-z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>"""
    r"|<[!?/][^>]*+>"
    r"|<(/?)([a-z][^\s/>]*+)([^>]*+)>"
    r"|</?[a-z][^>]*+\Z",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|style|hidden|aria-hidden|action)(?![\w-])(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_KIND = re.compile(r"""(?<![\w-])type\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")

#: Elements of HTML by their kind.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr picture source".split()
)
_NO_CONTENT = frozenset(
    "head nav footer aside button select option datalist fieldset legend dialog menu svg math canvas object "
    "applet audio video map meter progress output".split()
)
_LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table tbody thead tfoot tr td th figure figcaption caption center address hgroup details summary header".split())
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dt dd td th tr".split()
)
_CLOSES_ITSELF = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",)}
_SCOPE = frozenset("ul ol dl table div section article main body html td th".split())
_BAD_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar".split())
#: Words of class and id that speak against a part, and those that most of the page's text overrules.
_NEVER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot sponsor sponsored promo promotion "
    "nav navbar navigation submenu breadcrumb breadcrumbs pagination pager footer "
    "related recommended recommendations outbrain taboola "
    "comment comments commentlist disqus respond reply replies "
    "cookie cookies consent gdpr notice notices notification notifications popup newsletter subscribe subscription "
    "signup signin login logon register registration paywall share sharing".split()
)
_LAYOUT_WORDS = frozenset(
    "banner menu menubar toc foot sidebar side aside widget widgets trending popular promoted discussion "
    "alert modal overlay social toolbar search masthead skip".split()
)
#: A class name with one of these tells of a state of the page, not of what the part is.
_STATE_WORDS = frozenset("has have no not non with without show shows hide hides open opened closed enabled disabled free status given accepted count".split())
#: Elements that ask for an entry, and kinds of input that do not.
_FIELDS = frozenset("input select textarea".split())
_NO_FIELD = frozenset("hidden submit button image reset search".split())
#: Characters of text for each field of a form that is only the frame of a page, at least.
_TEXT_PER_FIELD = 200
#: Factor on the ratio of a part that its class, id or form speaks against.
_LOWERED = 0.25
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


def _names(value: str) -> set[str]:
    """Words of a class or id list, also two neighbouring ones as one (sign-in, log-in)."""
    out: set[str] = set()
    for name in value.split():
        words = [w.lower() for w in _WORDS.findall(name)]
        if not _STATE_WORDS.intersection(words):
            out.update(words)
            out.update(a + b for a, b in zip(words, words[1:], strict=False))
    return out


def _boilerplate(tag: str, attributes: str, within: bool) -> tuple[bool, bool, frozenset[str]]:
    """Is this element, by itself, none of the article; does a word rule it out; which only speak against it?

    ``within``: inside article or main.
    """
    against = {"form"} if tag == "form" else set()
    never = False
    if tag in _NO_CONTENT or (tag == "header" and not within):
        return True, False, frozenset()
    if not attributes:
        return False, False, frozenset(against)
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True, False, frozenset()
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, False, frozenset()
        if name == "role" and value.lower() in _BAD_ROLES:
            return True, False, frozenset()
        if (name in ("class", "id") and tag not in ("html", "body", "main")) or (name == "action" and tag == "form"):
            words = _names(value)
            never = never or not _NEVER_WORDS.isdisjoint(words)
            if tag != "article" and name != "action":
                against |= words & _LAYOUT_WORDS
                if not within and "header" in words:
                    against.add("header")
        if name == "role" and value.lower() == "form":
            against.add("form")
    return False, never, frozenset(against)


class _Paths:
    """Tag paths of a page as a trie; node 0 is the empty path, parents come before their children."""

    def __init__(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.parent = [0]
        self.tag = [""]
        self.hard = [False]
        self.never = [False]
        self.marked = [False]
        self.within = [False]
        self.mains = [0]
        self.articles = [0]
        self.fields: dict[int, int] = {}

    def child(self, at: int, tag: str, hard: bool, never: bool, against: frozenset[str]) -> int:
        """The path of an element below ``at``; equal tags with other words are paths of their own."""
        dead, within = self.hard[at] or hard, self.within[at]
        # every frame of a page and everything ruled out stands alone, all else shares its path
        alone = len(self.parent) if not dead and (never or "form" in against or (tag in ("article", "main") and not within)) else -1
        key = (at, tag, dead, against, alone)
        node = self.numbers.get(key)
        if node is None:
            node = self.numbers[key] = len(self.parent)
            self.parent.append(at)
            self.tag.append(tag)
            self.hard.append(dead)
            self.never.append(never and not dead)
            self.marked.append(bool(against) and not dead)
            self.within.append(within or tag in ("article", "main"))
            outermost = not dead and not never and not within
            self.mains.append(int(outermost and tag == "main"))
            self.articles.append(int(outermost and tag == "article"))
            if "form" in against:
                self.fields[node] = 0
        return node

    def upward(self, own: Sequence[float]) -> list[float]:
        """Sums over each node and all below it."""
        out = list(own)
        for node in range(len(out) - 1, 0, -1):
            out[self.parent[node]] += out[node]
        return out


#: Path, text and number of punctuation marks of a block.
Block = tuple[int, str, int]
#: What an opening tag may close, by the bit that says such an element is open here.
_BITS = {t: 1 << i for i, t in enumerate(("p", "li", "dt", "dd", "td", "th", "tr", "option"))}


def blocks_of(page: str) -> tuple[_Paths, list[Block]]:
    """The paths of a page and all its blocks of text, in page order."""
    paths = _Paths()
    # tag, path, which elements that close themselves are open in this scope, the form around
    stack: list[tuple[str, int, int, int]] = [("", 0, 0, 0)]
    opened: dict[str, int] = {}
    out: list[Block] = []
    piece: list[str] = []

    def close() -> None:
        if piece:
            text = " ".join(html.unescape("".join(piece)).split())
            piece.clear()
            if text:
                out.append((stack[-1][1], text, len(_PUNCTUATION.findall(text))))

    def pop(tag: str) -> None:
        """Up to and with the innermost open ``tag``."""
        while True:
            last = stack.pop()[0]
            opened[last] -= 1
            if last == tag:
                return

    def push(tag: str, attributes: str) -> None:
        _, at, bits, form = stack[-1]
        hard, never, against = _boilerplate(tag.lstrip("~"), attributes, paths.within[at])
        node = paths.child(at, tag, hard, never, against)
        if tag in ("ul", "ol", "dl", "table"):
            bits = 0
        if tag in _SCOPE:
            bits &= ~_BITS["p"]
        stack.append((tag, node, bits | _BITS.get(tag, 0), node if node in paths.fields else form))
        opened[tag] = opened.get(tag, 0) + 1

    def field(tag: str, attributes: str) -> None:
        form = stack[-1][3]
        if tag in _FIELDS and form:
            kind = _KIND.search(attributes)
            kind = kind[1].strip("\"'").lower() if kind else "text"
            if kind == "password":
                paths.never[form] = True
            elif kind not in _NO_FIELD:
                paths.fields[form] += 1

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            piece.append(page[at : m.start()])
        at = m.end()
        if m[1] and m[1].lower() == "textarea":
            field("textarea", "")
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            continue
        if tag == "br":
            piece.append(" ")
            continue
        ends = bool(m[2] or m[5])
        attributes = m[4] or m[7] or ""
        if not ends:
            field(tag, attributes)
        if tag in _INLINE:
            # only what hides an inline element, or a word against it, matters for the path
            if ends:
                if stack[-1][0] == "~" + tag:
                    close()
                    pop("~" + tag)
            elif tag not in _VOID and attributes and not attributes.endswith("/"):
                if any(_boilerplate(tag, attributes, paths.within[stack[-1][1]])):
                    close()
                    push("~" + tag, attributes)
            continue
        close()
        if ends:
            if opened.get(tag):
                pop(tag)
            continue
        if tag in _CLOSES_P and stack[-1][2] & _BITS["p"]:
            pop("p")
        for other in _CLOSES_ITSELF.get(tag, ()):
            if stack[-1][2] & _BITS[other]:
                pop(other)
        if tag == "body":
            while opened.get("head"):
                pop("head")
        if tag not in _VOID:
            push(tag, attributes)
    if at < len(page):
        piece.append(page[at:])
    close()
    return paths, out


def _judged(paths: _Paths, blocks: Sequence[Block]) -> tuple[list[bool], list[bool]]:
    """Of every path: does it take no part, and is its ratio lowered?"""
    count = len(paths.parent)
    mains, articles = paths.upward(paths.mains), paths.upward(paths.articles)

    def frame(node: int) -> bool:
        """All that the page marks as its article lies inside."""
        inside = mains[node] == mains[0] > 0 if mains[0] else articles[node] == articles[0] == 1
        return inside and not paths.within[paths.parent[node]]

    # an article with such a word in its class is the article if the page has no other
    lone = mains[0] + articles[0] == 0 and sum(paths.never[n] and paths.tag[n] == "article" and not paths.within[paths.parent[n]] for n in range(count)) == 1
    dead = list(paths.hard)
    for n in range(1, count):
        kept = lone and paths.tag[n] == "article" and not paths.within[paths.parent[n]]
        dead[n] |= dead[paths.parent[n]] or (paths.never[n] and not kept and not frame(n))
    own = np.zeros((3, count))
    for node, text, dots in blocks:
        if not dead[node]:
            own[:, node] += (len(text), dots, len(text) if paths.within[node] else 0)
    size, dots, inner = (paths.upward(row.tolist()) for row in own)
    lowered = [False] * count
    out = list(dead)
    for n in range(1, count):
        up = paths.parent[n]
        lowered[n] = lowered[up] or paths.marked[n]
        out[n] |= out[up]
        if paths.marked[n]:
            most = (2 * size[n] > size[0] and 2 * dots[n] > dots[0]) or 2 * inner[n] > inner[0]
            form = n in paths.fields and size[n] < _TEXT_PER_FIELD * paths.fields[n]
            out[n] |= form or not most
    if all(out[node] for node, _, _ in blocks):
        # nothing else is left: words of layout alone take no page away
        out = [d or (n in paths.fields and size[n] < _TEXT_PER_FIELD * paths.fields[n]) for n, d in enumerate(dead)]
        for n in range(1, count):
            out[n] |= out[paths.parent[n]]
    return out, lowered


def _smooth(x: np.ndarray, radius: int = 1) -> np.ndarray:
    kernel = np.exp(-np.arange(-radius, radius + 1) ** 2 / 2.0)
    return np.convolve(np.pad(x, radius, mode="edge"), kernel / kernel.sum(), mode="valid")


def path_scores(paths: _Paths, blocks: Sequence[Block], dead: Sequence[bool], lowered: Sequence[bool]) -> dict[int, float]:
    """Fused, smoothed ratio of every path that takes part."""
    count = len(paths.parent)
    at = np.array([b[0] for b in blocks])
    out = np.array(dead)
    nodes = np.bincount(at, minlength=count)
    lengths = np.bincount(at, [len(b[1]) for b in blocks], count) * ~out
    marks = np.bincount(at, [b[2] for b in blocks], count) * ~out
    size = _smooth(lengths[at] / nodes[at]) * ~out[at]
    dots = _smooth(marks[at] / nodes[at]) * ~out[at]
    fused = size * (1 + dots) * np.where(np.array(lowered)[at], _LOWERED, 1.0)
    # an element that says it is the article outweighs what stands around it
    mean = np.bincount(at, fused, count) / np.maximum(nodes, 1) * np.where(paths.within, 16.0, 1.0)
    return {int(n): float(mean[n]) for n in np.flatnonzero((nodes > 0) & ~out)}


def main_text(page: str) -> str:
    """The article's blocks, joined by line feeds."""
    paths, blocks = blocks_of(page)
    if not blocks:
        return ""
    dead, lowered = _judged(paths, blocks)
    scores = path_scores(paths, blocks, dead, lowered)
    if not scores:
        return ""
    values = np.array(list(scores.values()))
    most = values.max()
    threshold = min(most, max(values.std(), 0.1 * most))
    # the element around the text blocks of a path
    around = list(range(len(paths.parent)))
    for n in range(1, len(around)):
        if not paths.marked[n] and (paths.tag[n] in _LEAVES or paths.tag[n].startswith("~")):
            around[n] = around[paths.parent[n]]
    chosen = [False] * len(around)
    for n, value in scores.items():
        if value >= threshold:
            chosen[around[n]] = True
    for n in range(1, len(around)):
        chosen[n] = chosen[n] or (chosen[paths.parent[n]] and not paths.marked[n])
    return "\n".join(text for node, text, _ in blocks if chosen[node] and not dead[node])


def extract(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    """``key``, ``url``, ``text`` and ``n_chars`` (code points) of every page.

    A null or empty page gives an empty text. Nothing is cut from long pages; repeated pages
    give repeated rows.
    """

    def work(cols: dict) -> dict:
        found = [main_text(x) if x else "" for x in cols[column]]
        return {key: cols[key], "url": cols["url"], "text": found, "n_chars": [len(t) for t in found]}

    kinds = dict(pages.dtypes)
    return map_texts(
        pages.select(F.col(key), F.col("url"), F.col(column)), work,
        f"`{key}` {kinds[key]}, url {kinds['url']}, text string, n_chars bigint",
    )
