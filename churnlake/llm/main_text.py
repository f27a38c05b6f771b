"""Main text of web pages by composite text density.

A page is read into a tree. Every node gets the characters per tag of its subtree, adjusted by
its share of link text; the density sum of a node adds the densities of its children, and the
node of the greatest sum under the body is selected. The least density on its path to the body
is the threshold: the selection climbs as long as the parent's other parts reach it. Menus,
headers, footers, side bars, notices, adverts, forms, scripts and comments of readers are left
out by element, role and class name. A page that names its article keeps it whole.

Null, empty and tagless html are defined: no text, no text, and one block of all the text.
Unclosed and misnested tags close as browsers close them. Repeated rows get equal texts. Extra
columns pass through unless they bear the name of a result.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object noembed noframes".split())
BLOCK = frozenset(("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form "
                   "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul").split())
CLOSES_P = BLOCK - {"body", "html", "dd", "dt", "li", "tr", "tbody", "tfoot", "thead", "caption", "legend"}
# An element that begins ends these open ones, up to the nearest of the second group.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "body": ({"head"}, set()),
}
NOISE_TAGS = frozenset("nav header footer aside form button select input label menu dialog fieldset head".split()) | RAW
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
STRONG = frozenset(("ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies "
                    "consent disqus gdpr masthead modal newsletter outbrain popup promo promotion promoted share sharing signup social sponsor "
                    "sponsored subscribe subscription taboola").split())
WEAK = frozenset(("copyright disclaimer footer foot header login menu menubar nav navbar navigation notice notices notification "
                  "pagination pager related recommended search sidebar sidenav skip tags toolbar toc topbar widget widgets").split())
CONTENT = frozenset("article body container content entry layout main page post story text with has wrapper".split())

_TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|!--|[!?][^>]*>)")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def _named_noise(attributes: str) -> bool:
    if "=" not in attributes and "hidden" not in attributes:
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name == "role" and value.lower() in NOISE_ROLES:
            return True
        if name in ("class", "id"):
            for one in value.split():
                parts = {p.lower() for p in _NAME.findall(one)}
                if parts & {"with", "has", "no"}:
                    continue
                if parts & STRONG or parts & WEAK and not parts & CONTENT:
                    return True
    return False


class Page:
    """The tree of a page: per node its parent, tag, noise flag, and texts and children in order."""

    def __init__(self, source: str):
        self.parent, self.tag, self.noise, self.inside = [-1], ["#page"], [False], [[]]
        self.opened: dict[str, int] = {}  # open elements by tag, so that no search walks up in vain
        self.read(source)

    def open(self, tag: str, at: int, noise: bool) -> int:
        n = len(self.tag)
        self.parent.append(at)
        self.tag.append(tag)
        self.noise.append(noise)
        self.inside.append([])
        self.inside[at].append(n)
        return n

    def up_to(self, at: int, tags, stop) -> int:
        """Close the nearest open element of ``tags`` below ``stop``, and what is open in it; the node that is open then."""
        if not any(self.opened.get(t) for t in tags):
            return at
        k = at
        while k > 0 and self.tag[k] not in stop:
            if self.tag[k] in tags:
                to = self.parent[k]
                while at != to:
                    self.opened[self.tag[at]] -= 1
                    at = self.parent[at]
                return to
            k = self.parent[k]
        return at

    def read(self, source: str) -> None:
        at, place, size = 0, 0, len(source)
        no_comment_end = False
        last = source.rfind(">")
        while place < size:
            lt = source.find("<", place)
            if lt < 0:
                lt = size
            if lt > place:
                self.inside[at].append(html.unescape(source[place:lt]))
            if lt == size:
                break
            if lt > last and not source.startswith("<!--", lt):
                self.inside[at].append(html.unescape(source[lt:]))
                break
            m = _TAG.match(source, lt) or _LOOSE.match(source, lt)
            if m is None:
                self.inside[at].append("<")
                place = lt + 1
                continue
            place = m.end()
            if m[0] == "<!--":
                end = -1 if no_comment_end else source.find("-->", place)
                no_comment_end = end < 0
                place = end + 3 if end >= 0 else size
                continue
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                at = self.up_to(at, {tag}, {"table"} if tag not in ("table", "body", "html", "article", "main", "div", "section") else ())
                continue
            if tag in CLOSES_P:
                at = self.up_to(at, {"p"}, {"td", "th", "table", "button"})
            if tag in ENDS:
                tags, stop = ENDS[tag]
                at = self.up_to(at, tags, stop)
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(source, place)
                if end is None:
                    place = size if tag in ("script", "style") else place
                else:
                    gt = source.find(">", end.start())
                    place = gt + 1 if gt >= 0 else size
                continue
            node = self.open(tag, at, tag in NOISE_TAGS or tag not in ("html", "body", "article", "main") and _named_noise(m[3]))
            if tag not in VOID:
                at = node
                self.opened[tag] = self.opened.get(tag, 0) + 1

    def select(self) -> int:
        """The node whose subtree is the main text."""
        n = len(self.tag)
        holds = [t in ("article", "main") for t in self.tag]
        chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        for k in range(n - 1, -1, -1):
            for x in self.inside[k]:
                if type(x) is str:
                    chars[k] += sum(map(len, x.split()))
            if self.tag[k] == "a":
                link_chars[k], link_tags[k] = chars[k], link_tags[k] + 1
            p = self.parent[k]
            if p < 0:
                continue
            if holds[k]:
                holds[p] = True
                self.noise[k] = self.noise[k] and self.tag[k] not in ("article", "main")
                self.noise[p] = self.noise[p] and self.tag[p] == "head"
            if not self.noise[k]:
                chars[p] += chars[k]
                tags[p] += tags[k] + 1
                link_chars[p] += link_chars[k]
                link_tags[p] += link_tags[k]
        body = self.tag.index("body") if "body" in self.tag else 0
        ratio = link_chars[body] / max(1, chars[body])
        density = [0.0] * n
        for k in range(n):
            c, lc = chars[k], link_chars[k]
            if c and not self.noise[k]:
                t = max(1, tags[k])
                base = math.log(c / max(1, c - lc) * lc + ratio * c + math.e)
                density[k] = c / t * math.log(max(1.0, c / max(1, lc) * t / max(1, link_tags[k])) + 1e-9) / math.log(max(base, 1.0001) + 1)
        sums = density[:]  # a leaf stands for its own text
        has = [False] * n
        for k in range(n - 1, 0, -1):
            p = self.parent[k]
            if not self.noise[k]:
                if not has[p]:
                    sums[p], has[p] = 0.0, True
                sums[p] += density[k]
        hidden = [False] * n
        for k in range(1, n):
            hidden[k] = self.noise[k] or hidden[self.parent[k]]
        within = [k for k in range(n) if not hidden[k] and (k >= body)]
        if not within:
            return 0
        best = max(within, key=lambda k: (sums[k], -k))
        path = [best]
        while path[-1] not in (body, 0):
            path.append(self.parent[path[-1]])
        named = [k for k in path if self.tag[k] in ("article", "main")]
        if named:
            return named[-1]
        least = min(density[k] for k in path)
        for k, p in zip(path, path[1:]):
            others = [x for x in self.inside[p] if type(x) is int and x != k and not self.noise[x]]
            loose = sum(sum(map(len, x.split())) for x in self.inside[p] if type(x) is str)
            if any(chars[x] and density[x] >= least for x in others) or loose:
                best = p
        return best

    def blocks(self, top: int) -> list[str]:
        """The text of each block under a node, in page order."""
        out: list[str] = []
        now: list[str] = []

        def flush() -> None:
            words = " ".join("".join(now).split())
            if words:
                out.append(words)
            now.clear()

        stack = [(top, iter(self.inside[top]))]
        while stack:
            k, rest = stack[-1]
            x = next(rest, None)
            if x is None:
                stack.pop()
                if self.tag[k] in BLOCK:
                    flush()
                elif self.tag[k] in ("td", "th"):
                    now.append(" ")
            elif type(x) is str:
                now.append(x)
            elif not self.noise[x]:
                if self.tag[x] in BLOCK:
                    flush()
                elif self.tag[x] == "br":
                    now.append(" ")
                stack.append((x, iter(self.inside[x])))
        flush()
        return out


def main_text(source: str | None) -> str:
    if not source:
        return ""
    page = Page(source)
    return "\n".join(page.blocks(page.select()))


def _texts(pages: pa.Array) -> pa.Array:
    return pa.array([main_text(h) for h in pages.to_pylist()], pa.string())


def extracted(source: str | Column) -> Column:
    return arrow_udf(_texts, "string")(source)


def extract(pages: DataFrame, source: str = "html") -> DataFrame:
    """``pages`` without the html, with the main ``text`` and its length ``n_chars``. Nothing is shuffled."""
    kept = [c for c in pages.columns if c not in (source, "text", "n_chars")]
    return pages.select(*kept, extracted(source).alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
