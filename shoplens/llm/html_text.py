"""Main text of web pages by text-to-tag ratio.

The standard library's streaming parser turns a page into lines: a new line
begins at every block element and line break.  A line's ratio is its text
outside links over its tags.  The ratios are smoothed with a Gaussian kernel, a
two-means threshold on the smoothed values marks the dense lines, and runs of
dense lines form clusters; the content region starts from the smallest container
element that holds most of the dense text and grows to the whole article: to the
outermost article (or main) around it and on to all dense lines that stand in an
article or main, or, on pages that mark neither, to all dense lines.  The
text of an inline element that is skipped goes, the block around it stays one
line.  Every line of the region is kept - short paragraphs included - except those inside elements
that are never article text (menus, footers, forms, scripts, adverts, notices,
comments ..., by element, role or class words).  Class and id words never flag the
page's html, body, main or article, and neither they nor a form flag an element
that holds most of the page's dense text, unless an article or main beside it
holds text.

Defined results: null or empty html gives an empty text; pages whose region
has no text give an empty text; one output row per input row.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import batch_of, map_batches

BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
                   "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre "
                   "section summary table tbody td tfoot th thead tr ul br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("article main section div body td".split())
MARKED = frozenset(["article", "main"])
PAGE = frozenset(["html", "body"])
CLOSED_BY_BLOCK = frozenset(["p"])
SKIPPED = frozenset("head script style noscript template nav footer aside button select textarea iframe object "
                    "svg canvas menu dialog title audio video map".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar "
                  "toolbar".split())
HEAD_ONLY = frozenset("html head base basefont bgsound link meta title noscript noframes style script template".split())
#: Words of class and id that mark page furniture.
FURNITURE = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner "
                      "nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead topbar toolbar "
                      "cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe signup login "
                      "share sharing social related recommended comment comments respond disqus replies widget search "
                      "pagination pager copyright".split())
UNFINISHED = re.compile(r"<[A-Za-z!/?]")
WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")


class Line:
    """A run of text; the runs of one block are joined again at the end."""

    __slots__ = ("parts", "tags", "link_chars", "skip", "home", "flag", "block")

    def __init__(self, skip: bool, home: int, flag: int, block: int):
        self.block = block
        self.parts: list[str] = []
        self.tags = 0
        self.link_chars = 0
        self.skip = skip
        self.home = home
        self.flag = flag


class Lines(HTMLParser):
    """Collects the lines of a page and the tree of its containers."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int, int]] = []  # tag, skipped inside, container, flagged element
        self.parents = [-1]  # container number -> container around it; 0 is the page
        self.kinds = [""]  # container number -> its tag
        self.flags = [(-1, 0)]  # element flagged by class, id or as form -> such an element around it, container; 0: none
        self.open: Counter[str] = Counter()  # tags on the stack
        self.links = 0
        self.blocks = 0
        self.lines = [Line(False, 0, 0, 0)]

    def updatepos(self, i, j):
        return j  # line numbers are not needed

    def place(self) -> tuple[bool, int, int]:
        return self.stack[-1][1:] if self.stack else (False, 0, 0)

    def new_line(self, same_block: bool = False) -> None:
        """A line for what follows; of the same block if only an inline element was skipped or flagged."""
        skip, home, flag = self.place()
        self.blocks += not same_block
        last = self.lines[-1]
        if last.parts or last.tags:
            self.lines.append(Line(skip, home, flag, self.blocks))
        else:
            last.skip, last.home, last.flag, last.block = skip, home, flag, self.blocks

    def cut_stack(self, k: int) -> None:
        """Close the elements from the k-th on."""
        for tag, *_ in self.stack[k:]:
            self.open[tag] -= 1
            self.links -= tag == "a"
        del self.stack[k:]

    def turned(self) -> bool:
        """The place is skipped or flagged otherwise than the last line."""
        skip, _, flag = self.place()
        return self.lines[-1].skip != skip or self.lines[-1].flag != flag

    def close_head(self, tag: str) -> None:
        """The end tag of the head is optional: the body, or what only a body holds, ends it."""
        if tag == "body" or self.stack[-1][0] == "head":
            for k, (t, *_) in enumerate(self.stack):
                if t == "head":
                    self.cut_stack(k)
                    self.new_line()
                    break

    def handle_starttag(self, tag, attrs):
        if self.stack and tag not in HEAD_ONLY:
            self.close_head(tag)
        if tag in BLOCKS and tag != "br":
            # an open paragraph ends where the next block begins
            while self.stack and any(t == "p" for t, *_ in self.stack[-3:]):
                name = self.stack[-1][0]
                self.cut_stack(len(self.stack) - 1)
                if name == "p":
                    break
        if tag not in VOID:
            skip, home, flag = self.place()
            skip = skip or tag in SKIPPED or (tag == "header" and not self.open["article"] and not self.open["main"]) \
                or (bool(attrs) and tag not in PAGE and unseen(attrs, tag in MARKED))
            if not skip and (tag == "form" or (attrs and tag not in PAGE and tag not in MARKED and furniture(attrs))):
                self.flags.append((flag, home))
                flag = len(self.flags) - 1
            if tag in CONTAINERS:
                self.parents.append(home)
                self.kinds.append(tag)
                home = len(self.parents) - 1
            self.stack.append((tag, skip, home, flag))
            self.open[tag] += 1
            self.links += tag == "a"
        if tag in BLOCKS:
            self.new_line()
        if tag not in VOID or tag in ("img", "input"):
            if self.turned():
                self.new_line(same_block=True)
            self.lines[-1].tags += 1

    def handle_endtag(self, tag):
        if self.open[tag]:
            self.cut_stack(next(k for k in range(len(self.stack) - 1, -1, -1) if self.stack[k][0] == tag))
        if tag in BLOCKS:
            self.new_line()
        elif self.turned():
            self.new_line(same_block=True)

    def handle_data(self, data):
        if self.stack and self.stack[-1][0] == "head" and data.strip():
            self.close_head("")
        line = self.lines[-1]
        line.parts.append(data)
        if self.links > 0:
            line.link_chars += len(data)


def furniture(attrs) -> bool:
    return any(value and (name == "class" or name == "id")
               and not FURNITURE.isdisjoint(w.lower() for w in WORD.findall(value)) for name, value in attrs)


def unseen(attrs, marked: bool) -> bool:
    """Hidden, or of a role that is no article text (``marked``: an article or main, whatever its role)."""
    for name, value in attrs:
        if name == "role" and value and value.lower() in ROLES and not marked:
            return True
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
    return False


def dense_lines(lines: list[tuple[Line, str]]) -> list[bool]:
    ratios = smooth([math.log1p(max(0, len(t) - x.link_chars) / max(1, x.tags)) for x, t in lines])
    border = two_means(ratios)
    top = max(ratios)
    return [r > border or r == top for r in ratios]


def unflagged(p: Lines, lines: list[tuple[Line, str]]) -> list[tuple[Line, str]]:
    """The lines outside flagged elements.  A flagged element that holds most of the page's dense
    text is no furniture, unless an article or main beside it holds text outside links."""
    if all(x.flag == 0 for x, _ in lines):
        return lines
    own = [(x, max(0, len(t) - x.link_chars)) for x, t in lines]
    weight: dict[int, int] = {}
    for (x, n), d in zip(own, dense_lines(lines), strict=True):
        f = x.flag if d else -1
        while f >= 0:
            weight[f] = weight.get(f, 0) + n
            f = p.flags[f][0]
    cleared = {0}

    def clear(f: int) -> bool:
        while f in cleared and f > 0:
            f = p.flags[f][0]
        return f == 0

    for f in sorted(f for f, w in weight.items() if f and 2 * w > weight.get(0, 0)):  # each holds the next
        above = around(p.parents, p.flags[f][1])
        if all(c in above or p.kinds[c] not in MARKED
               for x, n in own if n and clear(x.flag) for c in around(p.parents, x.home)):
            cleared.add(f)
    return [(x, t) for x, t in lines if clear(x.flag)]


def smooth(values: list[float], sigma: float = 1.0) -> list[float]:
    """Gaussian kernel, cut at three sigma and renormalised at the ends."""
    r = math.ceil(3 * sigma)
    kernel = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-r, r + 1)]
    out, n = [], len(values)
    for i in range(n):
        a, z = max(0, i - r), min(n, i + r + 1)
        w = kernel[a - i + r:z - i + r]
        out.append(sum(x * y for x, y in zip(values[a:z], w, strict=True)) / sum(w))
    return out


def two_means(values: list[float]) -> float:
    """Border between the means of the low and the high values (one-dimensional two-means)."""
    low, high = min(values), max(values)
    for _ in range(50):
        border = (low + high) / 2
        a = [v for v in values if v <= border]
        b = [v for v in values if v > border]
        if not a or not b:
            return border
        new = sum(a) / len(a), sum(b) / len(b)
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def main_text(html: str | None) -> str:
    if not html:
        return ""
    p = Lines()
    p.feed(html)
    if UNFINISHED.match(p.rawdata):
        p.rawdata = ""  # a tag or comment that the page does not finish is no text
    p.close()
    lines = []
    for x in p.lines:
        text = " ".join("".join(x.parts).split()) if x.parts and not x.skip else ""
        if text:
            lines.append((x, text))
    if lines:
        lines = unflagged(p, lines)
    if not lines:
        return ""
    dense = dense_lines(lines)
    weight = [0] * len(p.parents)  # container -> dense text in it or below
    homes: set[int] = set()
    for (x, t), d in zip(lines, dense, strict=True):
        if d:
            weight[x.home] += len(t)
            homes.add(x.home)
    add_up(p.parents, weight)
    deep = [0] * len(p.parents)
    for c in range(1, len(deep)):  # a container's number is above its parent's
        deep[c] = deep[p.parents[c]] + 1
    region = max((c for c, w in enumerate(weight) if 2 * w > weight[0]), key=lambda c: (deep[c], weight[c]))
    region = whole(p, region, homes)
    within = [c == region for c in range(len(p.parents))]
    for c in range(1, len(within)):
        within[c] = within[c] or within[p.parents[c]]
    out: list[str] = []
    for _, run in groupby((x for x, _ in lines if within[x.home]), key=lambda x: x.block):
        out.append(" ".join("".join(part for x in run for part in x.parts).split()))
    return "\n".join(out)


def add_up(parents: list[int], values: list) -> None:
    """Add every container's value to those around it."""
    for c in range(len(parents) - 1, 0, -1):
        values[parents[c]] += values[c]


def around(parents: list[int], c: int) -> list[int]:
    """The container and those around it, up to the page."""
    out = []
    while c >= 0:
        out.append(c)
        c = parents[c]
    return out


def whole(p: Lines, region: int, homes: set[int]) -> int:
    """The smallest container that holds the region, all of the article or main it lies in,
    and the dense lines (in ``homes``) of every other article or main; where it lies in none,
    all dense lines."""
    chain = around(p.parents, region)
    marked = [c for c in chain if p.kinds[c] in MARKED]
    if marked:
        # the outermost article around the region; a main around it counts if it adds dense lines
        under = [kind in MARKED for kind in p.kinds]
        for c in range(1, len(under)):
            under[c] = under[c] or under[p.parents[c]]
        homes = {h for h in homes if under[h]}
        inner = [c for c in marked if p.kinds[c] == "article"] or marked
        chain = chain[chain.index(inner[-1]):]
    held = [c in homes for c in range(len(p.parents))]
    add_up(p.parents, held)
    return next(c for c in chain if held[c] == len(homes))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col``, ``url_col``, text, n_chars per page."""
    schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def fn(batches):
        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield batch_of(schema, [b.column(0), b.column(1), texts, [len(t) for t in texts]])

    src = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return map_batches(src, fn, "id long, url string, text string, n_chars long") \
        .withColumnsRenamed({"id": id_col, "url": url_col})
