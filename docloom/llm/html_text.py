"""Main text of web pages by tag-path ratios.

The blocks of a page are grouped by their path of tags from the root (with
classes, without ids). For each path, text length and punctuation are summed and
divided by its number of blocks. These ratios are smoothed over the blocks in
page order, fused, and paths are compared with a threshold. What passes is
joined, block by block.

Some elements never hold content (menus, scripts ...), and a few class names are
a role as they stand. Others only may be none: forms, articles in articles, and
names that are common words. A first pass over the page leaves them in and sums
the prose in each (long blocks with punctuation, outside links); where that says
that they hold the text, they stay.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import bound_batches, table

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
NEVER = RAW | frozenset("head nav footer aside button dialog menu label option select datalist noscript template canvas audio video map svg object annotation annotation-xml".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input embed button label select textarea output meter progress audio video canvas map svg object picture math annotation annotation-xml mi mn mo ms mtext mspace mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle semantics".split())
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SCOPES = frozenset("html body article section main div td th table ul ol dl blockquote aside nav header footer form figure".split())

#: Whole class names or ids that say by themselves that an element is not the
#: article's own text. A name that only contains one of these says nothing.
NOT_TEXT = frozenset(
    "ad ads advert advertisement sponsored banner cookie cookies cookie-bar cookie-banner cookie-notice consent nav navbar navigation menu masthead header site-header page-header "
    "footer site-footer page-footer sidebar comments comment comment-list respond disqus newsletter subscribe share social breadcrumb breadcrumbs pagination popup modal overlay hidden".split()
)
#: Those that are also ordinary names of a part of a text.
PERHAPS = frozenset("related login search menu header navigation pagination share social".split())
NOT_TEXT -= PERHAPS
#: Roles of the accessibility standard.
ROLES = frozenset("navigation banner contentinfo complementary dialog alert alertdialog menu menubar".split())
PIECE = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: A block with so many characters outside links, and punctuation, is prose.
PROSE = 80
PUNCTUATION = re.compile(r"[.,;:!?…。、，！？؟]")


class Page:
    """The blocks of a page, and the tree of its paths.

    Block elements have a path, a number; `up` is the path without its last
    element, `tag` that element, `weight` what its names say: 0 is no content,
    2 inside an article, 1 neither. blocks: (path, pieces of text, characters in
    links, innermost doubt), in page order; a block ends wherever a block element
    starts or ends, or a line breaks. Text of weight 0 is in no block, and an
    inline element of weight 0 does not end one. Each element is pushed and
    popped once. doubts: elements that may be no content, by their place in the
    page, as (kind, whether in an article, doubt around it); those in `rejected`
    have weight 0.
    """

    def __init__(self, page: str, rejected: frozenset[int] = frozenset()):
        self.up, self.tag, self.weight, self.blocks = [-1], ["html"], [1], []
        self.doubts: dict[int, tuple[str, bool, int | None]] = {}
        self._rejected, self._doubt = rejected, None
        self._ids: dict = {}
        self._stack: list[tuple[str, int, bool, int | None]] = []  # tag, path and doubt before it, whether a scope
        self._open = [Counter()]  # open tags of each scope, innermost last
        self._all: Counter = Counter()
        self._path = 0
        self._new = True
        self._read(page)

    def _child(self, tag: str, classes: str, weight: int) -> int:
        key = (self._path, tag, classes, weight)
        if key not in self._ids:
            self._ids[key] = len(self.up)
            self.up.append(self._path)
            self.tag.append(tag)
            self.weight.append(weight)
        return self._ids[key]

    def _push(self, tag: str, path: int, doubt: int | None) -> None:
        scope = tag in SCOPES
        self._stack.append((tag, self._path, scope, self._doubt))
        self._doubt = doubt
        self._all[tag] += 1
        self._open[-1][tag] += 1
        if scope:
            self._open.append(Counter())
        self._path = path

    def _pop(self) -> str:
        tag, self._path, scope, self._doubt = self._stack.pop()
        if scope:
            self._open.pop()
        self._open[-1][tag] -= 1
        self._all[tag] -= 1
        return tag

    def _weight_of(self, tag: str, attrs: dict, at: int) -> tuple[int, int | None]:
        """0 under what never holds content, 2 under an article, else 1; and the
        doubt that the element is under. An article's own header is its text."""
        above, doubt = self.weight[self._path], self._doubt
        if above == 0 or tag in NEVER:
            return 0, doubt
        if tag in ("html", "body"):
            return above, doubt
        inside = above == 2
        role = attrs.get("role", "").lower()
        names = {*attrs.get("class", "").lower().split(), attrs.get("id", "").lower()}
        if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style", "")) or role in ROLES or not names.isdisjoint(NOT_TEXT):
            return 0, doubt
        kind = "form" if tag in ("form", "fieldset") or role in ("form", "search") else "article" if tag == "article" and self._all["article"] else None
        if tag == "header":
            if not inside:
                return 0, doubt
        elif not kind and not (names - {"header"} if inside else names).isdisjoint(PERHAPS):
            kind = "name"
        if kind:
            self.doubts[at] = (kind, inside, doubt)
            doubt = at
            if at in self._rejected:
                return 0, doubt
        return 2 if tag in ("article", "main") or role in ("main", "article") else above, doubt

    def _text(self, text: str) -> None:
        if not self.weight[self._path]:
            return
        if self._new:
            self.blocks.append((self._path, [], [0], self._doubt))
            self._new = False
        _, pieces, linked, _ = self.blocks[-1]
        pieces.append(text)
        if self._all["a"]:
            linked[0] += len(text)

    def texts(self) -> list[tuple[int, str, int, int | None]]:
        """(path, text, characters outside links, doubt) of each block with text."""
        clean = [(path, " ".join(html.unescape("".join(pieces)).split()), linked[0], doubt) for path, pieces, linked, doubt in self.blocks]
        return [(path, t, max(0, len(t) - linked), doubt) for path, t, linked, doubt in clean if t]

    def none(self) -> frozenset[int]:
        """The doubts that are no content. A form, or outside articles an element
        with one of the PERHAPS names, is content if it holds half of the page's
        prose; in an article such a name is if it holds any. An article within an
        article is a reader's comment if the outer one has prose of its own."""
        whole, own, mass = 0, 0, Counter()
        for path, t, free, doubt in self.texts():
            if not prose(t, free):
                continue
            whole += free
            nested = False
            while doubt is not None:
                mass[doubt] += free
                nested |= self.doubts[doubt][0] == "article"
                doubt = self.doubts[doubt][2]
            own += self.weight[path] == 2 and not nested
        out = set()
        for at, (kind, inside, _) in self.doubts.items():
            if kind == "article":
                good = mass[at] and not own
            else:
                good = mass[at] and (kind == "name" and inside or 2 * mass[at] >= whole)
            if not good:
                out.add(at)
        return frozenset(out)

    def _read(self, page: str) -> None:
        at, n = 0, len(page)
        while at < n:
            m = PIECE.search(page, at)
            end = m.start() if m else n
            if end > at:
                self._text(page[at:end])
            if not m:
                return
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            block = tag not in INLINE
            self._new |= block
            if m[1]:
                if self._all[tag] > 0:
                    while self._pop() != tag:
                        pass
                continue
            if block:
                closes = SELF_CLOSING.get(tag, frozenset()) | ({"p"} if tag in ENDS_P else frozenset())
                if any(self._open[-1][t] > 0 for t in closes):
                    while self._pop() not in closes:
                        pass
            if tag in VOID:
                continue
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = close.end() if close else n
                continue
            attrs = {a[0].lower(): a[1] or a[2] or a[3] for a in ATTR.findall(m[3])} if m[3].strip(" /") else {}
            weight, doubt = self._weight_of(tag, attrs, m.start())
            if m[3].rstrip().endswith("/") and tag in ("svg", "math"):
                continue
            # an inline element is no part of a path, unless it is no content
            changes = block or weight != self.weight[self._path]
            self._push(tag, self._child(tag, attrs.get("class", "") if block else "", weight) if changes else self._path, doubt)


def prose(text: str, free: int) -> bool:
    return free >= PROSE and bool(PUNCTUATION.search(text))


def smooth(values: list[float], radius: int = 2) -> list[float]:
    """Gaussian mean over neighbours in page order."""
    kernel = [math.exp(-(d * d) / (2.0 * radius)) for d in range(-radius, radius + 1)]
    out = []
    for i in range(len(values)):
        w = [(k, values[j]) for k, j in zip(kernel, range(i - radius, i + radius + 1), strict=True) if 0 <= j < len(values)]
        out.append(sum(k * v for k, v in w) / sum(k for k, _ in w))
    return out


def path_ratios(blocks: list[tuple[int, str, int]]) -> dict[int, float]:
    """The fused ratio of each path, from (path, text, characters not in links).

    A path's length ratio is its characters outside links over its blocks, its
    punctuation ratio one more than its marks over its blocks. Each is smoothed
    over the blocks in page order; what a block is by its own path and what its
    neighbours are count alike (their geometric mean), so that a short block
    between long ones gains, and a notice beside a long one stays what it is.
    Both fused are the product, and a path has the mean of its blocks.
    """
    n, chars, marks = Counter(), Counter(), Counter()
    for path, t, free in blocks:
        n[path] += 1
        chars[path] += free
        marks[path] += len(PUNCTUATION.findall(t))
    series = [[chars[p] / n[p] for p, *_ in blocks], [1 + marks[p] / n[p] for p, *_ in blocks]]
    fused = [1.0] * len(blocks)
    for own in series:
        fused = [f * math.sqrt(a * b) for f, a, b in zip(fused, own, smooth(own), strict=True)]
    total = Counter()
    for (path, *_), f in zip(blocks, fused, strict=True):
        total[path] += f
    return {p: total[p] / n[p] for p in n}


def under(p: Page, roots: set[int]) -> list[bool]:
    """For each path whether it is one of the roots or continues one."""
    out = [False] * len(p.up)
    for x in range(len(p.up)):  # a path comes after the one it continues
        out[x] = x in roots or p.up[x] >= 0 and out[p.up[x]]
    return out


def with_title(p: Page, found: list, root: int) -> int:
    """The nearest path around the root that has a first heading, if what it has
    besides the root is short and no prose; else the root."""
    held = under(p, {root})
    if any(held[path] and p.tag[path] == "h1" for path, *_ in found):
        return root
    mass = sum(free for path, _, free, _ in found if held[path])
    x = p.up[root]
    while x > 0:
        more = [(path, t, free) for path, t, free, _ in found if not held[path] and under(p, {x})[path]]
        if any(prose(t, free) for _, t, free in more) or 5 * sum(free for *_, free in more) > mass:
            return root
        if any(p.tag[path] == "h1" for path, *_ in more):
            return x
        x = p.up[x]
    return root


def main_text(page: str | None, share: float = 0.1) -> str:
    """Content blocks of a page, one a line; "" if there are none.

    If article and main elements hold half of the page's prose, those with prose
    are the text, but for parts of them that are mostly links and whose paths
    have less than `share` of the highest ratio. Otherwise ratios decide between
    all blocks: paths with at least `share` of the highest are content, and so is
    whatever else stands in the same container, but not text that stands right
    in it if all of it is links. The container of the most content may be widened
    to take its title in; containers beside it must hold prose.
    """
    p = Page(page or "")
    if p.doubts:
        p = Page(page, p.none())
    texts = p.texts()
    mass = Counter()
    for path, t, free, _ in texts:
        mass[p.weight[path]] += free * prose(t, free)
    top = 2 if any(p.weight[path] == 2 for path, *_ in texts) and 2 * mass[2] >= mass[1] + mass[2] else 1
    found = [x for x in texts if p.weight[x[0]] >= top]
    if not found:
        return ""
    fused = path_ratios([x[:3] for x in found])
    least = share * max(fused.values())
    container = lambda x: x if p.tag[x] in SCOPES else p.up[x]
    if top == 2:
        root = list(range(len(p.up)))  # the outermost path of an article
        for x in range(1, len(p.up)):
            root[x] = root[p.up[x]] if p.weight[p.up[x]] == 2 else x
        roots = {root[path] for path, t, free, _ in found if prose(t, free)} or {root[path] for path, *_ in found}
        chars, out = Counter(), Counter()
        for path, t, free, _ in found:
            chars[container(path)] += len(t)
            out[container(path)] += free
        linked = {path for path in fused if container(path) not in roots and fused[path] < least and 2 * out[container(path)] < chars[container(path)]}
        return "\n".join(t for path, t, *_ in found if root[path] in roots and path not in linked)
    content = {x for x, f in fused.items() if f >= least}
    held = Counter()
    for path, _, free, _ in found:
        held[container(path)] += free * (path in content)
    main = max(held, key=lambda x: (held[x], -x))
    inside = {container(path) for path, t, free, _ in found if path in content and (container(path) == main or prose(t, free))}
    inside = {with_title(p, found, main), *inside}
    kept = under(p, inside)
    links = {x for x in inside if fused.get(x) == 0}
    return "\n".join(t for path, t, *_ in found if kept[path] and (path in content or path not in links))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row.

    A null or empty html gives an empty text. Pages are independent: repeated
    rows and ties give equal results, an empty table an empty result. Nothing
    is shuffled.
    """
    bound_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def text_of(pages: pd.Series) -> pd.Series:
        return pages.map(main_text)

    text = text_of(F.coalesce(F.col(html_col), F.lit("")))
    out = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text.alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def op10_html_text(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))
