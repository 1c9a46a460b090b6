"""Main text of HTML pages by composite text density.

Each page is parsed to a flat, preorder list of nodes, so a subtree is an index range and
every total is an array sum. What is never text (scripts, hidden and form controls) is taken
out first. Elements that are boilerplate by tag, role or class are taken out unless they wrap
the article: unless all ``article`` and ``main`` elements, or without such elements most of
the plain text, lie inside them. For every other node the composite density is its characters
per tag, lowered as more of its characters and tags are links. The node with the largest sum
of child densities holds the article. Inside a ``main`` or ``article``, the outermost one is
taken whole; else siblings along the path to the body belong to it that reach the smallest
density on that path, or that are headings, paragraphs or headed sections of few links.

Defined results: null or empty html has empty text; broken nesting is closed as browsers
do for paragraphs, items and cells; nesting and text length are unbounded, and the time is
linear in the length of the page, broken or not; repeated pages give repeated rows; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from coocatlas.llm.words import slices

#: The rest of a tag: quotes count after an equals sign only.
TAG_REST = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+>")
TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
BLANKS = re.compile(r"\s+")

# Fixed values of HTML: elements without content, with raw content, and those that break a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table "
    "tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"br", "body", "html", "option", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend"}
#: An opening tag ends open elements of these tags, up to the given container.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Never text of an article.
HARD_TAGS = frozenset(
    "head script style template noscript iframe object svg math canvas audio video map button select textarea input label title".split())
#: Boilerplate unless it wraps the article.
SOFT_TAGS = frozenset("nav footer aside form fieldset dialog menu header".split())
OUT_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist status".split())
#: Whole words of a class or id that name boilerplate; the second list only in a class, as ids often name headings.
OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle adbox adslot sponsor sponsored sponsors cookie cookies "
    "consent gdpr popup modal overlay sidebar sidebars nav navbar navigation breadcrumb breadcrumbs footer masthead topbar "
    "toolbar disqus newsletter signup searchform pagination pager outbrain taboola".split())
OUT_CLASS_WORDS = frozenset(
    "promo promos promotion banner notice notices notification notifications alert alerts aside menu menus foot share sharing "
    "social related recommended recommendations subscribe subscription login signin search widget widgets skip copyright "
    "disclaimer".split())
#: Words that name reader comments, and words that turn a class into the state of something else.
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond reply replies discussion".split())
STATE_WORDS = frozenset("no not without has have with is hide hidden open opened closed enabled disabled off on allow allowed count layout".split())
MAIN_TAGS = frozenset(("article", "main"))
HEADINGS = frozenset(f"h{n}" for n in range(1, 7))
FLOW = HEADINGS | frozenset("p pre blockquote ul ol dl table figure".split())

NOT_NAMED, BOILERPLATE, COMMENTS = 0, 1, 2


def _kind(value: str, words: frozenset[str]) -> int:
    """What the space-separated names of a class or id say; a name that tells a state, as in ``no-sidebar``, says nothing."""
    found = NOT_NAMED
    for name in value.lower().split():
        parts = re.split(r"[^a-z]+", name)
        if len(parts) > 1 and not STATE_WORDS.isdisjoint(parts):
            continue
        if not COMMENT_WORDS.isdisjoint(parts):
            return COMMENTS
        if not words.isdisjoint(parts):
            found = BOILERPLATE
    return found


class Page:
    """Flat parse of one page. ``runs`` lists (node, text) in page order, text None for a line break.

    Per node: parent, tag, ``hard`` (never text), ``kind`` (what its names say), ``soft`` (boilerplate by tag or role).
    Open elements are a stack; the depths at which each tag is open are kept beside it, so that
    no end tag and no implied end walks the stack.
    """

    def __init__(self, source: str):
        self.parent, self.tag, self.hard, self.kind, self.soft = [-1], ["#root"], [False], [NOT_NAMED], [False]
        self.runs: list[tuple[int, str | None]] = []
        self.stack, self.depths = [0], {}
        self._parse(source)

    def _parse(self, source: str) -> None:
        at, end, last, lenient = 0, len(source), source.rfind(">"), False
        while at < end:
            begin = source.find("<", at)
            if begin < 0 or begin > last:
                # no tag ends any more: what is left is text up to a tag that was begun
                self._text(source[at:begin if begin >= 0 else end])
                if begin < 0 or TAG_NAME.match(source, begin + 1) or source[begin + 1:begin + 2] in ("/", "!", "?"):
                    return
                self._text(source[begin:])
                return
            if begin > at:
                self._text(source[at:begin])
            if source.startswith("<!--", begin):
                stop = source.find("-->", begin + 4)
                at = end if stop < 0 else stop + 3
            elif source.startswith("<![CDATA[", begin):
                stop = source.find("]]>", begin + 9)
                self.runs.append((self.stack[-1], source[begin + 9:end if stop < 0 else stop]))
                at = end if stop < 0 else stop + 3
            elif source[begin + 1] in "!?":
                at = source.find(">", begin) + 1
            else:
                closing = source[begin + 1] == "/"
                found = TAG_NAME.match(source, begin + 1 + closing)
                if not found:
                    self._text("<")
                    at = begin + 1
                    continue
                rest = None if lenient else TAG_REST.match(source, found.end())
                if rest is None:
                    # quotes that never close: from here on the next > ends a tag
                    lenient = True
                at = rest.end() if rest else source.find(">", begin) + 1
                name = found.group().lower()
                if closing:
                    self._close(name)
                else:
                    self._open(name, source[found.end():at - 1])
                    if name in RAW:
                        stop = re.compile(rf"</{name}\b[^>]*>?", re.I).search(source, at)
                        at = stop.end() if stop else end
                        self._cut(len(self.stack) - 1)

    def has(self, tags: Iterable[str]) -> np.ndarray:
        return np.array([tag in tags for tag in self.tag])

    def _text(self, text: str) -> None:
        if text:
            self.runs.append((self.stack[-1], html.unescape(text)))

    def _push(self, node: int) -> None:
        for name in self._lists(node):
            self.depths.setdefault(name, []).append(len(self.stack))
        self.stack.append(node)

    def _cut(self, depth: int) -> None:
        """Close everything from ``depth`` up."""
        while len(self.stack) > depth:
            for name in self._lists(self.stack.pop()):
                self.depths[name].pop()

    def _lists(self, node: int) -> list[str]:
        tag = self.tag[node]
        return [tag, *(["#block"] if tag in BLOCK and tag != "p" else []), *(["#main"] if tag in MAIN_TAGS else [])]

    def _deepest(self, *names: str) -> int:
        return max((self.depths[name][-1] for name in names if self.depths.get(name)), default=0)

    def _close(self, name: str) -> None:
        depth = self._deepest(name)
        if depth and (name in BLOCK or self._deepest("#main") < depth):
            self._cut(depth)
        if name in BLOCK:
            self.runs.append((self.stack[-1], None))

    def _open(self, name: str, attributes: str) -> None:
        if name in CLOSES_P:
            self._imply(("p",), ("#block",))
        if name in IMPLIED:
            self._imply(*IMPLIED[name])
        if name in BLOCK:
            self.runs.append((self.stack[-1], None))
        if name == "br":
            return
        node = len(self.tag)
        hard, soft, kind = name in HARD_TAGS, name in SOFT_TAGS, NOT_NAMED
        if attributes.strip("/ \t\r\n"):
            values = {a.lower(): b or c or d for a, b, c, d in ATTRIBUTE.findall(attributes)}
            hard |= "hidden" in values or "display:none" in values.get("style", "").replace(" ", "").lower()
            soft |= values.get("role", "").lower() in OUT_ROLES
            kind = _kind(values.get("class", ""), OUT_WORDS | OUT_CLASS_WORDS)
            if not kind and name not in HEADINGS:
                kind = _kind(values.get("id", ""), OUT_WORDS)
        for column, value in ((self.parent, self.stack[-1]), (self.tag, name), (self.hard, hard), (self.kind, kind), (self.soft, soft)):
            column.append(value)
        if name not in VOID:
            self._push(node)

    def _imply(self, ends: Iterable[str], bounds: Iterable[str]) -> None:
        depth = self._deepest(*ends)
        if depth > self._deepest(*bounds):
            self._cut(depth)


def _subtree_sums(values: np.ndarray, parent: list[int]) -> np.ndarray:
    total = values.tolist()
    for node in range(len(parent) - 1, 0, -1):
        total[parent[node]] += total[node]
    return np.array(total, values.dtype)


def _down(own: np.ndarray, parent: list[int]) -> np.ndarray:
    """Count of true values at each node and its ancestors."""
    total = own.astype(np.int64).tolist()
    for i in range(1, len(parent)):
        total[i] += total[parent[i]]
    return np.array(total)


def boilerplate(page: Page) -> np.ndarray:
    """Which nodes are not part of the article by tag, role or name, or lie in such a node."""
    n, parent, tag = len(page.tag), page.parent, page.tag
    hard = _down(np.array(page.hard), parent) > 0
    link = _down(page.has({"a"}), parent) > 0
    plain = np.zeros(n)
    for node, text in page.runs:
        if text and not hard[node] and not link[node]:
            plain[node] += len(BLANKS.sub(" ", text).strip())
    kind, soft = np.array(page.kind), np.array(page.soft)
    root = page.has({"#root", "html", "body"})
    in_comments = _down((kind == COMMENTS) & ~root, parent) > 0
    aside = _down(page.has({"nav", "footer", "aside"}), parent) > 0
    article = page.has(MAIN_TAGS) & ~hard & ~aside
    main = article & (kind == NOT_NAMED) & ~in_comments
    if not main.any():
        # articles in a wrapper that is named like comments are better than none
        main = article & (kind != COMMENTS)
    plain = _subtree_sums(plain, parent)
    within, above = _subtree_sums(main.astype(np.int64), parent), _down(main, parent)
    mains, most = int(main.sum()), plain[0]
    out = hard.copy()
    for i in range(1, n):
        p = parent[i]
        if out[p] or out[i]:
            out[i] = True
            continue
        if root[i] or not (soft[i] or kind[i]):
            continue
        if tag[i] == "header" and above[i] and not kind[i]:
            continue
        elsewhere = mains - within[i] - (above[i] - main[i])
        if mains and within[i]:
            # a wrapper of all articles stays, one of some of them if it holds most of the text
            out[i] = elsewhere > 0 and (kind[i] == COMMENTS or plain[i] < 0.5 * most)
        elif mains:
            out[i] = True
        else:
            out[i] = plain[i] <= (0.9 if kind[i] == COMMENTS else 0.5) * most
    return out


def densities(page: Page, out: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Composite density of each node without the nodes that are out, its sum over children, and its share of links."""
    n, parent = len(page.tag), page.parent
    anchor = page.has({"a"})
    link = _down(anchor, parent) > 0
    chars, link_chars = np.zeros(n), np.zeros(n)
    for node, text in page.runs:
        if text and not out[node]:
            size = len(BLANKS.sub(" ", text).strip())
            chars[node] += size
            link_chars[node] += size * link[node]
    chars, link_chars = _subtree_sums(chars, parent), _subtree_sums(link_chars, parent)
    tags, link_tags = _subtree_sums(np.where(out, 0.0, 1.0), parent), _subtree_sums((anchor & ~out).astype(float), parent)
    share = link_chars[0] / max(chars[0], 1.0)
    plain = np.maximum(chars - link_chars, 1.0)
    base = np.log(chars / plain * link_chars + share * chars + np.e)
    ratio = chars / np.maximum(link_chars, 1.0) * tags / np.maximum(link_tags, 1.0)
    density = np.where(
        chars > 0, chars / np.maximum(tags, 1.0) * np.log(np.maximum(ratio, 1.0)) / np.log(np.maximum(base, 1.01)), 0.0)
    sums = np.zeros(n)
    np.add.at(sums, parent[1:], density[1:])
    return density, sums, link_chars / np.maximum(chars, 1.0)


def selected(page: Page, out: np.ndarray) -> np.ndarray:
    """Which nodes' text is the article's."""
    density, sums, links = densities(page, out)
    n, parent = len(page.tag), page.parent
    last = np.arange(n)
    for i in range(n - 1, 0, -1):
        last[parent[i]] = max(last[parent[i]], last[i])
    best = int(np.argmax(np.where(out, -1.0, sums)))
    path = [best]
    while path[-1] > 0:
        path.append(parent[path[-1]])
    chosen = np.zeros(n, bool)
    main = [i for i in path if page.tag[i] in MAIN_TAGS]
    inner = main[-1] if main else best
    chosen[inner:last[inner] + 1] = True
    if not main or page.tag[inner] == "article":
        low = min(density[i] for i in path)
        on_path = set(path[path.index(inner):])
        headed = _subtree_sums(page.has(HEADINGS).astype(np.int64), parent)
        for i in range(1, n):
            if parent[i] not in on_path or i in on_path or out[i] or density[i] <= 0:
                continue
            if main:
                taken = page.tag[i] == "article" and density[i] >= low
            else:
                taken = density[i] >= low or (links[i] <= 0.5 and page.tag[i] in FLOW) or (links[i] <= 0.3 and headed[i] > 0)
            if taken and links[i] <= 0.8:
                chosen[i:last[i] + 1] = True
        if not main:
            chosen[path] = True
    return chosen & ~out


def main_text(source: str | None) -> str:
    """The article's blocks, one per line; "" if there is none."""
    if not source:
        return ""
    page = Page(source)
    chosen = selected(page, boilerplate(page))
    blocks, held = [], []
    for node, text in [*page.runs, (0, None)]:
        if text is None:
            if held:
                block = BLANKS.sub(" ", "".join(held)).strip()
                if block:
                    blocks.append(block)
                held = []
        elif chosen[node]:
            held.append(text)
    return "\n".join(blocks)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html"):
        texts = [main_text(source) for source in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and the main text of every page."""
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.select("page_id", "url", "html").mapInArrow(
        _extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
