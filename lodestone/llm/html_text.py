"""Main text of web pages by composite text density.

A tolerant parser builds the tree of a page. Menus, headers, footers, sidebars, notices, adverts,
forms, reader comments and hidden elements are cut off first by element, role and name. What is
left is weighed: the composite density of a node is its characters per tag, raised to the extent
that its text is not link text and its tags are not links. The node with the largest sum of its
children's densities is the core of the article. The least density on the way from the core to
the body is the threshold which other parts must reach. A core within an article or main element
stands for that element.

A page is one value of a column, so a task holds a batch of pages and nothing else; there is no
shuffle, and a lost task parses its pages again.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.common import prepare, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup; all of it is left out.
RAW = frozenset("iframe noembed noframes script style textarea title".split())
#: Elements that stand on lines of their own.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option optgroup p pre search "
    "section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that are never part of an article.
CUT = frozenset(
    "aside audio button canvas datalist dialog fieldset footer input label legend menu nav noscript object optgroup "
    "option search select svg template video".split()
)
CUT_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split()
)
#: Words of a class or id that mark what surrounds an article.
CUT_NAMES = frozenset(
    "ad ads adsense advert advertisement advertising adverts banner bottombar breadcrumb breadcrumbs comment "
    "commentlist comments consent cookie cookies copyright discussion disqus donate footer gdpr login masthead menu "
    "menubar modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination "
    "paywall popup promo promoted promotion recommended registration related reply replies respond responses search "
    "share sharing sidebar signin signup skip social sponsor sponsored sponsors subscribe subscription taboola "
    "toolbar topbar widget widgets".split()
)
#: Words of a class or id that mark the article.
ARTICLE_NAMES = frozenset("article content entry main post story".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
FORMATTING = frozenset(
    "a abbr b bdi bdo big cite code del dfn em font i ins kbd mark q s samp small span strike strong sub sup tt u "
    "var".split()
)
#: What an end tag of another element does not reach over.
SCOPE = frozenset("body caption html table td th".split())
TABLE_PARTS = frozenset("caption table tbody td tfoot th thead tr".split())
#: For a start tag: the open elements it ends, and the elements that this does not reach over.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "a": ({"a"}, {"table"}),
}
#: A list, table or block of so many links that are so much of its text is a menu.
MENU_LINKS, MENU_SHARE = 3, 0.8
#: An article element is trusted if it holds this much of the text outside links.
REGION_SHARE = 0.25

_MARKUP = re.compile(r"<(?:(!--)|(/?)([A-Za-z][^\s/>]*)|[!?/])")
_REST_OF_TAG = re.compile(r"((?:[^>=]|=\s*+(?:\"[^\"]*\"|'[^']*')?+)*+)>")
_ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_COMMENT_END = re.compile(r"--!?>")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}

NOTHING, SURROUNDS, WEAK, STRONG = 0, 1, 2, 3


@lru_cache(maxsize=1 << 14)
def attributes_say(text: str) -> tuple[int, bool]:
    """What class, id, role and the like mark an element as, and whether they hide it."""
    names: set[str] = set()
    mark, hidden = NOTHING, False
    for found in _ATTRIBUTE.finditer(text):
        key = found[1].lower()
        value = next((v for v in found.groups()[1:] if v is not None), "")
        if key in ("class", "id"):
            names.update(w.lower() for w in _WORD.findall(value))
        elif key == "role":
            roles = set(value.lower().split())
            mark = SURROUNDS if roles & CUT_ROLES else STRONG if roles & {"article", "main"} else mark
        elif key == "itemprop" and value.lower() == "articlebody":
            mark = STRONG
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            hidden = True
        elif key == "style":
            hidden |= re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE) is not None
    if mark == NOTHING and names & CUT_NAMES:
        mark = SURROUNDS
    elif mark == NOTHING and names & ARTICLE_NAMES:
        mark = WEAK
    if mark == NOTHING and "header" in names:
        mark = -1  # a header, if it is not that of an article
    return mark, hidden


class Tree:
    """Nodes of a page in the order of their start tags; a parent comes before its children."""

    def __init__(self) -> None:
        self.tag, self.parent = ["body"], [0]
        self.mark, self.hidden = [NOTHING], [False]
        #: Texts with the node they are in; a text of None is the end of a line.
        self.pieces: list[tuple[int, str | None]] = []
        self.open = [0]
        #: Places in ``open`` by element, and those of block elements.
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def _pop(self) -> None:
        tag = self.tag[self.open.pop()]
        self.places[tag].pop()
        if tag in BLOCK:
            self.blocks.pop()
            self.pieces.append((0, None))

    def _last(self, names) -> int:
        return max((self.places[name][-1] for name in names if self.places.get(name)), default=-1)

    def _close(self, names, stops) -> None:
        """End the innermost open element of ``names``, unless one of ``stops`` is open within it."""
        place = self._last(names)
        if place < 0:
            return
        stop = (self.blocks[-1] if self.blocks else -1) if stops is BLOCK else self._last(stops)
        while place >= stop and len(self.open) > place:
            self._pop()

    def start(self, tag: str, attributes: str) -> None:
        if tag in ("html", "head", "body"):
            return
        if tag in BLOCK:
            self._close(("p",), SCOPE)
            self.pieces.append((0, None))
        if tag in _CLOSES:
            self._close(*_CLOSES[tag])
        elif tag in HEADINGS and self.tag[self.open[-1]] in HEADINGS:
            self._pop()
        mark, hidden = attributes_say(attributes) if attributes else (NOTHING, False)
        self.tag.append(tag)
        self.parent.append(self.open[-1])
        self.mark.append(mark)
        self.hidden.append(hidden)
        if tag == "br":
            self.pieces.append((self.open[-1], " "))
        if tag not in VOID and tag not in RAW:
            self.places.setdefault(tag, []).append(len(self.open))
            if tag in BLOCK:
                self.blocks.append(len(self.open))
            self.open.append(len(self.tag) - 1)

    def end(self, tag: str) -> None:
        if tag in ("html", "head", "body"):
            return
        if tag == "br":
            self.pieces.append((self.open[-1], " "))
        else:
            self._close((tag,), () if tag in TABLE_PARTS else BLOCK if tag in FORMATTING else SCOPE)
        if tag in BLOCK:
            self.pieces.append((0, None))

    def text(self, value: str) -> None:
        if value:
            self.pieces.append((self.open[-1], entities.unescape(value) if "&" in value else value))


def parse(page: str) -> Tree:
    """The tree of a page; what is malformed is mended as browsers do in the common cases."""
    tree, at = Tree(), 0
    while found := _MARKUP.search(page, at):
        tree.text(page[at : found.start()])
        comment, slash, name = found.groups()
        if comment:
            closed = _COMMENT_END.search(page, found.end() - 2)
            if closed is None:
                return tree
            at = closed.end()
            continue
        if name is None:
            closed = page.find(">", found.end())
            if closed < 0:
                return tree
            at = closed + 1
            continue
        rest = _REST_OF_TAG.match(page, found.end())
        if rest is None:  # the page ends within a tag
            return tree
        at = rest.end()
        tag = name.lower()
        if slash:
            tree.end(tag)
            continue
        tree.start(tag, rest[1].strip())
        if tag in RAW:
            closed = _RAW_END[tag].search(page, at)
            if closed is None:
                return tree
            at = closed.start()
    tree.text(page[at:])
    return tree


def _cut_off(tree: Tree) -> list[bool]:
    """Nodes that surround the article, with all that is below them.

    A wrapper named like a sidebar that holds the only article of the page is no sidebar; comments
    may be articles too, but then there is another one.
    """
    size = len(tree.tag)
    article = [
        tree.mark[n] != SURROUNDS and (tree.tag[n] in ("article", "main") or tree.mark[n] == STRONG) for n in range(size)
    ]
    holds, heading = article.copy(), [tag in HEADINGS for tag in tree.tag]
    main = [tag == "main" for tag in tree.tag]
    for node in range(size - 1, 0, -1):
        above = tree.parent[node]
        holds[above] |= holds[node]
        heading[above] |= heading[node]
        main[above] |= main[node]
    inside, off = [False] * size, [False] * size
    for node in range(1, size):
        above, tag, mark = tree.parent[node], tree.tag[node], tree.mark[node]
        inside[node] = inside[above] or tag in ("article", "main") or mark in (WEAK, STRONG)
        if tag == "header" or mark == -1:
            off[node] = not (inside[above] and heading[node])
        elif tag == "form":
            off[node] = not heading[node]
        else:
            off[node] = tag in CUT or mark == SURROUNDS

    def below(exempt: list[bool]) -> list[bool]:
        cut = [False] * size
        for node in range(1, size):
            cut[node] = cut[tree.parent[node]] or tree.hidden[node] or off[node] and not exempt[node]
        return cut

    cut = below(main)
    if any(article) and not any(a and not c for a, c in zip(article, cut, strict=True)):
        cut = below(holds)
    return cut


def densities(tree: Tree, cut: list[bool]) -> tuple[list[int], list[int], list[int], list[float]]:
    """Characters, link characters, links and composite density of every node that is not cut."""
    size = len(tree.tag)
    chars, tags, link_chars, links = [0] * size, [0] * size, [0] * size, [0] * size
    linked = [False] * size
    for node in range(1, size):
        linked[node] = linked[tree.parent[node]] or tree.tag[node] == "a"
    for node, text in tree.pieces:
        if text is not None and not cut[node]:
            count = len(text) if text.isprintable() and "  " not in text else len(" ".join(text.split()))
            chars[node] += count
            if linked[node]:
                link_chars[node] += count
    for node in range(size - 1, 0, -1):
        if not cut[node]:
            above = tree.parent[node]
            chars[above] += chars[node]
            link_chars[above] += link_chars[node]
            tags[above] += tags[node] + 1
            links[above] += links[node] + (tree.tag[node] == "a")
    share = link_chars[0] / max(chars[0], 1)
    density = [0.0] * size
    for node in range(size):
        c = chars[node]
        if c and not cut[node]:
            t, lc, lt, other = max(tags[node], 1), max(link_chars[node], 1), max(links[node], 1), max(c - link_chars[node], 1)
            base = math.log(c / other * lc + share * c + math.e)
            density[node] = c / t * max(math.log(c / lc * t / lt), 0.0) / max(math.log(base), 1e-9) if base > 1 else 0.0
    return chars, link_chars, links, density


def _select(tree: Tree, cut: list[bool]) -> tuple[list[bool], int, float, float]:
    """Whether the text of each node is part of the article; the core, its sum and the threshold."""
    size = len(tree.tag)
    chars, link_chars, links, density = densities(tree, cut)
    for node in range(1, size):  # menus without a name
        if links[node] >= MENU_LINKS and link_chars[node] >= MENU_SHARE * chars[node] and tree.tag[node] in BLOCK:
            cut[node] = True
        cut[node] |= cut[tree.parent[node]]
    chars, link_chars, links, density = densities(tree, cut)
    sums = [0.0] * size
    for node in range(1, size):
        sums[tree.parent[node]] += density[node]
    core = max(range(size), key=lambda node: (sums[node], -node))
    path = [core]
    while path[-1]:
        path.append(tree.parent[path[-1]])
    threshold = min(density[node] for node in path)

    strong = [tree.tag[n] in ("article", "main") or tree.mark[n] == STRONG for n in range(size)]
    chosen = [False] * size
    over = [n for n in path if strong[n]]
    if over:
        region = [over[-1]]
    else:
        under = [False] * size
        for node in range(1, size):
            under[node] = under[tree.parent[node]] or strong[tree.parent[node]]
        region = [n for n in range(1, size) if strong[n] and not under[n] and not cut[n]]
        held = sum(chars[n] - link_chars[n] for n in region)
        if held < REGION_SHARE * (chars[0] - link_chars[0]):
            region = []
    if region:
        for node in region:
            chosen[node] = True
    else:
        weak = next((n for n in path if n and tree.mark[n] == WEAK), None)
        chosen[core if weak is None else weak] = True
        if weak is None:  # what is as dense as the way to the core
            reached = [False] * size
            reached[0] = True
            for node in range(1, size):
                reached[node] = reached[tree.parent[node]] and density[node] >= threshold > 0
                if reached[node] and not sums[node]:
                    chosen[node] = True
        # Headings ahead of the core, beside it or beside what it is in.
        first = core if weak is None else weak
        within = set(_above(tree, first)) | {0}
        for node in range(1, first):
            if tree.tag[node] in ("h1", "h2") and tree.parent[node] in within:
                chosen[node] = True
    for node in range(1, size):
        chosen[node] = chosen[node] or chosen[tree.parent[node]]
    return [c and not off for c, off in zip(chosen, cut, strict=True)], core, sums[core], threshold


def _above(tree: Tree, node: int) -> list[int]:
    found = []
    while node:
        node = tree.parent[node]
        found.append(node)
    return found


def main_text(page: str | None) -> tuple[str, str, float, float]:
    """The text of the article, the path of its core, the core's density sum and the threshold."""
    if not page:
        return "", "", 0.0, 0.0
    tree = parse(page)
    keep, core, total, threshold = _select(tree, _cut_off(tree))
    lines, line = [], []
    for node, text in [*tree.pieces, (0, None)]:
        if text is None:
            if line and (words := "".join(line).split()):
                lines.append(" ".join(words))
            line = []
        elif keep[node]:
            line.append(text)
        elif line:
            line.append(" ")
    path = "/".join(tree.tag[n] for n in [*_above(tree, core)[::-1], core])
    return "\n".join(lines), path, total, threshold


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [main_text(page) for page in batch["html"].to_pylist()]
        texts, paths, sums, thresholds = zip(*found, strict=True) if found else ([], [], [], [])
        yield pa.RecordBatch.from_arrays(
            [
                batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()),
                pa.array(paths, pa.string()), pa.array(sums, pa.float64()), pa.array(thresholds, pa.float64()),
            ],
            names=["page_id", "url", "text", "n_chars", "core_path", "density_sum", "threshold"],
        )


def extract_main_text(pages: DataFrame) -> DataFrame:
    """Main text of every row of ``pages`` (page_id, url, html).

    Gives page_id, url, text, n_chars (code points), core_path (tags from the body to the core),
    density_sum and threshold. Character references are decoded, white space inside a block is one
    space (a ``br`` counts as white space), blocks are joined by a line break in page order.

    A null or empty page, or one without text of an article, has the empty text. Null ids and urls
    stay null, repeated rows are rows of their own, an empty table gives no row. Between nodes of
    equal density sum the earlier start tag counts. Texts of any length are read whole. Other
    columns of ``pages``, whatever their names, are not returned.
    """
    prepare(pages.sparkSession)
    schema = pages.select("page_id", "url").schema
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    result = f"{kinds}, text string, n_chars long, core_path string, density_sum double, threshold double"
    return pages.select("page_id", "url", "html").mapInArrow(_extract, result)


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
