"""Main text of web pages by tag-path ratios.

Text nodes are grouped by the path of tags from the root. Each path has a text ratio (characters per
node) and a punctuation ratio; both are smoothed over the paths in page order, fused into one score by
their geometric mean, and paths above the threshold (a share of the scores' standard deviation) hold content nodes. The
smallest element that has all content nodes is the article; it is widened to the
``article`` or ``main`` element around it. Of its text blocks, those with content nodes are kept, those between
them or in the same container as one of them, and headings. Elements that are no article text by their kind
(menus, headers, footers, sidebars, scripts) take no part, in the ratios either; of an article's own header the headings
do. Nor do forms and elements that their class, id or role marks (adverts, notices, comments), unless one holds more than half of
the content nodes' text, or nothing else has text. A name marks if all its words are marks or say where something stands, or if
its last word is a mark that nothing in an article is named by; so ``entry-header``, ``related-work``, ``has-sidebar`` and identifiers of headings and sections
(but for readers' comments) are no marks.

Cases: a null or empty html, or a page without such text, gives an empty text; unclosed and stray tags
are borne, and time and memory grow with the page's length only, however deep its tags lie; rows repeated are repeated in the result; a null identifier or url stays null; further
columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewright.session import bound_batches

# Kinds of elements.
RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
LEFT_OUT = frozenset("nav header footer aside script style noscript template iframe button select option textarea input svg canvas object embed audio video map head title menu dialog noembed noframes xmp math".split())
TEXT_LEVEL = INLINE | frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd pre blockquote figure figcaption td th tr tbody table".split())
#: Their text belongs to the container around them.
CARRIED = TEXT_LEVEL | frozenset("section thead tfoot caption details summary address hgroup".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NEVER_LEFT_OUT = frozenset("html body main article".split())
# Words of class, id and role that mark what is no article text.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "sidebar aside complementary footer header masthead contentinfo cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social comment comments commentlist disqus respond replies discussion related recommended recommendations widget pagination pager toolbar copyright legal disclaimer search".split()
)
#: Of these, as the last word of a class also beside words of other kinds (``post-comments``).
ALWAYS = frozenset("ad ads advert adverts advertisement adsense sponsored nav navbar navigation menu breadcrumb breadcrumbs sidebar cookies consent gdpr popup newsletter signup comments commentlist disqus replies pagination pager".split())
#: Names of classes that mark as a whole.
COMPOUNDS = frozenset("related-posts related-articles related-stories related-content related-links recommended-posts recommended-articles recommended-stories more-stories more-articles read-next up-next you-may-like".split())
#: Of the marks, also the identifier of a section marks it; other words name what a section is about.
READERS = frozenset("comment comments commentlist disqus respond replies".split())
#: Words that say where or what kind of part something is; beside them a mark marks.
PLACES = frozenset("site page top bottom left right upper lower inner outer main wrap wrapper container box area section block list form bar row column col panel button buttons link links item items group holder slot unit div google".split())
#: A name of a class that begins with one of these says what the page has, not what the element is.
MODIFIERS = frozenset("has no not non with without".split())
#: These end an open element of their kind, as parsers of HTML do.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table tbody thead tfoot div section article main body html blockquote".split())
#: Share of the standard deviation of the fused scores that a content path has at least.
THRESHOLD = 0.5

_TAG = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_END = re.compile(r"=\s*([\"'])|>")
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
_WORD = re.compile(r"[A-Za-z][a-z]*")


@dataclass(slots=True)
class Element:
    tag: str
    parent: int
    #: Number of its path of tags from the root.
    path: int
    left_out: bool
    #: A form, or marked by its words: left out too unless it holds most of the content nodes' text.
    doubtful: bool
    in_article: bool = False
    #: In the header of an article, of which headings stay.
    masthead: bool = False


@dataclass(slots=True)
class TextNode:
    element: int
    block: int
    text: str


def is_mark(name: list[str], anywhere: bool) -> bool:
    """Whether the words of one name mark its element; ``anywhere``: a last word of ALWAYS and whole compounds too."""
    if not name or name[0] in MODIFIERS:
        return False
    if any(w in MARKS for w in name) and all(w in MARKS or w in PLACES for w in name):
        return True
    return anywhere and ("-".join(name) in COMPOUNDS or next((w for w in reversed(name) if w not in PLACES), "") in ALWAYS)


def marked(tag: str, attributes: str) -> bool:
    """Whether names of class, id and role mark the element as no article text."""
    found: dict[str, list[list[str]]] = {}
    for m in _ATTRIBUTE.findall(attributes):
        found[m[0].lower()] = [[w.lower() for w in _WORD.findall(name)] for name in (m[1] or m[2] or m[3]).split()]
    if any(is_mark(name, True) for kind in ("class", "role") for name in found.get(kind, ())):
        return True
    named = [w for name in found.get("id", ()) for w in name]
    if tag in HEADINGS or not named:
        return False
    if tag == "section" or ["section"] in found.get("class", ()):
        return named[0] in READERS
    return is_mark(named, False)


class Tags:
    """The tags of a page, each found once; what follows an unclosed quote or tag isn't searched again."""

    def __init__(self, page: str):
        self.page, self.none_after = page, {c: len(page) + 1 for c in ("'", '"', "-->", ">")}

    def find(self, what: str, at: int) -> int:
        if at >= self.none_after[what]:
            return -1
        if (found := self.page.find(what, at)) < 0:
            self.none_after[what] = at
        return found

    def after(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """Start, end, whether it closes, name and attributes of the next tag; comments and the like have no name."""
        while m := _TAG.search(self.page, at):
            if m[2] is None:
                comment = m[0] == "<!--"
                end = self.find("-->" if comment else ">", m.end())
                return m.start(), len(self.page) if end < 0 else end + (3 if comment else 1), False, "", ""
            end = self._end(m.end())
            if end < 0:
                return None
            return m.start(), end + 1, bool(m[1]), m[2].lower(), self.page[m.end() : end]
        return None

    def _end(self, at: int) -> int:
        """The ``>`` of a tag; quotes count where a value begins, if they are closed and the tag ends after them."""
        if (plain := self.find(">", at)) < 0:
            return -1
        start = at
        while m := _END.search(self.page, start):
            if not m[1]:
                return m.start()
            closed = self.find(m[1], m.end())
            if closed < 0 or self.find(">", closed) < 0:
                break
            start = closed + 1
        return plain


def parse(page: str) -> tuple[list[Element], list[TextNode]]:
    """Elements, each with its parent's number, and text nodes, each with the number of its block."""
    elements = [Element("", -1, 0, False, False)]
    paths: dict[tuple[int, str], int] = {}
    texts: list[TextNode] = []
    stack = [0]
    opened: dict[str, int] = {}  # by kind, elements on the stack
    within: list[dict[str, int]] = [{}]  # the same of each scope
    tags = Tags(page)
    block = at = 0

    def close(first: int) -> None:
        for k in reversed(stack[first:]):
            tag = elements[k].tag
            opened[tag] -= 1
            if tag in SCOPES:
                within.pop()
            within[-1][tag] -= 1
        del stack[first:]

    while True:
        found = tags.after(at)
        start, end, closing, tag, attributes = found or (len(page), len(page), False, "", "")
        raw = page[at:start]
        if raw and not elements[stack[-1]].left_out:
            texts.append(TextNode(stack[-1], block, raw))
        if not found:
            return elements, texts
        at = end
        if not tag:
            continue
        if tag not in INLINE:
            block += 1
        elif tag == "br" and not elements[stack[-1]].left_out:
            texts.append(TextNode(stack[-1], block, " "))
        if closing:
            if opened.get(tag):
                close(next(k for k in range(len(stack) - 1, 0, -1) if elements[stack[k]].tag == tag))
            continue
        if tag in VOID:
            continue
        if any(within[-1].get(x) for x in CLOSES.get(tag, ())):
            close(next(k for k in range(len(stack) - 1, 0, -1) if elements[stack[k]].tag in CLOSES[tag]))
        above = elements[stack[-1]]
        masthead = (above.masthead or (tag == "header" and above.in_article and not above.left_out)) and (tag == "header" or tag not in LEFT_OUT)
        left_out = tag in LEFT_OUT or (above.left_out and not (above.masthead and tag in HEADINGS))
        doubtful = tag == "form" or (tag not in NEVER_LEFT_OUT and marked(tag, attributes))
        path = paths.setdefault((above.path, tag), len(paths) + 1)
        elements.append(Element(tag, stack[-1], path, left_out, doubtful, above.in_article or tag == "article", masthead))
        if attributes.endswith("/") and tag in LEFT_OUT:
            continue
        if tag in RAW:
            over = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = tags.find(">", over.end()) + 1 if over else 0
            at = at or len(page)
            block += 1
            continue
        stack.append(len(elements) - 1)
        opened[tag] = opened.get(tag, 0) + 1
        within[-1][tag] = within[-1].get(tag, 0) + 1
        if tag in SCOPES:
            within.append({})


def smoothed(values: list[float]) -> list[float]:
    padded = [values[0], *values, values[-1]]
    return [(a + 2 * b + c) / 4 for a, b, c in zip(padded, padded[1:], padded[2:], strict=False)]


def content_paths(elements: list[Element], texts: list[TextNode]) -> set[int]:
    """The paths whose fused, smoothed ratios pass the threshold."""
    paths: dict[int, list[float]] = {}
    for t in texts:
        if size := len(t.text.strip()):
            entry = paths.setdefault(elements[t.element].path, [0, 0, 0])
            entry[0] += size
            entry[1] += len(_PUNCTUATION.findall(t.text))
            entry[2] += 1
    if not paths:
        return set()
    text = smoothed([c / n for c, _, n in paths.values()])
    marks = smoothed([p / n for _, p, n in paths.values()])
    fused = [(a * (b + 0.05)) ** 0.5 for a, b in zip(text, marks, strict=True)]
    mean = sum(fused) / len(fused)
    deviation = (sum((x - mean) ** 2 for x in fused) / len(fused)) ** 0.5
    return {p for p, x in zip(paths, fused, strict=True) if x >= THRESHOLD * deviation}


def without_doubtful(elements: list[Element], texts: list[TextNode]) -> list[TextNode]:
    """The text nodes outside doubtful elements, but for elements that hold more than half of the content nodes' text; all nodes if no others are left."""
    if not any(e.doubtful for e in elements):
        return texts
    chosen = content_paths(elements, texts)
    weight = [0] * len(elements)
    for t in texts:
        if elements[t.element].path in chosen:
            weight[t.element] += len(t.text.strip())
    for k in range(len(elements) - 1, 0, -1):
        weight[elements[k].parent] += weight[k]
    out = [False] * len(elements)
    for k, e in enumerate(elements[1:], 1):
        out[k] = out[e.parent] or (e.doubtful and 2 * weight[k] <= weight[0])
    rest = [t for t in texts if not out[t.element]]
    return rest if any(t.text.strip() for t in rest) else texts


def article_element(elements: list[Element], texts: list[TextNode], chosen: set[int]) -> int:
    """The lowest element that holds all content nodes, or the outermost ``article`` or ``main`` around it."""
    holders = {t.element for t in texts if t.text.strip() and elements[t.element].path in chosen}
    weight = [0] * len(elements)
    for k in holders:
        weight[k] = 1
    for k in range(len(elements) - 1, 0, -1):
        weight[elements[k].parent] += weight[k]
    best = max((k for k in range(len(elements)) if weight[k] == len(holders)), default=0)  # the deepest comes last
    while elements[best].tag in TEXT_LEVEL:
        best = elements[best].parent
    at = best
    while at > 0:
        if elements[at].tag in ("article", "main"):
            best = at
        at = elements[at].parent
    return best


def kept_blocks(elements: list[Element], texts: list[TextNode], chosen: set[int]) -> set[int]:
    """Blocks with content nodes; those between them or in a container of theirs; first-level headings; headings of what is kept."""
    container, heading = [0] * len(elements), [""] * len(elements)
    for k, e in enumerate(elements[1:], 1):
        container[k] = container[e.parent] if e.tag in CARRIED else k
        heading[k] = e.tag if e.tag in HEADINGS else heading[e.parent] if e.tag in INLINE else ""
    first: dict[int, int] = {}
    content: set[int] = set()
    for t in texts:
        if t.text.strip():
            first.setdefault(t.block, t.element)
            if elements[t.element].path in chosen:
                content.add(t.block)
    if not content:
        return set()
    around = {container[first[b]] for b in content}
    low, high = min(content), max(content)
    kept, follows = set(), False
    for b in reversed(first):
        inside = b in content or low < b < high or container[first[b]] in around
        if inside or heading[first[b]] == "h1" or (heading[first[b]] and follows):
            kept.add(b)
        if not heading[first[b]]:
            follows = inside
    return kept


def main_text(page: str | None) -> str:
    """The article's blocks, joined by line feeds."""
    if not page:
        return ""
    elements, texts = parse(page)
    texts = without_doubtful(elements, texts)
    chosen = content_paths(elements, texts)
    root = article_element(elements, texts, chosen)
    inside = [k == root for k in range(len(elements))]
    for k in range(root + 1, len(elements)):
        inside[k] = inside[elements[k].parent]
    kept = kept_blocks(elements, texts, chosen)
    blocks: dict[int, list[str]] = {}
    for t in texts:
        if inside[t.element] and t.block in kept:
            blocks.setdefault(t.block, []).append(t.text)
    lines = (" ".join(html.unescape("".join(b)).split()) for b in blocks.values())
    return "\n".join(line for line in lines if line)


def extract_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [main_text(p) for p in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    bound_batches(pages.sparkSession)
    chosen = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return chosen.mapInArrow(run, "page_id long, url string, text string, n_chars long")
