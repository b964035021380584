"""Main text of web pages by text-to-tag ratio.

One pass of the standard library's streaming parser turns a page into blocks (the lines of the method): runs
of text between tags that break the flow, each with its tags, its link text and the elements it stands in.
The text-to-tag ratio of each block is smoothed with a Gaussian and clustered against a threshold, the
standard deviation of the page. Blocks above it are content; they select the region they stand in: the
innermost container around all of them. Inside that region every block counts, so that short
paragraphs and headings next to long ones are kept, while elements that by their name or class hold
navigation, adverts, forms, comments and the like are left out everywhere, unless nearly all text stands in them.

Pages are parsed one by one inside tasks; nothing is kept between them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# elements of HTML that break the flow of text (fixed values)
BLOCK_TAGS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre
section summary table tbody td tfoot th thead tr ul""".split())
# elements without an end tag (fixed values)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# elements whose content is never text of the page
SILENT_TAGS = frozenset("""script style noscript template head title svg annotation annotation-xml iframe object canvas audio
video map select option datalist textarea button""".split())
# elements that hold no article text, unless they hold nearly all there is
ASIDE_TAGS = frozenset("form nav footer aside dialog menu".split())
# parts of class, id and role names that mark an element as no article text
NOISE_NAMES = frozenset("""ad ads adv advert advertisement adverts advertising banner banners breadcrumb breadcrumbs
comment comments consent cookie cookies copyright disclaimer disqus footer form hidden masthead menu menus modal nav
navbar navigation newsletter notice notices pager pagination popup popover promo promos promoted recommended related
replies reply search share sharing sidebar sidebars sidenav signup skip social sponsor sponsored subscribe teaser toc
toolbar topbar widget widgets complementary contentinfo alert dialog alertdialog""".split())
# of these, words that an article is named after as well: they count alone or next to a word of layout
_AMBIGUOUS = frozenset("""alert complementary copyright disclaimer form hidden notice notices recommended related reply search
share sharing skip social teaser toc widget widgets""".split())
_LAYOUT = frozenset("""area article articles bar block box btn button buttons col column container content first footer group
header icon icons inner item items last left link links list main media module news outer page pane panel post posts right
row section stories story text title top bottom wrap wrapper""".split())
# text after a heading that says only this, up to the end of what it stands in, is the readers'
_READERS = re.compile(r"(?:\d+\s+)?(?:(?:reader|user)s?\S*\s+)?(?:comments?|replies|responses|kommentare?|commentaires?|comentarios?)"
                      r"(?:\s*\(\d+\))?:?|leave an? (?:comment|reply)", re.IGNORECASE)
# "with-sidebar" says nothing of the element's own content
_NEGATIONS = frozenset("with has no not without".split())
# the whole page may be named so, its content not
_WHOLE = frozenset(["html", "body", "main"])
_IN_HEAD = frozenset("title style script meta link base noscript template head".split())
# what holds text of an article where no element marks the article itself
_TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li pre blockquote dd dt td th figcaption caption".split())
# what may be the region where no article or main element is; a quote is part of a text, not its container
_CONTAINERS = frozenset("article main div section td center".split())
_TAG_START = re.compile(r"<[a-zA-Z/!?]")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_IMPLIED_END = {"p": BLOCK_TAGS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
                "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
                "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "option": frozenset(["option"])}


_ENDED_BY = {tag: [name for name, ends in _IMPLIED_END.items() if tag in ends] for tag in frozenset().union(*_IMPLIED_END.values())}
_HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
_ARTICLES = frozenset(["article", "main"])


@dataclass(slots=True)
class _Block:
    pieces: list[tuple[int, str, bool]]  # element it stands in, text, whether it is linked
    tags: int
    element: int  # the innermost around it; 0 is the page
    text: str = ""
    linked: int = 0


@dataclass(slots=True)
class _Element:
    tag: str
    number: int


def _hidden(attrs: list[tuple[str, str | None]]) -> bool:
    return any(key == "hidden" or (key == "aria-hidden" and value == "true")
               or (key == "style" and value and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))
               for key, value in attrs)


def _named_noise(attrs: list[tuple[str, str | None]]) -> bool:
    for key, value in attrs:
        if key in ("class", "id", "role") and value:
            for name in value.split():
                parts = [p.lower() for p in _NAME_PARTS.findall(name)]
                if not parts or parts[0] in _NEGATIONS:
                    continue
                found = {parts[0], parts[-1]} & NOISE_NAMES
                if found - _AMBIGUOUS or found and all(p in NOISE_NAMES or p in _LAYOUT for p in parts):
                    return True
    return False


class PageBlocks(HTMLParser):
    """Collects the blocks of one page from parser events. Open elements are closed as browsers do: a new block
    ends an open paragraph, an end tag ends all that is open inside its element.

    Elements are numbered as they open, so an element holds those from its own number to `last`.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[_Block] = []
        self.names, self.parents, self.last = [""], [0], [0]
        self.silent, self.noise = [False], [False]
        self._open: list[_Element] = []
        self._pieces: list[tuple[int, str, bool]] = []
        self._tags = self._links = self._articles = 0
        self._held: Counter[str] = Counter()  # open elements by name

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._tags += 1
        if tag == "br":
            self._add(" ")
        if tag in BLOCK_TAGS:
            self._end_block()
        if tag in VOID_TAGS:
            return
        if tag == "a":
            self._links += 1
        if tag not in _IN_HEAD and self._held["head"] and any(e.tag == "head" for e in self._open[:3]):
            self._close(next(i for i, e in enumerate(self._open) if e.tag == "head"))
        if any(self._held[name] for name in _ENDED_BY.get(tag, ())):
            self._end_implied(tag)
        above = self._open[-1].number if self._open else 0
        number = len(self.names)
        self.names.append(tag)
        self.parents.append(above)
        self.last.append(number)
        self.silent.append(self.silent[above] or tag in SILENT_TAGS or _hidden(attrs))
        self.noise.append(tag in ASIDE_TAGS or (tag == "header" and not self._articles)
                          or (tag not in _WHOLE and tag not in _HEADINGS and _named_noise(attrs)))
        self._articles += tag in _ARTICLES
        self._held[tag] += 1
        self._open.append(_Element(tag, number))

    def _end_implied(self, tag: str) -> None:
        """A start tag that ends the nearest open element of its kind, but none outside a list, table or section."""
        for i in range(len(self._open) - 1, -1, -1):
            name = self._open[i].tag
            if name in _IMPLIED_END and tag in _IMPLIED_END[name]:
                self._close(i)
                return
            if name in BLOCK_TAGS:
                return

    def _close(self, i: int) -> None:
        for e in self._open[i:]:
            self._articles -= e.tag in _ARTICLES
            self._held[e.tag] -= 1
            self.last[e.number] = len(self.names) - 1
            if e.tag == "a" and self._links:
                self._links -= 1
        del self._open[i:]

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        # "<div/>" is a start tag in HTML
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self._tags += 1
        if tag in BLOCK_TAGS:
            self._end_block()
        if not self._held[tag]:
            return
        for i in range(len(self._open) - 1, -1, -1):
            if self._open[i].tag == tag:
                self._close(i)
                return

    def _add(self, text: str) -> None:
        element = self._open[-1].number if self._open else 0
        if not self.silent[element]:
            self._pieces.append((element, text, self._links > 0))

    def handle_data(self, data: str) -> None:
        self._add(data)

    def _end_block(self) -> None:
        if any(t and not t.isspace() for _, t, _ in self._pieces):
            self.blocks.append(_Block(self._pieces, self._tags, self._open[-1].number if self._open else 0))
            self._tags, self._pieces = 0, []
        self._pieces.clear()

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        # "<![" outside of SVG and MathML starts a comment that ends at ">", whatever stands in it
        return self.parse_bogus_comment(i, report)

    def close(self) -> None:
        super().close()
        self._end_block()
        self._close(0)
        self.last[0] = len(self.names) - 1

    def within(self, chosen: set[int]) -> list[bool]:
        """Of each element, whether it is one of those chosen or inside of one."""
        out = [0 in chosen]
        for number in range(1, len(self.names)):
            out.append(number in chosen or out[self.parents[number]])
        return out

    def nearest(self, names: frozenset[str]) -> tuple[list[int], list[int]]:
        """Of each element, the outermost and the innermost of these names around it, itself included; 0 if none."""
        outer, inner = [0], [0]
        for number in range(1, len(self.names)):
            above = self.parents[number]
            inner.append(number if self.names[number] in names else inner[above])
            outer.append(outer[above] or inner[number])
        return outer, inner

    def around(self, elements: list[int], names: frozenset[str]) -> int:
        """The innermost element of these names that holds all of `elements`; 0 if there is none."""
        low, high = min(elements), max(elements)
        at = low
        while at and not (self.names[at] in names and self.last[at] >= high):
            at = self.parents[at]
        return at

    def spoken(self, share: float) -> list[_Block]:
        """Blocks without what stands in noise. An element marked as noise that holds more than `share` of all text that
        is not linked is none."""
        weight = [0] * len(self.names)
        for b in self.blocks:
            for element, text, linked in b.pieces:
                weight[element] += 0 if linked else len(text.strip())
        for number in range(len(self.names) - 1, 0, -1):
            weight[self.parents[number]] += weight[number]
        quiet = [False]
        for number in range(1, len(self.names)):
            quiet.append(quiet[self.parents[number]] or (self.noise[number] and weight[number] <= share * weight[0]))
        out: list[_Block] = []
        tags = 0
        readers = -1  # the last element of what follows a heading of readers' comments
        for b in self.blocks:
            kept = [(t, linked) for element, t, linked in b.pieces if not quiet[element]]
            b.text = " ".join("".join(t for t, _ in kept).split())
            b.linked = sum(len(t) for t, linked in kept if linked)
            tags += b.tags
            if b.text and self.names[b.element] in _HEADINGS and out and _READERS.fullmatch(b.text):
                readers = max(readers, self.last[self.parents[b.element]])
            if b.text and b.element > readers:
                b.tags, tags = tags, 0
                out.append(b)
        return out


@dataclass(frozen=True)
class RatioParams:
    sigma: float = 1.0  # of the Gaussian, in blocks
    reach: int = 2  # blocks on each side
    max_linked: float = 0.5  # a block with a larger share of link text is no content
    most: float = 0.8  # an element marked as noise is none if it holds more than this share of the text


def smoothed(values: list[float], params: RatioParams) -> list[float]:
    kernel = [math.exp(-(d * d) / (2 * params.sigma**2)) for d in range(-params.reach, params.reach + 1)]
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - params.reach), min(len(values), i + params.reach + 1)
        part = kernel[lo - i + params.reach:hi - i + params.reach]
        out.append(sum(k * v for k, v in zip(part, values[lo:hi])) / sum(part))
    return out


def content_blocks(page: PageBlocks, params: RatioParams = RatioParams()) -> list[str]:
    """Texts of the blocks of the content region, in page order."""
    blocks = page.spoken(params.most)
    if not blocks:
        return []

    def of_text(b: _Block) -> bool:
        return page.names[b.element] in _TEXT_TAGS or page.names[page.parents[b.element]] in _TEXT_TAGS

    linked = [b.linked > params.max_linked * len(b.text) for b in blocks]
    smooth = smoothed([0.0 if far else len(b.text) / max(1, b.tags) for b, far in zip(blocks, linked)], params)
    mean = sum(smooth) / len(smooth)
    threshold = min(math.sqrt(sum((x - mean) ** 2 for x in smooth) / len(smooth)), mean)
    hot = [x >= threshold and x > 0 for x in smooth]
    heaviest = sum(len(b.text) for b, is_hot in zip(blocks, hot) if is_hot)
    if not heaviest:
        return []
    # what the region has to hold: clustered blocks of their own weight or in an element of article text
    core = [b.element for i, b in enumerate(blocks) if hot[i] and not linked[i]
            and (len(b.text) / max(1, b.tags) >= threshold or of_text(b))]
    core = core or [b.element for b, is_hot in zip(blocks, hot) if is_hot]
    article, _ = page.nearest(_ARTICLES)
    inside = [e for e in core if article[e]]
    if 2 * sum(len(b.text) for b, is_hot in zip(blocks, hot) if is_hot and article[b.element]) > heaviest and inside:
        # the article or main element that holds all such blocks of these elements, else the outermost ones together
        shared = page.around(inside, _ARTICLES)
        held = page.within({shared} if shared else {article[e] for e in inside})
        return [b.text for b in blocks if held[b.element]]
    shared = page.around(core, _CONTAINERS)
    if shared:
        held = page.within({shared})
        return [b.text for b in blocks if held[b.element]]
    # the page itself is the region: its ends are cut to clustered blocks, to those that hold article text and to
    # all of the innermost containers of content; blocks of links stay in such containers only
    _, container = page.nearest(_CONTAINERS)
    within = page.within({container[e] for e in core if container[e]})
    held = [within[b.element] for b in blocks]
    keep = [i for i, b in enumerate(blocks) if held[i] or not linked[i] and (hot[i] or of_text(b))]
    return [b.text for i, b in enumerate(blocks) if keep and keep[0] <= i <= keep[-1] and (held[i] or not linked[i])]


def main_text(html: str | None, params: RatioParams = RatioParams()) -> str:
    """The blocks of the article, joined by an empty line; '' for null, empty or textless pages."""
    if not html:
        return ""
    # a tag that the page's end cuts off is none; the parser would look for the end of each such tag anew
    end = html.rfind(">") + 1
    broken = _TAG_START.search(html, end)
    page = PageBlocks()
    page.feed(html[:broken.start()] if broken else html)
    page.close()
    return "\n\n".join(content_blocks(page, params))


def extract_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                 params: RatioParams = RatioParams()) -> DataFrame:
    """One row per row of `pages`: page_id, url, text, n_chars (code points of the text).

    Defined cases: null or empty html, and pages without content, give the empty text; null ids and urls
    stay null; repeated rows give repeated rows; other columns are ignored; an empty table gives no rows.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    schema = rows.select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema

    def extracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(h, params) for h in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts,
                                "n_chars": [len(t) for t in texts]})

    return rows.mapInPandas(extracted, schema)
