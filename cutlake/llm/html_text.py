"""Main text of web pages: blocks are cut at block-level tags, judged by rules, and unclear ones follow their neighbours."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutlake.llm.common import read, text_groups
from cutlake.llm.quality_rules import STOP_WORDS

# A block under SHORT characters is judged by its neighbours; one of LONG or more needs fewer stop words.
SHORT, LONG = 70, 200
STOPS_LOW, STOPS_HIGH = 0.15, 0.25
MAX_LINKS = 0.5

# Element names of HTML.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noscript ol option p pre search "
    "section select summary table tbody td template tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
RAW_TAGS = frozenset("iframe noembed noframes script style textarea title xmp".split())
# Elements that never hold the article.
DROPPED_TAGS = frozenset(
    "aside audio button canvas datalist dialog fieldset footer form label legend map menu nav noscript object option "
    "search select svg template video".split()
)
DROPPED_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status tablist toolbar".split()
)
# Words in class and id by which pages name what surrounds an article.
ADVERT_WORDS = frozenset("ad ads adsense adslot adv advert advertisement advertising adverts promo promoted promotion sponsor sponsored".split())
COMMENT_WORDS = frozenset("comment commentlist comments disqus replies reply respond".split())
CLUTTER_WORDS = ADVERT_WORDS | COMMENT_WORDS | frozenset(
    "aside banner breadcrumb breadcrumbs consent cookie cookies copyright footer form gdpr header login masthead menu modal "
    "nav navbar navigation newsletter notice notification outbrain overlay pager pagination paywall popup recommended related "
    "rail search share sharing sidebar signup social subscribe taboola toolbar topbar widget widgets".split()
)
NEGATIONS = frozenset("has is no with without".split())

# Which open elements the start of one ends.
_ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"},
    "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"},
}
_MARKUP = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW_TAGS}
_NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_LEGAL = re.compile(r"(?:©|\(c\)\s|copyright\b)|.*\ball rights reserved\b", re.I | re.S)
_WORD_ENDS = ".,;:!?\"'()[]{}«»„“”‘’…-"
_STOPS = frozenset(STOP_WORDS)

DROP, ARTICLE, MAIN, LINK, HEADING, ITEM, HEADER = (1 << i for i in range(7))
GOOD, BAD = True, False


@dataclass
class Block:
    """The text between two block-level tags. ``label``: True main text, False not, None unclear."""

    flags: int
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""
    label: bool | None = None


def _names_clutter(name: str, attrs: str) -> bool:
    """Whether role, class, id or being hidden tells that an element isn't part of an article."""
    for key, *values in _ATTRIBUTE.findall(attrs):
        value = next(filter(None, values), "")
        key = key.lower()
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return name not in ("html", "body")
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return name not in ("html", "body")
        if key == "role" and value.lower() in DROPPED_ROLES:
            return True
        if key not in ("class", "id") or name in HEADINGS or name in ("html", "body"):
            continue
        telling = CLUTTER_WORDS
        if name in ("article", "main"):
            telling = COMMENT_WORDS
        elif name not in BLOCK_TAGS:
            telling = ADVERT_WORDS
        for part in value.split():
            before = ""
            for word in map(str.lower, _NAME_WORDS.findall(part)):
                if word in telling and before not in NEGATIONS:
                    return True
                before = word
    return False


class _Page:
    """Open elements and finished blocks of one page; one pass over its markup."""

    def __init__(self) -> None:
        self.open: list[tuple[str, int]] = []
        self.count: Counter[str] = Counter()
        self.blocks: list[Block] = []
        self.block: Block | None = None

    @property
    def flags(self) -> int:
        return self.open[-1][1] if self.open else 0

    def text(self, raw: str) -> None:
        flags = self.flags
        if flags & DROP or (flags & HEADER and not flags & HEADING) or not raw:
            return
        decoded = html.unescape(raw) if "&" in raw else raw
        if self.block is None:
            if decoded.isspace():
                return
            self.block = Block(flags)
        self.block.pieces.append(decoded)
        if flags & LINK:
            self.block.linked += len(" ".join(decoded.split()))

    def flush(self) -> None:
        if self.block is not None:
            self.block.text = " ".join("".join(self.block.pieces).split())
            if self.block.text:
                self.blocks.append(self.block)
            self.block = None

    def pop_to(self, name: str) -> None:
        while self.open:
            last = self.open.pop()[0]
            self.count[last] -= 1
            if last == name:
                return

    def start(self, name: str, attrs: str) -> None:
        if name in BLOCK_TAGS:
            self.flush()
            if self.count["p"]:
                self.pop_to("p")
            ends = _ENDS.get(name)
            for held, _ in reversed(self.open) if ends else ():
                if held in ends:
                    self.pop_to(held)
                    if name != "tr" or held == "tr":
                        break
                elif held in BLOCK_TAGS:
                    break
            if name in ("article", "main"):
                # Menus and page headers hold no article: one that is still open was never closed.
                for unclosed in ("nav", "header"):
                    if self.count[unclosed]:
                        self.pop_to(unclosed)
        elif name == "br":
            self.text(" ")
        if name in VOID_TAGS or name == "head":
            return
        flags = self.flags
        if name in DROPPED_TAGS or (attrs and not attrs.isspace() and _names_clutter(name, attrs)):
            # What names itself a header within an article may hold its title.
            inside = flags & (ARTICLE | MAIN) and name not in DROPPED_TAGS and _only_header(attrs)
            flags |= HEADER if inside else DROP
        elif name == "header":
            flags |= HEADER if flags & (ARTICLE | MAIN) else DROP
        elif name == "article":
            flags |= ARTICLE
        elif name == "main":
            flags |= MAIN
        elif name == "a":
            flags |= LINK
        elif name in HEADINGS:
            flags |= HEADING
        elif name == "li":
            flags |= ITEM
        self.open.append((name, flags))
        self.count[name] += 1

    def end(self, name: str) -> None:
        if name in BLOCK_TAGS:
            self.flush()
            if name in HEADINGS:
                name = next((held for held, _ in reversed(self.open) if held in BLOCK_TAGS), name)
                name = name if name in HEADINGS else ""
            if name not in ("body", "html") and self.count[name]:
                self.pop_to(name)
        elif name == "br":
            self.text(" ")
        elif self.count[name]:
            for held, _ in reversed(self.open):
                if held == name:
                    self.pop_to(name)
                    break
                if held in BLOCK_TAGS:
                    break


def _only_header(attrs: str) -> bool:
    words = {w.lower() for _, *values in _ATTRIBUTE.findall(attrs) for v in values for w in _NAME_WORDS.findall(v)}
    return words & CLUTTER_WORDS == {"header"}


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order, without those in elements that never hold an article."""
    state, at = _Page(), 0
    while found := _MARKUP.search(page, at):
        if found.start() > at:
            state.text(page[at : found.start()])
        at = found.end()
        name = (found["name"] or "").lower()
        if not name:
            continue
        if found["close"]:
            state.end(name)
            continue
        if name in RAW_TAGS:
            if name in BLOCK_TAGS or name == "iframe":
                state.flush()
            ended = _RAW_END[name].search(page, at)
            at = ended.start() if ended else len(page)
            continue
        state.start(name, found["attrs"])
    state.text(page[at:])
    state.flush()
    return state.blocks


def _first_pass(block: Block, zoned: bool) -> bool | None:
    """The label that place, links, length and stop words of a block give it; None where they don't tell."""
    inside = block.flags & ARTICLE
    if zoned and not block.flags & (ARTICLE | MAIN):
        return BAD
    if block.linked > MAX_LINKS * len(block.text):
        return None if (inside and not block.flags & ITEM) or block.flags & HEADING else BAD
    if block.flags & HEADING:
        return None
    if not inside and _LEGAL.match(block.text):
        return BAD
    if len(block.text) < SHORT:
        return None
    if inside:
        return GOOD
    words = block.text.lower().split()
    stops = sum(word.strip(_WORD_ENDS) in _STOPS for word in words)
    if stops >= STOPS_HIGH * len(words) or (stops >= STOPS_LOW * len(words) and len(block.text) >= LONG):
        return GOOD
    return None if stops >= STOPS_LOW * len(words) else BAD


def label(blocks: list[Block]) -> None:
    """Both passes of the rules over the blocks of a page.

    Unclear blocks take the label of the nearest decided one, the article's where both are
    equally near; headings that of the next decided one. With none decided, all are kept.
    """
    zoned = any(block.flags & (ARTICLE | MAIN) for block in blocks)
    for block in blocks:
        block.label = _first_pass(block, zoned)
    if not any(block.label for block in blocks):
        # No block reads like prose of a known language: stop words say nothing here.
        for block in blocks:
            fits = not zoned or block.flags & (ARTICLE | MAIN)
            if fits and len(block.text) >= SHORT and block.linked <= MAX_LINKS * len(block.text) and not _LEGAL.match(block.text):
                block.label = GOOD
    # Blocks outside the article's element are no neighbours of those inside.
    near = [block for block in blocks if not zoned or block.flags & (ARTICLE | MAIN)]
    decided = [block.label for block in near]
    far = len(near) + 1
    after: list[tuple[int, bool | None]] = [(far, None)] * len(near)
    reach, held = far, None
    for i in range(len(near) - 1, -1, -1):
        reach, held = (0, decided[i]) if decided[i] is not None else (reach + 1, held)
        after[i] = (reach, held)
    reach, held = far, None
    for i, block in enumerate(near):
        reach, held = (0, decided[i]) if decided[i] is not None else (reach + 1, held)
        ahead, other = after[i]
        if decided[i] is not None:
            continue
        if held is None or other is None:
            block.label = next((x for x in (held, other) if x is not None), GOOD)
        elif block.flags & HEADING:
            block.label = other
        else:
            block.label = held or other if reach == ahead else (held if reach < ahead else other)


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    label(blocks)
    return " ".join(block.text for block in blocks if block.label)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row.

    ``text`` holds the blocks of the article in page order, character references decoded,
    each run of white space one space, joined by one space; it is empty where there is none,
    also for null and empty pages. Pages of any length are read whole, one at a time. Rows
    that repeat, null ids and null urls stay as they are; other columns are not read.
    """
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    kinds = dict(pages.dtypes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_groups(batches, "html", 8 << 20):
            found = [main_text(text) for text in texts]
            columns = [rows.column("page_id"), rows.column("url"), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    return pages.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(read(spark, sf_dir, "pages", "page_id", "url", "html"))
