"""Main text of HTML pages by two-pass block rules.

Markup is cut into blocks at block-level tags. Elements whose role is not the
article (navigation, page headers and footers, asides, forms, scripts, and
hidden elements, and elements whose class or id says advert, sidebar, notice,
comments and the like; never article or main by their class or id) give no blocks.

Pass 1 decides blocks by link density, length and stop-word density: mostly
links is boilerplate, long text with many stop words is content, and so is any
text that is not short inside a landmark; short blocks, and blocks between the
limits, stay open. Pass 2 gives an open block the label
of its nearest decided neighbours in the same landmark (``article`` or ``main``,
or what lies outside them): where both sides agree, or one side is nearer or
alone; at equal distance headings follow the next block and others the more
content-like side. In a landmark without decided blocks open blocks are content,
outside of one they are not. A page that has a landmark with content takes none
from outside it. Where no landmark has text and pass 1 finds no content, as in
languages without stop words here, it is repeated by link density and length.

Cases: null and empty pages, and pages without content blocks, give the empty
text. Pages are read whole; tags cut off at the end are dropped. Repeated rows
give repeated rows; columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG, SHORT = 140, 50
MANY, FEW = 0.12, 0.04
LINKS = 0.5

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)>|</?[a-zA-Z][^>]*\Z", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_RAW = frozenset("script style noscript template textarea iframe svg title".split())
_ROLE = frozenset("nav footer aside form button select option dialog head menu fieldset".split())
_BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_SECTION = frozenset("article aside body div footer form header main nav section table td ul ol".split())
_NOT_MAIN = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs cookie cookies consent notice alert popup modal comment comments disqus reply replies respond share sharing social related recommended newsletter subscribe footer masthead toolbar widget contentinfo complementary search".split())
# Words that may stand beside those in a compound name (site-footer, comment-list); others make a modifier (has-sidebar, tag-ads).
_PARTS = frozenset("site page main global top bottom list box block container wrap wrapper area section slot unit form link links button buttons bar item items post posts article articles inner outer primary secondary header title".split())
# Frequent function words of the languages served; a parameter of the density, not a list to match.
STOP_WORDS = frozenset(
    "the of and to in is it that for on as with by are be this was at from or an a he you not but they have had his her she which we all there their been has when who will more no if out so what up "
    "der die das und in zu den von mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis mehr durch man sein "
    "le la les de des du un une et en à que qui dans pour par sur est au aux ce il elle ne pas plus se son sa ses avec ou mais nous vous ils cette comme sont on leur y "
    "el los las de del que y en un una por con no es para al lo como más pero sus su se ha o este sí porque esta entre cuando muy sin sobre también me hasta hay donde".split()
)
_WORD = re.compile(r"[^\W\d_]+")


def not_main(name: str, attributes: str) -> bool:
    """Whether the attributes of an element say that it isn't the article.

    Class and id count by whole tokens between blanks, never on a landmark; role
    and the two ways to hide count everywhere. A compound token counts where all
    its parts are known.
    """
    for found in _ATTRIBUTE.finditer(attributes):
        key, value = found.group(1).lower(), entities.unescape((found.group(2) or "").strip("\"'")).strip().lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True
        if key == "role" or (key in ("class", "id") and name not in ("article", "main")):
            for token in value.split():
                parts = {x for x in re.split(r"[^a-z]+", token) if x}
                if parts & _NOT_MAIN and parts <= _NOT_MAIN | _PARTS:
                    return True
    return False


@dataclass
class Block:
    text: str
    linked: int
    landmark: int  # 0 outside of article and main
    heading: bool
    label: bool | None = None


def blocks_of(page: str) -> list[Block]:
    """Blocks with text, in page order, without those of elements that are not the article."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int]] = []  # name, not the article, landmark
    parts: list[str] = []
    linked = 0
    landmarks = 0
    names: Counter[str] = Counter()  # open elements

    def close(depth: int) -> None:
        for name, _, _ in stack[depth:]:
            names[name] -= 1
        del stack[depth:]

    def flush(heading: bool) -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, linked, stack[-1][2] if stack else 0, heading))
            parts, linked = [], 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not (stack and stack[-1][1]):
            text = entities.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if names["a"]:
                linked += len(text.strip())

    at = 0
    while m := _TAG.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        name = (m.group(2) or m.group(5) or "").lower()
        if not name:
            continue
        if name in _BLOCK:
            flush(any(names[n] for n in _HEADING))
        if m.group(1) or m.group(4):
            depth = len(stack) - 1 if names[name] else -1
            while depth >= 0 and stack[depth][0] != name:
                # Inline ends don't close the section around them.
                depth = -1 if name not in _SECTION and stack[depth][0] in _SECTION else depth - 1
            if depth >= 0:
                close(depth)
            continue
        attributes = m.group(3) or m.group(6) or ""
        if name in _RAW:
            if not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if name in _VOID or attributes.rstrip().endswith("/"):
            continue
        if name in _BLOCK and names["p"]:
            depth = len(stack) - 1
            while stack[depth][0] != "p" and stack[depth][0] not in _SECTION:
                depth -= 1
            if stack[depth][0] == "p":
                close(depth)
        if name == "li" and stack and stack[-1][0] == "li":
            close(len(stack) - 1)
        outside, landmark = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
        if name in ("article", "main") and not landmark:
            landmarks += 1
            landmark = landmarks
        if name in _ROLE or (name == "header" and not landmark):
            outside = True
        if not outside and attributes and name not in ("html", "body"):
            outside = not_main(name, attributes)
        stack.append((name, outside, landmark))
        names[name] += 1
    add(page[at:])
    flush(any(names[n] for n in _HEADING))
    return out


def first_pass(block: Block, by_words: bool = True) -> bool | None:
    """True for content, False for boilerplate, None if open; without ``by_words`` by links and length alone."""
    size = len(block.text)
    if block.linked > LINKS * size and not block.heading:
        return False
    if not by_words:
        return True if size >= (SHORT if block.landmark else LONG) else None
    words = _WORD.findall(block.text)
    stops = sum(w.lower() in STOP_WORDS for w in words) / max(1, len(words))
    if size >= LONG and stops >= MANY:
        return True
    if block.landmark:
        return True if size >= SHORT else None
    return False if size >= SHORT and stops < FEW else None


def second_pass(blocks: list[Block]) -> None:
    """Label the open blocks from their nearest decided neighbours."""
    for mark in {b.landmark for b in blocks}:
        own = [b for b in blocks if b.landmark == mark]
        first = [b.label for b in own]
        decided = np.array([i for i, x in enumerate(first) if x is not None], np.int64)
        for i, block in enumerate(own):
            if first[i] is not None:
                continue
            k = int(np.searchsorted(decided, i))
            before = i - decided[k - 1] if k else None
            after = decided[k] - i if k < len(decided) else None
            if before is None and after is None:
                block.label = mark > 0
            elif after is None or (before is not None and before < after):
                block.label = first[decided[k - 1]]
            elif before is None or after < before:
                block.label = first[decided[k]]
            else:
                block.label = first[decided[k]] if block.heading else first[decided[k]] or first[decided[k - 1]]


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    for block in blocks:
        block.label = first_pass(block)
    if not any(b.label or b.landmark for b in blocks):
        for block in blocks:
            block.label = first_pass(block, by_words=False)
    second_pass(blocks)
    inside = [b for b in blocks if b.label and b.landmark]
    return " ".join(b.text for b in (inside or [b for b in blocks if b.label]))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
