"""Main-text extraction from HTML by two-pass block rules.

A page is cut into blocks at block-level tags. Menus, footers, sidebars, notices, adverts, forms and reader comments are
known by the elements around a block (their names, roles and class names) and are bad from the start. All other blocks are
decided by their text, in two passes:

1. Link density, length and stop-word density make a block good or bad; short blocks, and blocks whose density says
   neither, stay open.
2. An open block inherits the label of the nearest decided neighbours: those in its own container (article, section,
   div) first, those of the page if its container has none; the better label on a tie.

``article`` and ``main`` are hints: inside, a low stop-word density leaves a block open instead of making it bad (code,
tables, languages without stop words here), and open blocks with no decided neighbour in the element are good; outside,
in a page with an article, a block must pass the strict threshold of length and density.

Edge cases: a null or empty page has the text ''; markup cut off at the end is read as far as it goes; an element whose
content is no text (script, button, select) and that is never closed ends at the next block-level tag, an ``option``
also at the next one, so nothing behind it is lost; repeated rows are extracted one by one.
"""

from __future__ import annotations

import bisect
import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STOP = frozenset(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were her all she there would their we him been has when who will more no if out so what up said its about into than them can only other new some could time these two may then do "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde "
    "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son ou cette aux mais comme nous sa tout fait ont leur "
    "el que y los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue".split()
)
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose content is read as characters up to their end tag, other elements whose text is not text of the page,
#: and those of them that also end where the next of their kind begins.
RAW = frozenset("script style noscript textarea title iframe xmp noembed noframes".split())
SILENT = frozenset("template svg math object select option optgroup button canvas audio video datalist".split())
SHORT_LIVED = frozenset("option optgroup".split())
#: Elements whose blocks are never main text, empty elements, and elements that hold neighbours.
OUT = frozenset("nav footer aside form header menu dialog search fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset("article main".split())
HOLDERS = frozenset("article main section div td th blockquote details body html nav footer aside form header".split())
_HINT = re.compile(r"(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|gdpr|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|pagination|pager|popup|promo\w*|related|replies|reply|respond|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget)", re.I)
_PARTS = re.compile(r"[_-]+|(?<=[a-z0-9])(?=[A-Z])")
_NEGATED = frozenset("has no with without is not".split())
_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>|<[!?][^>]*(?:>|$)|</?[a-zA-Z][^<]*$", re.S)
_ATTR = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_BLOCK_TAG = re.compile(r"</?(?:" + "|".join(sorted(BLOCK, reverse=True)) + r")(?=[\s/>])", re.I)
_BLOCK_START = re.compile(r"<(?:" + "|".join(sorted(BLOCK, reverse=True)) + r")(?=[\s/>])", re.I)
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"\w+")


class Block:
    __slots__ = ("chars", "density", "heading", "holder", "link", "main", "out", "parts", "text", "verdict")

    def __init__(self, out: bool, main: bool, holder: int, heading: bool):
        self.parts, self.link, self.out, self.main, self.holder, self.heading = [], 0, out, main, holder, heading
        self.verdict, self.text, self.chars, self.density = "", "", 0, 0.0


def hinted(name: str, attributes: str) -> bool:
    """Whether role, class or id of an element call it a menu, notice, advert, comment or the like."""
    for k, a, b, c in _ATTR.findall(attributes):
        key, value = k.lower(), a or b or c
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "role" and value.lower() in _ROLE):
            return True
        if key in ("class", "id"):
            for i, token in enumerate(value.split()):
                words = [w for w in _PARTS.split(token) if w]
                if not words or words[0].lower() in _NEGATED or (name in MAIN and i):
                    continue  # an article is known by its first class only
                if _HINT.fullmatch(words[0]) or _HINT.fullmatch(words[-1]):
                    return True
    return False


def _silent_end(page: str, name: str, at: int) -> int:
    """Where the content of an element without text ends that begins at ``at``."""
    if name in RAW:
        end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, at)
        if end:
            return end.end()
        after = _BLOCK_START.search(page, at)
        return after.start() if after else len(page)
    if name in SHORT_LIVED:
        end = re.compile(r"</?(?:option|optgroup|select|datalist)(?=[\s/>])", re.I).search(page, at)
        block = _BLOCK_TAG.search(page, at, end.start() if end else len(page))
        return block.start() if block else end.start() if end else len(page)
    depth = 1
    for m in re.compile(rf"<(/?){name}(?=[\s/>])[^>]*>?", re.I).finditer(page, at):
        depth += -1 if m[1] else 0 if m[0].endswith("/>") or name in ("button", "select") else 1
        if not depth:
            return m.end()
    block = _BLOCK_TAG.search(page, at)
    return block.start() if block else len(page)


def blocks(page: str) -> list[Block]:
    """The non-empty blocks of a page in order, with the elements around them taken into account."""
    found: list[Block] = []
    stack: list[tuple[str, bool, bool, int]] = []  # name, out, main, holder
    out = main = False
    holder = n_holders = 0
    links, now, at, size = 0, Block(False, False, 0, False), 0, len(page)

    def close(heading: bool = False) -> None:
        nonlocal now
        if now.parts:
            found.append(now)
        now = Block(out, main, holder, heading)

    def words(text: str) -> None:
        if text:
            text = html.unescape(text)
            now.parts.append(text)
            if links:
                now.link += len(_SPACE.sub("", text))

    def around() -> None:
        nonlocal out, main, holder
        _, out, main, holder = stack[-1] if stack else ("", False, False, 0)

    while at < size:
        m = _TOKEN.search(page, at)
        if not m:
            words(page[at:])
            break
        words(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        attributes = m[3] or m[6] or ""
        if m[1] or m[4]:
            if name == "a":
                links = max(0, links - 1)
            if any(x[0] == name for x in stack):
                while stack and stack.pop()[0] != name:
                    pass
                around()
            if name in BLOCK:
                links = 0 if name in HOLDERS else links
                close()
            continue
        if name in RAW or name in SILENT:
            if not attributes.endswith("/"):
                at = _silent_end(page, name, at)
            continue
        if name == "br":
            now.parts.append(" ")
        elif name == "a":
            links = 1  # links don't nest
        if name not in BLOCK:
            continue
        if name in ("p", "li", "dt", "dd", "tr", "td", "th") and stack and stack[-1][0] == name:
            stack.pop()  # an end tag that may be left out
            around()
        if name not in VOID:
            was_main = main
            main = main or name in MAIN
            out = out or (name in OUT and not (name == "header" and was_main)) or (name not in ("body", "html", "head") and hinted(name, attributes))
            if name in HOLDERS:
                n_holders += 1
                holder = n_holders
            stack.append((name, out, main, holder))
        close(name in ("h1", "h2", "h3", "h4", "h5", "h6"))
    close()
    kept = []
    for b in found:
        b.text = _SPACE.sub(" ", "".join(b.parts)).strip()
        if b.text:
            b.chars = len(b.text) - b.text.count(" ")
            tokens = _WORD.findall(b.text.lower())
            b.density = sum(w in STOP for w in tokens) / max(1, len(tokens))
            kept.append(b)
    return kept


def first_pass(b: Block, short: int, max_links: float, low: float, high: float) -> str:
    """good, bad or open, from the block alone."""
    if b.out:
        return "bad"
    if b.link > max_links * b.chars:
        return "open" if b.main and b.heading else "bad"
    if "©" in b.text and len(b.text) < 3 * short and not b.main:
        return "bad"
    if len(b.text) < short:
        return "bad" if b.link and not b.main else "open"
    if b.density >= high or (b.density >= low and len(b.text) >= 3 * short):
        return "good"
    return "open" if b.density >= low or b.main else "bad"


def nearest(i: int, decided: list[int], found: list[Block]) -> str:
    """The label of the decided blocks (ascending) nearest to block ``i``, the better one on a tie; '' if there are none."""
    at = bisect.bisect(decided, i)
    sides = [(abs(i - j), found[j].verdict != "good") for j in decided[max(0, at - 1) : at + 1]]
    return ("bad" if min(sides)[1] else "good") if sides else ""


def label(found: list[Block], short: int = 70, max_links: float = 0.4, low: float = 0.08, high: float = 0.2, strict: float = 0.3) -> None:
    """Both passes: afterwards every block is good or bad.

    ``short`` is in characters, ``max_links`` the share of linked characters, ``low`` and ``high`` are stop-word densities,
    ``strict`` is the density asked of a block of ``3 * short`` characters that stands outside the article.
    """
    for b in found:
        b.verdict = first_pass(b, short, max_links, low, high)
    article = any(b.main and b.verdict != "bad" for b in found)
    decided, own = [], {}
    for i, b in enumerate(found):
        if article and b.verdict == "good" and not b.main and not (b.density >= strict and len(b.text) >= 3 * short):
            b.verdict = "open"
        if b.verdict != "open":
            own.setdefault(b.holder, []).append(i)
            if not (article and b.main):  # what stands around an article takes no label from it
                decided.append(i)
    final = {}
    for i, b in enumerate(found):
        if b.verdict == "open":
            final[i] = nearest(i, own.get(b.holder, []), found) or (b.main and "good") or nearest(i, decided, found) or ("bad" if article else "good")
    for i, verdict in final.items():
        found[i].verdict = verdict


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    label(found)
    return "\n".join(b.text for b in found if b.verdict == "good")


def extract(page: Column) -> Column:
    """The main text of a column of pages."""

    @F.pandas_udf("string")
    def run(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in pages:
            yield s.map(main_text)

    return run(page)


def op5_html(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of the whole table."""
    return pages.select("page_id", "url", extract(F.coalesce("html", F.lit(""))).alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))
