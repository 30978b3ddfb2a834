"""Main text of web pages by two-pass block rules."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Very frequent words of English, French, German and Spanish.
STOP_WORDS = frozenset("""
the of and to in a is that it was for on are as with his they at be this from have or by one had not but what all were
le la les de des du un une et est en que qui dans pour pas sur avec par au ce il elle ne se plus sont
der die das und ist in den von zu mit sich des auf für nicht ein eine dem auch als an im werden aus er hat
el los las y que en un una es por con para del se no al lo su como más o pero sus
""".split())

# Elements that break a line of text, hold no text, or never hold an article's text.
BLOCK_TAGS = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre
section select summary table tbody td tfoot th thead title tr ul""".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE_TAGS = frozenset("""aside button canvas dialog footer form head header iframe menu nav noscript object select
svg template textarea title""".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
OUTSIDE_NAMES = frozenset("""ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment
comments comments-area cookie cookies consent disqus footer gdpr header login menu modal nav navbar navigation newsletter
notice notification pagination pager popup promo promoted promotion recommended related replies reply respond share
sharing sidebar side-bar signup skip social sponsor sponsored subscribe subscription tags toolbar widget widgets
""".split())
# Nouns that only say a thing is a container, words that make a name a property of something
# else ("with-sidebar"), and names of what readers write, which may outweigh a short article.
CONTAINERS = frozenset("""area bar block box button buttons cards col column container feed group holder icons inner item
items left link links list module outer overlay panel post posts region right row section slot top bottom unit wrap wrapper
""".split())
PROPERTIES = frozenset("and enable enabled has hide hides is no not show shows with without".split())
READERS = frozenset("comment comments comments-area disqus replies reply respond".split())

LONG, SHORT = 200, 70  # characters
LINKS, STOPS_HIGH, STOPS_LOW = 0.4, 0.30, 0.15  # shares of characters and of words
FOREIGN = 0.05  # share of stop words below which a page's language is taken for one without a list

# Elements whose content is not markup of the page's text.
RAW_TAGS = frozenset("script style noscript template svg iframe textarea".split())
JUDGED_TAGS = BLOCK_TAGS | OUTSIDE_TAGS | {"span"}

# the beginning of a tag, with its attributes and end where these are short
_OPEN = re.compile(r"<(?:(/?)([a-zA-Z][a-zA-Z0-9:-]*+)(?:((?:[^<>\"']{1,200}+|\"[^<\"]{0,200}+\"|'[^<']{0,200}+'){0,20}+)>)?|[!?])")
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_RAW_END = {tag: re.compile(rf"</{tag}\s*+>", re.I) for tag in RAW_TAGS}
_LONG_NUMBER = re.compile(r"&#[0-9]{8,}+;?")
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[A-Za-z]+")
_WORD = re.compile(r"\w+")
_LATIN = re.compile("[A-Za-z\u00c0-\u024f\u1e00-\u1eff]")
_WIDE = re.compile("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003134f]")


def outside(tag: str, attributes: str, inside: bool) -> tuple[bool, str]:
    """Whether an element is no part of the text for certain, and the listed name it bears, or "".

    ``inside`` an article, its header stays: it holds the headline.
    """
    if tag in OUTSIDE_TAGS and not (inside and tag == "header"):
        return True, ""
    if not attributes.strip():
        return False, ""
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or found.get("role") in OUTSIDE_ROLES:
        return True, ""
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")):
        return True, ""
    if tag in ("body", "html", "main", "article"):
        return False, ""
    names = map(listed, f"{found.get('class', '')} {found.get('id', '')}".split())
    return False, next((n for n in names if n and not (inside and n == "header")), "")


def listed(token: str) -> str:
    """The listed name that a class or id as a whole, or its head noun, is; else ""."""
    if token in OUTSIDE_NAMES:
        return token
    parts = _NAME.findall(token)
    if not PROPERTIES.isdisjoint(parts):
        return ""
    while len(parts) > 1 and parts[-1] in CONTAINERS:
        parts.pop()
    return parts[-1] if parts and parts[-1] in OUTSIDE_NAMES else ""


def extent(text: str) -> int:
    """Characters of a text; those of scripts that write a syllable or word in one count twice."""
    return len(text) if text.isascii() else len(text) + len(_WIDE.findall(text))


class Remembered(dict):
    """Results by arguments, asked for again and again; forgotten when ``most`` are held. Long arguments are not kept."""

    def __init__(self, function, most: int, longest: int):
        self.function, self.most, self.longest = function, most, longest

    def __missing__(self, key: tuple):
        found = self.function(*key)
        if len(self) >= self.most:
            self.clear()
        if sum(len(part) for part in key if isinstance(part, str)) <= self.longest:
            self[key] = found
        return found


def counted(text: str) -> tuple[int, int]:
    """Stop words and words of a text."""
    words = _WORD.findall(text.lower())
    return sum(map(STOP_WORDS.__contains__, words)), len(words)


_COUNTS = Remembered(counted, 512, 5000)
_OUTSIDE = Remembered(outside, 4096, 500)


def foreign(found: list[tuple]) -> bool:
    """Whether the page's long blocks hold so few stop words that its language is not listed."""
    known = total = 0
    for text, links, marked, *_ in found:
        if not marked and links <= LINKS and len(text) >= SHORT:
            stops, words = _COUNTS[text,]
            known, total = known + stops, total + words
    return total >= 20 and known < FOREIGN * total


def density(text: str, unlisted: bool) -> float:
    """Share of stop words; 1 where the list cannot know any: another language or script."""
    if unlisted or not text.isascii() and 2 * len(_LATIN.findall(text)) < sum(map(str.isalpha, text)):
        return 1.0
    stops, words = _COUNTS[text,]
    return stops / max(words, 1)


def prose(text: str, links: float, unlisted: bool) -> bool:
    """Whether a block by itself is running text."""
    size = extent(text)
    return links <= LINKS and size >= SHORT and density(text, unlisted) >= (STOPS_LOW if size > LONG else STOPS_HIGH)


def _resolved(found: list[tuple[str, float, bool, bool, int]], named: list[tuple[int, str]]) -> list[tuple[str, float, bool, bool]]:
    """Blocks with names judged: a name marks nothing where its element holds the main prose.

    That is more than half of the page's prose, or all of it where readers' texts are named.
    ``named`` lists (number of the named element around, name); a block has its innermost one's
    number, -1 for none. Elements are numbered from outside in, so one walk each way will do.
    """
    if not named:  # nothing is to be judged
        return [b[:4] for b in found]
    unlisted = foreign(found)
    total, held = 0, [0] * len(named)
    for text, links, marked, _, at in found:
        if not marked and prose(text, links, unlisted):
            total += len(text)
            if at >= 0:
                held[at] += len(text)
    for at in range(len(named) - 1, -1, -1):
        if named[at][0] >= 0:
            held[named[at][0]] += held[at]
    bad: list[bool] = []
    for (around, name), n in zip(named, held, strict=True):
        void = n and (n == total if name in READERS else 2 * n > total)
        bad.append(not void or around >= 0 and bad[around])
    return [(text, links, marked or at >= 0 and bad[at], inside) for text, links, marked, inside, at in found]


def _tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, is an end tag, name, attributes) of each tag; name "" for what is skipped whole.

    One walk forward. A tag ends at the first ``>`` outside quotes. Where quotes do not close
    before the page ends, they mean nothing from there on, so that no part is walked again and again.
    """
    at, quotes, last = 0, True, page.rfind(">")
    while m := _OPEN.search(page, at):
        start, at = m.span()
        if m[2] is None:
            for opening, closing in (("<!--", "-->"), ("<![CDATA[", "]]>")):
                if page.startswith(opening, start):
                    end = page.find(closing, start + len(opening))
                    at = len(page) if end < 0 else end + len(closing)
                    break
            else:
                if at > last:
                    continue
                at = page.index(">", at) + 1
            yield start, at, False, "", ""
            continue
        if at > last and m[3] is None:
            continue
        tag, attributes, end = m[2].lower(), m[3], at
        if attributes is None or not quotes:
            at = m.end(2)
            rest = _REST.match(page, at) if quotes else None
            quotes = rest is not None
            end = rest.end() if rest else page.index(">", at) + 1
            attributes = page[at: end - 1]
        if tag in RAW_TAGS and not m[1]:
            if not (tag == "svg" and attributes.endswith("/")):  # only this one may end in itself
                close = _RAW_END[tag].search(page, end)
                end = close.end() if close else len(page)
            tag = ""
        at = end
        yield start, end, bool(m[1]), tag, attributes


def _decoded(text: str) -> str:
    return html.unescape(_LONG_NUMBER.sub("\ufffd", text)) if "&" in text else text


def blocks(page: str) -> list[tuple[str, float, bool, bool]]:
    """(text, link share, in a marked element, in an article) for each text block in order."""
    found, parts, linked, total = [], [], 0, 0
    # tag, in a marked element, in an article, number of the innermost element with a listed name
    stack: list[tuple[str, bool, bool, int]] = []
    named: list[tuple[int, str]] = []
    opened: dict[str, int] = {}  # tags on the stack, by name
    none, link = ("", False, False, -1), 0

    def close() -> None:
        nonlocal parts, linked, total
        text = " ".join("".join(parts).split())
        if text:
            found.append((text, linked / max(total, 1), *(stack[-1] if stack else none)[1:]))
        parts, linked, total = [], 0, 0

    def pop() -> None:
        opened[stack.pop()[0]] -= 1

    at = 0
    for start, after, ending, tag, attributes in _tags(page):
        if start > at:
            piece = _decoded(page[at: start])
            parts.append(piece)
            n = len(piece.strip())
            total += n
            linked += n * (link > 0)
        at = after
        if tag == "a":
            link = 0 if ending else 1
        if tag in ("br", ""):
            parts.append(" ")
        if tag in BLOCK_TAGS:
            close()
            link = 0
        if tag in VOID_TAGS or not tag:
            continue
        if not ending:
            if stack and stack[-1][0] == "p" and tag in BLOCK_TAGS:  # a paragraph ends where a block begins
                pop()
            if tag in JUDGED_TAGS:
                _, marked, inside, around = stack[-1] if stack else none
                sure, name = _OUTSIDE[tag, attributes, inside]
                if (sure and not marked or name) and tag not in BLOCK_TAGS:
                    close()
                if name:
                    named.append((around, name))
                    around = len(named) - 1
                stack.append((tag, marked or sure, inside or tag in ("article", "main"), around))
                opened[tag] = opened.get(tag, 0) + 1
        elif opened.get(tag):
            if tag not in BLOCK_TAGS and (stack[-1][1] or stack[-1][3] >= 0):
                close()
            while stack[-1][0] != tag:
                pop()
            pop()
    if at < len(page):
        tail = page[at:]
        cut = _OPEN.search(tail)  # a tag without an end
        parts.append(_decoded(tail[: cut.start()] if cut and cut[2] else tail))
        total += len(tail)
    close()
    return _resolved(found, named)


def labels(found: list[tuple[str, float, bool, bool]]) -> list[bool]:
    """Pass one decides long, dense, linked and marked blocks; pass two lets the rest inherit."""
    first: list[bool | None] = []
    unlisted = foreign(found)
    # an article element counts if it holds most of the text that is kept: teasers do not
    within = [(text, links) for text, links, marked, inside in found if inside and not marked]
    article = bool(within) and sum(len(t) for t, links in within if links <= LINKS and extent(t) >= SHORT) >= sum(
        len(text) for text, links, marked, inside in found if not inside and not marked and prose(text, links, unlisted))
    for text, links, marked, inside in found:
        size = extent(text)
        if marked or links > LINKS or (article and not inside):
            first.append(False)
        elif size < SHORT:
            first.append(None)
        elif inside and article:
            first.append(True)
        else:
            stops = density(text, unlisted)
            sure = stops >= (STOPS_LOW if size > LONG else STOPS_HIGH)
            first.append(True if sure else None if stops >= STOPS_LOW else False)
    # neighbours are unmarked blocks on the same side of an article's border
    out = [bool(x) for x in first]
    for side in (True, False):
        row = [i for i, b in enumerate(found) if b[3] == side and not b[2]]
        before, after = _nearest(row, first), _nearest(row[::-1], first)
        for i in row:
            if first[i] is None:
                near = [j for j in (before[i], after[i]) if j is not None]
                least = min((abs(j - i) for j in near), default=0)
                # a short block alone in an article stays; between two equally near, both must be kept
                out[i] = all(first[j] for j in near if abs(j - i) == least) if near else side
    return out


def _nearest(row: list[int], first: list[bool | None]) -> dict[int, int | None]:
    """For each block of a row, the last decided one before it."""
    last, out = None, {}
    for i in row:
        out[i] = last
        last = last if first[i] is None else i
    return out


def main_text(page: str | None) -> str:
    """Article text of a page: kept blocks in page order, joined by an empty line."""
    found = blocks(page or "")
    return "\n\n".join(b[0] for b, keep in zip(found, labels(found), strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages(page_id, url, html, ...)``.

    Blocks inside elements marked as menus, forms, notices, adverts or comments are dropped.
    The others are classified by stop-word share, length and link share; ambiguous short
    blocks take the label of their nearest decided neighbours. Where article elements hold
    most of a page's prose, only their blocks count. A class or id marks an element by its whole
    or its head noun, and not where the element holds the page's main prose. Pages in a language
    without a stop list, and blocks in a script other than Latin, are judged by length and links. The work grows
    with a page's length, however broken its markup. A null or empty page gives an empty text; null ids and urls pass through, repeated rows give repeated results, other columns are ignored.
    """
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(_extracted, f"page_id {kind}, url string, text string, n_chars long")


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h.as_py()) for h in batch.column("html")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])
