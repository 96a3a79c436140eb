"""Main text of web pages by two passes of block rules.

Pass one labels every block from its stop-word density, length and link density; markup that is never
article text (navigation, footers, asides, forms, notices, adverts, comments, scripts) is bad by its
element or its class and id names. Pass two lets the undecided short blocks inherit the label of their
nearest decided neighbours: good if both sides are good, or the nearer one is.

A class or id name doesn't condemn a wrapper: an element that holds an article, a first headline or most of the
page's text stands, unless its name is that of comments, footers, menus or notices. On pages in a language
whose function words aren't listed, length and link density alone decide.

Defined results: null html and pages without blocks give an empty text; unclosed and stray tags are tolerated;
a quote that is never closed ends with its tag, a comment that is never closed at its first '>', a last tag
without its '>' is dropped; nothing else is cut off, however long a page is, and the time taken grows with its
length; rows that repeat get the same result each; an empty table gives no rows; columns other than page_id,
url and html are ignored, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent function words of the languages that the rules know.
STOP_WORDS = {
    "en": "the of and to in a is that it for on was be with as by at from this are or an not which he his have had but they you were her all she there been one we their has would what will if can more who so no when up out into than them",
    "fr": "le la les de des du un une et est que qui en dans pour pas par sur au aux ce se il elle ne plus avec son sa ses ou mais nous vous ont cette comme sont",
    "de": "der die das und den von zu in mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder",
    "es": "el la los las de del y que en un una por con no para es se su al lo como más pero sus le ya o fue este ha sí porque esta son entre cuando muy sin sobre",
    "it": "il lo la i gli le di del della che e un una in per non con si da come più ma sono al dei nel",
    "pt": "o a os as de do da dos das e que em um uma para com não por se na no mais como mas foi ao ele",
    "nl": "de het een en van in is dat op te zijn met voor niet aan er om ook als maar bij",
}
STOPS = frozenset(w for ws in STOP_WORDS.values() for w in ws.split())
SKIPPED = frozenset("script style noscript template svg math head iframe object embed canvas audio video select textarea button".split())
BAD_TAGS = frozenset("nav footer aside form menu dialog fieldset header".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Words of class and id names that stand for what is no article text. Those of the first kind are
# never a wrapper of the article.
FIRM_NAMES = r"comments?|comment-?list|disqus|replies|respond|cookies?|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|signup|login|nav\w*|menu\w*|breadcrumbs?|footer\w*|pagination|pager|share|sharing|copyright|ads?|advert\w*|adsense"
LOOSE_NAMES = r"banner|sponsor\w*|promo\w*|sidebar\w*|header|masthead|topbar|toolbar|social\w*|related|recommend\w*|widget\w*|tags|tagcloud|skip|legal"
BAD_NAMES = re.compile(rf"(?:^|[\s_-])(?:(?P<firm>{FIRM_NAMES})|{LOOSE_NAMES})(?:$|[\s_-])", re.I)
MODIFIER = re.compile(r"(?:^|(?<=\s))(?:with|has|no|without|show|hide|is)[_-]\S*", re.I)  # with-sidebar says nothing of an element's own role
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# a tag without quotes, or with whole quoted values that hold no angle brackets
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>\"']|=\s*+\"[^<>\"]*+\"|=\s*+'[^<>']*+')*+)>")
TAG_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
TAG_STOP = re.compile(r"[>\"']")
ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
RAW_END = {name: re.compile(rf"</{name}[\s/]*>", re.I) for name in ("script", "style", "textarea", "iframe")}  # their content holds no tags
WORD = re.compile(r"[^\W\d_]+")
SPACE = re.compile(r"\s+")


@dataclass(frozen=True)
class HtmlRules:
    """Stop-word densities that make a long block good, a middling one near good; lengths in characters."""

    high_stops: float = 0.30
    low_stops: float = 0.12
    short: int = 70
    long: int = 200
    links: float = 0.33


@dataclass
class Block:
    text: str
    link_chars: int
    tag: str
    bad: bool
    article: bool


def _bad_attributes(attrs: str, heading: bool) -> int:
    """2: never article text; 1: only by a name that a wrapper of it may have, too; 0: nothing said."""
    found = 0
    for m in ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name in ("class", "id") and not heading:
            for hit in BAD_NAMES.finditer(MODIFIER.sub("", value)):
                found = max(found, 2 if hit["firm"] else 1)
        if name == "role" and value.lower() in BAD_ROLES or name == "aria-hidden" and value.lower() == "true":
            return 2
        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return 2
    return found


@dataclass(slots=True)
class Tag:
    """A tag or comment (name empty) of a page."""

    start: int
    end: int
    closing: bool = False
    name: str = ""
    attrs: str = ""


class _Scanner:
    """Finds the next tag; remembers what a page no longer holds, so that no part is searched again and again."""

    def __init__(self, page: str):
        self.page, self.gone = page, set()

    def find(self, what: str, at: int) -> int:
        if what in self.gone:
            return -1
        i = self.page.find(what, at)
        if i < 0:
            self.gone.add(what)
        return i

    def next(self, at: int) -> Tag | None:
        page = self.page
        while (i := self.find("<", at)) >= 0:
            m = PLAIN_TAG.match(page, i)
            if m:
                return Tag(i, m.end(), bool(m[1]), m[2].lower(), m[3])
            ahead = page[i + 1 : i + 2]
            if ahead in ("!", "?"):
                for opens, closes in (("<!--", "-->"), ("<![CDATA[", "]]>")):
                    if page.startswith(opens, i) and (j := self.find(closes, i + len(opens))) >= 0:
                        return Tag(i, j + len(closes))
                j = self.find(">", i)
                return Tag(i, j + 1 if j >= 0 else len(page))
            m = TAG_NAME.match(page, i)
            if m:
                j = self._close(m.end())
                return Tag(i, min(j + 1, len(page)), bool(m[1]), m[2].lower() if j < len(page) else "", page[m.end() : j])
            at = i + 1
        return None

    def _close(self, at: int) -> int:
        """Place of the '>' that ends a tag, outside of quoted values; the page's length if there is none."""
        page = self.page
        while m := TAG_STOP.search(page, at):
            at = m.end()
            if m[0] == ">":
                return m.start()
            before = page[max(0, m.start() - 8) : m.start()].rstrip()
            if before.endswith("="):
                j = self.find(m[0], at)
                # a closing quote is followed by a blank or the tag's end; else the quote was never closed
                if j >= 0 and (page[j + 1 : j + 2] in tuple(" \t\r\n\f/>") and j + 1 < len(page) or page.find(">", at, j) < 0):
                    at = j + 1
        return len(page)


def _tokens(page: str) -> Iterator[Tag]:
    """Tags and comments in order; what a script or the like holds is passed over up to its own closing tag."""
    at, gone, scan = 0, set(), _Scanner(page)
    while m := scan.next(at):
        yield m
        at = m.end
        if m.name in RAW_END and m.name not in gone and not m.closing and not m.attrs.endswith("/"):
            close = RAW_END[m.name].search(page, at)
            if close is None:
                gone.add(m.name)
            else:
                at = close.start()


def _ends(tokens: list[Tag]) -> dict[int, int]:
    """Opening to closing tag of every skipped element that has both, by place in tokens."""
    opened: dict[str, list[int]] = {}
    ends = {}
    for i, m in enumerate(tokens):
        if m.name not in SKIPPED or m.name in VOID:
            continue
        if not m.closing:
            if not m.attrs.endswith("/"):
                opened.setdefault(m.name, []).append(i)
        elif opened.get(m.name):
            ends[opened[m.name].pop()] = i
    return ends


@dataclass(slots=True)
class _Open:
    """An open element. bad: it makes its text bad for certain; named: number of the wrapper that its name condemns, or -1."""

    tag: str
    bad: bool
    article: bool
    named: int


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order, each with what its surroundings say of it."""
    out: list[Block] = []
    within: list[tuple[int, ...]] = []  # of each block, the wrappers around it that their names condemn
    wrappers: list[list] = []  # of each such wrapper: characters, holds an article or a first headline
    stack: list[_Open] = []
    named: list[int] = []
    bad = article = links = 0
    pieces: list[str] = []
    linked = 0
    tag = "body"

    def flush() -> None:
        nonlocal linked
        text = SPACE.sub(" ", "".join(pieces)).strip()
        if text:
            out.append(Block(text, linked, tag, bad > 0, article > 0))
            within.append(tuple(named))
            for w in named:
                wrappers[w][0] += len(text)
        pieces.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        text = entities.unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if links:
            linked += len(SPACE.sub(" ", text))

    def shut() -> str:
        nonlocal bad, article
        o = stack.pop()
        bad -= o.bad
        article -= o.article
        depth[o.tag] -= 1
        if o.named >= 0:
            named.pop()
        return o.tag

    tokens = list(_tokens(page))
    ends = _ends(tokens)
    depth: dict[str, int] = {}  # open elements by name
    at, last = 0, -1  # last: the token that ends a skipped element
    for i, m in enumerate(tokens):
        if i <= last:
            continue
        name = m.name
        if m.start > at:
            add(page[at : m.start])
        at = m.end
        if not name:
            continue
        if name in SKIPPED:
            if i in ends:  # of one that is never closed, only the tag goes
                last = ends[i]
                at = tokens[last].end
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if name in VOID and name != "hr":
            continue
        if name == "a":
            links = max(0, links + (-1 if m.closing else 1))
        if name in BLOCKS:
            flush()
            links = 0 if name != "a" else links
        if m.closing:
            if depth.get(name):
                while shut() != name:
                    pass
        elif not m.attrs.endswith("/") and name not in VOID:
            if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1].tag == name:
                shut()  # an end tag left out
            is_article = name in ("article", "main")
            if is_article or name == "h1":
                for w in named:
                    wrappers[w][1] = True
            b = name in BAD_TAGS and not (name == "header" and article)
            by_name = -1
            if m.attrs and not is_article and name != "body":
                said = _bad_attributes(m.attrs, name in HEADINGS)
                b = b or said == 2
                if said == 1 and not b:
                    by_name = len(wrappers)
                    wrappers.append([0, False])
                    named.append(by_name)
            stack.append(_Open(name, b, is_article, by_name))
            depth[name] = depth.get(name, 0) + 1
            bad += b
            article += is_article
        if name in BLOCKS:
            tag = name if not m.closing else (stack[-1].tag if stack else "body")
    if at < len(page):
        add(page[at:])
    flush()
    if wrappers:
        most = sum(len(x.text) for x in out) / 2
        condemned = {w for w, (chars, holds) in enumerate(wrappers) if not holds and chars <= most}
        for x, ws in zip(out, within, strict=True):
            x.bad = x.bad or any(w in condemned for w in ws)
    return out


def classify(blocks: list[Block], r: HtmlRules) -> list[bool]:
    """Is each block main text? Two passes, as the module says."""
    labels: list[str] = []
    inside = any(b.article and not b.bad for b in blocks)
    words = [WORD.findall(b.text.lower()) for b in blocks]
    shares = [sum(w in STOPS for w in ws) / max(1, len(ws)) for ws in words]
    # no long block has function words: the language isn't one of those listed, so length stands in for them
    long_ones = [x for b, x in zip(blocks, shares, strict=True) if not b.bad and len(b.text) >= r.short and b.link_chars <= r.links * len(b.text)]
    if long_ones and max(long_ones) < r.low_stops / 2:
        shares = [r.high_stops if len(b.text) >= r.short else x for b, x in zip(blocks, shares, strict=True)]
    for b, stops in zip(blocks, shares, strict=True):
        n = len(b.text)
        density = b.link_chars / n
        if b.bad or density > r.links or inside and not b.article:
            labels.append("bad")
        elif n < r.short:
            labels.append("short" if density == 0 or b.tag[0] == "h" or stops >= r.low_stops else "bad")
        elif stops >= r.high_stops:
            labels.append("good" if n > r.long else "near")
        elif stops >= r.low_stops:
            labels.append("near")
        else:
            labels.append("short" if inside else "bad")
    decided = ["good" if x == "near" else x for x in labels]  # near good ones have the function words of prose
    n = len(blocks)
    before, after = [-1] * n, [-1] * n
    last = -1
    for i in range(n):
        before[i] = last
        if decided[i] in ("good", "bad"):
            last = i
    last = -1
    for i in reversed(range(n)):
        after[i] = last
        if decided[i] in ("good", "bad"):
            last = i
    out = []
    for i, x in enumerate(decided):
        if x in ("good", "bad"):
            out.append(x == "good")
            continue
        # with an article element, what lies outside of it is no neighbour
        a, z = before[i], after[i]
        a = -1 if inside and a >= 0 and not (blocks[a].article and not blocks[a].bad) else a
        z = -1 if inside and z >= 0 and not (blocks[z].article and not blocks[z].bad) else z
        sides = [decided[k] == "good" for k in (a, z) if k >= 0]
        if not sides:
            out.append(inside)
        elif all(sides) or not any(sides):
            out.append(sides[0])
        else:
            nearer = a if i - a <= z - i else z
            out.append(decided[nearer] == "good" or blocks[i].tag in ("h1", "h2", "h3") and decided[z] == "good")
    return out


def main_text(page: str | None, rules: HtmlRules | None = None) -> str:
    blocks = blocks_of(page or "")
    return "\n".join(b.text for b, good in zip(blocks, classify(blocks, rules or HtmlRules()), strict=True) if good)


def extract_pages(pages: DataFrame, rules: HtmlRules | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html)."""
    rules = rules or HtmlRules()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, rules) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
