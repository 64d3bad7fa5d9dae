"""Main text of web pages by two-pass block rules.

The page is cut at block-level tags. Pass one labels each block by itself: blocks in menus, headers, footers, sidebars, notices,
adverts, forms and reader comments and blocks of mostly links are bad; long blocks with many stop words are good; the rest is
undecided (short, or of middling density). Pass two gives an undecided block the label of its nearest decided
neighbours: of both if they agree, else good only next to a good one inside an article or, for near-good blocks, next to a good one.

What lies in such a part is told by tag, role, and the tokens of class and id (attributes are parsed; other attributes don't count). A name is
evidence, not a verdict: a wrapper (a form or header, too) that holds the article, or a main heading with running text, isn't such a part,
and names like ``no-sidebar`` or ``tag-social`` say nothing. Inside the ``article`` that holds most text a block is never bad for its words
or links alone; when the articles hold more running text than what lies outside them, the latter is left out but for the heading before them.

Plan: one pass over the pages with Arrow batches; no shuffle, nothing shared. Parsing takes time in proportion to the page, whatever its markup.

Defined results: null or empty html gives an empty text; unclosed tags end with their parents (script, style: with the page); a ``<`` that
opens no complete tag is text; an unclosed comment reaches to the end; a page without any good block gives an empty text; repeated rows
give repeated results; columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Common words of English, French, German and Spanish (fixed values).
STOP_WORDS = frozenset(
    "the of and to in is that it for was on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than been its who now my over did down only way find use may long little very after words called just where most know "
    "le la les des du et est en un une que qui dans pour pas sur au avec ce il sont par plus ne se aux ou son elle mais nous vous leur "
    "der die das und ist von zu den mit auf nicht ein eine im dem des sich auch es an als für er hat aus bei nach wie wird so einer sie noch oder um "
    "el los las de y que en un una por con no su para es al lo como más pero sus este ya o fue ha si sobre".split()
)
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their end tag, and other elements without running text.
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
DROPPED = frozenset("noscript template select button svg math object canvas video audio datalist label".split())
BAD_TAGS = frozenset("nav footer aside menu dialog search fieldset".split()) | DROPPED
WRAPPERS = frozenset(["form", "header", "head"])
GOOD_TAGS = frozenset(["article", "main"])
BAD_ROLES = frozenset("navigation contentinfo complementary search form menu menubar alert alertdialog dialog toolbar tablist".split())
#: Parts of names: of what is beside the text wherever it is, of layout (which may also wrap the text), and of names that say nothing.
BESIDE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted nav navbar navigation menu menubar submenu breadcrumb breadcrumbs widget widgets cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login comment comments commentlist respond replies reply disqus share sharing social related recommended recommendations tags pagination pager copyright legal disclaimer skip".split()
)
LAYOUT = frozenset("banner sidebar side aside rail footer foot header masthead topbar toolbar notice notices notification alert form discussion".split())
TOP = frozenset("banner header masthead form".split())
SILENT = frozenset("no with without has not non category tag type status format enabled open js layout".split())
CLOSED_BY = {"p": BLOCK - {"html", "body", "head"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}, "head": {"body"}}
SHORT, LONG = 70, 200
LINKS_BAD, STOP_HIGH, STOP_LOW = 0.5, 0.3, 0.1

NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
ATTRIBUTE = re.compile(r"""[\s/]*+(?:([^\s/>=][^\s/>=]*+)\s*+(?:=\s*+("|'|[^\s>"'][^\s>]*+)?)?|=)?""")
QUOTES = ("'", '"')
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SPACE = re.compile(r"\s+")
WORD = re.compile(r"[^\W\d_]+")


class Tag:
    __slots__ = ("attributes", "closing", "empty", "name")

    def __init__(self, name: str, closing: bool):
        self.name, self.closing, self.empty = name, closing, False
        self.attributes: dict[str, str] = {}


def tokens(page: str) -> Iterator[str | Tag]:
    """Text and tags of a page in order; raw elements are left out with their content, character references stay as they are."""
    at, n, last, unclosed, cut = 0, len(page), page.rfind(">"), set(), False
    while at < n:
        lt = page.find("<", at)
        if lt < 0 or lt > last:
            yield page[at:lt] if lt >= 0 and page.startswith("<!--", lt) else page[at:]
            return
        if lt > at:
            yield page[at:lt]
        at = lt + 1
        if page.startswith("!--", at):
            end = page.find("-->", at + 1)
            at = n if end < 0 else end + 3
            continue
        if page[at : at + 1] in ("!", "?"):
            at = page.find(">", at) + 1
            continue
        closing = page[at : at + 1] == "/"
        name = NAME.match(page, at + closing)
        if name is None:
            if closing and at + 1 < n and page[at + 1] != "<":
                at = page.find(">", at) + 1  # </ and no name: a comment
            else:
                yield "<"
            continue
        tag, spot, first = Tag(name[0].lower(), closing), name.end(), page.find(">", at)
        for whole in (True, False) if not cut else (False,):
            # whole: quoted values may hold brackets; once a quote or tag has turned out not to end, tags end at the first bracket
            spot, stop = name.end(), n if whole else first
            while spot < stop and page[spot] != ">":
                m = ATTRIBUTE.match(page, spot, stop)
                spot, value = m.end(), m[2] or ""
                if value in QUOTES:
                    end = page.find(value, spot, stop)
                    if end < 0 and whole:
                        spot = n
                        break
                    end = stop if end < 0 else end
                    spot, value = end + 1, page[spot:end]
                if m[1]:
                    tag.attributes.setdefault(m[1].lower(), value)
            if spot < n and whole:
                break
            cut = True
            if not whole:
                spot = first
        tag.empty, at = page[spot - 1] == "/", spot + 1
        if tag.name in RAW and not closing:
            end = None if tag.name in unclosed else re.compile(rf"</{tag.name}(?=[\s/>])", re.I).search(page, at)
            if end is not None:
                at = page.find(">", end.end())
                at = n if at < 0 else at + 1
            elif tag.name in ("script", "style") and not tag.empty:
                return
            else:
                unclosed.add(tag.name)
            continue
        yield tag


FIXED, BESIDE_NAME, LAYOUT_NAME, FRAME = range(4)


class Wrap:
    """A part that may lie beside the main text: what tells so, whether that holds for its surroundings too, and what it holds."""

    __slots__ = ("around", "bad", "fixed", "headed", "kind", "layout", "parent", "running", "void")

    def __init__(self, parent: Wrap | None, kind: int):
        self.parent, self.kind = parent, kind
        self.fixed = kind == FIXED or (parent is not None and parent.fixed)
        self.layout = kind >= LAYOUT_NAME and (parent is None or parent.layout)  # neither this nor any part around is beside the text by name
        self.void, self.bad, self.headed, self.around, self.running = False, True, False, False, 0


class Zone:
    """An article or main element, and the length of its text."""

    __slots__ = ("article", "size", "wrap")

    def __init__(self, article: bool, wrap: Wrap | None):
        self.article, self.wrap, self.size = article, wrap, 0

    @property
    def eligible(self) -> bool:
        return self.wrap is None or not self.wrap.fixed and (self.wrap.layout or not self.article)


class Block:
    __slots__ = ("heading", "linked", "parts", "text", "wrap", "zone")

    def __init__(self, wrap: Wrap | None, zone: Zone | None, heading: int):
        self.wrap, self.zone, self.heading = wrap, zone, heading
        self.parts: list[str] = []
        self.linked = 0

    @property
    def bad(self) -> bool:
        return self.wrap is not None and self.wrap.bad


def _names(value: str) -> tuple[bool, bool, bool]:
    """Of a class or id: whether a token names something beside the text, a part of the layout, and one of its upper parts."""
    beside = layout = top = False
    for token in value.split():
        parts = {x.lower() for x in PARTS.findall(token)}
        if parts.isdisjoint(SILENT):
            beside = beside or not parts.isdisjoint(BESIDE)
            if not parts.isdisjoint(LAYOUT):
                layout, top = True, top or not parts.isdisjoint(TOP)
    return beside, layout, top


def _kind(tag: Tag, zone: Zone | None) -> int | None:
    """What kind of part beside the text begins with a tag, if any."""
    a = tag.attributes
    role = a.get("role", "").lower()
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or ("style" in a and HIDDEN.search(a["style"])):
        return FIXED
    if tag.name in BAD_TAGS or role in BAD_ROLES:
        return FIXED
    if zone is None and (tag.name in WRAPPERS or role == "banner"):
        return FRAME
    if tag.name == "form":
        return LAYOUT_NAME
    if tag.name in ("html", "body", "main") or not ("class" in a or "id" in a):
        return None
    names = f"{a.get('class', '')} {a.get('id', '')}"
    if tag.name == "article":
        return BESIDE_NAME if any(x.lower() in ("comment", "comments", "reply") for x in PARTS.findall(names)) else None
    beside, layout, top = _names(names)
    if tag.name not in BLOCK:
        return FIXED if beside else None
    return BESIDE_NAME if beside else LAYOUT_NAME if layout and not (top and zone is not None) else None


def blocks(page: str) -> tuple[list[Block], list[Wrap]]:
    """Blocks with text, in page order, white space made single, and the parts beside the text in the order of their begins."""
    out: list[Block] = []
    wraps: list[Wrap] = []
    stack: list[tuple[str, Wrap | None, Zone | None]] = [("", None, None)]
    opened: dict[str, int] = {}
    block, links = Block(None, None, 0), 0

    def end() -> None:
        nonlocal block
        if block.parts:
            block.text = SPACE.sub(" ", "".join(block.parts)).strip()
            if block.text:
                out.append(block)
        name, wrap, zone = stack[-1]
        block = Block(wrap, zone, int(name[1]) if len(name) == 2 and name[0] == "h" and name[1].isdigit() else 0)

    def pop() -> None:
        opened[stack.pop()[0]] -= 1

    for tag in tokens(page):
        if isinstance(tag, str):
            if stack[-1][1] is block.wrap:  # else an inline part beside the text
                text = entities.unescape(tag) if "&" in tag else tag
                block.parts.append(text)
                if links:
                    block.linked += len(text.strip())
            continue
        name = tag.name
        if tag.closing:
            if name == "a":
                links = max(0, links - 1)
            if opened.get(name):
                while stack[-1][0] != name:
                    pop()
                pop()
                if name in BLOCK or block.wrap is not stack[-1][1]:
                    end()
            continue
        if name == "br":
            block.parts.append(" ")
            continue
        if name == "a":
            links = 1
        while len(stack) > 1 and name in CLOSED_BY.get(stack[-1][0], ()):
            pop()
        if name in BLOCK:
            # an inline element left open does not reach over a block: <p><b>...<br><p>
            while len(stack) > 1 and stack[-1][0] not in BLOCK and stack[-1][0] not in DROPPED:
                pop()
            while len(stack) > 1 and name in CLOSED_BY.get(stack[-1][0], ()):
                pop()
            links = 0 if name not in VOID else links
        _, wrap, zone = stack[-1]
        role = tag.attributes.get("role", "").lower()
        if name not in VOID and not tag.empty:
            kind = _kind(tag, zone)
            if kind is not None:
                wrap = Wrap(wrap, kind)
                wraps.append(wrap)
            if (name in GOOD_TAGS or role in GOOD_TAGS) and (zone is None or not zone.article):
                zone = Zone("article" in (name, role), wrap)
            stack.append((name, wrap, zone))
            opened[name] = opened.get(name, 0) + 1
        if name in BLOCK:
            end()
    del stack[1:]
    end()
    return out, wraps


def _density(b: Block) -> float:
    words = WORD.findall(b.text.lower())
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def _running(b: Block) -> bool:
    return len(b.text) >= LONG and b.linked <= LINKS_BAD * len(b.text) and _density(b) >= STOP_HIGH


def _weigh(found: list[Block], wraps: list[Wrap]) -> None:
    """Sizes of articles, and which parts named as beside the text hold the main text instead."""
    total = 0
    for b in found:
        if b.zone is not None and b.wrap is b.zone.wrap and b.zone.eligible:
            b.zone.size += len(b.text)
        if (b.wrap is None or not b.wrap.fixed) and _running(b):
            total += len(b.text)
            if b.wrap is not None:
                b.wrap.running += len(b.text)
        if b.wrap is not None and b.heading == 1:
            b.wrap.headed = True
    for w in reversed(wraps):
        if w.parent is not None:
            w.parent.running += w.running
            w.parent.headed = w.parent.headed or w.headed
        w.void = w.kind != FIXED and 0 < total <= 2 * w.running and (w.headed or w.kind == FRAME)
    most = max((b.zone.size for b in found if b.zone is not None), default=0)
    for b in found:
        if b.zone is not None and 0 < most <= 2 * b.zone.size:
            w = b.zone.wrap
            while w is not None and not w.around:
                w.void = w.around = True
                w = w.parent
    for w in wraps:
        w.bad = not w.void or (w.parent is not None and w.parent.bad)


def _first_pass(b: Block, inside: bool) -> str:
    """inside: in the article that holds most text."""
    if b.bad:
        return "bad"
    size = len(b.text)
    if inside:
        return "good" if size >= LONG else "near" if size >= SHORT else "short"
    if b.linked > LINKS_BAD * size:
        return "bad"
    if size < SHORT:
        return "bad" if b.linked and b.zone is None else "short"
    share = _density(b)
    if share >= STOP_HIGH:
        return "good" if size >= LONG or b.zone is not None else "near"
    if share >= STOP_LOW:
        return "good" if b.zone is not None and size >= LONG else "near"
    return "near" if b.zone is not None else "bad"


def extract(page: str | None) -> str:
    found, wraps = blocks(page or "")
    _weigh(found, wraps)
    articles = {id(b.zone): b.zone.size for b in found if b.zone is not None and b.zone.article and not b.bad}
    most = max(articles.values(), default=0)
    inside = [b.zone is not None and b.zone.article and 0 < most <= 2 * b.zone.size for b in found]
    labels = [_first_pass(b, x) for b, x in zip(found, inside, strict=True)]
    within, beside = (sum(len(b.text) for b, x in zip(found, labels, strict=True) if (b.zone is not None) == side and x != "bad") for side in (True, False))
    if within and within >= beside:  # what is outside is left out but for the heading before
        first = next(i for i, b in enumerate(found) if b.zone is not None and labels[i] != "bad")
        titled = any(b.heading == 1 and b.zone is not None and x != "bad" for b, x in zip(found, labels, strict=True))
        title = max((i for i in range(first) if found[i].heading == 1 and labels[i] != "bad"), default=-1) if not titled else -1
        labels = ["good" if i == title else "bad" if b.zone is None else x for i, (b, x) in enumerate(zip(found, labels, strict=True))]
    n = len(found)
    before, after = [""] * n, [""] * n  # nearest decided label within the same article
    for order, near in ((range(n), before), (range(n - 1, -1, -1), after)):
        last, zone = "", None
        for i in order:
            if found[i].zone is not zone:
                last, zone = "", found[i].zone
            near[i] = last
            if labels[i] in ("good", "bad") and not (zone and found[i].bad):
                last = labels[i]
    keep = []
    for i, b in enumerate(found):
        label = labels[i]
        if label in ("short", "near") and not inside[i]:
            sides = {before[i], after[i]} - {""}
            if not sides:
                good = b.zone is not None or label == "near"
            elif len(sides) == 1:
                good = sides == {"good"}
            else:
                good = b.zone is not None or label == "near" or (b.heading > 0 and after[i] == "good")
        else:
            good = label != "bad"
        if good:
            keep.append(b.text)
    return "\n".join(keep)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [extract(h) for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"].astype("Int64"), "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return pages.select("page_id", "url", "html").mapInPandas(rows, "page_id long, url string, text string, n_chars long")
