"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. Containers that hold no article text (menus, headers outside the article,
footers, sidebars, forms, scripts, elements whose class, id or role names a notice, an advert, comments ..) are left out
with all they hold. A name counts as a whole (sidebar, site-footer, cookie-notice; not has-sidebar or category-notices).
Names drop neither article nor main, nor a container that holds main; one that holds articles is dropped for its name
(comments and teasers are articles on many pages) only if the page has article text elsewhere. First pass: link density, length and stop-word density call a block good, bad or undecided. Second
pass: undecided blocks take the label of the nearest decided neighbour in the page, and a tie goes to the one before.
Where a page has an article or main element, blocks outside it are bad, and undecided ones in it without any decided
neighbour are good. Inside it a block of links has no say over its neighbours, and one or two linked paragraphs or heads
in a row are undecided, as heads often link to their own page; more of them, and linked blocks of other kinds, are lists of
links. A name that text may have as well (teaser, related, search ..) drops a container there only if a third of its
characters are links. List items outside an article aren't bad for their few stop words.

Cases: null and empty pages give an empty text; unclosed tags, comments, scripts and cut-off pages are read to their end
as browsers do; a tag whose quote has no end stops at the next >; very long pages are read in one pass; repeated rows are all returned; other columns are not carried.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import arrow_map

_MARKUP = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^>]*\Z", re.S)
_ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "noembed", "noframes", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
_NEVER = {"head", "nav", "footer", "aside", "form", "button", "select", "option", "dialog", "menu", "svg", "math", "canvas", "audio", "video", "object", "datalist", "fieldset", "label", "map"}
_SCOPE = _BLOCK - {"p", "h1", "h2", "h3", "h4", "h5", "h6"}
#: Words of class, id and role values that name what is no article text, and words that may stand before and after them in such a name.
_ROLE = r"(?:ads?|adverts?|advertis\w*|adsense|adslot|banners?|sponsor\w*|promo\w*|side-?bar|aside|widgets?|menus?|menubar|navbar|navigation|nav|breadcrumbs?|footer|cookies?|consent|gdpr|notices?|notification|alert|newsletter|subscri\w*|popup|modal|overlay|dialog|social|share|sharing|related|recommend\w*|comments?|commentlist|disqus|repl(?:y|ies)|respond|login|signin|signup|register|search|searchbox|pagination|pager|toolbar|complementary|contentinfo|skip-link|disclaimer|paywall|teaser)"
_HEADER = r"(?:header|masthead|topbar|site-title)"
_BEFORE = r"(?:site|page|global|main|primary|secondary|top|bottom|left|right|mobile|post|article|entry|wp|block|google|dfp|gpt|div)"
_AFTER = r"(?:wrapper|wrap|container|box|area|inner|outer|list|items?|links?|bar|section|buttons?|form|text|title|heading|icons?|primary|secondary|left|right|top|bottom|first|second|posts|articles|slot|unit|[\dx]+)"
_ROLES = re.compile(rf"(?:{_BEFORE}[-_]+)*{_ROLE}(?:[-_]+(?:{_ROLE}|{_AFTER}))*[-_]*", re.I)
#: Names that inside an article may belong to its text.
_DOUBTFUL = re.compile(rf"(?:{_BEFORE}[-_]+)*(?:related|recommend\w*|teaser|search|register|disclaimer)(?:[-_]+{_AFTER})*[-_]*", re.I)
_OUTSIDE = re.compile(rf"(?:{_BEFORE}[-_]+)*{_HEADER}(?:[-_]+{_AFTER})*[-_]*", re.I)
_WORDS = re.compile(r"[^\W\d_]+")
#: Stop words of English, German, French and Spanish (fixed values).
STOP_WORDS = frozenset(
    """a about all also an and are as at be been but by can for from had has have he her his if in into is it its more no not of on one or our she so that the their them then there they this to was we were what when which who will with would you your
    aber als am an auch auf aus bei bin bis das dass dem den der des die doch ein eine einem einen einer er es für hat ich ihr im in ist mit nach nicht noch nur oder sich sie sind so über um und uns unter vom von vor war was wenn wie wir zu zum zur
    au aux avec ce cette comme dans de des du elle en est et il ils je la le les leur lui mais mes ne nous on ou où par pas pour plus qu que qui sa se ses son sont sur un une vous y
    al como con cuando del desde el ella en entre era es esta este fue ha hay la las le lo los mas más me mi muy no nos o para pero por que se sin sobre su sus también un una y ya""".split()
)
_ITEMS = {"li", "dt", "dd"}
_PARAGRAPHS = {"p", "h1", "h2", "h3", "h4", "h5", "h6"}
#: Linked paragraphs in a row that make a list of links.
LINK_LIST = 3
#: Link densities from which a block is bad outside and inside an article, characters of a short block, stop-word densities of good and of bad blocks.
LINKS_OUTSIDE, LINKS_INSIDE, SHORT, STOPS_GOOD, STOPS_BAD = 0.33, 0.66, 60, 0.15, 0.05


class Block(NamedTuple):
    """A block's text, its share of linked characters, whether it is inside the article, and its tag."""

    text: str
    links: float
    inside: bool
    tag: str = ""

    @property
    def linked(self) -> bool:
        return self.links >= (LINKS_INSIDE if self.inside else LINKS_OUTSIDE)


class _Open:
    __slots__ = ("group", "inside", "linked", "parts", "tag", "text")

    def __init__(self, inside: bool, tag: str, group: int):
        self.parts, self.linked, self.inside, self.tag, self.group, self.text = [], 0, inside, tag, group, ""


def _solid(text: str) -> int:
    """Characters of a text with single spaces, without these."""
    return len(text) - text.count(" ")


def _attributes(raw: str) -> dict[str, str]:
    """Names in lower case with their whole values; the first of equal names counts."""
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), value[1:-1] if value[:1] in ("'", '"') else value)
    return out


def _unwanted(tag: str, attributes: str, inside: bool) -> int:
    """0: wanted, 1: left out, 2: left out for its name, 3: left out if it is full of links."""
    if tag in _NEVER or tag == "header" and not inside:
        return 1
    if not attributes or tag in ("html", "body"):
        return 0
    found = _attributes(attributes)
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
        return 1
    if tag in ("article", "main"):
        return 0
    names = [n for k in ("class", "id", "role") for n in found.get(k, "").split()]
    named = [n for n in names if _ROLES.fullmatch(n) or not inside and _OUTSIDE.fullmatch(n)]
    if inside and named and all(map(_DOUBTFUL.fullmatch, named)):
        return 3 if tag in _BLOCK else 0
    return 2 if named else 0


def blocks(page: str, holders: bool = False) -> tuple[list[Block], bool]:
    """(the blocks outside unwanted containers, whether there is an article).

    holders: containers of articles aren't left out for their names. Set where there is no article text without.
    """
    out: list[_Open] = []
    stack: list[tuple[str, int]] = []  # tag, whether unwanted from here on
    dropped = links = articles = doubtful = groups = 0
    found_article = named = False

    def opened() -> _Open:
        tag = stack[-1][0] if stack else ""
        if tag not in _BLOCK:
            tag = next((t for t, _ in reversed(stack) if t in _BLOCK), "")
        return _Open(articles > 0, tag, groups if doubtful else 0)

    now = opened()

    def close() -> None:
        nonlocal now
        if now.parts:
            now.text = " ".join("".join(now.parts).split())
            out.append(now)
            now = opened()

    def pop() -> None:
        nonlocal dropped, links, articles, doubtful
        tag, unwanted = stack.pop()
        dropped -= unwanted in (1, 2)
        doubtful -= unwanted == 3
        links -= tag == "a"
        articles -= tag in ("article", "main")

    def add(raw: str) -> None:
        if raw and not dropped:
            text = entities.unescape(raw)
            now.parts.append(text)
            if links:
                now.linked += len("".join(text.split()))

    at = 0
    while m := _MARKUP.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        closing, tag, attributes = m.group(1, 2, 3) if m[2] else m.group(4, 5, 6)  # the second: a quote without its end
        tag = (tag or "").lower()
        if not tag:
            continue
        if closing:
            if tag in _BLOCK:
                close()
            if any(t == tag for t, _ in reversed(stack)):
                while stack[-1][0] != tag:
                    pop()
                pop()
            if tag in _BLOCK:
                now = opened()
            continue
        if tag == "br" or tag == "wbr":
            if tag == "br" and not dropped and now.parts:
                now.parts.append(" ")
            continue
        if tag in _BLOCK:
            close()
            for k in range(len(stack) - 1, -1, -1):  # an open paragraph ends here, as do open items before a new one
                if stack[k][0] == "p" or stack[k][0] == tag and tag in ("li", "dt", "dd", "option", "tr", "td", "th"):
                    while len(stack) > k:
                        pop()
                    break
                if stack[k][0] in _SCOPE:
                    break
        if tag == "a":  # links don't nest
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "a":
                    while len(stack) > k:
                        pop()
                    break
                if stack[k][0] in _SCOPE:
                    break
        if tag in _RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag not in _VOID:
            if dropped and tag in ("article", "main") and all(u != 1 for _, u in stack):
                if tag == "main" or holders:
                    stack, dropped, doubtful = [(t, 0) for t, _ in stack], 0, 0
                named |= dropped > 0
            stack.append((tag, unwanted := _unwanted(tag, attributes, articles > 0)))
            dropped += unwanted in (1, 2)
            groups += unwanted == 3 and not doubtful
            doubtful += unwanted == 3
            links += tag == "a"
            if tag in ("article", "main"):
                articles += 1
                found_article |= not dropped
        if tag in _BLOCK:
            now = opened()
    add(page[at:])
    close()
    chars, linked = Counter(), Counter()
    for b in out:
        if b.group:
            chars[b.group] += _solid(b.text)
            linked[b.group] += b.linked
    full = {g for g in chars if linked[g] >= LINKS_OUTSIDE * max(1, chars[g])}
    found = [Block(b.text, b.linked / max(1, _solid(b.text)) if b.linked else 0.0, b.inside, b.tag) for b in out if b.text and b.group not in full]
    if named and not any(b.inside for b in found):
        return blocks(page, True)
    return found, found_article


def first_pass(text: str, links: float, inside: bool, tag: str = "") -> bool | None:
    """Good, bad or (None) undecided."""
    linked = Block(text, links, inside).linked
    if len(text) < SHORT or linked and not inside:
        return False if linked else None
    words = _WORDS.findall(text.lower())
    stops = sum(map(STOP_WORDS.__contains__, words)) / max(1, len(words))
    if linked:  # an article's paragraph may be one long link; a list of links has few stop words
        return None if stops >= STOPS_GOOD else False
    if stops >= STOPS_GOOD:
        return True
    return False if stops < STOPS_BAD and not inside and tag not in _ITEMS and words and text.isascii() else None


def list_links(found: list[Block]) -> list[bool]:
    """Whether each block belongs to a list of links: linked, and no paragraph or head, or one of LINK_LIST linked ones in a row."""
    out, at = [], 0
    while at < len(found):
        end = at
        while end < len(found) and found[end].linked:
            end += 1
        out += [end - at >= LINK_LIST or b.tag not in _PARAGRAPHS for b in found[at:end]]
        out += [False] * (end < len(found))
        at = end + 1
    return out


def second_pass(labels: list[bool | None], default: bool, silent: list[bool] | None = None) -> list[bool]:
    """Undecided blocks take the nearest decided label (in a tie the one before) that isn't silent; default where there is none."""
    heard = [x is not None and not (silent and silent[i]) for i, x in enumerate(labels)]
    before, after = [None] * len(labels), [None] * len(labels)
    for order, to in ((range(len(labels)), before), (range(len(labels) - 1, -1, -1), after)):
        seen = None
        for i in order:
            seen = i if heard[i] else seen
            to[i] = seen
    out = []
    for i, label in enumerate(labels):
        near = [(abs(i - j), k, labels[j]) for k, j in enumerate((before[i], after[i])) if j is not None]
        out.append(label if label is not None else min(near)[2] if near else default)
    return out


def main_text(page: str | None) -> str:
    found, article = blocks(page or "")
    if article:
        found = [b for b in found if b.inside]
    of_list = list_links(found)
    first = [None if b.inside and b.linked and not x else first_pass(*b) for b, x in zip(found, of_list, strict=True)]
    labels = second_pass(first, True, [b.inside and x for b, x in zip(found, of_list, strict=True)])
    return "\n\n".join(b.text for b, good in zip(found, labels, strict=True) if good)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [main_text(p) for p in batch.column("html").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

        return step

    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = pages.schema[id_col].dataType.simpleString()
    return arrow_map(source, make, f"page_id {kind}, url string, text string, n_chars long")
