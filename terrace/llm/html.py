"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from statistics import pstdev

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose text is not shown as text.
UNSEEN = frozenset("head title script style noscript template iframe svg math canvas object audio video select option textarea".split())
#: Elements whose text never is content.
SKIPPED = UNSEEN | frozenset("nav footer aside form button input label fieldset dialog menu".split())
#: Elements whose content is not markup.
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "iframe"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time "
    "tt u var".split()
)
#: Open elements that a new one of the same kind ends.
ENDS_ITS_LIKE = {
    "p": ("p",),
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
CONTAINERS = frozenset(("article", "main"))
#: Names in a class or id that mark what surrounds an article, as a token's last word but for words of holders; a token
#: with one of the qualifiers (``has-sidebar``) speaks of something else than its element.
SURROUNDING = frozenset(
    "nav navbar navigation menu sidebar footer masthead ad ads advert adverts advertisement advertising sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice alert newsletter subscribe subscription signup popup modal overlay share sharing social related "
    "recommended recommendations breadcrumb breadcrumbs pagination pager comment comments reply replies respond disqus widget login search "
    "toolbar banner copyright commentlist adsbygoogle".split()
)
#: Names of headers, which are a site's only outside an article.
HEADERS = frozenset(("header",))
HOLDERS = frozenset(
    "area banner bar block bottom box button buttons container content form group inner item items left link links list panel posts right "
    "section slot thread tools top unit wrap wrapper".split()
)
QUALIFIERS = frozenset("has have hide no non not with without".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Share of an element's characters in links above which its path holds links, not prose.
MOST_LINKED = 0.8
#: Share of a page's characters above which an element's name alone doesn't drop it.
NAMED_SHARE = 0.5
#: Share of the content's characters that the main element must hold.
MAIN_SHARE = 0.75
#: Share of an article's characters that content paths must hold for the article to be taken with its other paths.
CONTENT_SHARE = 0.5

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+)>?",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]+)))?")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？]")


@dataclass
class Block:
    """A run of text between block elements."""

    path: str
    tag: str
    open: tuple[int, ...]
    removed: bool
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _attributes(raw: str) -> dict[str, str]:
    """Values by name; the first one of a name counts."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        value = m[2] or m[3] or m[4] or ""
        out.setdefault(m[1].lower(), unescape(value) if "&" in value else value)
    return out


def _named(token: str) -> str:
    """The word of a token of a class or id that says what surrounds an article its element is; empty if none does."""
    words = [w.lower() for w in _PARTS.findall(token)]
    if not QUALIFIERS.isdisjoint(words):
        return ""
    while len(words) > 1 and words[-1] in HOLDERS:
        words.pop()
    return words[-1] if words and (words[-1] in SURROUNDING or words[-1] in HEADERS) else ""


def _surrounds(tag: str, attributes: str) -> int:
    """Whether an element is not part of an article: 2 by its kind, role or style, 1 by its class or id alone, 3 as a header by these, else 0."""
    if tag in SKIPPED:
        return 2
    if not attributes or tag in ("html", "body"):
        return 0
    by = _attributes(attributes)
    if (
        by.get("role", "").strip().lower() in ROLES
        or "display:none" in by.get("style", "").replace(" ", "").lower()
        or by.get("aria-hidden", "").lower() == "true"
        or by.get("hidden", "until-found").lower() != "until-found"
    ):
        return 2
    found = {_named(t) for k in ("class", "id") for t in by.get(k, "").split()} - {""}
    return 0 if not found else 3 if found <= HEADERS else 1


def blocks_of(html: str) -> tuple[list[Block], dict[int, str]]:
    """Blocks of text in page order, and the tag of each element they name; ``removed`` are those in skipped elements.

    An element that is skipped for its class or id alone stays if it holds the
    page's main part, an article without such a name, or, where none stands
    beside it, more than ``NAMED_SHARE`` of the characters.
    """
    out, tags, named = _parsed(html, None)
    if not named:
        return out, tags
    total, holders, _ = named.pop(0)
    return _parsed(html, {n for n, (size, inside, around) in named.items() if inside or (inside + around == holders and size > NAMED_SHARE * total)})[:2]


def _parsed(html: str, spared: set[int] | None) -> tuple[list[Block], dict[int, str], dict[int, tuple[int, int, int]]]:
    """Blocks and tags as ``blocks_of`` has them, with the named elements that are ``spared``.

    None spares all; then the characters in each named element, and the articles
    and main parts in it and around it, come third, with those of the page as
    element 0. Elements have the same numbers whatever is spared.
    """
    named: dict[int, tuple[int, int, int]] = {}
    began: dict[int, tuple[int, int, int]] = {}
    holders: set[int] = set()
    seen = 0
    stack: list[tuple[str, int, bool]] = []  # tag, number, skipped
    tags: dict[int, str] = {}
    out: list[Block] = []
    current: Block | None = None
    skip = unseen = links = number = at = 0
    article = 0

    def text(raw: str) -> None:
        nonlocal current, seen
        if unseen or not raw:
            return
        if not skip:
            seen += len(raw.strip())
        if current is not None and current.removed != bool(skip):
            if skip:  # a skipped element within a line
                return
            flush()
        if current is None:
            if raw.isspace():
                return
            shown = [(t, n) for t, n, _ in stack if t not in INLINE]
            current = Block("/".join(t for t, _ in shown), shown[-1][0] if shown else "", tuple(n for _, n in shown), bool(skip))
        raw = unescape(raw) if "&" in raw else raw
        current.pieces.append(raw)
        if links:
            current.linked += len(raw)

    def flush() -> None:
        nonlocal current
        if current is not None:
            current.text = " ".join("".join(current.pieces).split())
            if current.text:
                out.append(current)
            current = None

    def close(to: int) -> None:
        nonlocal skip, unseen, links, article
        while len(stack) > to:
            tag, n, skipped = stack.pop()
            if n in began:
                size, before, around = began[n]
                named[n] = (seen - size, len(holders) - before, around)
            skip -= skipped
            unseen -= tag in UNSEEN
            links -= tag == "a"
            article -= tag in CONTAINERS

    for m in _TOKEN.finditer(html):
        if m.start() < at:
            continue
        text(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:-3])
            continue
        tag = m[2].lower()
        if tag not in INLINE and tag != "br" and tag != "wbr":
            flush()
        if m[1]:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if depth is not None and not (tag in INLINE and any(t not in INLINE for t, _, _ in stack[depth + 1 :])):
                close(depth)
            continue
        if tag == "br":
            text(" ")
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if m[3].endswith("/") and tag not in INLINE and tag in ("svg", "math"):
            continue
        like = ENDS_ITS_LIKE.get(tag)
        if like:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in like:
                    close(k)
                    break
                if stack[k][0] not in INLINE and stack[k][0] != "p":
                    break
        elif tag not in INLINE:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] not in INLINE), None)
            if depth is not None and stack[depth][0] == "p":
                close(depth)
        number += 1
        why = _surrounds(tag, m[3])
        if why == 3:
            why = 0 if article else 1
        skipped = why == 2 or (why == 1 and spared is not None and number not in spared) or (tag == "header" and not article)
        if why == 1 and spared is None and not skip and not skipped:
            began[number] = (seen, len(holders), sum(n in holders for _, n, _ in stack))
        if not skip and not skipped and (tag == "main" or (tag == "article" and not why)):
            holders.add(number)
        tags[number] = tag
        stack.append((tag, number, skipped))
        skip += skipped
        unseen += tag in UNSEEN
        links += tag == "a"
        article += tag in CONTAINERS
    text(html[at:])
    flush()
    close(0)
    if named:
        named[0] = (seen, len(holders), 0)
    return out, tags, named


def fused_ratios(blocks: list[Block]) -> dict[tuple[str, bool], float]:
    """Per tag path, removed or not: characters and punctuation a node, smoothed over neighbouring paths, multiplied.

    Paths follow each other as they first come in the page; each ratio is
    averaged with its neighbours by weights 1, 2, 1. Characters in links don't
    count as text.
    """
    sums: dict[tuple[str, bool], list[float]] = {}
    for b in blocks:
        s = sums.setdefault((b.path, b.removed), [0, 0, 0])
        s[0] += max(0, len(b.text) - b.linked)
        s[1] += len(_PUNCTUATION.findall(b.text))
        s[2] += 1
    paths = list(sums)

    def smooth(x: list[float]) -> list[float]:
        return [(x[max(0, i - 1)] + 2 * x[i] + x[min(len(x) - 1, i + 1)]) / 4 for i in range(len(x))]

    text = smooth([sums[p][0] / sums[p][2] for p in paths])
    marks = smooth([1 + sums[p][1] / sums[p][2] for p in paths])
    return {p: t * m for p, t, m in zip(paths, text, marks, strict=True)}


def content_paths(fused: dict[tuple[str, bool], float]) -> set[str]:
    """The paths that are not removed and whose fused ratio reaches the spread of all paths' ratios.

    Removed paths say what text around an article looks like, so they count in
    the spread, but with no more than the largest ratio of the others.
    """
    own = {p: r for (p, removed), r in fused.items() if not removed}
    if not own:
        return set()
    most = max(own.values())
    least = min(pstdev([min(r, most) for r in fused.values()]), most)
    return {p for p, r in own.items() if r >= least}


def main_text(html: str) -> str:
    """The blocks of a page's article, joined by empty lines.

    Content paths are those whose fused ratio passes the page's threshold. The
    main element is the innermost one around ``MAIN_SHARE`` of the characters on
    content paths. In it, blocks on content paths are kept, and others that are
    headings or lie between such blocks. If it is an article or the page's main
    part, or lies in one of which content paths make up ``CONTENT_SHARE`` of the
    characters, all blocks of that are kept. Paths of links never are.
    """
    everything, tags = blocks_of(html)
    blocks = [b for b in everything if not b.removed]
    if not blocks:
        return ""
    content = content_paths(fused_ratios(everything))
    linked: dict[str, list[int]] = {}
    size: dict[int, int] = {}
    for b in blocks:
        s = linked.setdefault(b.path, [0, 0])
        s[0] += b.linked
        s[1] += len(b.text)
    links = {p for p, (a, n) in linked.items() if a > MOST_LINKED * n}
    chosen = [b.path in content and b.path not in links for b in blocks]
    within: dict[int, int] = {}
    total = 0
    for b, c in zip(blocks, chosen, strict=True):
        if b.path not in links:
            for n in b.open:
                size[n] = size.get(n, 0) + len(b.text)
        if c:
            total += len(b.text)
            for n in b.open:
                within[n] = within.get(n, 0) + len(b.text)
    if not total:
        return ""
    # numbers grow inwards, so the largest that holds enough is the innermost
    main = max((n for n, held in within.items() if held >= MAIN_SHARE * total), default=None)
    around = next((b.open for b, c in zip(blocks, chosen, strict=True) if c and (main is None or main in b.open)), ())
    holder = next((n for n in reversed(around) if tags[n] in CONTAINERS and (main is None or n <= main)), None)
    if holder is not None and within[holder] >= CONTENT_SHARE * size[holder]:
        kept = [holder in b.open and b.path not in links for b in blocks]
    else:
        inside = [main is None or main in b.open for b in blocks]
        places = [i for i, c in enumerate(chosen) if c and inside[i]]
        first, last = places[0], places[-1]
        kept = [
            inside[i] and b.path not in links and (chosen[i] or b.tag in HEADINGS or first < i < last)
            for i, b in enumerate(blocks)
        ]
    return "\n\n".join(b.text for b, k in zip(blocks, kept, strict=True) if k)


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)``, one row per row of ``pages``.

    ``text`` is ``main_text`` of the whole html, ``n_chars`` its code points. A
    null or empty html and a page without an article give the empty string.
    Malformed and cut-off markup is read as far as it goes. Repeated rows count
    each; an empty table gives an empty result; other columns are ignored. Pages
    are independent: no shuffle, and memory for one page at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py() or "") for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
