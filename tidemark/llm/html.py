"""Main text of web pages by two-pass block rules.

A page is cut into blocks at its block tags. The first pass decides what stop-word density, length and link
density make plain: long text with stop words is good, links are bad. Containers that say they are something else
are left out, unless these densities show that the article is in them. The rest, mostly short blocks such as headings
or one-line paragraphs, takes the label of the nearest decided block in the second pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import prepare, slices

LINK_DENSITY = 0.5
STOP_DENSITY = 0.15
LONG = 70

# Frequent function words of four languages.
STOP_WORDS = frozenset(
    "a an and are as at be but by for from had has have he her his i in is it not of on or she that the their they this to was "
    "we were which with you "
    "als am auf auch aus bei das dem den der des die ein eine einen einer er es für hat ich im ist mit nach nicht noch oder sich "
    "sie sind so über um und von vor war wie wird zu zum zur "
    "au aux avec ce cette dans de du elle en est et il je la le les leur mais ne nous ou où par pas plus pour qui que sa se ses "
    "son sont sur un une vous "
    "al como con del el ella este esta ha hay las lo los más muy no nos o para pero por si sin su sus también una y ya".split()
)
# Tags.
_BREAKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 "
    "h2 h3 h4 h5 h6 header hr html li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th "
    "thead tr ul".split()
)
_NEVER = frozenset("nav menu dialog button select textarea template noscript iframe head object svg".split())
_SUSPECT = frozenset("footer aside form".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INLINE_KEPT = frozenset(["a"])
# Words of class, id and role names that tell of something beside the article, then words that add nothing to them.
_HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs complementary consent "
    "contentinfo cookie cookies copyright disclaimer dialog feedback footer form gdpr login menu menubar modal nav navbar "
    "navigation newsletter notice notices notification pager pagination popup promo promoted promotion recommendations "
    "recommended related search share sharing sidebar signup social sponsor sponsored subscribe teaser "
    "toolbar widget widgets".split()
)
_COMMENTS = frozenset("comment comments commentlist disqus replies reply respond responses".split())
_PLAIN = frozenset(
    "area articles bar block body bottom box btn buttons card container content fixed global group header inner item items left "
    "legal list links main outer page panel post posts primary region right row secondary section site slot sticky stories "
    "text thread title top unit wrap wrapper zone".split()
)
_ROOTS = frozenset(["html", "body", "main"])
_HEADS = frozenset(["h1", "article", "main"])

_PART = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style)\b(?>[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?>[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[!?/][^>]*>"
    r"|(?P<text>[^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_UNSEEN = re.compile(r"display\s*:\s*none", re.IGNORECASE)
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Container:
    """An element whose tag or name speaks against it; ``parent`` is the container around it, or -1."""

    parent: int
    form: bool
    comments: bool
    holds_head: bool = False
    size: int = 0
    good: int = 0
    good_blocks: int = 0
    own_good: int = 0


@dataclass
class Block:
    text: str
    linked: int
    never: bool
    container: int
    article: bool
    heading: bool
    label: bool | None = None


def _said(name: str) -> str | None:
    """What one whole name of an element says: "comments", "beside" or nothing.

    Every part of it has to be such a word or a plain one: ``cookie-banner`` and ``site-footer`` say it, ``has-sidebar``
    and ``comments-open`` do not.
    """
    parts = [part.lower() for part in _NAME_PART.findall(name)]
    if any(p not in _HINTS and p not in _COMMENTS and p not in _PLAIN for p in parts):
        return None
    if any(p in _COMMENTS for p in parts):
        return "comments"
    return "beside" if any(p in _HINTS for p in parts) else None


def _kind(tag: str, rest: str, in_article: bool) -> str | None:
    """"never" for what is no text of a page, "form", "comments" or "beside" for a suspect container."""
    if tag in _ROOTS:
        return None
    if tag in _NEVER:
        return "never"
    kind = None
    if tag in _SUSPECT or (tag == "header" and not in_article):
        kind = "form" if tag == "form" else "beside"
    if not rest or rest.isspace():
        return kind
    for found in _ATTRIBUTE.finditer(rest):
        attribute = found[1].lower()
        value = found[2] or found[3] or found[4] or ""
        if attribute == "hidden" or (attribute == "aria-hidden" and value.lower() == "true"):
            return "never"
        if attribute == "style" and _UNSEEN.search(value):
            return "never"
        if attribute in ("class", "id", "role"):
            for name in value.split():
                said = _said(name)
                if said == "comments" or (said and kind is None):
                    kind = said
    return kind


def blocks(html: str) -> tuple[list[Block], list[Container]]:
    """The blocks of a page in order, those without text left out, and its suspect containers, outer ones first."""
    result: list[Block] = []
    containers: list[Container] = []
    parts: list[str] = []
    linked = links = never = article = heading = breaks = 0
    inside = -1
    stack: list[tuple[str, str | None]] = []  # tag and kind

    def close() -> None:
        nonlocal linked, breaks
        text = " ".join(unescape("".join(parts)).split())
        if text:
            result.append(Block(text, linked, never > 0, inside, article > 0, heading > 0))
        parts.clear()
        linked = breaks = 0

    def pop(to: int) -> None:
        nonlocal never, inside, article, heading, links
        while len(stack) > to:
            tag, kind = stack.pop()
            if kind == "never":
                never -= 1
            elif kind:
                inside = containers[inside].parent
            article -= tag in ("article", "main")
            heading -= tag == "h1"
            links -= tag == "a"

    for part in _PART.finditer(html):
        if (text := part["text"]) is not None:
            if text.strip():
                breaks = 0
            parts.append(text)
            if links:
                linked += len(text.strip())
            continue
        if (name := part["tag"]) is None:
            continue
        tag = name.lower()
        if tag == "br":
            breaks += 1
            if breaks == 2:
                close()
            else:
                parts.append(" ")
            continue
        if tag in _BREAKS:
            close()
        if part["close"]:
            for at in range(len(stack) - 1, -1, -1):
                if stack[at][0] == tag:
                    if tag not in _BREAKS and tag not in _NEVER and any(t in _BREAKS for t, _ in stack[at + 1 :]):
                        break  # an inline tag does not close the blocks inside it
                    if stack[at][1]:
                        close()
                    pop(at)
                    break
            continue
        if tag in _VOID:
            continue
        rest = part["rest"]
        if rest.endswith("/") and tag not in _BREAKS:
            continue
        if tag in _BREAKS and stack and stack[-1][0] == "p":
            pop(len(stack) - 1)
        kind = _kind(tag, rest, article > 0)
        if kind and tag not in _BREAKS:
            close()
        if kind or tag in _BREAKS or tag in _INLINE_KEPT:
            if tag == "body":
                pop(0)  # whatever the head left open
            stack.append((tag, kind))
            if kind == "never":
                never += 1
            elif kind:
                containers.append(Container(inside, kind == "form", kind == "comments"))
                inside = len(containers) - 1
            if tag in _HEADS and not never and inside >= 0:
                containers[inside].holds_head = True
            article += tag in ("article", "main")
            heading += tag == "h1"
            links += tag == "a"
    close()
    return result, containers


def _by_density(block: Block) -> bool | None:
    """What length, stop words and links alone tell of a block."""
    size = len(block.text)
    if block.linked > LINK_DENSITY * size:
        return False
    words = _WORD.findall(block.text.lower())
    stops = sum(w in STOP_WORDS for w in words)
    if size >= LONG and words and stops >= STOP_DENSITY * len(words):
        return True
    return None


def _condemned(found: list[Block], containers: list[Container]) -> list[bool]:
    """Which containers keep their text out of the article.

    A name only weighs: a form around a heading or an article is the page itself; three good blocks that make up over
    half of a container and two thirds of the page's good text clear it, unless it holds comments; and when
    nothing else on the page can be the article, the containers around most good text are cleared from outside in.
    """
    condemned = [True] * len(containers)
    for block in found:
        if block.container >= 0 and not block.never:
            c = containers[block.container]
            c.size += len(block.text)
            if block.label:
                c.good += len(block.text)
                c.good_blocks += 1
                c.own_good += 1
    inner: dict[int, list[int]] = {}
    for i in range(len(containers) - 1, -1, -1):  # inner ones come later, so they are complete here
        c = containers[i]
        inner.setdefault(c.parent, []).append(i)
        if c.parent >= 0:
            outer = containers[c.parent]
            outer.size += c.size
            outer.good += c.good
            outer.good_blocks += c.good_blocks
            outer.holds_head |= c.holds_head
    page = sum(len(b.text) for b in found if b.label and not b.never)
    for i, c in enumerate(containers):
        heavy = not c.comments and c.good_blocks >= 3 and 2 * c.good > c.size and 3 * c.good > 2 * page
        if heavy or (c.form and c.holds_head):
            condemned[i] = False
    covered = _covered(containers, condemned)
    if any(_free(b, covered) and b.label is not False and (b.label or b.article or b.heading) for b in found):
        return covered
    at = -1
    while within := [i for i in inner.get(at, ()) if containers[i].good]:
        at = max(within, key=lambda i: (containers[i].good, -i))
        condemned[at] = False
        if containers[at].own_good:
            break
    return _covered(containers, condemned)


def _covered(containers: list[Container], condemned: list[bool]) -> list[bool]:
    """Whether a container or one around it is condemned."""
    covered: list[bool] = []
    for c, own in zip(containers, condemned):
        covered.append(own or (c.parent >= 0 and covered[c.parent]))
    return covered


def _free(block: Block, covered: list[bool]) -> bool:
    return not block.never and (block.container < 0 or not covered[block.container])


def main_text(html: str | None) -> str:
    """The main text of a page: its good blocks, joined by empty lines.

    Null and empty pages give an empty text. Elements ``article`` and ``main`` are the whole article if they hold at least
    half of the good text outside condemned containers; else they are blocks like others.
    """
    found, containers = blocks(html or "")
    for block in found:
        block.label = _by_density(block)
    covered = _condemned(found, containers)
    free = [b for b in found if _free(b, covered)]
    good = [0, 0]
    for block in free:
        if block.label:
            good[block.article] += len(block.text)
    if any(b.article for b in free) and good[True] >= good[False]:
        free = [b for b in free if b.article]
    else:
        for block in free:
            if block.label is None and not block.article and "©" in block.text:
                block.label = False
    # Condemned containers say what they are and tell nothing about the blocks beside them.
    told = [i for i, b in enumerate(free) if b.label is not None]
    kept = []
    after = 0
    for i, block in enumerate(free):
        while after < len(told) and told[after] < i:
            after += 1
        label = block.label
        if label is None:
            beside = [told[k] for k in (after - 1, after) if 0 <= k < len(told)]
            nearest = min((abs(k - i) for k in beside), default=0)
            label = not beside or any(free[k].label for k in beside if abs(k - i) == nearest)
        if label:
            kept.append(block.text)
    return "\n\n".join(kept)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html"):
        texts = [main_text(page) for page in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` (code points) of every page.

    One row per input row, so repeated pages repeat; a null page has an empty text. Every task reads its own
    pages and nothing is shuffled. Other columns are not looked at.
    """
    prepare(pages.sparkSession)
    asked = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return asked.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
