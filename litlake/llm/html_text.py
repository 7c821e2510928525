"""Main text of web pages by two passes of block rules.

Markup is cut into blocks; elements that are never text or never the article
(scripts, menus, buttons, ...) give no blocks. Forms, and elements with a class, id or role
of adverts, comments and the like, are regions: whether one goes is decided when the whole
page is known, and a region that holds the page's main article, or most of its
text, is only a wrapper with such a word in its name. The first pass
labels blocks by stop-word density, length and link density as good or bad, or
leaves short and middling ones open; the second gives open blocks the label of
their nearest decided neighbours. All blocks go through the same rules; article
and main elements only lower their thresholds, and only where they hold the
larger part of the page's text (a teaser card is an article too). On a page in
none of the languages of the stop words, density says nothing, and length and
links decide.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litlake.llm.common import only

SHORT, LONG = 70, 200
STOP_LOW, STOP_HIGH = 0.2, 0.3
#: Density from which a block of an article is text.
STOP_IN_ARTICLE = 0.1
LINKS, LINKS_IN_ARTICLE = 0.2, 0.6

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^\"'>]|\"[^\"]*\"|'[^']*')*)(?P<end>>|\Z)"
    r"|<(?P<loose>/?[a-zA-Z][^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?")
WORD = re.compile(r"[^\W\d_]+")

RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = RAW | set(
    "head nav footer aside button select option menu dialog template svg math object canvas audio "
    "video map fieldset".split()
)
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ARTICLE = {"article", "main"}
#: Words of a class, id or role that mark what isn't the article.
MARKS = set(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments "
    "complementary consent contentinfo cookie cookies copyright dialog disqus footer gdpr login menu modal nav "
    "navbar navigation newsletter notice notices overlay pager pagination popup promo related search share sharing "
    "sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: The same outside an article only: an article has headers of its own.
OUTER_MARKS = {"header", "masthead", "topbar"}

#: Frequent function words of four languages.
STOP_WORDS = set(
    """
    a about after all also an and are as at be been but by can could did do for from had has have he her his how i if
    in into is it its more no not of on only or other our out she so some than that the their them then there these
    they this to up was we were what when which who will with would you your
    au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par
    pas plus pour qu que qui sa se ses son sont sur un une vous y
    aber als am auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich
    ihr im ist kein man mit nach nicht noch nur oder sein sich sie sind so über um und uns vom von vor war wie wird zu
    zum zur
    al como con cual del donde el ella ellos entre era es esta este esto ha han hay las lo los más me mi muy nos o
    para pero por porque que se ser si sin sobre su sus te todo tu una uno ya
    """.split()
)


#: Characters of text outside of all plainly marked regions from which these aren't the page.
PROSE = 200


@dataclass
class Block:
    text: str
    links: int
    article: bool
    heading: bool
    region: int = -1
    #: The outermost article or main element that holds the block.
    element: int = -1


@dataclass
class Region:
    """An element that may not be the article: the region around it, and whether its mark is a whole name."""

    outer: int
    plain: bool
    plain_inside: bool
    text: int = 0


def _attributes(rest: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(rest)}


def _dropped(name: str, found: dict[str, str], in_article: bool) -> bool:
    """Whether an element is never shown, or never text of an article."""
    if name in DROPPED or (name == "header" and not in_article):
        return True
    if name in ("html", "body") or name in ARTICLE:
        return False
    if "hidden" in found or found.get("aria-hidden") == "true":
        return True
    return "display:none" in found.get("style", "").replace(" ", "").lower()


def _marked(name: str, found: dict[str, str], in_article: bool) -> str:
    """"plain" for an element that a class, id or role calls what isn't the article; "part" where
    such a word is one of several in the name; else empty."""
    if name in ("html", "body") or name in ARTICLE:
        return ""
    marks = MARKS if in_article else MARKS | OUTER_MARKS
    names = " ".join(found.get(k, "") for k in ("class", "id", "role")).lower().split()
    if any(n in marks for n in names):
        return "plain"
    if any(w in marks for n in names for w in re.split(r"[^a-z]+", n)):
        return "part"
    return "part" if name == "form" else ""


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, without those of dropped elements and regions."""
    out: list[Block] = []
    regions: list[Region] = []
    stack: list[tuple[str, bool, bool, int, int]] = []  # name, dropped, in an article, region, element
    open_names: Counter[str] = Counter()
    parts: list[str] = []
    element_regions: list[int] = []  # per outermost article or main element, the region around it
    links = 0
    heading = False

    def flush():
        nonlocal parts, links, heading
        text = " ".join("".join(parts).split())
        if text:
            _, _, article, region, element = stack[-1] if stack else ("", False, False, -1, -1)
            out.append(Block(text, links, article, heading, region, element))
        parts, links, heading = [], 0, False

    def add(raw: str):
        nonlocal links
        if raw and not (stack and stack[-1][1]):
            text = html.unescape(raw)
            parts.append(text)
            if open_names["a"]:
                links += len(" ".join(text.split()))

    def close_to(i: int):
        if any(entry[0] in BLOCKS for entry in stack[i:]):
            flush()
        open_names.subtract(entry[0] for entry in stack[i:])
        del stack[i:]

    def last_open(name: str) -> int | None:
        if not open_names[name]:
            return None
        return next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name)

    at = 0
    while at < len(page):
        tag = TOKEN.search(page, at)
        if tag is None:
            add(page[at:])
            break
        add(page[at : tag.start()])
        at = max(tag.end(), at + 1)
        name = (tag["name"] or "").lower()
        if not name or not tag["end"]:
            continue
        if tag["close"]:
            found = last_open(name)
            if found is not None:
                close_to(found)
            elif name in BLOCKS:
                flush()
            continue
        if name in BLOCKS:
            if name == "p" and (open_p := last_open("p")) is not None:
                if not {entry[0] for entry in stack[open_p:]} & (BLOCKS - {"p"}):
                    close_to(open_p)
            flush()
            heading = name in HEADINGS
        elif name == "br":
            parts.append(" ")
        if name in VOID:
            continue
        _, dropped, in_article, region, element = stack[-1] if stack else ("", False, False, -1, -1)
        if not dropped:
            attributes = _attributes(tag["rest"]) if tag["rest"].strip() else {}
            dropped = _dropped(name, attributes, in_article)
            mark = "" if dropped else _marked(name, attributes, in_article)
            if mark and name not in BLOCKS:
                dropped = True  # inside a line of text
            elif mark:
                inside = mark == "plain" or (region >= 0 and regions[region].plain_inside)
                regions.append(Region(region, mark == "plain", inside))
                region = len(regions) - 1
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if dropped and name in BLOCKS | DROPPED:
            flush()
        if name in ARTICLE and element < 0:
            element = len(element_regions)
            element_regions.append(region)
        stack.append((name, dropped, in_article or name in ARTICLE, region, element))
        open_names[name] += 1
    flush()
    return without_regions(out, regions, element_regions)


def without_regions(found: list[Block], regions: list[Region], element_regions: list[int]) -> list[Block]:
    """``found`` without the blocks of regions that aren't the article.

    The main article is the article or main element with most text outside of plainly marked
    regions. A region stays if it holds that; or, on a page without one, if it holds most
    of the text. A plainly marked one goes as well wherever there is text outside of such regions.
    """
    if not regions:
        return found
    sizes = [len(b.text) - b.links for b in found]
    plain = [b.region >= 0 and regions[b.region].plain_inside for b in found]
    strict = sum(n for n, p in zip(sizes, plain, strict=True) if not p) >= PROSE
    texts: Counter[int] = Counter()
    for b, n, p in zip(found, sizes, plain, strict=True):
        if b.region >= 0:
            regions[b.region].text += n
        if b.element >= 0 and not (strict and p):
            texts[b.element] += n
    main = max(texts, key=lambda e: texts[e], default=None)
    if main is not None and not strict and 2 * texts[main] <= sum(sizes):
        main = None  # all is marked: an article among it must be most of the page
    holds = set()
    around = -1 if main is None else element_regions[main]
    while around >= 0:
        holds.add(around)
        around = regions[around].outer
    for r in reversed(regions):
        if r.outer >= 0:
            regions[r.outer].text += r.text
    stays: list[bool] = []
    for i, r in enumerate(regions):
        most = main is None and 2 * r.text > sum(sizes)
        kept = not (strict and r.plain) and (i in holds or most)
        stays.append(kept and (r.outer < 0 or stays[r.outer]))
    return [b for b in found if b.region < 0 or stays[b.region]]


def stop_words(text: str) -> tuple[int, int]:
    """Number of stop words and of all words."""
    words = WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words), len(words)


def known_language(found: list[Block]) -> bool:
    """Whether the page's blocks of plain text, taken together, have the stop words of prose."""
    counts = [stop_words(b.text) for b in found if len(b.text) >= SHORT and b.links <= LINKS * len(b.text)]
    return sum(n for n, _ in counts) >= STOP_LOW * max(1, sum(n for _, n in counts))


def first_pass(block: Block, known: bool) -> str:
    """good, bad, or open; ``known`` is that of the page's language."""
    length = len(block.text)
    links = block.links / length
    if links > (LINKS_IN_ARTICLE if block.article else LINKS):
        return "bad"
    if length < SHORT:
        if block.article:
            return "good" if block.heading else "open"
        return "bad" if block.links or "\N{COPYRIGHT SIGN}" in block.text else "open"
    if not known:
        return "good" if block.article or length > LONG else "open"
    n, words = stop_words(block.text)
    density = n / max(1, words)
    if block.article:
        if density >= STOP_IN_ARTICLE:
            return "good"
        return "bad" if links > LINKS else "open"
    if density >= STOP_HIGH:
        return "good" if length > LONG else "open"
    return "open" if density >= STOP_LOW else "bad"


def without_teasers(found: list[Block], known: bool) -> list[Block]:
    """``found``, with no block of an article where more text stands outside of articles."""
    inside = sum(len(b.text) - b.links for b in found if b.article)
    outside = sum(len(b.text) for b in found if not b.article and first_pass(b, known) == "good")
    return found if inside >= outside else [replace(b, article=False) for b in found]


def second_pass(found: list[Block], labels: list[str]) -> list[bool]:
    """Open blocks take the label of their decided neighbours, of the nearer one if these differ.

    The edges of an article count as good, those of a page as bad. Between a good and
    a bad one at equal distance, a heading follows the block below, all else is kept.
    """
    out = []
    before = {}
    last = None
    for i, label in enumerate(labels):
        if label != "open":
            last = i
        before[i] = last
    following = None
    after = {}
    for i in range(len(labels) - 1, -1, -1):
        if labels[i] != "open":
            following = i
        after[i] = following
    for i, (block, label) in enumerate(zip(found, labels, strict=True)):
        if label != "open":
            out.append(label == "good")
            continue
        sides = []
        for j in (before[i], after[i]):
            inside = j is not None and found[j].article == block.article
            good = labels[j] == "good" if inside else block.article
            sides.append((abs(i - j) if inside else len(labels), good))
        if sides[0][1] == sides[1][1]:
            out.append(sides[0][1])
        elif sides[0][0] == sides[1][0]:
            out.append(sides[1][1] or not block.heading)
        else:
            out.append(min(sides)[1])
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    known = known_language(found)
    found = without_teasers(found, known)
    labels = [first_pass(b, known) for b in found]
    kept = second_pass(found, labels)
    return "\n".join(b.text for b, keep in zip(found, kept, strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars.

    Every row gives one row, repeated ids included. A null or empty page, or one
    without main text, has the empty text. Pages that end inside a tag, a comment
    or a script lose that piece only.
    """
    rows = only(pages, page_id="long", url="string", html="string")

    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([main_text(p.as_py()) for p in batch], pa.string())

    texts.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    found = rows.select("page_id", "url", F.arrow_udf(texts, "string")(F.col("html")).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
