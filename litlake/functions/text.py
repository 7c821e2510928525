"""Text column expressions: whitespace, tokens, headings, match offsets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as the data model understands it: Unicode spaces plus the four
# ASCII separators. Every pattern that uses it carries the (?U) flag.
WS = r"[\s\x1c-\x1f]"
WS_INLINE = r"[\s\x1c-\x1f&&[^\n]]"

_RUN = rf"(?U){WS}+"
# The same characters spelled out, for trimming without a regex.
SPACES = "".join(
    chr(c)
    for c in (
        *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
        0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    )
)

# Token shape and the words that never become index terms.
TOKEN = r"[a-z0-9][a-z0-9\-.]*[a-z0-9]|[a-z0-9]"
STOPWORDS = (
    "a an the and or but of to in on at for with by from as is are was were be "
    "been being this that these those it its we our their them they he she his her "
    "i you your if then than so such into about over under between"
).split()

# A line that opens a section (levels 1-2) and one that opens a sub-heading.
SECTION_LINE = rf"(?mdU)^#{{1,2}}{WS_INLINE}[^\n]+$"
SUBHEAD_LINE = rf"(?mdU)^###({WS_INLINE}[^\n]+)$"
# Whole-text heading search: the gap after the marks may run over a line end.
HEADING = rf"(?mdU)^#{{1,6}}{WS}+.+$"

PREAMBLE = "Preamble"
CHARS_PER_TOKEN = 4


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    A lambda variable is bound once, so a costly array that is read inside
    another higher-order function is not recomputed per element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(SPACES))


def collapse(c: Column) -> Column:
    """Trim and squeeze every whitespace run to one space."""
    return strip(F.regexp_replace(c, _RUN, " "))


def words(c: Column) -> Column:
    """Whitespace-separated words; an all-blank text gives an empty array."""
    return F.filter(F.split(strip(c), _RUN, -1), lambda w: w != "")


# Characters of a text that hold its first words as a rule.
HEAD = 1000


def first_words(c: Column, n: int) -> Column:
    """The first ``n`` of ``words``; a text is cut no further than that."""
    # One piece more for what an untrimmed text would begin with, one for the rest.
    cut = lambda t: F.split(strip(t), _RUN, n + 2)
    # With a rest, all pieces before it are whole; a head without one may end inside a word.
    pieces = let(
        cut(F.substring(c, 1, HEAD)),
        lambda p: F.when((F.size(p) < n + 2) & (F.length(c) > HEAD), cut(c)).otherwise(p),
    )
    return F.slice(F.filter(pieces, lambda w: w != ""), 1, n)


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def tokens(c: Column) -> Column:
    """Lower-cased index terms of a text, in order, with repeats."""
    found = F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(*STOPWORDS))


def term_counts(token_array: Column) -> Column:
    """``array<struct<term, tf>>`` of a token array, sorted by term.

    Sorting brings equal terms together; a term's count is the distance between
    its first position and the next term's. Row-local, so no shuffle is needed.
    """

    def runs(s: Column) -> Column:
        starts = F.filter(
            F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(
                F.array().cast("array<int>")
            ),
            lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)),
        )
        return let(
            starts,
            lambda st: F.transform(
                st,
                lambda at, i: F.struct(
                    F.get(s, at).alias("term"),
                    (F.coalesce(F.get(st, i + 1), F.size(s)) - at).alias("tf"),
                ),
            ),
        )

    return let(F.sort_array(token_array), runs)


def literal_pattern(text: str, *, case_sensitive: bool = True, whole_words: bool = False) -> str:
    """A Java pattern that matches ``text`` literally."""
    body = "".join(f"\\x{{{ord(ch):x}}}" for ch in text)
    if whole_words:
        body = rf"\b{body}\b"
    return ("(?U)" if case_sensitive else "(?iuU)") + body


def match_spans(text: Column, pattern: str, limit: int | None = None) -> Column:
    """``array<struct<pos, match>>`` of the non-overlapping matches in a text.

    The pieces between matches and the matches alternate, so offsets follow from
    their lengths. ``limit`` keeps only the first matches.
    """
    pieces = F.split(text, pattern, -1 if limit is None else limit + 1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if limit is not None:
        found = F.slice(found, 1, limit)

    def spans(m: Column) -> Column:
        lengths = F.zip_with(
            F.slice(pieces, F.lit(1), F.size(m)), m, lambda gap, hit: F.length(gap) + F.length(hit)
        )
        return F.zip_with(
            running_sums(lengths),
            m,
            lambda end, hit: F.struct((end - F.length(hit)).alias("pos"), hit.alias("match")),
        )

    return let(found, spans)


def running_sums(lengths: Column) -> Column:
    """Sums of an int array up to each element.

    Each step adds what lies 1, 2, 4, ... places before, so an array of n is copied log2(n)
    times, not once per element.
    """

    def sums(values: Column) -> Column:
        steps = F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int")
        return F.aggregate(
            F.sequence(F.lit(0), steps),
            values,
            lambda acc, k: F.transform(
                acc,
                lambda x, i: x + F.coalesce(F.get(acc, i - F.pow(F.lit(2), k).cast("int")), F.lit(0)),
            ),
        )

    return let(lengths, sums)


def _heading_level(heading: Column) -> Column:
    return F.length(F.regexp_extract(heading, r"^#+", 0))


def _heading_title(heading: Column) -> Column:
    return strip(F.regexp_replace(heading, r"\A#+", ""))


def first_title(md: Column) -> Column:
    """First level-1 or level-2 heading of a text, else null."""
    heads = F.filter(
        F.regexp_extract_all(md, F.lit(HEADING), F.lit(0)), lambda h: _heading_level(h) <= 2
    )
    return _heading_title(F.get(heads, F.lit(0)))


def section_starts(md: Column) -> Column:
    """``(pos, title)`` of every level-1/2 heading, in order; small beside the text."""
    heads = F.filter(match_spans(md, HEADING), lambda h: _heading_level(h["match"]) <= 2)
    return F.transform(
        heads, lambda h: F.struct(h["pos"].alias("pos"), _heading_title(h["match"]).alias("title"))
    )


def title_at(starts: Column, offset: Column) -> Column:
    """Title of the last of ``section_starts`` at or before ``offset``."""
    return F.try_element_at(F.filter(starts, lambda h: h["pos"] <= offset), F.lit(-1))["title"]


def section_at(md: Column, offset: Column) -> Column:
    """Title of the last level-1/2 heading that starts at or before ``offset``."""
    return title_at(section_starts(md), offset)


def section_array(md: Column) -> Column:
    """All sections of a markdown text as one array, computed inside the row.

    Element: ``index, title, h3s, approx_tokens, content`` (content stripped).
    Blank sections vanish before numbering.
    """

    def build(heads: Column) -> Column:
        def one(body: Column, i: Column) -> Column:
            head = F.when(i == 0, F.lit(PREAMBLE)).otherwise(_heading_title(F.get(heads, i - 1)))
            lead = F.when((i > 0) & body.startswith("\n"), F.substr(body, F.lit(2))).otherwise(body)
            lines = F.when(
                (i < F.size(heads)) & lead.endswith("\n"),
                F.substr(lead, F.lit(1), F.length(lead) - 1),
            ).otherwise(lead)
            return F.struct(head.alias("title"), lines.alias("text"), strip(lines).alias("content"))

        kept = F.filter(
            F.transform(F.split(md, SECTION_LINE, -1), one), lambda s: s["content"] != ""
        )
        return F.transform(
            kept,
            lambda s, i: F.struct(
                i.alias("index"),
                s["title"].alias("title"),
                F.transform(
                    F.regexp_extract_all(s["text"], F.lit(SUBHEAD_LINE), F.lit(1)), strip
                ).alias("h3s"),
                approx_tokens(s["text"]).alias("approx_tokens"),
                s["content"].alias("content"),
            ),
        )

    return let(F.regexp_extract_all(md, F.lit(SECTION_LINE), F.lit(0)), build)


def approx_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / CHARS_PER_TOKEN).cast("int"))
