"""Author-name and citation-key column expressions."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from litlake.functions.text import collapse, let

# Surname particles and the words a citation key skips.
PARTICLES = ("van", "von", "de", "del", "della", "di", "la", "le", "den", "der", "el", "al")
KEY_SKIP = ("a", "an", "the", "on", "in", "of", "for", "to", "with", "and", "or")


@cache
def _folding() -> tuple[str, str]:
    """``translate`` arguments that drop accents, derived from Unicode itself.

    Characters that decompose to exactly one base character map to it; lone
    combining marks map to nothing and therefore come last.
    """
    mapped, dropped = [], []
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        base = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        if base == "":
            dropped.append(ch)
        elif len(base) == 1 and base != ch:
            mapped.append((ch, base))
    sources = "".join(ch for ch, _ in mapped) + "".join(dropped)
    return sources, "".join(base for _, base in mapped)


@cache
def _unfolding() -> dict[str, str]:
    """Characters that decompose to several base characters, Hangul syllables aside."""
    found = {}
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xDFFF:
            continue
        base = "".join(
            c for c in unicodedata.normalize("NFKD", chr(cp)) if not unicodedata.combining(c)
        )
        if len(base) > 1:
            found[chr(cp)] = base
    return found


def _ranges(chars: Iterable[str]) -> str:
    """Characters as the ranges of a character class: a class is tried part by part."""
    runs: list[list[int]] = []
    for cp in sorted(map(ord, chars)):
        if runs and cp == runs[-1][1] + 1:
            runs[-1][1] = cp
        else:
            runs.append([cp, cp])
    return "".join(f"\\x{{{low:x}}}-\\x{{{high:x}}}" for low, high in runs)


def fold_accents(c: Column) -> Column:
    """Drop accents and unfold compatibility characters, one or several for one.

    Text with a character that unfolds to several is rebuilt character by
    character; all other text takes one ``translate``. Hangul syllables stay whole.
    Plain ASCII has nothing to fold and skips both, whose tables are long.
    """
    source, target = _folding()
    several = _unfolding()
    listed = "\x01".join(f"{ch}\x02{base}" for ch, base in several.items())
    table = F.str_to_map(F.lit(listed), F.lit("\x01"), F.lit("\x02"))
    rebuilt = F.array_join(
        F.transform(F.split(c, ""), lambda ch: F.coalesce(F.try_element_at(table, ch), ch)), ""
    )
    rare = "[" + _ranges(several) + "]"
    folded = F.translate(F.when(c.rlike(rare), rebuilt).otherwise(c), source, target)
    return F.when(c.rlike(r"[^\x00-\x7f]"), folded).otherwise(c)


# The last word of a name with the particles right before it.
_SURNAME = rf"(?:^| )((?:(?i:{'|'.join(PARTICLES)}) )*[^ ]+)$"


def _surname(name: Column) -> Column:
    """Surname of a name whose words are one space apart."""
    return F.regexp_extract(name, _SURNAME, 1)


def surname_key(name: Column) -> Column:
    """Lower-case accent-free surname with its particles joined on."""

    def key(plain: Column) -> Column:
        joined = F.replace(_surname(plain), F.lit(" "), F.lit(""))
        return F.when(plain == "", F.lit("unknown")).otherwise(F.lower(let(joined, fold_accents)))

    return let(collapse(name), key)


def inverted_name(name: Column) -> Column:
    """``Last, First`` with particles kept on the surname."""

    def form(plain: Column) -> Column:
        last = _surname(plain)
        first = F.substring(plain, F.lit(1), F.length(plain) - F.length(last) - 1)
        return F.concat_ws(", ", last, F.when(first != "", first))

    return let(collapse(name), form)


def author_list(names: Column) -> Column:
    """All names of a paper joined with `` and ``; empty names are skipped."""
    kept = F.filter(names, lambda n: n.isNotNull() & (n != ""))
    return F.array_join(F.transform(kept, inverted_name), " and ")


# A run of letters that isn't a skip word.
_KEY_WORD = rf"(?<![a-zA-Z])(?!(?i:{'|'.join(KEY_SKIP)})(?![a-zA-Z]))[a-zA-Z]+"


def citation_key(first_author: Column, year: Column, title: Column) -> Column:
    """surname + year + first title word that is not a skip word."""
    word = F.regexp_extract(title, _KEY_WORD, 0)
    return F.concat(
        surname_key(F.coalesce(first_author, F.lit("unknown"))),
        F.coalesce(year.cast("string"), F.lit("")),
        F.when(word == "", F.lit("untitled")).otherwise(F.coalesce(F.lower(word), F.lit("untitled"))),
    )


def escape_bibtex(c: Column) -> Column:
    return F.regexp_replace(c, "([&%_#])", r"\\$1")
