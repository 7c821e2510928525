"""Paper-identifier column expressions: normal forms, routing, storage names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from litlake.functions.text import strip

# Identifier shapes and provider prefixes.
DOI = r"^10\.\d{4,}/\S+$"
DOI_LEAD = r"(?i)^(?:doi:\s*)?(?:https?://(?:dx\.)?doi\.org/)?"
ARXIV_NEW = r"^\d{4}\.\d{4,5}(v\d+)?$"
ARXIV_OLD = r"^[a-z-]+/\d{7}(v\d+)?$"
ARXIV_HOSTS, ARXIV_PAGES = ("arxiv.org",), ("abs", "pdf")
PREPRINT_HOSTS = ("biorxiv.org", "medrxiv.org", "www.biorxiv.org", "www.medrxiv.org")
PREPRINT_PAGES = ("content",)
PREPRINT_VIEWS = (".full.pdf", ".full")
PREPRINT_PREFIX = "10.1101/"
ANTHOLOGY_PREFIX = "10.18653/v1/"

# The stored-name prefixes whose slashes can be restored.
STEM_REPAIRS = {
    "arxiv": [
        (f"{archive}_", f"{archive}/")
        for archive in (
            "hep-th", "hep-ph", "astro-ph", "cond-mat", "gr-qc", "nucl-th", "math-ph", "quant-ph",
        )
    ],
    "biorxiv": [("10.1101_", "10.1101/")],
    "acl_anthology": [("10.18653_v1_", "10.18653/v1/")],
}


def bare_doi(c: Column) -> Column:
    """Strip spaces, a ``doi:`` mark and a resolver address, in any case."""
    return F.regexp_replace(strip(c), DOI_LEAD, "")


def canonical_doi(c: Column) -> Column:
    return F.lower(bare_doi(c))


def _below(address: Column, hosts: tuple[str, ...], pages: tuple[str, ...]) -> Column:
    """What follows ``<scheme>://<host>/<page>/`` in an address of these hosts and pages, else null."""
    parts = F.split(address, "/")
    known = (
        F.get(parts, F.lit(0)).isin("http:", "https:")
        & (F.get(parts, F.lit(1)) == "")
        & F.get(parts, F.lit(2)).isin(*hosts)
        & F.get(parts, F.lit(3)).isin(*pages)
        & (F.size(parts) > 4)
    )
    rest = F.array_join(F.slice(parts, F.lit(5), F.greatest(F.size(parts) - 4, F.lit(0))), "/")
    return F.when(known & (rest != ""), rest)


def _without_end(c: Column, ends: tuple[str, ...]) -> Column:
    """``c`` without the first of ``ends`` that it ends in."""
    out = c
    for end in reversed(ends):
        cut = F.substr(c, F.lit(1), F.length(c) - len(end))
        out = F.when(c.endswith(end), cut).otherwise(out)
    return out


def content_doi(bare: Column) -> Column:
    """DOI inside a preprint content page address; any other text is kept."""
    shown = _without_end(_below(bare, PREPRINT_HOSTS, PREPRINT_PAGES), PREPRINT_VIEWS)
    doi = F.regexp_replace(shown, r"v\d+$", "")
    return F.when(doi.rlike(DOI), doi).otherwise(bare)


def preprint_doi(c: Column) -> Column:
    """Bare DOI of a preprint, also from its content page address."""
    return content_doi(bare_doi(c))


def bare_arxiv(c: Column) -> Column:
    """arXiv id without spaces, a ``doi:`` mark or the address around it."""
    text = F.regexp_replace(strip(c), r"(?i)^doi:\s*", "")
    return F.coalesce(_without_end(_below(text, ARXIV_HOSTS, ARXIV_PAGES), (".pdf",)), text)


def unversioned(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"v\d+$", ""))


def canonical_arxiv(c: Column) -> Column:
    return unversioned(bare_arxiv(c))


def anthology_id(bare: Column) -> Column:
    """Part of a bare DOI after the anthology prefix, else null."""
    return F.when(
        bare.startswith(ANTHOLOGY_PREFIX), F.substr(bare, F.lit(len(ANTHOLOGY_PREFIX) + 1))
    )


def author_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^https://openalex\.org/", ""))


def key_sha(c: Column) -> Column:
    return F.sha2(c, 256)


def stem(c: Column) -> Column:
    """File stem of a stored document."""
    return F.replace(c, F.lit("/"), F.lit("_"))


def canonical_from_stem(namespace: Column, c: Column) -> Column:
    """Inverse of :func:`stem` for the prefixes that are known to hold slashes."""
    out = c
    for name, repairs in STEM_REPAIRS.items():
        for flat, restored in repairs:
            out = F.when(
                (namespace == name) & c.startswith(flat),
                F.concat(F.lit(restored), F.substr(c, F.lit(len(flat) + 1))),
            ).otherwise(out)
    return out


def title_key(c: Column) -> Column:
    return F.lower(F.replace(strip(c), F.lit(" "), F.lit("_")))
