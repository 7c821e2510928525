"""Bibliography entries from work, arXiv and preprint records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litlake.functions import identifiers as ids
from litlake.functions.names import author_list, citation_key, escape_bibtex
from litlake.functions.text import blank_to_null
from litlake.operators.metadata import arxiv_id_of, institution_names

# Work type -> entry type; any other type becomes misc.
ENTRY_TYPES = {
    "article": "article",
    "review": "article",
    "letter": "article",
    "editorial": "article",
    "erratum": "article",
    "preprint": "misc",
    "posted-content": "misc",
    "book": "book",
    "book-chapter": "incollection",
    "monograph": "book",
    "dissertation": "phdthesis",
    "proceedings-article": "inproceedings",
    "proceedings": "proceedings",
    "report": "techreport",
    "standard": "misc",
    "dataset": "misc",
    "other": "misc",
}
# The field that names the venue, per entry type.
VENUE_FIELDS = {
    "article": "journal",
    "inproceedings": "booktitle",
    "incollection": "booktitle",
    "techreport": "institution",
}


def _field(name: str, value: Column, keep: Column | None = None) -> Column:
    """``  name={value}``, or null where the value is missing or not wanted."""
    wanted = value.isNotNull() & (value != "")
    if keep is not None:
        wanted = wanted & keep
    return F.when(wanted, F.concat(F.lit(f"  {name}={{"), value, F.lit("}")))


def _entry(kind: Column, key: Column, fields: list[Column]) -> Column:
    return F.concat(
        F.lit("@"), kind, F.lit("{"), key, F.lit(",\n"), F.concat_ws(",\n", *fields), F.lit("\n}")
    )


def _title_field(title: Column) -> Column:
    return F.concat(F.lit("  title={"), escape_bibtex(F.coalesce(title, F.lit(""))), F.lit("}"))


def _author_field(names: Column) -> Column:
    return F.when(F.size(names) > 0, F.concat(F.lit("  author={"), author_list(names), F.lit("}")))


def _year(date: Column) -> Column:
    return F.when(F.length(date) >= 4, F.substr(date, F.lit(1), F.lit(4)))


def entry_type(work_type: Column) -> Column:
    out = F.lit("misc")
    for kind in sorted(set(ENTRY_TYPES.values()) - {"misc"}):
        out = F.when(
            work_type.isin(*(t for t, k in ENTRY_TYPES.items() if k == kind)), F.lit(kind)
        ).otherwise(out)
    return out


ENTRY = ("_source", "_canonical_id", "bibtex")


def bibtex_openalex(works: DataFrame) -> DataFrame:
    return _openalex(works).select(*ENTRY)


def _openalex(works: DataFrame) -> DataFrame:
    kind = entry_type(F.col("type"))
    names = F.transform("authorships", lambda a: a["author"]["display_name"])
    url = F.col("doi")
    doi = F.regexp_replace(url, r"^https://doi\.org/", "")
    venue = blank_to_null(escape_bibtex(F.col("primary_location.source.display_name")))
    school = escape_bibtex(F.get(institution_names(F.col("authorships")), F.lit(0)))
    first_page, last_page = F.col("biblio.first_page"), F.col("biblio.last_page")
    year = F.col("publication_year").cast("string")
    preprint = F.col("type").isin("preprint", "posted-content")
    on_arxiv = F.coalesce(F.lower(doi).contains("arxiv"), F.lit(False))
    eprint = F.regexp_replace(F.element_at(F.split(doi, "/", -1), -1), r"(?i)^arxiv\.", "")
    indexed = F.coalesce(F.col("ids.openalex").contains("openalex"), F.lit(False))
    fields = [
        _title_field(F.col("title")),
        _author_field(names),
        *(_field(f, venue, kind == k) for k, f in VENUE_FIELDS.items()),
        _field("school", school, kind == "phdthesis"),
        _field("volume", F.col("biblio.volume")),
        _field("number", F.col("biblio.issue")),
        _field("pages", F.concat_ws("--", blank_to_null(first_page), blank_to_null(last_page)),
               first_page.isNotNull() & (first_page != "")),
        _field("year", year),
        _field("publisher", escape_bibtex(F.col("primary_location.source.host_organization_name"))),
        _field("doi", doi),
        _field("eprint", eprint, preprint & on_arxiv),
        F.when(preprint & on_arxiv, F.lit("  archiveprefix={arXiv}")),
        _field("howpublished", F.concat(F.lit("\\url{"), url, F.lit("}")),
               preprint & ~on_arxiv & indexed),
    ]
    key = citation_key(F.get(names, F.lit(0)), year, F.coalesce("title", F.lit("")))
    return works.select(
        F.lit("openalex").alias("_source"),
        ids.canonical_doi(url).alias("_canonical_id"),
        F.coalesce(ids.canonical_doi(url), F.col("ids.openalex")).alias("_key"),
        F.coalesce(F.col("publication_date").cast("string"), F.lit("")).alias("_date"),
        _entry(kind, key, fields).alias("bibtex"),
    )


def bibtex_arxiv(papers: DataFrame) -> DataFrame:
    return _arxiv(papers).select(*ENTRY)


def _arxiv(papers: DataFrame) -> DataFrame:
    names = F.transform("authors", lambda a: a["name"])
    journal = blank_to_null(F.col("journal_ref"))
    eprint = F.regexp_replace(arxiv_id_of(F.col("id")), r"v\d+$", "")
    year = _year(F.col("published"))
    fields = [
        _title_field(F.col("title")),
        _author_field(names),
        _field("journal", escape_bibtex(journal)),
        _field("year", year),
        _field("eprint", eprint),
        F.when(eprint != "", F.lit("  archiveprefix={arXiv}")),
        _field("primaryclass", F.col("primary_category")),
        _field("doi", F.col("doi")),
    ]
    kind = F.when(journal.isNotNull(), F.lit("article")).otherwise(F.lit("misc"))
    key = citation_key(F.get(names, F.lit(0)), year, F.coalesce("title", F.lit("")))
    return papers.select(
        F.lit("arxiv").alias("_source"),
        ids.canonical_arxiv(arxiv_id_of(F.col("id"))).alias("_canonical_id"),
        ids.canonical_arxiv(arxiv_id_of(F.col("id"))).alias("_key"),
        F.coalesce(F.col("published").cast("string"), F.lit("")).alias("_date"),
        _entry(kind, key, fields).alias("bibtex"),
    )


def bibtex_biorxiv(papers: DataFrame) -> DataFrame:
    return _biorxiv(papers).select(*ENTRY)


def _biorxiv(papers: DataFrame) -> DataFrame:
    names = F.transform("authors", lambda a: a["name"])
    published = blank_to_null(F.col("published_doi"))
    preprint = published.isNull()
    year = _year(F.col("date"))
    server = F.when(F.col("server") == "medrxiv", F.lit("medRxiv")).otherwise(F.lit("bioRxiv"))
    fields = [
        _title_field(F.col("title")),
        _author_field(names),
        _field("doi", published),
        _field("year", year),
        _field("publisher", server, preprint),
        _field("doi", F.col("doi"), preprint),
        _field(
            "howpublished",
            F.concat(F.lit("\\url{https://doi.org/"), blank_to_null(F.col("doi")), F.lit("}")),
            preprint,
        ),
    ]
    kind = F.when(preprint, F.lit("misc")).otherwise(F.lit("article"))
    key = citation_key(F.get(names, F.lit(0)), year, F.coalesce("title", F.lit("")))
    return papers.select(
        F.lit("biorxiv").alias("_source"),
        F.lower(ids.preprint_doi(F.col("doi"))).alias("_canonical_id"),
        F.lower(ids.preprint_doi(F.col("doi"))).alias("_key"),
        F.coalesce(F.col("date").cast("string"), F.lit("")).alias("_date"),
        _entry(kind, key, fields).alias("bibtex"),
    )


#: Which provider's entry a paper gets that several have: the one its id is routed to.
PREFERRED = ("openalex", "biorxiv", "arxiv")


def all_entries(arxiv: DataFrame, biorxiv: DataFrame, works: DataFrame) -> DataFrame:
    """Entries of all providers, one per paper: that of the newest record of one provider.

    A paper is its canonical id, or without one the provider's own id. A record with neither is a
    paper of its own, whatever its title. Where several providers have a paper, its
    preprint server's entry is taken.
    """
    rows = _arxiv(arxiv).unionByName(_biorxiv(biorxiv)).unionByName(_openalex(works))
    rank = F.array_position(F.array(*(F.lit(s) for s in PREFERRED)), F.col("_source"))
    best = F.max(F.struct(rank.alias("rank"), "_date", "bibtex", "_source", "_canonical_id")).alias("_r")
    columns = ["_source", "_canonical_id", "bibtex"]
    known = rows.where("_key is not null").groupBy("_key").agg(best)
    return known.select(*(f"_r.{c}" for c in columns)).unionByName(
        rows.where("_key is null").select(*columns)
    )


def export_bibliography(entries: DataFrame, path: str) -> None:
    """Write entries as text, a blank line between them."""
    entries.select(F.concat("bibtex", F.lit("\n")).alias("value")).write.mode("overwrite").text(path)
