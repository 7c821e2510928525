"""Unified paper metadata, abstracts, authors and short hit lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litlake.functions import identifiers as ids
from litlake.functions.text import blank_to_null
from litlake.operators.identifiers import resolve_identifiers
from litlake.sources.buckets import write_bucketed
from litlake.operators.spread import at_least_one, first_per_key, keyed_join

HINTS = {
    "arxiv": "Check the arXiv ID format (e.g. 2301.00001) or search by title.",
    "biorxiv": "Check the DOI format (10.1101/...) or search by title.",
    "openalex": "Check the DOI format or search by title to find the correct DOI.",
}
UNKNOWN_ERROR = "Identifier is neither an arXiv id nor a DOI."
UNKNOWN_HINT = "Use an arXiv id (2301.00001) or a DOI (10.xxxx/...)."
AUTHORS_PER_PAGE = 25
TOP_TOPICS = 5
INTERNAL_COLUMNS = ("path", "markdown_path")


def arxiv_id_of(entry_id: Column) -> Column:
    """Bare id, version kept, from an entry's abstract address."""
    return F.when(
        entry_id.contains("/abs/"), F.element_at(F.split(entry_id, "/abs/", -1), -1)
    ).otherwise(entry_id)


def _pdf_link(links: Column) -> Column:
    return F.get(F.filter(links, lambda k: k["title"] == "pdf"), F.lit(0))["href"]


def unified_metadata(df: DataFrame, source: str) -> DataFrame:
    """Lean metadata of one provider, tagged ``_source`` and ``_canonical_id``."""
    if source == "arxiv":
        arxiv_id = arxiv_id_of(F.col("id"))
        return df.select(
            F.lit("arxiv").alias("_source"),
            ids.canonical_arxiv(arxiv_id).alias("_canonical_id"),
            arxiv_id.alias("arxiv_id"),
            "title",
            "published",
            "updated",
            "primary_category",
            "categories",
            _pdf_link(F.col("links")).alias("pdf_url"),
            "doi",
            "journal_ref",
            "comment",
        )
    if source == "biorxiv":
        return df.select(
            F.lit("biorxiv").alias("_source"),
            F.lower(ids.preprint_doi(F.col("doi"))).alias("_canonical_id"),
            "doi",
            "title",
            "date",
            "version",
            "type",
            "category",
            "license",
            "server",
            "published_doi",
            "pdf_url",
        )
    if source == "openalex":
        return df.select(
            F.lit("openalex").alias("_source"),
            ids.canonical_doi(F.col("doi")).alias("_canonical_id"),
            "title",
            "doi",
            "publication_year",
            "publication_date",
            "type",
            "language",
            F.col("primary_location.source.display_name").alias("venue"),
            F.col("open_access.is_oa").alias("is_oa"),
            F.col("open_access.oa_status").alias("oa_status"),
            F.col("open_access.oa_url").alias("oa_url"),
        )
    raise ValueError(f"unknown source: {source}")


def all_metadata(arxiv: DataFrame, biorxiv: DataFrame, works: DataFrame) -> DataFrame:
    """One table over all providers; columns a provider lacks are null."""
    return (
        unified_metadata(arxiv, "arxiv")
        .unionByName(unified_metadata(biorxiv, "biorxiv"), allowMissingColumns=True)
        .unionByName(unified_metadata(works, "openalex"), allowMissingColumns=True)
    )


def inverted_text(index: Column) -> Column:
    """Text of a word -> positions map, ordered by position then word."""
    placed = F.flatten(
        F.transform(
            F.map_entries(index),
            lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w"))),
        )
    )
    return F.array_join(F.transform(F.sort_array(placed), lambda x: x["w"]), " ")


def abstracts(df: DataFrame, source: str) -> DataFrame:
    """Plain-text abstract per paper; an empty one is null."""
    if source == "arxiv":
        text, key = F.col("summary"), ids.canonical_arxiv(arxiv_id_of(F.col("id")))
    elif source == "biorxiv":
        text, key = F.col("abstract"), F.lower(ids.preprint_doi(F.col("doi")))
    elif source == "openalex":
        text = inverted_text(F.col("abstract_inverted_index"))
        key = ids.canonical_doi(F.col("doi"))
    else:
        raise ValueError(f"unknown source: {source}")
    return df.select(
        F.lit(source).alias("_source"),
        key.alias("_canonical_id"),
        "title",
        blank_to_null(text).alias("abstract"),
    )


def _display_names(institutions: Column) -> Column:
    """Institution names that are neither null nor empty."""
    return F.filter(
        F.transform(institutions, lambda i: i["display_name"]),
        lambda n: n.isNotNull() & (n != ""),
    )


def _or_none(items: Column, kind: str) -> Column:
    """A missing list is an empty one."""
    return F.coalesce(items, F.array().cast(f"array<{kind}>"))


def author_profiles(df: DataFrame, top_topics: int = TOP_TOPICS) -> DataFrame:
    return df.select(
        F.col("display_name").alias("name"),
        F.col("id").alias("openalex_id"),
        "orcid",
        "works_count",
        "cited_by_count",
        F.col("summary_stats.h_index").alias("h_index"),
        F.col("summary_stats.i10_index").alias("i10_index"),
        _or_none(_display_names(F.col("last_known_institutions")), "string").alias(
            "current_institutions"
        ),
        _or_none(
            F.transform(
                F.slice("topics", 1, top_topics),
                lambda t: F.struct(t["display_name"].alias("name"), t["count"].alias("count")),
            ),
            "struct<name:string,count:int>",
        ).alias("top_topics"),
        _or_none(
            F.transform(
                "affiliations",
                lambda a: F.struct(
                    a["institution"]["display_name"].alias("institution"),
                    a["institution"]["country_code"].alias("country_code"),
                    F.array_sort(_or_none(a["years"], "int")).alias("years"),
                ),
            ),
            "struct<institution:string,country_code:string,years:array<int>>",
        ).alias("affiliations"),
    )


def triage_arxiv(df: DataFrame) -> DataFrame:
    year = F.substr(F.col("published"), F.lit(1), F.lit(4))
    return df.select(
        arxiv_id_of(F.col("id")).alias("arxiv_id"),
        "title",
        F.get("authors", F.lit(0))["name"].alias("first_author"),
        F.greatest(F.size("authors"), F.lit(0)).alias("author_count"),
        F.when(year.rlike(r"^\d{4}$"), year.try_cast("int")).alias("published_year"),
    )


def crossref_first_author(authors: Column) -> Column:
    """First author with any name part."""
    full = F.transform(
        authors,
        lambda a: F.concat_ws(" ", blank_to_null(a["given"]), blank_to_null(a["family"])),
    )
    return F.get(F.filter(full, lambda n: n != ""), F.lit(0))


def crossref_year() -> Column:
    """Print year, or the online year where no print date exists."""
    date = F.coalesce(F.col("`published-print`"), F.col("`published-online`"))
    return F.get(F.get(date["date-parts"], F.lit(0)), F.lit(0))


def crossref_triage_columns() -> list[Column]:
    return [
        F.col("DOI").alias("doi"),
        F.get("title", F.lit(0)).alias("title"),
        crossref_first_author(F.col("author")).alias("first_author"),
        F.greatest(F.size("author"), F.lit(0)).alias("author_count"),
        crossref_year().alias("year"),
    ]


def triage_crossref(df: DataFrame) -> DataFrame:
    return df.select(*crossref_triage_columns())


def page_status(titles: DataFrame, summaries: DataFrame) -> DataFrame:
    """For each requested ``title``: does its page exist, and what kind is it."""
    known = summaries.select(
        ids.title_key(F.col("title")).alias("_title_key"),
        F.lit(True).alias("_found"),
        F.col("title").alias("_page_title"),
        F.col("type").alias("_type"),
        F.col("url").alias("_url"),
        F.col("description").alias("_description"),
    )
    known = known.where(F.col("_title_key").isNotNull())
    order = [F.col(c).asc_nulls_last() for c in ("_page_title", "_url", "_type", "_description")]
    known = first_per_key(known, ["_title_key"], order)
    asked = titles.withColumn("_title_key", ids.title_key(F.col("title")))
    joined = keyed_join(asked, known, "_title_key", "left", spread=["request_id"])
    found = F.coalesce("_found", F.lit(False))
    return joined.select(
        "request_id",
        F.coalesce("_page_title", "title").alias("title"),
        found.alias("exists"),
        (found & F.coalesce(F.col("_type") == "disambiguation", F.lit(False))).alias(
            "is_disambiguation"
        ),
        F.when(found, F.col("_url")).alias("url"),
        F.col("_description").alias("description"),
    )


def tag_errors(df: DataFrame, suggestion: str) -> DataFrame:
    """Give failed rows a suggestion where they have none; hide storage paths."""
    present = F.col("suggestion") if "suggestion" in df.columns else F.lit(None).cast("string")
    kept = [c for c in df.columns if c not in (*INTERNAL_COLUMNS, "suggestion")]
    hint = F.when(F.col("error").isNotNull(), F.coalesce(present, F.lit(suggestion))).otherwise(
        present
    )
    return df.select(*kept, hint.alias("suggestion"))


def follow_published(preprints: DataFrame, works: DataFrame) -> DataFrame:
    """Journal record of a preprint where one exists, otherwise the preprint itself."""
    own = unified_metadata(preprints, "biorxiv").withColumn(
        "_work_key", ids.canonical_doi(F.col("published_doi"))
    )
    journal = unified_metadata(works, "openalex")
    journal = journal.select(
        F.col("_canonical_id").alias("_work_key"), F.struct(*journal.columns).alias("_work")
    )
    journal = journal.where(F.col("_work_key").isNotNull())
    journal = newest_per_key(journal, ["_work_key"], F.col("_work.publication_date"))
    joined = keyed_join(own, journal, "_work_key", "left", spread=["_canonical_id"])
    found = F.col("_work").isNotNull()
    from_work = {
        "title", "doi", "publication_year", "publication_date", "type", "language", "venue",
        "is_oa", "oa_status", "oa_url",
    }
    from_own = {
        "doi", "title", "date", "version", "type", "category", "license", "server",
        "published_doi", "pdf_url",
    }
    out = [
        F.when(found, F.lit("openalex_via_biorxiv")).otherwise(F.lit("biorxiv")).alias("_source"),
        F.when(found, F.col("_work._canonical_id"))
        .otherwise(F.col("_canonical_id"))
        .alias("_canonical_id"),
        F.when(found, F.col("doi")).alias("preprint_doi"),
    ]
    for name in sorted(from_work | from_own):
        work = F.col(f"_work.{name}") if name in from_work else None
        if work is None:
            out.append(F.when(~found, F.col(name)).alias(name))
        elif name in from_own:
            out.append(F.when(found, work).otherwise(F.col(name)).alias(name))
        else:
            out.append(work.alias(name))
    return joined.select(*out)


def newest_per_key(df: DataFrame, keys: list[str], date: Column) -> DataFrame:
    """One record per key: that with the latest date, a hash of the record breaking ties.

    What is compared is a date and a number, however wide the records are.
    """
    return first_per_key(df, keys, [date.desc_nulls_last(), F.xxhash64(*df.columns).asc()])


def _latest(papers: DataFrame, key: str) -> DataFrame:
    dates = [c for c in ("publication_date", "date", "updated", "published") if c in papers.columns]
    return newest_per_key(papers, [key], F.coalesce(*dates, F.lit("")) if dates else F.lit(""))


def _with_paper_key(papers: DataFrame) -> DataFrame:
    keyed = papers.withColumn("_paper", F.concat_ws("\x00", "_source", "_canonical_id"))
    return _latest(keyed.where(F.col("_canonical_id").isNotNull()), "_paper")


def store_papers(papers: DataFrame, path: str, buckets: int | None = None) -> DataFrame:
    """Newest record per paper of :func:`all_metadata`, bucketed by paper for ``batch_metadata``.

    Written once, then asked many times: a join on the table sorts and shuffles the
    requests only. ``buckets`` (by default the session's shuffle partitions) shouldn't be
    fewer than those.
    """
    spark = papers.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return write_bucketed(_with_paper_key(papers), path, "_paper", buckets, ["_paper"])


def batch_metadata(requests: DataFrame, papers: DataFrame) -> DataFrame:
    """One row per input position with the paper's metadata or an error row.

    ``requests(pos, raw)`` keeps duplicates; ``papers`` is :func:`all_metadata`
    over record tables; of several records of one paper the newest answers. All
    providers are answered by one join on (source, canonical id). A table of
    :func:`store_papers` has one record per paper already and isn't shuffled.
    """
    asked = resolve_identifiers(requests, "raw").select(
        "pos",
        F.col("raw").alias("_input"),
        F.col("source").alias("_want"),
        F.concat_ws("\x00", "source", "canonical_id").alias("_paper"),
    )
    stored = "_paper" in papers.columns
    keyed = papers if stored else _with_paper_key(papers)
    shown = [c for c in papers.columns if c != "_paper"]
    joined = keyed_join(asked, keyed, "_paper", "left", spread=["pos"])
    missing = F.col("_source").isNull()
    hint = F.lit(UNKNOWN_HINT)
    for source, text in HINTS.items():
        hint = F.when(F.col("_want") == source, F.lit(text)).otherwise(hint)
    return joined.select(
        "pos",
        "_input",
        *shown,
        F.when(
            missing,
            F.when(F.col("_want").isNull(), F.lit(UNKNOWN_ERROR)).otherwise(
                F.concat(F.lit("No paper found for: "), F.col("_input"))
            ),
        ).alias("error"),
        F.when(missing, hint).alias("suggestion"),
    )


def institution_names(authorships: Column) -> Column:
    """Distinct institution names in first-seen order."""
    return F.array_distinct(
        F.flatten(
            F.transform(
                authorships, lambda a: _or_none(_display_names(a["institutions"]), "string")
            )
        )
    )


def authors_page(
    works: DataFrame, page: int = 1, page_size: int = AUTHORS_PER_PAGE
) -> DataFrame:
    """A page of every work's author list with the institutions of that page."""
    size = at_least_one("page_size", page_size)
    start = (at_least_one("page", page) - 1) * size
    shown = F.slice("authorships", start + 1, size)
    institutions = institution_names(shown)
    return works.select(
        F.lit("openalex").alias("_source"),
        ids.canonical_doi(F.col("doi")).alias("_canonical_id"),
        F.size("authorships").alias("author_count"),
        F.lit(page).alias("page"),
        F.lit(size).alias("page_size"),
        (F.size("authorships") > start + size).alias("has_more"),
        F.transform(
            shown,
            lambda a: F.struct(
                a["author"]["display_name"].alias("name"),
                a["author"]["id"].alias("openalex_id"),
                a["author_position"].alias("position"),
                a["is_corresponding"].alias("is_corresponding"),
                _or_none(_display_names(a["institutions"]), "string").alias("institutions"),
            ),
        ).alias("authors"),
        institutions.alias("page_institutions"),
        F.size(institutions).alias("page_institution_count"),
    )


def plain_authors_page(
    papers: DataFrame, source: str, page: int = 1, page_size: int = AUTHORS_PER_PAGE
) -> DataFrame:
    """Author page of preprints, whose authors carry no institutions."""
    size = at_least_one("page_size", page_size)
    start = (at_least_one("page", page) - 1) * size
    key = (
        ids.canonical_arxiv(arxiv_id_of(F.col("id")))
        if source == "arxiv"
        else F.lower(F.col("doi"))
    )
    extra = (
        ["author_corresponding", "author_corresponding_institution"] if source == "biorxiv" else []
    )
    return papers.select(
        F.lit(source).alias("_source"),
        key.alias("_canonical_id"),
        F.size("authors").alias("author_count"),
        F.lit(page).alias("page"),
        F.lit(size).alias("page_size"),
        (F.size("authors") > start + size).alias("has_more"),
        F.slice("authors", start + 1, size).alias("authors"),
        *extra,
        F.array().cast("array<string>").alias("page_institutions"),
        F.lit(0).alias("page_institution_count"),
    )
