"""Citation graph: reference lists, counts, best source, pages, enrichment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litlake.functions.identifiers import canonical_doi
from litlake.functions.text import blank_to_null
from litlake.operators.spread import (
    at_least_one,
    first_per_key,
    keyed_join,
    page_columns,
    page_items,
    store_ordinals,
    stored_page_items,
    paginate,
)

PAGE_SIZE = 20
FAILED = "No record from this source"
# Fixed value: a message text that clients read.
BOTH_FAILED = "Both reference sources failed for this DOI."

# Provider field name -> reference field name.
REFERENCE_FIELDS = {
    "DOI": "doi",
    "author": "author",
    "article-title": "title",
    "year": "year",
    "journal-title": "journal",
    "volume": "volume",
    "first-page": "first_page",
    "unstructured": "unstructured",
}


def lean_reference(ref: Column) -> Column:
    return F.struct(
        *(blank_to_null(ref[raw]).alias(name) for raw, name in REFERENCE_FIELDS.items())
    )


def crossref_references(works: DataFrame) -> DataFrame:
    """One row per listed reference; ``ref_pos`` is its place in the list."""
    # The DOI is brought to its form before the list is cut up, once per work.
    named = works.select(canonical_doi(F.col("DOI")).alias("citing"), "reference")
    exploded = named.select("citing", F.posexplode("reference").alias("ref_pos", "_r"))
    return exploded.select("citing", "ref_pos", lean_reference(F.col("_r")).alias("_x")).select(
        "citing", "ref_pos", "_x.*"
    )


def reference_counts(
    asked: DataFrame,
    crossref_refs: DataFrame,
    crossref_known: DataFrame,
    opencitations_refs: DataFrame,
    opencitations_known: DataFrame,
) -> DataFrame:
    """Per asked DOI and source: number of references, or an error without a record.

    Every input has a ``doi`` column; the ``known`` ones list the DOIs a source
    has a record for. One union and one partially aggregated count answer both
    sources, so there is no join to skew.
    """

    def tagged(df: DataFrame, source: str, refs: int) -> DataFrame:
        return df.select("doi", F.lit(source).alias("src"), F.lit(refs).alias("n"))

    rows = (
        tagged(crossref_refs, "crossref", 1)
        .unionByName(tagged(crossref_known, "crossref", 0))
        .unionByName(tagged(opencitations_refs, "opencitations", 1))
        .unionByName(tagged(opencitations_known, "opencitations", 0))
        .unionByName(tagged(asked, "asked", 0))
    )

    def count_of(source: str) -> Column:
        mine = F.col("src") == source
        known = F.count(F.when(mine & (F.col("n") == 0), 1)) > 0
        return F.when(known, F.sum(F.when(mine, F.col("n"))))

    per_source = (
        rows.groupBy("doi")
        .agg(
            *(count_of(s).alias(f"{s}_count") for s in ("crossref", "opencitations")),
            F.count(F.when(F.col("src") == "asked", 1)).alias("_asked"),
        )
        .where("_asked > 0")
    )
    return per_source.select(
        "doi",
        "crossref_count",
        F.when(F.col("crossref_count").isNull(), F.lit(FAILED)).alias("crossref_error"),
        "opencitations_count",
        F.when(F.col("opencitations_count").isNull(), F.lit(FAILED)).alias("opencitations_error"),
    )


def best_reference_source(counts: DataFrame) -> DataFrame:
    """Source with more references; a tie goes to crossref, a failed source loses."""
    cr = F.coalesce("crossref_count", F.lit(-1))
    oc = F.coalesce("opencitations_count", F.lit(-1))
    none = (cr < 0) & (oc < 0)
    return counts.select(
        "doi",
        F.when(~none, F.when(cr >= oc, F.lit("crossref")).otherwise(F.lit("opencitations"))).alias(
            "best_source"
        ),
        F.when(~none, F.greatest(cr, oc)).alias("best_count"),
        F.when(none, F.lit(BOTH_FAILED)).alias("error"),
    )


def citation_counts(edges: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Citations of every ``asked`` DOI, 0 where nothing cites it, or of every cited one."""
    counts = edges.groupBy(F.col("cited").alias("doi")).agg(
        F.count(F.lit(1)).alias("citation_count")
    )
    if asked is None:
        return counts
    found = asked.select("doi").distinct().join(counts, "doi", "left")
    return found.select("doi", F.coalesce("citation_count", F.lit(0)).alias("citation_count"))


def references_page(
    counts: DataFrame,
    crossref_refs: DataFrame,
    opencitations_refs: DataFrame,
    order: Sequence[str],
    page: int = 1,
    page_size: int = PAGE_SIZE,
    source: str = "auto",
) -> DataFrame:
    """A page of every DOI's reference list from the chosen (or better) source.

    Both lists are cut to the page first; choosing the source then touches at
    most one page per DOI and source. Totals are the counts already at hand. A DOI
    that the chosen source lacks, or both, has an ``error`` and an empty page.
    """
    at_least_one("page", page)
    size = at_least_one("page_size", page_size)
    rows = _both_sources(crossref_refs, opencitations_refs)
    columns = [c for c in rows.columns if c not in ("citing", "_source")]
    pages = page_items(rows, ["citing", "_source"], [F.col(c) for c in order], page, size, columns)
    return _chosen_pages(counts, pages, page_columns(rows, columns, page, size), source)


def _both_sources(crossref_refs: DataFrame, opencitations_refs: DataFrame) -> DataFrame:
    return crossref_refs.withColumn("_source", F.lit("crossref")).unionByName(
        opencitations_refs.withColumn("_source", F.lit("opencitations")), allowMissingColumns=True
    )


def _chosen_pages(
    counts: DataFrame, pages: DataFrame, shown: dict[str, Column], source: str
) -> DataFrame:
    """One page per DOI of ``counts``, from ``pages`` by (citing, source)."""
    if source == "auto":
        chosen = best_reference_source(counts)
        picked, total, error = F.col("best_source"), F.col("best_count"), F.col("error")
    else:
        chosen, picked, total = counts, F.lit(source), F.col(f"{source}_count")
        error = F.when(total.isNull(), F.lit(FAILED))
    wanted = chosen.select(
        F.col("doi").alias("citing"),
        picked.alias("_source"),
        total.alias("total"),
        error.alias("error"),
    )
    return (
        wanted.join(pages, ["citing", "_source"], "left")
        .select("citing", "_source", "total", *(c.alias(n) for n, c in shown.items()), "error")
        .withColumnsRenamed({"citing": "doi", "items": "references"})
    )


def store_references(
    crossref_refs: DataFrame, opencitations_refs: DataFrame, path: str, order: Sequence[str]
) -> DataFrame:
    """Both reference lists with the place of each reference in its paper's list, stored once.

    What ``stored_references_page`` reads; the places of a paper with very many
    references are numbered in range pieces, so that it isn't one task's work.
    """
    rows = _both_sources(crossref_refs, opencitations_refs)
    return store_ordinals(rows, path, ["citing", "_source"], order)


def stored_references_page(
    counts: DataFrame,
    stored: DataFrame,
    page: int = 1,
    page_size: int = PAGE_SIZE,
    source: str = "auto",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """``references_page`` from a table of ``store_references``: a deep page costs what a first one does.

    With ``columns`` a reference has these only, and the others aren't read.
    """
    at_least_one("page", page)
    size = at_least_one("page_size", page_size)
    keys = ["citing", "_source"]
    if columns is None:
        columns = [c for c in stored.columns if c not in (*keys, "ordinal", "ordinal_block")]
    pages = stored_page_items(stored, keys, page, size, columns)
    return _chosen_pages(counts, pages, page_columns(stored, columns, page, size), source)


def citations_page(
    edges: DataFrame,
    order: Sequence[str],
    columns: Sequence[str],
    page: int = 1,
    page_size: int = PAGE_SIZE,
    asked: DataFrame | None = None,
) -> DataFrame:
    """A page of the incoming citations of every ``asked`` DOI, or of every cited one.

    An asked DOI that nothing cites has total 0 and an empty page.
    """
    size = at_least_one("page_size", page_size)
    pages = paginate(
        edges, ["cited"], [F.col(c) for c in order], at_least_one("page", page), size, columns
    ).withColumnsRenamed({"cited": "doi", "items": "citations"})
    if asked is None:
        return pages
    shown = page_columns(edges, columns, page, size) | {"total": F.coalesce("total", F.lit(0))}
    missing = F.col("citations")
    empty = F.coalesce(missing, F.array().cast(pages.schema["citations"].dataType))
    joined = asked.select("doi").distinct().join(pages.select("doi", "total", "citations"), "doi", "left")
    return joined.select(
        "doi",
        shown["total"].alias("total"),
        shown["page"].alias("page"),
        shown["page_size"].alias("page_size"),
        (F.coalesce("total", F.lit(0)) > page * size).alias("has_more"),
        empty.alias("citations"),
    )


def enrich_references(
    edges: DataFrame, papers: DataFrame, spread: Sequence[str]
) -> DataFrame:
    """Every edge with the metadata of the paper it cites; unknown papers stay null.

    A few papers draw a large share of all citations; adaptive execution splits
    them. Of several records of one paper one answers, by a fixed order.
    """
    keyed = papers.withColumnRenamed("_canonical_id", "cited").where("cited is not null")
    keyed = first_per_key(keyed, ["cited"], [F.xxhash64(*keyed.columns).asc()])
    return keyed_join(edges, keyed, "cited", "left", spread=spread)
