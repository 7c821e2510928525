"""Citation-graph queries over the line-item edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from litlake.functions import text as tx
from litlake.operators import graph as op
from litlake.operators.metadata import unified_metadata
from litlake.operators.normalize import normalize_citations
from litlake.plans import sql, views
from litlake.plans.registry import query
from litlake.session import scratch_path

def _citing():
    return F.col("citing").alias("doi")


@query(
    "normalize_citations",
    sql.with_(
        sql.EDGES,
        body="""SELECT ord, line, part, supp, 'br/06' || part AS omid, '10.1234/p' || part AS doi, 'X:' || supp AS openalex,
  3 AS n_ids, creation, journal_sc = 'yes' AS journal_self_citation, author_sc = 'yes' AS author_self_citation
FROM edges""",
    ),
)
def citations_normalized(spark, sf_dir):
    """The openalex mark is repeated with a value that holds a colon; the last one wins."""
    raw = views.edges(spark, sf_dir).withColumn(
        "ids", F.concat("ids", F.lit("  junk openalex:X:"), "supp")
    )
    ids = F.col("ids")
    return normalize_citations(raw, "ids").select(
        "ord",
        "line",
        "part",
        "supp",
        ids["omid"].alias("omid"),
        ids["doi"].alias("doi"),
        ids["openalex"].alias("openalex"),
        F.size(ids).alias("n_ids"),
        "creation",
        "journal_self_citation",
        "author_self_citation",
    )


def counts(spark, sf_dir):
    asked = views.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("10.1234/o"), F.col("o_orderkey")).alias("doi")
    )
    return op.reference_counts(
        asked,
        views.crossref_edges(spark, sf_dir).select(_citing()),
        views.known_dois(spark, sf_dir, "crossref"),
        views.edges(spark, sf_dir).select(_citing()),
        views.known_dois(spark, sf_dir, "opencitations"),
    )


_COUNTS = (sql.EDGES, sql.CROSSREF_EDGES, sql.KNOWN, sql.COUNTS)


@query(
    "reference_counts",
    sql.with_(
        *_COUNTS,
        body=f"""SELECT doi, crossref_count, CASE WHEN crossref_count IS NULL THEN '{op.FAILED}' END AS crossref_error,
  opencitations_count, CASE WHEN opencitations_count IS NULL THEN '{op.FAILED}' END AS opencitations_error
FROM counts""",
    ),
)
def reference_counts(spark, sf_dir):
    return counts(spark, sf_dir)


BEST = f"""best AS (
  SELECT doi, CASE WHEN crossref_count IS NULL AND opencitations_count IS NULL THEN NULL
      WHEN coalesce(crossref_count, -1) >= coalesce(opencitations_count, -1) THEN 'crossref'
      ELSE 'opencitations' END AS best_source,
    greatest(crossref_count, opencitations_count) AS best_count,
    CASE WHEN crossref_count IS NULL AND opencitations_count IS NULL THEN '{op.BOTH_FAILED}' END AS error
  FROM counts)"""


@query("best_reference_source", sql.with_(*_COUNTS, BEST, body="SELECT * FROM best"))
def best_reference_source(spark, sf_dir):
    return op.best_reference_source(counts(spark, sf_dir))


# Every part, and as many papers that nothing cites.
ASKED_PARTS = """asked AS (
  SELECT unnest(['10.1234/p' || p_partkey, '10.1234/none' || p_partkey]) AS doi FROM part)"""


def asked_parts(spark, sf_dir):
    key = F.col("p_partkey").cast("string")
    both = [F.concat(F.lit(start), key) for start in ("10.1234/p", "10.1234/none")]
    return views.table(spark, sf_dir, "part").select(F.explode(F.array(*both)).alias("doi"))


@query(
    "citation_counts",
    sql.with_(
        sql.EDGES,
        ASKED_PARTS,
        body="SELECT doi, count(citing) AS citation_count FROM asked LEFT JOIN edges ON cited = doi GROUP BY doi",
    ),
)
def citation_counts(spark, sf_dir):
    return op.citation_counts(views.edges(spark, sf_dir), asked_parts(spark, sf_dir))


def _page_sql(listed: str, key: str, size: int, page: int, item: str) -> str:
    """``listed`` rows numbered per key, one page of them joined to a string."""
    return f"""numbered AS (
  SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY line, part, supp, creation, journal_sc, author_sc, ord) AS r FROM {listed}),
pages AS (
  SELECT {key}, count(*) AS total,
    string_agg({item}, '|' ORDER BY r) FILTER (WHERE r > {(page - 1) * size} AND r <= {page * size}) AS items
  FROM numbered GROUP BY {key})"""


def _joined(items: str, *fields: str):
    parts = lambda r: F.concat_ws(" ", *(r[f].cast("string") for f in fields))
    return F.array_join(F.transform(items, parts), "|")


ORDER = [*views.EDGE_ORDER, "ord"]


REFERENCES_PAGE = sql.with_(
    *_COUNTS,
    BEST,
    """listed AS (
  SELECT 'crossref' AS src, * FROM crossref_edges UNION ALL SELECT 'opencitations', * FROM edges)""",
    _page_sql("listed", "citing, src", 3, 1, "cited || ' ' || line"),
    body="""SELECT doi, best_source AS _source, CASE WHEN error IS NULL THEN coalesce(total, 0) END AS total, 1 AS page, 3 AS page_size,
  coalesce(total > 3, false) AS has_more, coalesce(items, '') AS items, error
FROM best LEFT JOIN pages ON doi = citing AND best_source = src""",
)


@query("references_page", REFERENCES_PAGE)
def references_page(spark, sf_dir):
    columns = ["citing", "cited", *ORDER]
    return (
        op.references_page(
            counts(spark, sf_dir),
            views.crossref_edges(spark, sf_dir).select(*columns),
            views.edges(spark, sf_dir).select(*columns),
            ORDER,
            1,
            3,
        )
        .withColumn("items", F.coalesce(_joined("references", "cited", "line"), F.lit("")))
        .drop("references")
    )


@query("stored_references_page", REFERENCES_PAGE)
def stored_references_page(spark, sf_dir):
    """The same pages from references stored with their places."""
    columns = ["citing", "cited", *ORDER]
    stored = op.store_references(
        views.crossref_edges(spark, sf_dir).select(*columns),
        views.edges(spark, sf_dir).select(*columns),
        scratch_path(spark, "references"),
        ORDER,
    )
    pages = op.stored_references_page(counts(spark, sf_dir), stored, 1, 3, columns=["cited", "line"])
    joined = F.coalesce(_joined("references", "cited", "line"), F.lit(""))
    return pages.withColumn("items", joined).drop("references")


@query(
    "citations_page",
    sql.with_(
        sql.EDGES,
        ASKED_PARTS,
        _page_sql("edges", "cited", 5, 2, "citing || ' ' || creation"),
        body="""SELECT doi, coalesce(total, 0) AS total, 2 AS page, 5 AS page_size, coalesce(total > 10, false) AS has_more,
  coalesce(items, '') AS items
FROM asked LEFT JOIN pages ON cited = doi""",
    ),
)
def citations_page(spark, sf_dir):
    return (
        op.citations_page(
            views.edges(spark, sf_dir),
            ORDER,
            ["citing", "creation"],
            2,
            5,
            asked_parts(spark, sf_dir),
        )
        .withColumn("items", _joined("citations", "citing", "creation"))
        .drop("citations")
    )


@query(
    "crossref_references",
    f"""SELECT citing, i - 1 AS ref_pos, CASE WHEN length(w) % 2 = 0 THEN '10.1234/' || w END AS doi,
  CAST(1990 + (i - 1) % 30 AS VARCHAR) AS year, 'Vol ' || (i - 1) AS volume,
  CASE WHEN length(w) % 2 = 1 THEN w END AS unstructured
FROM (SELECT '10.1234/o' || doc_id AS citing, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
  FROM (SELECT doc_id, {sql.words('text')} AS ws FROM documents))""",
)
def crossref_references(spark, sf_dir):
    """Work records whose reference list has one entry per word of a document."""
    none = F.lit(None).cast("string")
    reference = lambda w, i: F.struct(
        F.when(F.length(w) % 2 == 0, F.concat(F.lit("10.1234/"), w)).otherwise("").alias("DOI"),
        none.alias("author"),
        F.lit("").alias("article-title"),
        (i % 30 + 1990).cast("string").alias("year"),
        none.alias("journal-title"),
        F.concat(F.lit("Vol "), i.cast("string")).alias("volume"),
        none.alias("first-page"),
        F.when(F.length(w) % 2 == 1, w).alias("unstructured"),
    )
    works = views.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("10.1234/O"), "doc_id").alias("DOI"),
        F.transform(tx.words(F.col("text")), reference).alias("reference"),
    )
    return op.crossref_references(works).select(
        "citing", "ref_pos", "doi", "year", "volume", "unstructured"
    )


@query(
    "enrich_references",
    sql.with_(
        sql.EDGES,
        sql.WORKS,
        body="""SELECT e.ord, e.line, e.part, e.supp, e.citing, '10.1234/o' || e.part AS cited, w.title, w.publication_year, w.venue
FROM edges e LEFT JOIN works w ON w.canonical_id = '10.1234/o' || e.part""",
    ),
)
def enrich_references(spark, sf_dir):
    edges = views.edges(spark, sf_dir).select(
        "ord", "line", "part", "supp", "citing", F.concat(F.lit("10.1234/o"), F.col("part")).alias("cited")
    )
    papers = unified_metadata(views.works(spark, sf_dir), "openalex").select(
        "_canonical_id", "title", "publication_year", "venue"
    )
    return op.enrich_references(edges, papers, spread=["ord", "line", "part", "supp"])
