"""Identifier queries over the spelled-out order ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from litlake.operators import identifiers as op
from litlake.operators.records import first_seen
from litlake.plans import sql, views
from litlake.plans.registry import query


@query(
    "resolve_identifiers",
    sql.with_(
        sql.IDS,
        sql.RESOLVED,
        body="""SELECT pos, raw, normalized, source, namespace, canonical_id, sha256(canonical_id) AS key_sha
FROM resolved""",
    ),
)
def resolve_identifiers(spark, sf_dir):
    return op.resolve_identifiers(views.ids(spark, sf_dir))


@query(
    "record_keys",
    sql.with_(
        sql.CORPUS,
        body="SELECT namespace, canonical_id, sha256(canonical_id) AS key_sha FROM corpus",
    ),
)
def record_keys(spark, sf_dir):
    return op.record_keys(views.corpus(spark, sf_dir).select("namespace", "canonical_id"))


@query(
    "storage_names",
    sql.with_(
        sql.IDS,
        sql.RESOLVED,
        body="""SELECT pos, namespace, canonical_id, replace(canonical_id, '/', '_') AS stem,
  CASE WHEN namespace = 'manual' THEN replace(canonical_id, '/', '_') ELSE canonical_id END AS restored_id
FROM resolved""",
    ),
)
def storage_names(spark, sf_dir):
    resolved = op.resolve_identifiers(views.ids(spark, sf_dir))
    return op.storage_names(resolved.select("pos", "namespace", "canonical_id"))


@query(
    "resolve_author_ids",
    """SELECT c_custkey AS n, author_id, lower(regexp_replace(author_id, '^https://openalex.org/', '')) AS author_key
FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'A' || c_custkey
  WHEN 1 THEN 'https://openalex.org/A' || c_custkey
  ELSE 'https://orcid.org/0000-0001-' || c_custkey || '-X' END AS author_id FROM customer)""",
)
def resolve_author_ids(spark, sf_dir):
    k = F.col("c_custkey")
    spelled = (
        F.when(k % 3 == 0, F.concat(F.lit("A"), k))
        .when(k % 3 == 1, F.concat(F.lit("https://openalex.org/A"), k))
        .otherwise(F.concat(F.lit("https://orcid.org/0000-0001-"), k, F.lit("-X")))
    )
    authors = views.table(spark, sf_dir, "customer").select(k.alias("n"), spelled.alias("author_id"))
    return op.resolve_author_ids(authors)


@query(
    "plan_downloads",
    sql.with_(
        sql.IDS,
        sql.RESOLVED,
        f"""urls AS (
  SELECT *, CASE namespace WHEN 'arxiv' THEN 'https://arxiv.org/pdf/' || normalized
    WHEN 'acl_anthology' THEN 'https://aclanthology.org/' || normalized[13:] || '.pdf'
    WHEN 'biorxiv' THEN 'https://www.biorxiv.org/content/' || normalized || 'v1.full.pdf' END AS pdf_url
  FROM resolved)""",
        body=f"""SELECT pos, raw, namespace, canonical_id, pdf_url,
  CASE WHEN pdf_url IS NULL THEN '{op.DOWNLOAD_ERROR}' END AS error,
  CASE WHEN pdf_url IS NULL THEN '{op.DOWNLOAD_HINT}' END AS suggestion FROM urls""",
    ),
)
def plan_downloads(spark, sf_dir):
    return op.plan_downloads(views.ids(spark, sf_dir))


# Two spellings of every order id, the later one in reverse order.
TWICE = """twice AS (
  SELECT pos, lower(raw) AS raw, canonical_id FROM resolved
  UNION ALL SELECT 2 * (SELECT count(*) FROM ids) - pos, raw, canonical_id FROM resolved)"""


@query(
    "first_seen",
    sql.with_(
        sql.IDS,
        sql.RESOLVED,
        TWICE,
        body="SELECT canonical_id, min(pos) AS pos FROM twice GROUP BY canonical_id",
    ),
)
def first_seen_ids(spark, sf_dir):
    ids = views.ids(spark, sf_dir)
    n = views.table(spark, sf_dir, "orders").agg(F.count(F.lit(1))).scalar()
    twice = ids.unionByName(ids.select((n * 2 - F.col("pos")).alias("pos"), "raw"))
    resolved = op.resolve_identifiers(twice).select("canonical_id", "pos")
    return first_seen(resolved, "canonical_id")


@query(
    "route_imports",
    """SELECT page_id, path, extension, route, CASE WHEN route IS NULL
  THEN 'Unsupported file extension. Expected .pdf or .md/.markdown.' END AS error
FROM (SELECT *, CASE WHEN extension = '.pdf' THEN 'pdf'
    WHEN extension IN ('.md', '.markdown') THEN 'markdown' END AS route
  FROM (SELECT page_id, path, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS extension
    FROM (SELECT page_id, '/in/' || page_id || CASE page_id % 5 WHEN 0 THEN '.PDF' WHEN 1 THEN '.md'
      WHEN 2 THEN '.Markdown' WHEN 3 THEN '.v1/paper' ELSE '.tar.gz' END AS path FROM pages)))""",
)
def route_imports(spark, sf_dir):
    k = F.col("page_id")
    ends = (".PDF", ".md", ".Markdown", ".v1/paper", ".tar.gz")
    ending = F.get(F.array(*(F.lit(e) for e in ends)), (k % 5).cast("int"))
    files = views.table(spark, sf_dir, "pages").select(
        "page_id", F.concat(F.lit("/in/"), k, ending).alias("path")
    )
    return op.route_imports(files)
