"""Bibliography queries over works, arXiv papers and preprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from litlake.functions.names import KEY_SKIP, PARTICLES
from litlake.operators import bibliography as op
from litlake.plans import sql, views
from litlake.plans.metadata_queries import preprints
from litlake.plans.registry import query
from litlake.session import scratch_path

_PARTICLES = ", ".join(f"'{p}'" for p in PARTICLES)
_SKIP = ", ".join(f"'{w}'" for w in KEY_SKIP)


def _last_start(name: str) -> str:
    """Index of the first surname word: only particles lie between it and the last word."""
    w = sql.words(name)
    between = f"list_filter({w}[i:len({w}) - 1], lambda x: NOT list_contains([{_PARTICLES}], lower(x)))"
    return (
        f"coalesce(list_min(list_filter(range(1, len({w})), lambda i: len({between}) = 0)), len({w}))"
    )


def _inverted(name: str) -> str:
    w, at = sql.words(name), _last_start(name)
    return (
        f"array_to_string({w}[{at}:], ' ') || "
        f"CASE WHEN {at} > 1 THEN ', ' || array_to_string({w}[1:{at} - 1], ' ') ELSE '' END"
    )


def _key(name: str, year: str, title: str) -> str:
    w = sql.words(name)
    return (
        f"CASE WHEN {name} IS NULL THEN 'unknown' ELSE "
        f"lower(strip_accents(array_to_string({w}[{_last_start(name)}:], ''))) END || {year} || "
        f"coalesce(lower(list_filter(regexp_extract_all({title}, '[a-zA-Z]+'), "
        f"lambda x: NOT list_contains([{_SKIP}], lower(x)))[1]), 'untitled')"
    )


def _esc(c: str) -> str:
    return f"regexp_replace({c}, '([&%_#])', '\\\\\\1', 'g')"


def _authors(names: str) -> str:
    return (
        f"CASE WHEN len({names}) > 0 THEN '  author={{' || "
        f"array_to_string(list_transform({names}, lambda n: {_inverted('n')}), ' and ') || '}}' END"
    )


def _entry(kind: str, key: str, *fields: str) -> str:
    return f"'@' || {kind} || '{{' || {key} || ',' || chr(10) || concat_ws(',' || chr(10), {', '.join(fields)}) || chr(10) || '}}'"


def _f(name: str, value: str, keep: str = "true") -> str:
    return f"CASE WHEN {keep} AND {value} <> '' THEN '  {name}={{' || {value} || '}}' END"


_KIND = (
    "CASE type "
    + " ".join(f"WHEN '{t}' THEN '{k}'" for t, k in op.ENTRY_TYPES.items())
    + " ELSE 'misc' END"
)
_BARE = "'10.1234/O' || k"
_OPENALEX = _entry(
    "kind",
    _key("names[1]", "publication_year", "title"),
    f"'  title={{' || {_esc('title')} || '}}'",
    _authors("names"),
    *(_f(field, "venue", f"kind = '{kind}'") for kind, field in op.VENUE_FIELDS.items()),
    _f("school", _esc("n_name"), "kind = 'phdthesis' AND len(names) > 0"),
    _f("volume", "CAST(k % 50 AS VARCHAR)"),
    _f("number", "CAST(k % 12 AS VARCHAR)"),
    _f("pages", "k || '--' || (k + 9)"),
    _f("year", "CAST(publication_year AS VARCHAR)"),
    _f("publisher", _esc("n_name")),
    _f("doi", _BARE),
    _f("howpublished", r"'\url{' || doi || '}'", "type IN ('preprint', 'posted-content')"),
)
_ARXIV = _entry(
    "CASE WHEN journal_ref IS NULL THEN 'misc' ELSE 'article' END",
    _key("names[1]", "published[1:4]", "title"),
    f"'  title={{' || {_esc('title')} || '}}'",
    _authors("names"),
    _f("journal", _esc("journal_ref")),
    _f("year", "published[1:4]"),
    _f("eprint", "canonical_id"),
    "'  archiveprefix={arXiv}'",
    _f("primaryclass", "'cs.CL'"),
    _f("doi", "doi"),
)
_BIORXIV = _entry(
    "CASE WHEN published_doi IS NULL THEN 'misc' ELSE 'article' END",
    "lower(replace(first_author, 'Anna van Berg', 'vanBerg')) || date[1:4] || 'preprint'",
    f"'  title={{' || {_esc('title')} || '}}'",
    "'  author={' || replace(first_author, 'Anna van Berg', 'van Berg') || ', Anna and ' || second_author || ' and Solo}'",
    _f("doi", "published_doi"),
    _f("year", "date[1:4]"),
    _f("publisher", "CASE server WHEN 'medrxiv' THEN 'medRxiv' ELSE 'bioRxiv' END", "published_doi IS NULL"),
    _f("doi", "doi", "published_doi IS NULL"),
    _f("howpublished", r"'\url{https://doi.org/' || doi || '}'", "published_doi IS NULL"),
)

_WORK_KIND = f"kinds AS (SELECT *, {_KIND} AS kind FROM works)"
_OPENALEX_SELECT = f"SELECT 'openalex' AS _source, canonical_id AS _canonical_id, {_OPENALEX} AS bibtex FROM kinds"
_ARXIV_SELECT = f"SELECT 'arxiv' AS _source, canonical_id AS _canonical_id, {_ARXIV} AS bibtex FROM arxiv"
_BIORXIV_SELECT = f"SELECT 'biorxiv' AS _source, lower(doi) AS _canonical_id, {_BIORXIV} AS bibtex FROM preprints"


@query("bibtex_openalex", sql.with_(sql.WORKS, _WORK_KIND, body=_OPENALEX_SELECT))
def bibtex_openalex(spark, sf_dir):
    return op.bibtex_openalex(views.works(spark, sf_dir))


@query("bibtex_arxiv", sql.with_(sql.ARXIV, body=_ARXIV_SELECT))
def bibtex_arxiv(spark, sf_dir):
    return op.bibtex_arxiv(views.arxiv_papers(spark, sf_dir))


@query("bibtex_biorxiv", sql.with_(sql.PREPRINTS, body=_BIORXIV_SELECT))
def bibtex_biorxiv(spark, sf_dir):
    return op.bibtex_biorxiv(preprints(spark, sf_dir))


@query(
    "export_bibliography",
    sql.with_(
        sql.WORKS,
        _WORK_KIND,
        sql.ARXIV,
        sql.PREPRINTS,
        body=f"""SELECT line, count(*) AS n FROM (
  SELECT unnest(string_split(bibtex, chr(10))) AS line
  FROM ({_OPENALEX_SELECT} UNION ALL {_ARXIV_SELECT} UNION ALL {_BIORXIV_SELECT}))
GROUP BY line""",
    ),
)
def export_bibliography(spark, sf_dir):
    """Entries of all providers written as text and read back line by line."""
    out = scratch_path(spark, "bib")
    entries = op.all_entries(
        views.arxiv_papers(spark, sf_dir), preprints(spark, sf_dir), views.works(spark, sf_dir)
    )
    op.export_bibliography(entries, out)
    lines = spark.read.text(out).where("value <> ''")
    return lines.groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))
