"""Provider-record and unified-metadata queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from litlake.operators import metadata as op, normalize as norm
from litlake.plans import sql, views
from litlake.plans.registry import query
from litlake.session import pin, scratch_path
from litlake.sources import dumps


#: Provider dumps are kept compressed, as providers publish them.
COMPRESSION = "gzip"


def preprints(spark, sf_dir):
    # Versions are compared on narrow rows; records are built for the newest only.
    latest = norm.latest_version(views.preprint_versions(spark, sf_dir), "pos", "date")
    return norm.normalize_biorxiv(views.preprint_records(latest).drop("pos"))


@query(
    "latest_version",
    sql.with_(sql.PREPRINTS, body="SELECT doi, title, version, date, pos FROM preprints"),
)
def latest_version(spark, sf_dir):
    return norm.latest_version(views.preprints_raw(spark, sf_dir), "pos", "date").select(
        "doi", "title", "version", "date", "pos"
    )


@query(
    "normalize_biorxiv",
    sql.with_(
        sql.PREPRINTS,
        body="""SELECT doi, title, authors, date, version, category, server, published_doi,
  'https://www.' || server || '.org/content/' || doi || 'v' || version || '.full.pdf' AS pdf_url, pos FROM versions""",
    ),
)
def normalize_biorxiv(spark, sf_dir):
    raw = views.preprints_raw(spark, sf_dir)
    # pos rides along in jatsxml, which normalisation passes through unchanged
    done = norm.normalize_biorxiv(raw.withColumn("jatsxml", F.col("pos").cast("string")))
    return done.select(
        "doi",
        "title",
        F.array_join(F.transform("authors", lambda a: a["name"]), "|").alias("authors"),
        "date",
        "version",
        "category",
        "server",
        "published_doi",
        "pdf_url",
        F.col("jatsxml").cast("long").alias("pos"),
    )


@query(
    "read_biorxiv_details",
    """SELECT '10.1101/2024.01.01.' || o_orderkey AS doi, 'Version ' || n || ' of ' || o_orderkey AS title,
  'Anna Last' || o_custkey || '|Solo' AS authors, CAST(n AS VARCHAR) AS version,
  CASE WHEN o_orderstatus = 'F' THEN 'medrxiv' ELSE 'biorxiv' END AS server,
  CASE WHEN o_orderstatus = 'O' THEN '10.1234/O' || o_orderkey END AS published_doi
FROM (SELECT *, 8 + o_custkey % 4 AS n FROM orders)""",
)
def read_biorxiv_details(spark, sf_dir):
    """Version lists written as provider answers (the newest twice), read back, newest kept."""
    out = scratch_path(spark, "biorxiv")
    k = F.col("o_orderkey")
    last = (F.col("o_custkey") % 4 + 8).cast("int")
    text = lambda *parts: F.concat(
        *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)
    )
    version = lambda v, i: F.struct(
        text("10.1101/2024.01.01.", k).alias("doi"),
        F.when(i > last, F.lit("Repeat")).otherwise(text("Version ", v, " of ", k)).alias("title"),
        text("Last", F.col("o_custkey"), ", Anna; Solo").alias("authors"),
        v.cast("string").alias("version"),
        F.when(F.col("o_orderstatus") == "F", "medRxiv").otherwise("bioRxiv").alias("server"),
        F.when(F.col("o_orderstatus") == "O", text("10.1234/O", k)).otherwise("NA").alias("published"),
    )
    numbers = F.concat(F.sequence(F.lit(0), last), F.array(last))
    views.table(spark, sf_dir, "orders").select(
        F.transform(numbers, version).alias("collection")
    ).write.json(out, compression=COMPRESSION)
    latest = norm.latest_version(dumps.read_biorxiv_details(spark, out), "pos").drop("pos")
    return norm.normalize_biorxiv(latest).select(
        "doi",
        "title",
        F.array_join(F.transform("authors", lambda a: a["name"]), "|").alias("authors"),
        "version",
        "server",
        "published_doi",
    )


FEED_SIZE = 1000  # entries per written feed file


def _escape(c):
    for plain, mark in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(plain), F.lit(mark))
    return c


def _element(tag: str, c):
    return F.when(
        c.isNotNull(), F.concat(F.lit(f"<{tag}>"), _escape(c), F.lit(f"</{tag}>"))
    ).otherwise("")


def _write_atom(papers, path: str) -> None:
    """Papers as Atom entries, one feed per file; titles hold line breaks, some entries are errors."""
    author = F.array_join(
        F.transform(
            "authors",
            lambda a: F.concat(
                F.lit("<author>"),
                _element("name", a["name"]),
                F.array_join(
                    F.transform(a["affiliations"], lambda x: _element("arxiv:affiliation", x)), ""
                ),
                F.lit("</author>"),
            ),
        ),
        "\n",
    )
    link = F.array_join(
        F.transform(
            "links",
            lambda k: F.concat(
                F.lit('<link href="'), k["href"], F.lit('" rel="'), k["rel"], F.lit('"'),
                F.when(k["title"].isNotNull(), F.concat(F.lit(' title="'), k["title"], F.lit('"'))).otherwise(""),
                F.lit("/>"),
            ),
        ),
        "\n",
    )
    category = F.array_join(
        F.transform("categories", lambda c: F.concat(F.lit('<category term="'), c, F.lit('"/>'))), ""
    )
    failed = F.col("doc_id") % 10 == 9
    entry = F.concat(
        F.lit("<entry>"),
        _element(
            "id",
            F.when(failed, F.concat(F.lit("http://arxiv.org/api/errors#"), "id")).otherwise(F.col("id")),
        ),
        _element("updated", F.col("updated")),
        _element("published", F.col("published")),
        _element("title", F.replace("title", F.lit(" "), F.lit("\n   "))),
        _element("summary", F.concat(F.lit("  "), F.col("summary"), F.lit("\n"))),
        author,
        _element("arxiv:comment", F.col("comment")),
        _element("arxiv:journal_ref", F.col("journal_ref")),
        _element("arxiv:doi", F.col("doi")),
        link,
        F.concat(F.lit('<arxiv:primary_category term="'), "primary_category", F.lit('"/>')),
        category,
        F.lit("</entry>"),
    )
    feed = F.concat(
        F.lit('<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom">\n'),
        F.array_join(F.collect_list("entry"), "\n"),
        F.lit("\n</feed>"),
    )
    (
        papers.select(F.floor(F.col("doc_id") / FEED_SIZE).alias("part"), entry.alias("entry"))
        .groupBy("part")
        .agg(feed.alias("value"))
        .select("value")
        .write.option("maxRecordsPerFile", 1)
        .text(path)
    )


ARXIV_FIELDS = """arxiv_id, title, summary, published, updated, array_to_string(names, '|') AS authors,
  CASE WHEN len(names) > 0 THEN 'Lab ' || source ELSE '' END AS affiliations,
  'cs.CL|lang.' || lang AS categories, 'cs.CL' AS primary_category,
  'http://arxiv.org/pdf/' || arxiv_id AS pdf_url, comment, journal_ref, doi"""


def _arxiv_flat(df):
    return df.select(
        op.arxiv_id_of(F.col("id")).alias("arxiv_id"),
        "title",
        "summary",
        "published",
        "updated",
        F.array_join(F.transform("authors", lambda a: a["name"]), "|").alias("authors"),
        F.array_join(F.flatten(F.transform("authors", lambda a: a["affiliations"])), "|").alias(
            "affiliations"
        ),
        F.array_join("categories", "|").alias("categories"),
        "primary_category",
        op._pdf_link(F.col("links")).alias("pdf_url"),
        "comment",
        "journal_ref",
        "doi",
    )


@query(
    "normalize_arxiv",
    sql.with_(sql.ARXIV, body=f"SELECT {ARXIV_FIELDS} FROM arxiv WHERE doc_id % 10 <> 9"),
)
def normalize_arxiv(spark, sf_dir):
    """Atom files written from documents, read with the XML source, normalised."""
    out = scratch_path(spark, "atom")
    _write_atom(views.arxiv_papers(spark, sf_dir), out)
    entries, _ = norm.split_arxiv_errors(dumps.read_arxiv_atom(spark, out))
    return _arxiv_flat(norm.normalize_arxiv(entries))


@query(
    "arxiv_error_entries",
    sql.with_(
        sql.ARXIV,
        body="""SELECT 'http://arxiv.org/api/errors#http://arxiv.org/abs/' || arxiv_id AS id FROM arxiv
WHERE doc_id % 10 = 9""",
    ),
)
def arxiv_error_entries(spark, sf_dir):
    out = scratch_path(spark, "atom")
    _write_atom(views.arxiv_papers(spark, sf_dir), out)
    _, errors = norm.split_arxiv_errors(dumps.read_arxiv_atom(spark, out))
    return errors.select("id")


@query(
    "read_openalex",
    sql.with_(
        sql.WORKS,
        body="""SELECT doi, title, publication_year, type, array_to_string(names, '|') AS names, venue, is_oa,
  abstract FROM works""",
    ),
)
def read_openalex(spark, sf_dir):
    """Works written as single records and as batch answers, read with one schema."""
    out = scratch_path(spark, "openalex")
    works = views.works(spark, sf_dir)
    whole = F.struct(*(c for c in works.columns if c != "k"))
    works.where("k % 2 = 0").drop("k").write.json(f"{out}/single")
    works.where("k % 2 = 1").select(F.array(whole).alias("results")).write.json(f"{out}/batch")
    read = dumps.read_openalex(spark, f"{out}/*", "works")
    return read.select(
        "doi",
        "title",
        "publication_year",
        "type",
        F.array_join(F.transform("authorships", lambda a: a["author"]["display_name"]), "|").alias(
            "names"
        ),
        F.col("primary_location.source.display_name").alias("venue"),
        F.col("open_access.is_oa").alias("is_oa"),
        F.coalesce(op.inverted_text(F.col("abstract_inverted_index")), F.lit("")).alias("abstract"),
    )


@query(
    "read_crossref",
    sql.with_(
        sql.WORKS,
        body="""SELECT '10.1234/O' || k AS doi, title, CASE WHEN len(names) >= 2 THEN names[2] END AS first_author,
  len(names) AS author_count, publication_year + CASE WHEN k % 2 = 0 THEN 0 ELSE 1 END AS year FROM works""",
    ),
)
def read_crossref(spark, sf_dir):
    out = scratch_path(spark, "crossref")
    works = views.crossref_works(spark, sf_dir)
    whole = F.struct(*works.columns)
    works.select(F.struct(*works.columns).alias("message")).where("message.DOI like '%0'").write.json(
        f"{out}/single"
    )
    works.where("DOI not like '%0'").select(
        F.struct(F.array(whole).alias("items")).alias("message")
    ).write.json(f"{out}/search")
    return op.triage_crossref(dumps.read_crossref(spark, f"{out}/*"))


@query(
    "read_opencitations",
    sql.with_(
        sql.EDGES,
        body="""SELECT 'references' AS direction, citing AS asked, cited AS doi, creation,
  journal_sc = 'yes' AS journal_self_citation, count(*) AS n FROM edges GROUP BY ALL
UNION ALL SELECT 'citations', cited, citing, creation, journal_sc = 'yes', count(*) FROM edges GROUP BY ALL""",
    ),
)
def read_opencitations(spark, sf_dir):
    out = scratch_path(spark, "opencitations")
    mark = lambda c: F.concat(F.lit("doi:"), F.col(c))
    views.edges(spark, sf_dir).select(
        F.concat_ws("-", "ord", "line", "part", "supp").alias("oci"),
        mark("citing").alias("citing"),
        mark("cited").alias("cited"),
        "creation",
        "journal_sc",
        "author_sc",
    ).write.json(out, compression=COMPRESSION)
    both = [
        norm.normalize_citations(dumps.read_opencitations(spark, out, d), "ids").withColumn(
            "direction", F.lit(d)
        )
        for d in ("references", "citations")
    ]
    return (
        both[0]
        .unionByName(both[1])
        .groupBy(
            "direction", "asked", F.col("ids")["doi"].alias("doi"), "creation", "journal_self_citation"
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "normalize_summaries",
    sql.with_(
        sql.SUMMARIES,
        body="SELECT title, description, extract, url, type, pageid FROM summaries",
    ),
)
def normalize_summaries(spark, sf_dir):
    out = scratch_path(spark, "summaries")
    views.summaries_raw(spark, sf_dir).write.json(out)
    return norm.normalize_summaries(dumps.read_wikipedia(spark, out))


@query(
    "read_wikipedia_search",
    """SELECT 'q' || s_suppkey AS query, p.pos, s_name || ' ' || p.pos AS title, 'https://w/' || s_suppkey || '/' || p.pos AS url
FROM supplier, (VALUES (0), (1)) p(pos) WHERE s_suppkey % 4 <> 3""",
)
def read_wikipedia_search(spark, sf_dir):
    """Search answers with two titles and three addresses; some are cut short."""
    out = scratch_path(spark, "opensearch")
    k = F.col("s_suppkey")
    title = lambda i: F.concat(F.lit('"'), F.col("s_name"), F.lit(f' {i}"'))
    url = lambda i: F.concat(F.lit('"https://w/'), k, F.lit(f'/{i}"'))
    full = F.concat(
        F.lit('["q'), k, F.lit('",['), title(0), F.lit(","), title(1), F.lit('],["",""],['),
        url(0), F.lit(","), url(1), F.lit(","), url(2), F.lit("]]"),
    )
    cut = F.concat(F.lit('["q'), k, F.lit('",["x"]]'))
    views.table(spark, sf_dir, "supplier").select(
        F.when(k % 4 == 3, cut).otherwise(full).alias("value")
    ).write.text(out)
    return dumps.read_wikipedia_search(spark, out)


@query(
    "page_status",
    sql.with_(
        sql.SUMMARIES,
        body="""SELECT l_orderkey * 1000000000 + l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey AS request_id,
  coalesce(s.title, asked) AS title, s.title IS NOT NULL AS exists,
  coalesce(s.type = 'disambiguation', false) AS is_disambiguation, s.url, s.description
FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN 'Missing ' || l_partkey
    ELSE '  ' || upper(p_name) || ' ' || l_partkey || ' ' END AS asked
  FROM lineitem JOIN part ON l_partkey = p_partkey)
LEFT JOIN summaries s ON replace(lower(s.title), ' ', '_') = replace(lower(trim(asked)), ' ', '_')""",
    ),
)
def page_status(spark, sf_dir):
    part = views.table(spark, sf_dir, "part")
    asked = (
        views.table(spark, sf_dir, "lineitem")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.expr(
                "l_orderkey * 1000000000 + l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey"
            ).alias("request_id"),
            F.when(F.col("l_returnflag") == "R", F.concat(F.lit("Missing "), "l_partkey"))
            .otherwise(F.concat(F.lit("  "), F.upper("p_name"), F.lit(" "), "l_partkey", F.lit(" ")))
            .alias("title"),
        )
    )
    return op.page_status(asked, norm.normalize_summaries(views.summaries_raw(spark, sf_dir)))


@query(
    "unified_metadata",
    sql.with_(
        sql.WORKS,
        sql.ARXIV,
        sql.PREPRINTS,
        body="""SELECT 'openalex' AS _source, canonical_id AS _canonical_id, title, doi, publication_year, venue, is_oa, oa_url,
  NULL AS published, NULL AS version, NULL AS pdf_url, NULL AS published_doi FROM works
UNION ALL SELECT 'arxiv', canonical_id, title, doi, NULL, NULL, NULL, NULL, published, NULL,
  'http://arxiv.org/pdf/' || arxiv_id, NULL FROM arxiv
UNION ALL SELECT 'biorxiv', lower(doi), title, doi, NULL, NULL, NULL, NULL, NULL, version, pdf_url, published_doi
FROM preprints""",
    ),
)
def unified_metadata(spark, sf_dir):
    return _papers(spark, sf_dir).select(
        "_source", "_canonical_id", "title", "doi", "publication_year", "venue", "is_oa", "oa_url",
        "published", "version", "pdf_url", "published_doi",
    )


def _papers(spark, sf_dir):
    return op.all_metadata(
        views.arxiv_papers(spark, sf_dir), preprints(spark, sf_dir), views.works(spark, sf_dir)
    )


@query(
    "abstracts",
    sql.with_(
        sql.WORKS,
        sql.ARXIV,
        sql.PREPRINTS,
        body="""SELECT 'openalex' AS _source, canonical_id AS _canonical_id, title, nullif(abstract, '') AS abstract FROM works
UNION ALL SELECT 'arxiv', canonical_id, title, nullif(summary, '') FROM arxiv
UNION ALL SELECT 'biorxiv', lower(doi), title, abstract FROM preprints""",
    ),
)
def abstracts(spark, sf_dir):
    return (
        op.abstracts(views.works(spark, sf_dir), "openalex")
        .unionByName(op.abstracts(views.arxiv_papers(spark, sf_dir), "arxiv"))
        .unionByName(op.abstracts(preprints(spark, sf_dir), "biorxiv"))
    )


@query(
    "author_profiles",
    """SELECT c_name AS name, 'https://openalex.org/A' || c_custkey AS openalex_id, c_custkey % 100 AS works_count,
  c_custkey % 7 AS h_index, n_name AS current_institutions,
  array_to_string([c_mktsegment || ' ' || i FOR i IN range(least(c_custkey % 8, 5))], '|') AS top_topics,
  n_name || ':2001,2003,' || (2004 + c_custkey % 3) AS affiliations
FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def author_profiles(spark, sf_dir):
    k = F.col("c_custkey")
    named = lambda c: F.struct(c.alias("display_name"))
    many = F.sequence(F.lit(0), (k % 8).cast("int"))
    raw = (
        views.table(spark, sf_dir, "customer")
        .join(views.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("c_name").alias("display_name"),
            F.concat(F.lit("https://openalex.org/A"), k).alias("id"),
            F.lit(None).cast("string").alias("orcid"),
            (k % 100).cast("int").alias("works_count"),
            k.alias("cited_by_count"),
            F.struct((k % 7).alias("h_index"), (k % 9).alias("i10_index")).alias("summary_stats"),
            F.array(named(F.lit("")), named(F.col("n_name")), named(F.lit(None).cast("string"))).alias(
                "last_known_institutions"
            ),
            F.transform(
                F.slice(many, F.lit(1), (k % 8).cast("int")),
                lambda i: F.struct(
                    F.concat_ws(" ", "c_mktsegment", i).alias("display_name"), i.alias("count")
                ),
            ).alias("topics"),
            F.array(
                F.struct(
                    F.struct(F.col("n_name").alias("display_name"), F.lit("XX").alias("country_code")).alias(
                        "institution"
                    ),
                    F.array((k % 3 + 2004).cast("int"), F.lit(2001), F.lit(2003)).alias("years"),
                )
            ).alias("affiliations"),
        )
    )
    out = scratch_path(spark, "authors")
    raw.write.json(out)
    return op.author_profiles(dumps.read_openalex(spark, out, "authors")).select(
        "name",
        "openalex_id",
        "works_count",
        "h_index",
        F.array_join("current_institutions", "|").alias("current_institutions"),
        F.array_join(F.transform("top_topics", lambda t: t["name"]), "|").alias("top_topics"),
        F.array_join(
            F.transform(
                "affiliations",
                lambda a: F.concat(
                    a["institution"],
                    F.lit(":"),
                    F.array_join(F.transform(a["years"], lambda y: y.cast("string")), ","),
                ),
            ),
            "|",
        ).alias("affiliations"),
    )


@query(
    "triage_arxiv",
    sql.with_(
        sql.ARXIV,
        body="""SELECT arxiv_id, title, names[1] AS first_author, len(names) AS author_count,
  CAST(published[1:4] AS INTEGER) AS published_year FROM arxiv""",
    ),
)
def triage_arxiv(spark, sf_dir):
    return op.triage_arxiv(views.arxiv_papers(spark, sf_dir))


@query(
    "triage_crossref",
    sql.with_(
        sql.WORKS,
        body="""SELECT '10.1234/O' || k AS doi, title, CASE WHEN len(names) >= 2 THEN names[2] END AS first_author,
  len(names) AS author_count, publication_year + CASE WHEN k % 2 = 0 THEN 0 ELSE 1 END AS year FROM works""",
    ),
)
def triage_crossref(spark, sf_dir):
    return op.triage_crossref(views.crossref_works(spark, sf_dir))


@query(
    "follow_published",
    sql.with_(
        sql.PREPRINTS,
        sql.WORKS,
        body="""SELECT CASE WHEN w.k IS NULL THEN 'biorxiv' ELSE 'openalex_via_biorxiv' END AS _source,
  coalesce(w.canonical_id, lower(p.doi)) AS _canonical_id, CASE WHEN w.k IS NOT NULL THEN p.doi END AS preprint_doi,
  coalesce(w.doi, p.doi) AS doi, coalesce(w.title, p.title) AS title, w.publication_year, w.venue,
  CASE WHEN w.k IS NULL THEN p.version END AS version, CASE WHEN w.k IS NULL THEN p.published_doi END AS published_doi
FROM preprints p LEFT JOIN works w ON lower(p.published_doi) = w.canonical_id""",
    ),
)
def follow_published(spark, sf_dir):
    latest = pin(preprints(spark, sf_dir), "preprints")
    return op.follow_published(latest, views.works(spark, sf_dir)).select(
        "_source", "_canonical_id", "preprint_doi", "doi", "title", "publication_year", "venue",
        "version", "published_doi",
    )


BATCH_METADATA = sql.with_(
    sql.IDS,
    sql.RESOLVED,
    sql.WORKS,
    sql.ARXIV,
    sql.PREPRINTS,
    """papers AS (
  SELECT 'openalex' AS src, canonical_id, title, CAST(publication_year AS VARCHAR) AS dated FROM works
  UNION ALL SELECT 'arxiv', canonical_id, title, published FROM arxiv
  UNION ALL SELECT 'biorxiv', lower(doi), title, date FROM preprints)""",
    body="""SELECT pos, raw AS _input, p.src AS _source, p.canonical_id AS _canonical_id, p.title, p.dated,
  CASE WHEN p.src IS NOT NULL THEN NULL WHEN r.source IS NULL THEN 'Identifier is neither an arXiv id nor a DOI.'
    ELSE 'No paper found for: ' || raw END AS error,
  CASE WHEN p.src IS NOT NULL THEN NULL WHEN r.source IS NULL THEN 'Use an arXiv id (2301.00001) or a DOI (10.xxxx/...).'
    ELSE CASE r.source
    WHEN 'arxiv' THEN 'Check the arXiv ID format (e.g. 2301.00001) or search by title.'
    WHEN 'biorxiv' THEN 'Check the DOI format (10.1101/...) or search by title.'
    WHEN 'openalex' THEN 'Check the DOI format or search by title to find the correct DOI.' END END AS suggestion
FROM resolved r LEFT JOIN papers p ON r.source = p.src AND r.canonical_id = p.canonical_id""",
)


@query("batch_metadata", BATCH_METADATA)
def batch_metadata(spark, sf_dir):
    return _answers(op.batch_metadata(views.ids(spark, sf_dir), _papers(spark, sf_dir)))


@query("stored_metadata", BATCH_METADATA)
def stored_metadata(spark, sf_dir):
    """The same answers from a bucketed table of papers, which the join doesn't shuffle."""
    stored = op.store_papers(_papers(spark, sf_dir), scratch_path(spark, "papers"))
    return _answers(op.batch_metadata(views.ids(spark, sf_dir), stored))


def _answers(rows):
    dated = F.coalesce(F.col("publication_year").cast("string"), "published", "date")
    return rows.select(
        "pos", "_input", "_source", "_canonical_id", "title", dated.alias("dated"), "error", "suggestion"
    )


INSTITUTIONS = """page_names AS (
  SELECT *, CASE WHEN len(names) = 0 THEN '' WHEN len(names) = 1 THEN n_name
    ELSE n_name || '|' || c_mktsegment END AS institutions,
    CASE WHEN len(names) = 0 THEN 0 WHEN len(names) = 1 THEN 1 ELSE 2 END AS n_institutions FROM works)"""


@query(
    "authors_page",
    sql.with_(
        sql.WORKS,
        INSTITUTIONS,
        body="""SELECT 'openalex' AS _source, canonical_id AS _canonical_id, len(names) AS author_count, 1 AS page,
  2 AS page_size, len(names) > 2 AS has_more, array_to_string(names[1:2], '|') AS authors,
  institutions AS page_institutions, n_institutions AS page_institution_count FROM page_names""",
    ),
)
def authors_page(spark, sf_dir):
    return _names_joined(op.authors_page(views.works(spark, sf_dir), 1, 2)).withColumn(
        "page_institutions", F.array_join("page_institutions", "|")
    )


def _names_joined(df):
    return df.withColumn(
        "authors", F.array_join(F.transform("authors", lambda a: a["name"]), "|")
    )


@query(
    "preprint_authors_page",
    sql.with_(
        sql.PREPRINTS,
        sql.ARXIV,
        body="""SELECT 'biorxiv' AS _source, lower(doi) AS _canonical_id, 4 AS author_count, 2 AS page, 2 AS page_size,
  false AS has_more, '|Solo' AS authors, first_author AS author_corresponding FROM preprints
UNION ALL SELECT 'arxiv', canonical_id, len(names), 2, 2, false, array_to_string(names[3:4], '|'), NULL FROM arxiv""",
    ),
)
def preprint_authors_page(spark, sf_dir):
    drop = ("author_corresponding_institution", "page_institutions", "page_institution_count")
    bio = op.plain_authors_page(preprints(spark, sf_dir), "biorxiv", 2, 2)
    arx = op.plain_authors_page(views.arxiv_papers(spark, sf_dir), "arxiv", 2, 2)
    return _names_joined(bio).unionByName(_names_joined(arx), allowMissingColumns=True).drop(*drop)


@query(
    "institution_rollup",
    sql.with_(
        sql.WORKS,
        INSTITUTIONS,
        body="SELECT canonical_id, institutions, n_institutions FROM page_names",
    ),
)
def institution_rollup(spark, sf_dir):
    names = op.institution_names(F.col("authorships"))
    return views.works(spark, sf_dir).select(
        F.lower(F.regexp_replace("doi", "https://doi.org/", "")).alias("canonical_id"),
        F.array_join(names, "|").alias("institutions"),
        F.size(names).alias("n_institutions"),
    )
