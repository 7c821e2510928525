"""Section, search-in-document and document queries over the derived corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from litlake.operators import find, sections as op
from litlake.operators.normalize import clean_converted_markdown
from litlake.plans import sql, views
from litlake.plans.registry import query
from litlake.session import scratch_path

DOC = ["namespace", "canonical_id"]


def _with_sections(*more: str, body: str) -> str:
    return sql.with_(sql.CORPUS, sql.SECTIONS, *more, body=body)


@query("parse_sections", _with_sections(body="SELECT * FROM sections"))
def parse_sections(spark, sf_dir):
    return op.parse_sections(views.corpus(spark, sf_dir)).withColumn(
        "h3s", F.array_join("h3s", "|")
    )


@query(
    "section_content",
    _with_sections(
        body="""SELECT namespace, canonical_id, index, title, content, length(content) AS total_chars,
  greatest(1, length(content) // 4) AS approx_tokens FROM sections"""
    ),
)
def section_content(spark, sf_dir):
    return op.section_content(op.parse_sections(views.corpus(spark, sf_dir)))


@query(
    "section_totals",
    _with_sections(
        body="""SELECT namespace, canonical_id, count(*) AS total_sections,
  CAST(sum(approx_tokens) AS BIGINT) AS total_approx_tokens FROM sections GROUP BY namespace, canonical_id"""
    ),
)
def section_totals(spark, sf_dir):
    return op.section_totals(op.parse_sections(views.corpus(spark, sf_dir)))


@query(
    "slice_section",
    _with_sections(
        body="""SELECT namespace, canonical_id, index, title, approx_tokens,
  CASE WHEN ok THEN content[101:400] END AS content, CASE WHEN ok THEN 100 END AS offset,
  CASE WHEN ok THEN least(400, n) - 100 END AS chars_returned, CASE WHEN ok THEN n END AS total_chars,
  CASE WHEN ok THEN n > 400 END AS has_more, CASE WHEN n > 400 THEN 400 END AS next_offset,
  CASE WHEN NOT ok THEN 'offset 100 is beyond section length ' || n END AS error
FROM (SELECT *, length(content) AS n, length(content) >= 100 AS ok FROM sections)"""
    ),
)
def slice_section(spark, sf_dir):
    return op.slice_sections(op.parse_sections(views.corpus(spark, sf_dir)), 100, 300)


@query(
    "chunk_sections",
    _with_sections(
        body="""SELECT namespace, canonical_id, index, title, chunk, chunk * 500 AS offset,
  content[chunk * 500 + 1 : chunk * 500 + 500] AS text, chunk * 500 + 500 < length(content) AS has_more
FROM (SELECT *, unnest(range(0, (length(content) + 499) // 500)) AS chunk FROM sections)"""
    ),
)
def chunk_sections(spark, sf_dir):
    return op.chunk_sections(op.parse_sections(views.corpus(spark, sf_dir)), 500)


# Requests: per document an index (sometimes out of range), a title part that is
# often ambiguous, and a title that exists in longer documents only.
SECTION_REQUESTS = """asked AS (
  SELECT namespace, canonical_id, doc_id * 3 + n AS request_id,
    CASE n WHEN 0 THEN CAST(doc_id % 4 AS VARCHAR) WHEN 1 THEN 'SEC' ELSE 'sec 2' END AS section
  FROM corpus, (VALUES (0), (1), (2)) v(n)),
listed AS (
  SELECT namespace, canonical_id, count(*) AS n, string_agg(title, ', ' ORDER BY index) AS titles
  FROM sections GROUP BY namespace, canonical_id),
matched AS (
  SELECT a.request_id, count(s.index) AS hits, string_agg(s.title, ', ' ORDER BY s.index) AS hit_titles,
    min(s.index) AS hit
  FROM asked a LEFT JOIN sections s ON a.namespace = s.namespace AND a.canonical_id = s.canonical_id
    AND a.request_id % 3 <> 0 AND contains(lower(s.title), lower(a.section))
  GROUP BY a.request_id),
chosen AS (
  SELECT a.*, l.n, l.titles, m.hits, m.hit_titles,
    CASE WHEN a.request_id % 3 = 0 THEN CAST(a.section AS BIGINT) WHEN m.hits = 1 THEN m.hit END AS want
  FROM asked a JOIN matched m USING (request_id) LEFT JOIN listed l USING (namespace, canonical_id))"""


@query(
    "select_sections",
    _with_sections(
        SECTION_REQUESTS.replace(
            "CASE WHEN a.request_id % 3 = 0 THEN CAST(a.section AS BIGINT)",
            "CASE WHEN a.request_id % 3 = 0 THEN TRY_CAST(a.section AS BIGINT)",
        ),
        body="""SELECT c.request_id, c.namespace, c.canonical_id, c.section, s.index, s.title,
  s.content[1:400] AS content, length(s.content) AS total_chars,
  CASE WHEN c.request_id % 3 = 0 AND s.index IS NULL
      THEN 'Section index ' || section || ' out of range (0-' || (coalesce(n, 0) - 1) || ')'
    WHEN s.index IS NULL AND hits > 1 THEN 'Ambiguous section title. Matches: ' || hit_titles
    WHEN s.index IS NULL THEN 'No section matching. Available: ' || coalesce(titles, '') END AS error
FROM chosen c LEFT JOIN sections s
  ON c.namespace = s.namespace AND c.canonical_id = s.canonical_id AND c.want = s.index""",
    ),
)
def select_sections(spark, sf_dir):
    corpus = views.corpus(spark, sf_dir)
    n = F.col("n")
    asked = corpus.select(
        *DOC, "doc_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("n")
    ).select(
        *DOC,
        (F.col("doc_id") * 3 + n).alias("request_id"),
        F.when(n == 0, (F.col("doc_id") % 4).cast("string"))
        .when(n == 1, "SEC")
        .otherwise("sec 2")
        .alias("section"),
    )
    return op.select_sections(asked, corpus, 0, 400).select(
        "request_id", *DOC, "section", "index", "title", "content", "total_chars", "error"
    )


@query(
    "titles",
    sql.with_(
        sql.CORPUS,
        body=f"SELECT namespace, canonical_id, {sql.first_title('markdown')} AS title FROM corpus",
    ),
)
def titles(spark, sf_dir):
    return op.titles(views.corpus(spark, sf_dir))


OFFSETS = """offsets AS (
  SELECT namespace, canonical_id, unnest([0, length(markdown) // 3, length(markdown) - 1]) AS offset FROM corpus)"""


@query(
    "section_at_offset",
    _with_sections(
        sql.HEADS,
        OFFSETS,
        body=f"""SELECT o.namespace, o.canonical_id, o.offset,
  {sql.strip("regexp_replace(max_by(line, start_at), '^#+', '')")} AS section
FROM offsets o LEFT JOIN heads h ON o.namespace = h.namespace AND o.canonical_id = h.canonical_id AND start_at <= o.offset
GROUP BY o.namespace, o.canonical_id, o.offset""",
    ),
)
def section_at_offset(spark, sf_dir):
    corpus = views.corpus(spark, sf_dir)
    size = F.length("markdown")
    offsets = corpus.select(
        *DOC,
        F.explode(
            F.array_distinct(F.array(F.lit(0), F.floor(size / 3).cast("int"), size - 1))
        ).alias("offset"),
    )
    return op.section_at_offset(corpus, offsets)


@query(
    "document_stats",
    sql.with_(
        sql.CORPUS,
        body="""SELECT namespace, canonical_id, length(markdown) AS char_count, sha256(markdown) AS md_sha256
FROM corpus""",
    ),
)
def document_stats(spark, sf_dir):
    return op.document_stats(views.corpus(spark, sf_dir))


@query(
    "clean_markdown",
    sql.with_(
        sql.CORPUS,
        r"""messy AS (SELECT namespace, canonical_id,
  '![Figure ' || doc_id || '](img/' || doc_id || '.png) ![](x.jpg)' || chr(10) ||
  replace(markdown, chr(10), '  ' || chr(9) || chr(10)) AS m FROM corpus)""",
        body=rf"""SELECT namespace, canonical_id, regexp_replace(
  array_to_string(list_transform(string_split(m, chr(10)), lambda l: regexp_replace(l, '{sql.WS}+$', '')), chr(10)),
  '!\[([^\]]*)\]\([^)]*\)', '![\1]()', 'g') AS markdown FROM messy""",
    ),
)
def clean_markdown(spark, sf_dir):
    d = F.col("doc_id").cast("string")
    messy = views.corpus(spark, sf_dir).select(
        *DOC,
        F.concat(
            F.lit("![Figure "), d, F.lit("](img/"), d, F.lit(".png) ![](x.jpg)\n"),
            F.replace("markdown", F.lit("\n"), F.lit("  \t\n")),
        ).alias("markdown"),
    )
    return clean_converted_markdown(messy)


def _find_sql(pieces: str, keep: str, limit: int) -> str:
    """Hits from the lengths of the text pieces around a literal."""
    return _with_sections(
        f"""cut AS (
  SELECT namespace, canonical_id, index, title, content, unnest(p) AS piece,
    generate_subscripts(p, 1) AS i, len(p) AS n
  FROM (SELECT *, {pieces} AS p FROM sections)),
placed AS (
  SELECT *, sum(length(piece) + 4) OVER (PARTITION BY namespace, canonical_id, index ORDER BY i) - 4 AS char_offset
  FROM cut),
found AS (
  SELECT *, row_number() OVER (PARTITION BY namespace, canonical_id ORDER BY index, i) - 1 AS hit
  FROM placed WHERE i < n AND {keep})""",
        body=f"""SELECT namespace, canonical_id, hit, index AS section_index, title AS section,
  CAST(char_offset AS BIGINT) AS char_offset,
  content[char_offset + 1 : char_offset + 4] AS match,
  {sql.strip("replace(content[greatest(char_offset - 60, 0) + 1 : char_offset + 64], chr(10), ' ')")} AS snippet
FROM found WHERE hit < {limit}""",
    )


@query("find_in_documents", _find_sql("string_split(lower(content), 'tion')", "true", 20))
def find_in_documents(spark, sf_dir):
    return find.find_in_documents(views.corpus(spark, sf_dir), "TION", 20)


@query(
    "find_whole_words",
    _find_sql(
        "string_split(content, 'that')",
        r"""NOT regexp_matches(substr(content, CAST(char_offset AS BIGINT), 1), '[\pL\pN_]')
      AND NOT regexp_matches(substr(content, CAST(char_offset + 5 AS BIGINT), 1), '[\pL\pN_]')""",
        100,
    ),
)
def find_whole_words(spark, sf_dir):
    return find.find_in_documents(
        views.corpus(spark, sf_dir), "that", 100, case_sensitive=True, whole_words=True
    )


_CHANGED_CORPUS = """was AS (SELECT * FROM corpus WHERE doc_id % 10 <> 9),
now AS (
  SELECT namespace, canonical_id, doc_id,
    CASE WHEN doc_id % 7 = 0 THEN markdown || chr(10) || '## Added' || chr(10) || 'new words' ELSE markdown END AS markdown
  FROM corpus WHERE doc_id % 11 <> 0)"""


@query(
    "changed_documents",
    sql.with_(
        sql.CORPUS,
        _CHANGED_CORPUS,
        sql.SECTIONS.replace("FROM corpus)", "FROM now)"),
        body="""SELECT coalesce(n.namespace, w.namespace) AS namespace, coalesce(n.canonical_id, w.canonical_id) AS canonical_id,
  CASE WHEN w.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change,
  (SELECT count(*) FROM sections s WHERE s.namespace = n.namespace AND s.canonical_id = n.canonical_id) AS n_sections
FROM now n FULL JOIN was w ON n.doc_id = w.doc_id
WHERE w.doc_id IS NULL OR n.doc_id IS NULL OR n.markdown <> w.markdown""",
    ),
)
def changed_documents(spark, sf_dir):
    """A corpus that was derived from once, then lost, gained and changed documents."""
    from litlake.operators import changes
    from litlake.sources.corpus import write_clustered

    root = scratch_path(spark, "derived")
    whole = views.corpus(spark, sf_dir)
    d = F.col("doc_id")
    longer = F.when(d % 7 == 0, F.concat("markdown", F.lit("\n## Added\nnew words"))).otherwise(
        F.col("markdown")
    )
    states = [whole.where(d % 10 != 9), whole.where(d % 11 != 0).withColumn("markdown", longer)]
    for i, state in enumerate(states):
        write_clustered(state, f"{root}/corpus-{i}")
        found = changes.apply_changes(spark, root, spark.read.parquet(f"{root}/corpus-{i}"))
    stored = changes.current_sections(spark, root)
    counted = stored.select("namespace", "canonical_id", F.size("sections").alias("n_sections"))
    return found.join(counted, ["namespace", "canonical_id"], "left").select(
        "namespace", "canonical_id", "change", F.coalesce("n_sections", F.lit(0)).cast("long").alias("n_sections")
    )
