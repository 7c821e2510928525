"""Search queries over the derived corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from litlake.operators import index, search
from litlake.plans import sql, views
from litlake.plans.registry import query
from litlake.session import pin, scratch_path

QUERY = "ering queque license"
DOC = ["namespace", "canonical_id"]


def _stem(c: str = "canonical_id") -> str:
    return f"replace({c}, '/', '_')"


def _ranked(where: str = "true", k: int = 10) -> str:
    corpus = sql.CORPUS + (
        f",\nsub AS (SELECT * FROM corpus WHERE {where})"
    )
    return sql.with_(
        corpus,
        sql.POSTINGS.replace("FROM corpus", "FROM sub"),
        body=f"""SELECT namespace, canonical_id, round(score, 6) AS score FROM (
  SELECT namespace, canonical_id, sum({sql.SCORE}) AS score
  FROM postings JOIN dfs USING (term), size WHERE term IN ('ering', 'queque', 'license')
  GROUP BY namespace, canonical_id)
ORDER BY score DESC, namespace, {_stem()} LIMIT {k}""",
    )


def _index(spark, sf_dir):
    """Postings written once; statistics and scores both read the table."""
    return pin(search.term_index(views.corpus(spark, sf_dir)), "postings")


@query(
    "tokenize",
    sql.with_(
        sql.CORPUS,
        body=f"""SELECT namespace, canonical_id, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens
FROM (SELECT *, {sql.tokens('markdown')} AS t FROM corpus)""",
    ),
)
def tokenize(spark, sf_dir):
    return search.tokenize(views.corpus(spark, sf_dir)).select(
        *DOC, F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens")
    )


@query(
    "term_index",
    sql.with_(sql.CORPUS, sql.POSTINGS, body="SELECT namespace, canonical_id, term, tf, doc_len FROM postings"),
)
def term_index(spark, sf_dir):
    return search.term_index(views.corpus(spark, sf_dir)).drop("ord")


@query(
    "corpus_stats",
    sql.with_(
        sql.CORPUS,
        sql.POSTINGS,
        body="SELECT term, df, n_docs, round(avgdl, 6) AS avgdl FROM dfs, size",
    ),
)
def corpus_stats(spark, sf_dir):
    return search.corpus_stats(_index(spark, sf_dir)).withColumn("avgdl", F.round("avgdl", 6))


@query("bm25_top_k", _ranked())
def bm25_top_k(spark, sf_dir):
    ranked = search.rank_documents(views.corpus(spark, sf_dir), QUERY, 10)
    return ranked.withColumn("score", F.round("score", 6))


@query("bm25_namespace", _ranked("namespace = 'arxiv'", 20))
def bm25_namespace(spark, sf_dir):
    ranked = search.rank_documents(views.corpus(spark, sf_dir), QUERY, 20, namespace="arxiv")
    return ranked.withColumn("score", F.round("score", 6))


SNIPPETS = f"""ranked AS (
  SELECT namespace, canonical_id, sum({sql.SCORE}) AS score
  FROM postings JOIN dfs USING (term), size WHERE term IN ('ering', 'queque', 'license')
  GROUP BY namespace, canonical_id ORDER BY round(score, 9) DESC, namespace, {_stem()} LIMIT 20),
cut AS (
  SELECT namespace, canonical_id, markdown, term, unnest(p) AS piece, generate_subscripts(p, 1) AS i, len(p) AS n
  FROM (SELECT *, string_split(lower(markdown), term) AS p FROM ranked JOIN corpus USING (namespace, canonical_id),
    (VALUES ('ering'), ('queque'), ('license')) t(term))),
spots AS (
  SELECT *, CAST(sum(length(piece) + length(term))
    OVER (PARTITION BY namespace, canonical_id, term ORDER BY i) - length(term) AS BIGINT) AS pos FROM cut),
hits AS (
  SELECT namespace, canonical_id, term, pos FROM spots WHERE i < n
    AND NOT regexp_matches(substr(markdown, pos, 1), '[\\pL\\pN_]')
    AND NOT regexp_matches(substr(markdown, pos + length(term) + 1, 1), '[\\pL\\pN_]')),
near AS (
  SELECT namespace, canonical_id, a.pos, count(DISTINCT b.term) AS d
  FROM hits a JOIN hits b USING (namespace, canonical_id) WHERE abs(a.pos - b.pos) <= 100
  GROUP BY namespace, canonical_id, a.pos),
best AS (
  SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY namespace, canonical_id ORDER BY d DESC, pos) = 1),
sections_of AS (
  SELECT namespace, canonical_id, max_by(line, start_at) AS line
  FROM best JOIN heads USING (namespace, canonical_id) WHERE start_at <= pos GROUP BY namespace, canonical_id)"""


DESCRIBED = sql.with_(
        sql.CORPUS,
        sql.POSTINGS,
        sql.SECTIONS,
        sql.HEADS,
        SNIPPETS,
        body=f"""SELECT namespace, canonical_id, round(score, 3) AS score, {sql.first_title('markdown')} AS title,
  CASE WHEN pos IS NULL THEN {sql.strip('markdown[1:200]')}
    ELSE {sql.strip(f"regexp_replace(markdown[greatest(pos - 100, 0) + 1 : greatest(pos - 100, 0) + 200], '{sql.WS}+', ' ', 'g')")} END AS snippet,
  {sql.strip("regexp_replace(line, '^#+', '')")} AS section, length(markdown) AS char_count
FROM ranked JOIN corpus USING (namespace, canonical_id) LEFT JOIN best USING (namespace, canonical_id)
LEFT JOIN sections_of USING (namespace, canonical_id)""",
    )


@query("bm25_search", DESCRIBED)
def bm25_search(spark, sf_dir):
    return search.bm25_search(views.corpus(spark, sf_dir), QUERY, 20)


@query("bm25_stored_index", _ranked())
def bm25_stored_index(spark, sf_dir):
    built = _stored(spark, sf_dir)
    return index.search_index(built, QUERY, 10).withColumn("score", F.round("score", 6))


def _stored(spark, sf_dir):
    """An index that was added to twice: odd documents first, then the even ones."""
    path = scratch_path(spark, "index")
    corpus = views.corpus(spark, sf_dir)
    index.add_documents(spark, path, corpus.where("doc_id % 2 = 1"))
    return index.add_documents(spark, path, corpus.where("doc_id % 2 = 0"))


@query("bm25_index_namespace", _ranked("namespace = 'arxiv'", 20))
def bm25_index_namespace(spark, sf_dir):
    built = _stored(spark, sf_dir)
    found = index.search_index(built, QUERY, 20, namespace="arxiv", prune=True)
    return found.withColumn("score", F.round("score", 6))


@query("bm25_index_removed", _ranked("doc_id % 3 <> 0", 20))
def bm25_index_removed(spark, sf_dir):
    """Every third document removed again, then the segments merged."""
    built = _stored(spark, sf_dir)
    gone = views.corpus(spark, sf_dir).where("doc_id % 3 = 0")
    index.remove_documents(spark, built.path, gone)
    merged = index.merge_segments(spark, built.path)
    return index.search_index(merged, QUERY, 20).withColumn("score", F.round("score", 6))


@query("bm25_index_described", DESCRIBED)
def bm25_index_described(spark, sf_dir):
    return index.search_described(_stored(spark, sf_dir), QUERY, 20)


@query(
    "bm25_batch",
    sql.with_(
        sql.CORPUS,
        sql.POSTINGS,
        f"""asked AS (
  SELECT DISTINCT item_id AS query_id, unnest({sql.tokens('text')}) AS term FROM benchmark),
scored AS (
  SELECT query_id, namespace, canonical_id, sum({sql.SCORE}) AS score
  FROM asked JOIN postings USING (term) JOIN dfs USING (term), size
  GROUP BY query_id, namespace, canonical_id)""",
        body=f"""SELECT query_id, rank, namespace, canonical_id, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id
    ORDER BY round(score, 9) DESC, namespace, {_stem()}) AS rank FROM scored) WHERE rank <= 10""",
    ),
)
def bm25_batch(spark, sf_dir):
    built = index.add_documents(spark, scratch_path(spark, "index"), views.corpus(spark, sf_dir))
    queries = views.table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )
    return index.search_batch(built, queries, 10).withColumn("score", F.round("score", 6))


@query(
    "search_papers",
    sql.with_(
        sql.ARXIV,
        """hits AS (
  SELECT * FROM arxiv WHERE contains(lower(title), 'tion') AND NOT ('lang.fr' = 'lang.' || lang))""",
        body="""SELECT arxiv_id, title, names[1] AS first_author, len(names) AS author_count,
  CAST(published[1:4] AS INTEGER) AS published_year, (SELECT count(*) FROM hits) AS total_results
FROM hits ORDER BY arxiv_id LIMIT 50""",
    ),
)
def search_papers(spark, sf_dir):
    return search.search_papers(
        views.arxiv_papers(spark, sf_dir), ti="tion", cat="lang.fr", op="ANDNOT", max_results=50
    )


@query(
    "search_titles",
    sql.with_(
        sql.WORKS,
        """bib AS (
  SELECT '10.1234/O' || k AS canonical_id, 'crossref' AS namespace, title, names,
    publication_year + CASE WHEN k % 2 = 0 THEN 0 ELSE 1 END AS year,
    concat_ws(' ', title, array_to_string(list_transform(names, lambda n, i:
      concat_ws(' ', CASE WHEN i <> 1 THEN n END, CASE WHEN i = 3 THEN 'Family' END)), ' ')) AS markdown
  FROM works),
corpus AS (SELECT * FROM bib WHERE year = 1997)""",
        sql.POSTINGS,
        f"""top AS (
  SELECT canonical_id, sum({sql.SCORE}) AS score FROM postings JOIN dfs USING (term), size
  WHERE term IN ('the', 'tion', 'family', 'er') GROUP BY canonical_id),
shown AS (SELECT * FROM top ORDER BY score DESC, replace(canonical_id, '/', '_') LIMIT 5)""",
        body="""SELECT canonical_id AS doi, title,
  CASE WHEN len(names) >= 2 THEN names[2] END AS first_author, len(names) AS author_count, year,
  round(score, 6) AS score, (SELECT count(*) FROM top) AS total_results
FROM shown JOIN bib USING (canonical_id)""",
    ),
)
def search_titles(spark, sf_dir):
    found = search.search_titles(
        views.crossref_works(spark, sf_dir), "The tion family er", year=1997, rows=5
    )
    return found.withColumn("score", F.round("score", 6))


@query(
    "search_pages",
    sql.with_(
        sql.SUMMARIES,
        body="SELECT title, url FROM summaries WHERE starts_with(lower(title), 'red') ORDER BY title, url LIMIT 10",
    ),
)
def search_pages(spark, sf_dir):
    from litlake.operators.normalize import normalize_summaries

    return search.search_pages(normalize_summaries(views.summaries_raw(spark, sf_dir)), "Red", 10)
