"""Corpus search: term index, BM25 ranking, snippets, field search."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from litlake.functions import text as tx
from litlake.functions.identifiers import stem
from litlake.operators.metadata import crossref_triage_columns, crossref_year, triage_arxiv
from litlake.operators.sections import DOC
from litlake.operators.spread import at_least_one, first_per_key
from litlake.session import pin

# Ranking constants, snippet width and result caps.
K1 = 1.5
B = 0.75
SNIPPET = 200


def query_terms(query: str) -> list[str]:
    """Distinct index terms of a query, by the same rule as documents."""
    found = re.findall(tx.TOKEN, query.lower())
    return sorted({t for t in found if len(t) > 1 and t not in tx.STOPWORDS})


def tokenize(corpus: DataFrame) -> DataFrame:
    return corpus.select(*DOC, tx.tokens(F.col("markdown")).alias("tokens"))


def term_index(corpus: DataFrame) -> DataFrame:
    """Postings ``(doc, ord, term, tf, doc_len)``; documents without tokens drop out.

    Counting happens inside each document's row, so building postings shuffles
    nothing. ``ord`` numbers a document's terms; ``ord = 0`` marks one row per
    document, which makes corpus statistics a plain aggregate.
    """
    counted = corpus.select(
        *DOC,
        tx.let(
            tx.tokens(F.col("markdown")),
            lambda t: F.struct(F.size(t).alias("doc_len"), tx.term_counts(t).alias("terms")),
        ).alias("_c"),
    )
    return counted.select(
        *DOC, F.col("_c.doc_len").alias("doc_len"), F.posexplode("_c.terms").alias("ord", "t")
    ).select(*DOC, "ord", "t.term", "t.tf", "doc_len")


def corpus_size(index: DataFrame) -> DataFrame:
    """``n_docs`` and ``avgdl`` of an index."""
    one_per_doc = F.col("ord") == 0
    return index.agg(
        F.count(F.when(one_per_doc, 1)).alias("n_docs"),
        (F.sum(F.when(one_per_doc, F.col("doc_len"))) / F.count(F.when(one_per_doc, 1))).alias(
            "avgdl"
        ),
    )


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(index: DataFrame) -> DataFrame:
    """``term, df`` with ``n_docs`` and ``avgdl`` of the same corpus on every row."""
    size = corpus_size(index).select(F.struct("n_docs", "avgdl")).scalar()
    return (
        document_frequency(index)
        .withColumn("_size", size)
        .select("term", "df", "_size.n_docs", "_size.avgdl")
    )


def idf(n_docs: Column, df: Column) -> Column:
    return F.log1p((n_docs - df + 0.5) / (df + 0.5))


def term_score(idf_: Column, tf: Column, doc_len: Column, avgdl: Column) -> Column:
    return idf_ * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * doc_len / avgdl))


def _top(scored: DataFrame, top_k: int) -> DataFrame:
    return scored.orderBy(
        F.col("score").desc(), "namespace", stem(F.col("canonical_id"))
    ).limit(at_least_one("top_k", top_k))


def rank_documents(
    corpus: DataFrame, query: str, top_k: int = 10, namespace: str | None = None
) -> DataFrame:
    """Top documents of a query by BM25, ``(doc, score)``."""
    if namespace:
        corpus = corpus.where(F.col("namespace") == namespace)
    return _top(matching(corpus, query, DOC), top_k)


def matching(corpus: DataFrame, query: str, keep: Sequence[str]) -> DataFrame:
    """Rows whose ``markdown`` has a term of the query: the columns ``keep`` and ``score``.

    One pass over the text leaves a slim row per document: its length and the
    counts of the query's terms. Statistics and scores both read those rows.
    """
    terms = query_terms(query)
    if not terms:
        corpus = corpus.where(F.lit(False))

    def count_of(toks: Column, term: str) -> Column:
        return F.size(F.filter(toks, lambda t: t == term))

    def counts(toks: Column) -> Column:
        return F.struct(
            F.size(toks).alias("doc_len"),
            F.array(*(count_of(toks, q) for q in terms or [""])).alias("tf"),
        )

    # The length filter comes after the write: pushed below the projection it
    # would tokenise every text a second time.
    slim = pin(
        corpus.select(*keep, tx.let(tx.tokens(F.col("markdown")), counts).alias("_c")).select(
            *keep, F.col("_c.doc_len").alias("_len"), F.col("_c.tf").alias("_tf")
        ),
        "ranked",
    ).where("_len > 0")
    stats = slim.agg(
        F.struct(
            F.count(F.lit(1)).alias("n_docs"),
            (F.sum("_len") / F.count(F.lit(1))).alias("avgdl"),
            F.array(
                *(F.count(F.when(F.get("_tf", F.lit(i)) > 0, 1)) for i in range(max(len(terms), 1)))
            ).alias("df"),
        )
    ).scalar()
    weighed = slim.where(F.exists("_tf", lambda n: n > 0)).withColumn("_s", stats)
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf = F.get("_tf", F.lit(i))
        weight = idf(F.col("_s.n_docs"), F.get("_s.df", F.lit(i)))
        score = score + F.when(
            tf > 0, term_score(weight, tf, F.col("_len"), F.col("_s.avgdl"))
        ).otherwise(0.0)
    return weighed.select(*keep, score.alias("score")).where("score > 0")


def _term_pattern(term: str) -> str:
    return tx.literal_pattern(term, whole_words=True)


def snippets(docs: DataFrame, terms: Sequence[str], window: int = SNIPPET) -> DataFrame:
    """Add ``snippet`` and ``snippet_offset`` to a bounded list of ranked documents with texts.

    The offset is the term occurrence with most distinct terms within half a
    window, the earliest on ties. Without any occurrence the head of the
    document is shown and the offset is null.
    """
    half = window // 2
    lowered = F.lower("markdown")
    runs = [
        F.struct(
            F.lit(t).alias("term"),
            F.zip_with(
                F.slice(F.split(lowered, _term_pattern(t), -1), F.lit(1), F.size(m)),
                m,
                lambda gap, x: F.struct(F.length(gap).alias("gap"), F.length(x).alias("len")),
            ).alias("steps"),
        )
        for t in terms
        for m in [F.regexp_extract_all(lowered, F.lit(_term_pattern(t)), F.lit(0))]
    ]
    before = W.partitionBy(*DOC, "term").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    near = W.partitionBy(*DOC).orderBy("pos").rangeBetween(-half, half)
    placed = (
        docs.select(*DOC, F.inline(F.array(*runs)))
        .select(*DOC, "term", F.posexplode("steps").alias("i", "s"))
        .withColumn("pos", F.sum(F.col("s.gap") + F.col("s.len")).over(before) - F.col("s.len"))
        .select(*DOC, "term", F.col("pos").cast("int").alias("pos"))
        .withColumn("distinct_terms", F.size(F.collect_set("term").over(near)))
    )
    best = first_per_key(
        placed, DOC, [F.col("distinct_terms").desc(), F.col("pos").asc()]
    ).select(*DOC, F.col("pos").alias("snippet_offset"))
    start = F.greatest(F.col("snippet_offset") - half, F.lit(0)) + 1
    snippet = F.when(
        F.col("snippet_offset").isNull(), tx.strip(F.substr("markdown", F.lit(1), F.lit(window)))
    ).otherwise(tx.collapse(F.substr("markdown", start, F.lit(window))))
    return docs.join(best, DOC, "left").withColumn("snippet", snippet)


def bm25_search(
    corpus: DataFrame, query: str, top_k: int = 10, namespace: str | None = None
) -> DataFrame:
    """Ranked hits with score, title, snippet, section and size.

    Ranking runs on slim rows; text is read again for the top documents only.
    """
    ranked = rank_documents(corpus, query, top_k, namespace).collect()
    return describe_texts(fetch_texts(corpus, ranked), query)


def fetch_texts(corpus: DataFrame, ranked: Sequence[Row]) -> DataFrame:
    """Texts and scores of ranked documents, at most as many as the search was asked for.

    Their names go to the scan as lists, so a corpus that is stored in the order of its
    names, or with filters on them (``write_clustered``), gives up only the row groups
    that hold one.
    """
    scores = {(r.namespace, r.canonical_id): r.score for r in ranked}
    empty = F.lit(None).cast("map<struct<n:string,c:string>,double>")
    key = F.struct(F.col("namespace").alias("n"), F.col("canonical_id").alias("c"))
    pairs = [
        x
        for (n, c), v in scores.items()
        for x in (F.struct(F.lit(n).alias("n"), F.lit(c).alias("c")), F.lit(v))
    ]
    score = (F.create_map(*pairs) if pairs else empty)[key]
    wanted = F.col("namespace").isin(*{n for n, _ in scores}) & F.col("canonical_id").isin(
        *{c for _, c in scores}
    )
    found = corpus.where(wanted if scores else F.lit(False)).select(*DOC, "markdown", score.alias("score"))
    return pin(found.where("score is not null"), "fetched")


def describe_texts(ranked: DataFrame, query: str) -> DataFrame:
    """Title, snippet, section and size of ranked documents (namespace, canonical_id, score, markdown)."""
    terms = query_terms(query)
    if not terms:
        return ranked.where(F.lit(False)).select(
            *DOC,
            "score",
            *(F.lit("").alias(c) for c in ("title", "snippet", "section")),
            F.lit(0).alias("char_count"),
        )
    md = F.col("markdown")
    return (
        snippets(ranked, terms)
        .select(
            *DOC,
            "score",
            tx.first_title(md).alias("title"),
            "snippet",
            F.when(
                F.col("snippet_offset").isNotNull(), tx.section_at(md, F.col("snippet_offset"))
            ).alias("section"),
            F.length(md).alias("char_count"),
        )
        .orderBy(F.col("score").desc(), "namespace", stem(F.col("canonical_id")))
        .withColumn("score", F.round("score", 3))
    )


def search_papers(
    papers: DataFrame,
    ti: str | None = None,
    au: str | None = None,
    abs: str | None = None,
    cat: str | None = None,
    op: str = "AND",
    max_results: int = 10,
) -> DataFrame:
    """Field search over local papers with the short result list.

    ``op`` is AND, OR or ANDNOT (the first given field and none of the others).
    ``total_results`` counts all matches, not only the rows shown.
    """
    has = lambda c, text: F.lower(c).contains(text.lower())
    tests = []
    if ti:
        tests.append(has(F.col("title"), ti))
    if au:
        tests.append(F.exists("authors", lambda a: has(a["name"], au)))
    if abs:
        tests.append(has(F.col("summary"), abs))
    if cat:
        tests.append(F.exists("categories", lambda c: c == cat))
    if not tests:
        raise ValueError("give at least one field")
    match = tests[0]
    for test in tests[1:]:
        match = {"AND": match & test, "OR": match | test, "ANDNOT": match & ~test}[op]
    found = papers.where(F.coalesce(match, F.lit(False)))
    total = found.agg(F.count(F.lit(1))).scalar()
    return (
        triage_arxiv(found)
        .orderBy("arxiv_id")
        .limit(at_least_one("max_results", max_results))
        .withColumn("total_results", total)
    )


def search_titles(
    works: DataFrame, query: str, year: int | None = None, rows: int = 5
) -> DataFrame:
    """Bibliographic search over titles and author names, optionally in one year.

    One row per record, records with one DOI or without any included; ``total_results``
    counts all records that match, not only the rows shown.
    """
    if year is not None:
        works = works.where(crossref_year() == year)
    names = F.transform("author", lambda a: F.concat_ws(" ", a["given"], a["family"]))
    text = F.concat_ws(" ", F.array_join("title", " "), F.array_join(names, " "))
    # What is shown goes through the ranking with its row: records may share a DOI or have none.
    records = works.select(*crossref_triage_columns(), text.alias("markdown"))
    shown = ["doi", "title", "first_author", "author_count", "year"]
    found = matching(records, query, shown)
    total = found.agg(F.count(F.lit(1))).scalar()
    ties = [F.col(c).asc_nulls_last() for c in shown[1:]]
    return (
        found.orderBy(F.col("score").desc(), stem(F.col("doi")).asc_nulls_last(), *ties)
        .limit(at_least_one("rows", rows))
        .withColumn("total_results", total)
    )


def search_pages(summaries: DataFrame, prefix: str, limit: int = 5) -> DataFrame:
    return (
        summaries.where(F.lower("title").startswith(prefix.lower()))
        .select("title", "url")
        .orderBy("title", "url")
        .limit(at_least_one("limit", limit))
    )
