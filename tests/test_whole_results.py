"""No rows lost, none multiplied, no silent limits."""

import pytest
from pyspark.sql import functions as F

from litlake import session
from litlake.operators import bibliography, find, graph, metadata, search
from litlake.operators.corpus import import_markdown
from litlake.operators.identifiers import plan_downloads, resolve_identifiers
from litlake.operators.telemetry import counters_snapshot, retry_after_seconds
from litlake.plans import views
from litlake.sources.corpus import read_pdf_blobs

SF_DIR = "/root/testdata/sf0.001"


def test_works_without_doi_keep_their_entries(spark):
    works = views.works(spark, SF_DIR).limit(5)
    bare = works.withColumn("doi", F.lit(None).cast("string")).withColumn(
        "ids", F.struct(F.col("ids.openalex").alias("openalex"))
    )
    none = views.arxiv_papers(spark, SF_DIR).where("false")
    preprints = views.preprints(spark, SF_DIR).where("false") if hasattr(views, "preprints") else None
    if preprints is None:
        from litlake.plans.metadata_queries import preprints as made

        preprints = made(spark, SF_DIR).where("false")
    distinct = bare.withColumn(
        "ids", F.struct(F.concat(F.lit("https://openalex.org/W"), F.monotonically_increasing_id().cast("string")).alias("openalex"))
    ).cache()
    assert bibliography.all_entries(none, preprints, distinct).count() == distinct.count()
    twice = distinct.unionByName(distinct.withColumn("publication_date", F.lit("2999-01-01")))
    assert bibliography.all_entries(none, preprints, twice).count() == distinct.count()


def test_one_row_per_request(spark):
    titles = spark.createDataFrame([(1, "foo bar"), (2, "none"), (3, None)], "request_id long, title string")
    summaries = spark.createDataFrame(
        [("Foo Bar", "standard", "u1", "d"), ("foo bar", "standard", "u2", "d"), (None, "x", "u", "d")],
        "title string, type string, url string, description string",
    )
    got = {r.request_id: r.exists for r in metadata.page_status(titles, summaries).collect()}
    assert metadata.page_status(titles, summaries).count() == 3 and got == {1: True, 2: False, 3: False}


def test_batch_metadata_takes_the_newest_record(spark):
    papers = spark.createDataFrame(
        [("openalex", "10.1/abcd/a", "2020-01-01", "old"), ("openalex", "10.1/abcd/a", "2021-01-01", "new")],
        "_source string, _canonical_id string, publication_date string, title string",
    ).withColumn("_canonical_id", F.lit("10.1234/a"))
    asked = spark.createDataFrame([(0, "10.1234/A"), (1, "10.1234/a"), (2, "label")], "pos int, raw string")
    got = sorted((r.pos, r.title) for r in metadata.batch_metadata(asked, papers).collect())
    assert got == [(0, "new"), (1, "new"), (2, None)]


def test_failed_and_uncited_papers_have_pages(spark):
    counts = spark.createDataFrame(
        [("a", 2, None), ("b", None, None), ("c", 0, 0)], "doi string, crossref_count int, opencitations_count int"
    )
    refs = spark.createDataFrame([("a", "x", 1), ("a", "y", 2)], "citing string, cited string, n int")
    got = {r.doi: r for r in graph.references_page(counts, refs, refs.where("false"), ["n"]).collect()}
    assert set(got) == {"a", "b", "c"} and got["b"].error == graph.BOTH_FAILED and got["b"].references == []
    assert got["c"].error is None and got["c"].total == 0
    pinned = graph.references_page(counts, refs, refs.where("false"), ["n"], source="opencitations")
    assert {r.doi: r.error for r in pinned.collect()}["a"] == graph.FAILED
    asked = spark.createDataFrame([("x",), ("never",)], "doi string")
    pages = {r.doi: r for r in graph.citations_page(refs, ["n"], ["citing"], asked=asked).collect()}
    assert pages["never"].total == 0 and pages["never"].citations == [] and pages["x"].total == 1
    assert {r.doi: r.citation_count for r in graph.citation_counts(refs, asked).collect()} == {"x": 1, "never": 0}


def test_sizes_are_used_as_given(spark):
    edges = spark.range(120).select(F.lit("p").alias("cited"), F.col("id").alias("n"))
    (page,) = graph.citations_page(edges, ["n"], ["n"], page_size=100).collect()
    assert len(page.citations) == 100 and page.has_more
    text = " ".join(["needle"] * 500)
    corpus = spark.createDataFrame([("manual", "d", text)], "namespace string, canonical_id string, markdown string")
    assert find.find_in_documents(corpus, "needle", 500).count() == 500
    many = spark.range(120).select(
        F.lit("manual").alias("namespace"), F.col("id").cast("string").alias("canonical_id"), F.lit("word here").alias("markdown")
    ).unionByName(corpus)
    assert search.bm25_search(many, "word", 100).count() == 100
    for call in (
        lambda: graph.citations_page(edges, ["n"], ["n"], page_size=0),
        lambda: find.find_in_documents(corpus, "needle", 0),
    ):
        with pytest.raises(ValueError):
            call()


def test_empty_files_are_rejects(spark, tmp_path):
    (tmp_path / "full.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "empty.pdf").write_bytes(b"")
    paths = [(f"file:{tmp_path}/full.pdf",), (f"file:{tmp_path}/empty.pdf",)]
    expected = spark.createDataFrame(paths, "path string")
    got = {r.path.rsplit("/", 1)[1]: r.error for r in read_pdf_blobs(spark, str(tmp_path), expected=expected).collect()}
    assert got == {"full.pdf": None, "empty.pdf": "Empty or missing file"}


def test_a_second_file_finds_the_first_stored(spark):
    files = spark.createDataFrame(
        [(0, "note", b"\xff"), (1, "note", b"one"), (2, "note", b"two"), (3, "old", b"new")],
        "pos int, identifier string, content binary",
    )
    stored = spark.createDataFrame([("manual", "old", "kept")], "namespace string, canonical_id string, markdown string")
    corpus, outcome = import_markdown(files, stored)
    got = {r.pos: (r.cached, r.error is not None) for r in outcome.collect()}
    assert got == {0: (False, True), 1: (False, False), 2: (True, False), 3: (True, False)}
    assert {r.canonical_id: r.markdown for r in corpus.collect()} == {"old": "kept", "note": "one"}


def test_marked_arxiv_ids_and_servers(spark):
    raw = spark.createDataFrame([("doi:2401.12345",), ("10.1101/2020.02.02.900001",)], "raw string")
    got = {r.raw: r.source for r in resolve_identifiers(raw, "raw").collect()}
    assert got == {"doi:2401.12345": "arxiv", "10.1101/2020.02.02.900001": "biorxiv"}
    preprints = spark.createDataFrame([("10.1101/2020.02.02.900001", "3", "medRxiv")], "raw string, version string, server string")
    (row,) = plan_downloads(preprints).collect()
    assert row.pdf_url == "https://www.medrxiv.org/content/10.1101/2020.02.02.900001v3.full.pdf"


@pytest.mark.parametrize(
    "raw, seconds", [("5", 5.0), (" 2.5 ", 2.5), ("NaN", None), ("5d", None), ("1f", None), ("-1", None), ("0", None), ("Infinity", None)]
)
def test_retry_after_is_a_plain_number(spark, raw, seconds):
    row = spark.createDataFrame([(raw,)], "raw string").select(retry_after_seconds(F.col("raw")).alias("s")).first()
    assert row.s == seconds


def test_stale_reads_are_misses_in_both_counts(spark):
    log = spark.createDataFrame([("p", "stale"), ("p", "cache_misses")], "provider string, metric string")
    assert counters_snapshot(log).first().cache_misses == 2
    from litlake.operators.telemetry import metric_counts

    assert log.groupBy("provider").agg(*metric_counts()).first().cache_misses == 2


def test_scratch_needs_a_shared_folder_on_a_cluster(monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError):
        session.scratch_root(Session())
    Context.master = "local[2]"
    assert session.scratch_root(Session())


@pytest.mark.parametrize(
    "text, folded",
    [("\U0001d400bc", "Abc"), ("\u00bdx", "1\u20442x"), ("\u3392", "MHz"), ("\ufb01n \u00e9", "fin e"), (None, None), ("plain", "plain")],
)
def test_folding_covers_all_code_points(spark, text, folded):
    from litlake.functions.names import fold_accents

    row = spark.createDataFrame([(text,)], "s string").select(fold_accents(F.col("s")).alias("f")).first()
    assert row.f == folded


@pytest.mark.parametrize(
    "raw, canonical",
    [
        ("https://arxiv.org/abs/2401.12345v2", "2401.12345"),
        ("http://arxiv.org/pdf/math/0301234.pdf", "math/0301234"),
        ("https://www.medrxiv.org/content/10.1101/2020.02.02.900001v2.full.pdf", "10.1101/2020.02.02.900001"),
        ("https://biorxiv.org/content/10.1101/2020.02.02.900001.full", "10.1101/2020.02.02.900001"),
        ("https://example.org/abs/2401.12345", "https://example.org/abs/2401.12345"),
    ],
)
def test_addresses(spark, raw, canonical):
    row = resolve_identifiers(spark.createDataFrame([(raw,)], "raw string"), "raw").first()
    assert row.canonical_id == canonical


def test_asked_side_of_citation_dumps(spark, tmp_path):
    import json

    from litlake.sources import dumps

    edge = {"oci": "1", "citing": "omid:br/1 doi:10.1/A", "cited": "doi:10.1/b x:y", "creation": "2020", "journal_sc": "no", "author_sc": "no"}
    (tmp_path / "e.json").write_text(json.dumps(edge))
    sides = {d: dumps.read_opencitations(spark, str(tmp_path), d).first().asked for d in ("references", "citations")}
    assert sides == {"references": "10.1/a", "citations": "10.1/b"}


def test_texts_do_not_travel_for_titles(spark):
    slim = views.works(spark, SF_DIR).select("doi", "title", "authorships")
    plan = slim._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("AS title")
