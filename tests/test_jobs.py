"""Metadata joins and corpus jobs on small fixtures."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from litlake.operators import bibliography, corpus as jobs, metadata, normalize, sections
from litlake.operators.identifiers import plan_downloads
from litlake.sources import dumps, files

DOC = "namespace string, canonical_id string"


@pytest.fixture(scope="module")
def papers(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("papers")

    def lines(name, *docs):
        path = root / name
        path.mkdir()
        (path / "part.json").write_text("\n".join(map(json.dumps, docs)))
        return str(path)

    preprint = {"version": "1", "server": "bioRxiv", "title": "P", "authors": "Doe, J", "date": "2024-01-01"}
    biorxiv = normalize.normalize_biorxiv(
        dumps.read_biorxiv_details(
            spark,
            lines(
                "bio",
                {"collection": [{**preprint, "doi": "10.1101/A", "published": "10.1234/J"}]},
                {"collection": [{**preprint, "doi": "10.1101/B", "published": "10.1234/absent"}]},
                {"collection": [{**preprint, "doi": "10.1101/C", "published": "NA"}]},
            ),
        ).drop("pos")
    )
    works = dumps.read_openalex(
        spark, lines("oa", {"doi": "https://doi.org/10.1234/j", "title": "Journal", "publication_year": 2025,
                            "open_access": {"is_oa": True}})
    )
    arxiv = spark.createDataFrame(
        [("http://arxiv.org/abs/2301.00001v2", "Arx", "s", "2023-01-01", "2023-02-01", [("A B", [])], [], "cs.CL", [], None, None, None)],
        "id string, title string, summary string, published string, updated string, "
        "authors array<struct<name:string,affiliations:array<string>>>, categories array<string>, primary_category string, "
        "links array<struct<href:string,rel:string,title:string>>, comment string, journal_ref string, doi string",
    )
    return arxiv, biorxiv, works


def test_follow_published(papers):
    _, biorxiv, works = papers
    got = {r._canonical_id: r for r in metadata.follow_published(biorxiv, works).collect()}
    journal = got["10.1234/j"]
    assert (journal._source, journal.preprint_doi, journal.title) == ("openalex_via_biorxiv", "10.1101/A", "Journal")
    assert journal.is_oa is True and journal.server is None
    for doi, published in (("10.1101/b", "10.1234/absent"), ("10.1101/c", None)):
        assert got[doi]._source == "biorxiv" and got[doi].published_doi == published
        assert got[doi].preprint_doi is None and got[doi].title == "P"


def test_batch_keeps_positions_and_duplicates(spark, papers):
    raw = ["2301.00001", "label", "https://doi.org/10.1234/J", "2301.00001v1", "10.1101/zzz", "10.1101/c", "10.9999/none"]
    rows = metadata.batch_metadata(
        spark.createDataFrame(list(enumerate(raw)), "pos int, raw string"), metadata.all_metadata(*papers)
    ).collect()
    assert [r._input for r in rows] == raw
    assert [r.title for r in rows] == ["Arx", None, "Journal", "Arx", None, "P", None]
    assert rows[1].error == metadata.UNKNOWN_ERROR
    assert rows[4].suggestion == metadata.HINTS["biorxiv"] and rows[6].suggestion == metadata.HINTS["openalex"]
    assert all((r.error is None) == (r.title is not None) for r in rows)


def test_export_is_one_entry_per_paper(spark, papers, tmp_path):
    arxiv, biorxiv, works = papers
    entries = bibliography.all_entries(arxiv.unionByName(arxiv), biorxiv, works)
    assert entries.count() == 5
    bibliography.export_bibliography(entries, str(tmp_path / "bib"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "bib")).collect())
    assert text.count("@misc{b2023arx,") == 1 and text.count("title={P}") == 3


def test_download_addresses_from_links(spark):
    df = spark.createDataFrame(
        [("2301.00001", [("p", "related", "pdf")]), ("2301.00002", [("a", "alternate", None)])],
        "raw string, links array<struct<href:string,rel:string,title:string>>",
    )
    got = {r.raw: (r.pdf_url, r.error) for r in plan_downloads(df).collect()}
    assert got["2301.00001"] == ("p", None) and got["2301.00002"][0] is None and got["2301.00002"][1]


def test_import_existing_document_wins(spark):
    stored = spark.createDataFrame([("arxiv", "2301.00001", "old")], DOC + ", markdown string")
    new = spark.createDataFrame(
        [(0, "2301.00001v3", b"new"), (1, "note", b"\xff\xfe"), (2, "Note", "é".encode()), (3, "note", b"later")],
        "pos int, identifier string, content binary",
    )
    merged, outcome = jobs.import_markdown(new, stored)
    assert {r.canonical_id: r.markdown for r in merged.collect()} == {"2301.00001": "old", "note": "é"}
    got = {r.pos: (r.cached, r.error is not None) for r in outcome.collect()}
    assert got == {0: (True, False), 1: (False, True), 2: (False, False), 3: (True, False)}


def test_convert_skips_stored_unless_forced(spark):
    blobs = spark.createDataFrame([("m", "a", b"A  \n![c](p)"), ("m", "b", b"B"), ("m", "bad", b"\xff")], DOC + ", content binary")
    stored = spark.createDataFrame([("m", "b")], DOC)
    got = {r.canonical_id: (r.markdown, r.error is not None) for r in jobs.convert_documents(blobs, stored, bytes.decode).collect()}
    assert got == {"a": ("A\n![c]()", False), "bad": (None, True)}
    assert jobs.convert_documents(blobs, stored, bytes.decode, force=True).count() == 3


def test_conversion_is_isolated(spark):
    """A converter that hangs, and one that ends its process, cost their own file only."""

    def converter(blob):
        if blob == b"hang":
            time.sleep(60)
        if blob == b"crash":
            os._exit(3)
        if blob == b"fail":
            raise ValueError("no")
        return f"{len(blob)} {blob[:5].decode()}"

    files = {"a": b"first", "h": b"hang", "b": b"second", "c": b"crash", "f": b"fail", "d": b"x" * 3_000_000, "n": None}
    rows = [("m", k, v) for k, v in files.items()]
    blobs = spark.createDataFrame(rows, DOC + ", content binary").coalesce(1)
    stored = spark.createDataFrame([], "namespace string, canonical_id string, markdown string")
    began = time.monotonic()
    found = jobs.convert_documents(blobs, stored, converter, time_limit=2.0).collect()
    assert time.monotonic() - began < 40
    got = {r.canonical_id: (r.markdown, r.error) for r in found}
    assert {k: v[0] for k, v in got.items() if v[0]} == {"a": "5 first", "b": "6 secon", "d": "3000000 xxxxx"}
    errors = {k: v[1].removeprefix("Conversion failed: ") for k, v in got.items() if v[1]}
    assert errors == {
        "h": "no result within 2 seconds",
        "c": "the converter's process ended",
        "f": "no",
        "n": "no content",
    }


def test_refresh_only_stale(spark):
    corpus = spark.createDataFrame([("m", k, f"## {k}\ntext") for k in "abcd"], DOC + ", markdown string")
    index = sections.section_index(corpus)
    stored = index.where("canonical_id != 'd'").withColumn(
        "md_sha256",
        F.when(F.col("canonical_id") == "a", F.col("md_sha256")).when(F.col("canonical_id") == "b", F.lit("x")),
    )
    got = {r.canonical_id: r for r in sections.refresh_sections(corpus, stored).collect()}
    assert {k: r.refreshed for k, r in got.items()} == {"a": False, "b": True, "c": True, "d": True}
    assert all(len(r.sections) == 1 and r.md_sha256 for r in got.values())


def test_cascade_only_on_real_replacement(spark):
    corpus = spark.createDataFrame([("m", k, "t") for k in "abcde"], DOC + ", markdown string")
    down = spark.createDataFrame(
        [("m", "a", False, True, None), ("m", "b", True, True, None), ("m", "c", False, False, None), ("m", "d", False, True, "failed")],
        DOC + ", cached boolean, forced boolean, error string",
    )
    text, index = sections.cascade_invalidate(corpus, sections.section_index(corpus), down)
    assert sorted(r.canonical_id for r in text.collect()) == ["b", "c", "d", "e"] == sorted(r.canonical_id for r in index.collect())


def test_hot_document_requests(spark):
    corpus = spark.createDataFrame([("m", "hot", "# A\nx\n# B\ny"), ("m", "cold", "# A\nz")], DOC + ", markdown string")
    asked = spark.range(400).select(
        F.col("id").alias("request_id"),
        F.lit("m").alias("namespace"),
        F.when(F.col("id") % 3 == 0, "cold").when(F.col("id") % 100 == 1, "gone").otherwise("hot").alias("canonical_id"),
        (F.col("id") % 2).cast("string").alias("section"),
    )
    rows = sections.select_sections(asked, corpus).collect()
    assert len(rows) == 400 and len({r.request_id for r in rows}) == 400
    for r in rows:
        want = {("hot", "0"): "x", ("hot", "1"): "y", ("cold", "0"): "z"}.get((r.canonical_id, r.section))
        assert r.content == want and (r.error is None) == (want is not None)


def test_exported_files_read_back(spark, tmp_path):
    from litlake.sources.corpus import read_markdown_corpus

    corpus = spark.createDataFrame(
        [("arxiv", "hep-th/9901001", "# é\r\n"), ("manual", "a b+c%20", "x")], DOC + ", markdown string"
    )
    root = str(tmp_path / "store")
    assert files.export_markdown(corpus, root).count() == 2
    got = {(r.namespace, r.canonical_id): r.markdown for r in read_markdown_corpus(spark, root).collect()}
    assert got == {("arxiv", "hep-th/9901001"): "# é\r\n", ("manual", "a b+c%20"): "x"}


def test_exported_files_without_text_read_back(spark, tmp_path, monkeypatch):
    from litlake.sources import files as source
    from litlake.sources.corpus import read_markdown_corpus

    corpus = spark.createDataFrame(
        [("arxiv", "2401.00001", ""), ("manual", "x", "y"), ("manual", "none", None), ("manual", None, "z"), ("acl_anthology", "10.18653/v1/e", "")],
        DOC + ", markdown string",
    )
    root = str(tmp_path / "store")
    assert files.export_markdown(corpus, root).count() == 3
    (tmp_path / "store" / "no-folder").mkdir()
    want = {("arxiv", "2401.00001", ""), ("manual", "x", "y"), ("acl_anthology", "10.18653/v1/e", "")}
    read = lambda *a: {(r.namespace, r.canonical_id, r.markdown) for r in read_markdown_corpus(spark, root, *a).collect()}
    assert read() == want and read("arxiv") == {("arxiv", "2401.00001", "")} and read("no-folder") == set()
    monkeypatch.setattr(source, "_opens", lambda uri: False)  # as where only Hadoop knows the file system
    assert read() == want and read("arxiv") == {("arxiv", "2401.00001", "")}


def test_markdown_corpus_of_odd_documents_matches_sql(spark, tmp_path):
    import __spark_entry__ as entry
    from tests.compare import connect, difference, run_spark, run_sql

    rows = [(1, ""), (2, ""), (3, None), (4, "a\n\nb"), (-2, "n"), (-7, ""), (None, "m"), (11, "\n")]
    spark.createDataFrame(rows, "doc_id long, text string").toPandas().astype({"doc_id": "Int64"}).to_parquet(tmp_path / "documents.parquet")
    name = "read_markdown_corpus"
    got = run_spark(entry.queries()[name](spark, str(tmp_path)))
    assert len(got[1]) == len(rows) and difference(got, run_sql(connect(str(tmp_path)), entry.oracle_sql()[name])) is None


def test_driver_holds_no_list_of_markdown_files(spark, tmp_path):
    from litlake.sources.corpus import read_markdown_corpus

    folder = tmp_path / "manual" / "markdown"
    folder.mkdir(parents=True)
    for i in range(30):
        (folder / f"{i}.md").write_text(f"text {i}")
    read = read_markdown_corpus(spark, str(tmp_path))
    assert read.inputFiles() == [] and read.count() == 30
    (folder / "late.md").write_text("late")  # listed when the job runs
    assert read.count() == 31
