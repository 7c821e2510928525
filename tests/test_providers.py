"""Provider records: sources, normalisation, metadata, graph and bibliography rules."""

import json

import pytest
from pyspark.sql import functions as F

from litlake.operators import bibliography, graph, metadata, normalize, search, telemetry
from litlake.sources import corpus as files, dumps


def write(tmp_path, name, text):
    folder = tmp_path / name
    folder.mkdir()
    (folder / "part.txt").write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(folder)


FEED = """<?xml version="1.0" encoding="UTF-8"?>
<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom">
<title>query</title>
<entry><id>http://arxiv.org/abs/2301.00001v2</id><published>2023-01-01T00:00:00Z</published>
<title>A long
   title</title><summary>  Some
 text </summary>
<author><name> Ada Lovelace </name><arxiv:affiliation>Lab A</arxiv:affiliation><arxiv:affiliation> </arxiv:affiliation></author>
<author><name>Plato</name></author>
<arxiv:comment xmlns:arxiv="http://arxiv.org/schemas/atom">12 pages</arxiv:comment>
<link href="http://arxiv.org/abs/2301.00001v2" rel="alternate" type="text/html"/>
<link title="pdf" href="http://arxiv.org/pdf/2301.00001v2" rel="related"/>
<arxiv:primary_category term="cs.CL" scheme="s"/><category term="cs.CL"/><category term=""/></entry>
<entry><id>http://arxiv.org/api/errors#bad</id><title>Error</title></entry>
<entry><id>http://arxiv.org/abs/2301.00002v1</id></entry>
</feed>"""


def test_arxiv_feed(spark, tmp_path):
    entries = dumps.read_arxiv_atom(spark, write(tmp_path, "feed", FEED))
    good, errors = normalize.split_arxiv_errors(entries)
    assert [r.id for r in errors.collect()] == ["http://arxiv.org/api/errors#bad"]
    full, bare = normalize.normalize_arxiv(good).orderBy("id").collect()
    assert (full.title, full.summary, full.comment, full.doi) == ("A long title", "Some text", "12 pages", None)
    assert [(a.name, a.affiliations) for a in full.authors] == [("Ada Lovelace", ["Lab A"]), ("Plato", [])]
    assert (full.categories, full.primary_category) == (["cs.CL"], "cs.CL")
    assert [(k.rel, k.title) for k in full.links] == [("alternate", None), ("related", "pdf")]
    assert (bare.title, bare.published, bare.authors, bare.links, bare.journal_ref) == ("", "", [], [], None)
    meta = metadata.unified_metadata(normalize.normalize_arxiv(good), "arxiv").orderBy("arxiv_id").first()
    assert (meta._canonical_id, meta.arxiv_id, meta.pdf_url) == (
        "2301.00001", "2301.00001v2", "http://arxiv.org/pdf/2301.00001v2",
    )
    slim = metadata.triage_arxiv(normalize.normalize_arxiv(good)).orderBy("arxiv_id").collect()
    assert [(r.first_author, r.author_count, r.published_year) for r in slim] == [("Ada Lovelace", 2, 2023), (None, 0, None)]


@pytest.mark.parametrize(
    "text, names",
    [
        ("Last, First; Solo", ["First Last", "Solo"]),
        ("Smith, J., Jr.; ; X ,", ["J., Jr. Smith", "X"]),
        ("", []),
        (None, []),
    ],
)
def test_author_strings(spark, text, names):
    df = spark.createDataFrame([(text,)], "a string")
    got = df.select(normalize.parse_author_string(F.col("a"))).first()[0]
    assert [a.name for a in got] == names


def test_preprint_versions(spark, tmp_path):
    record = lambda **k: {"doi": "10.1101/a", "server": "medRxiv", "published": "NA", **k}
    lines = [
        {"collection": [record(version="2", title="two"), record(version="10", title="ten"), record(version="10", title="tie")]},
        {"collection": [record(doi="10.1101/b", server="x", published="10.1/J", title="none")]},
        {"collection": []},
    ]
    path = write(tmp_path, "bio", "\n".join(map(json.dumps, lines)))
    raw = dumps.read_biorxiv_details(spark, path)
    got = {r.doi: r for r in normalize.normalize_biorxiv(normalize.latest_version(raw, "pos")).collect()}
    a, b = got["10.1101/a"], got["10.1101/b"]
    assert (a.title, a.server, a.published_doi) == ("ten", "medrxiv", None)
    assert a.pdf_url == "https://www.medrxiv.org/content/10.1101/av10.full.pdf"
    assert (b.version, b.server, b.published_doi) == ("1", "biorxiv", "10.1/J")


def test_citation_ids(spark):
    marks = ["omid:br/1 doi:10.1/a:b pmid:7 junk doi:10.2/c", "doi:10.1/x", "", None, "nocolon"]
    df = spark.createDataFrame([(i, m, None, "yes", None) for i, m in enumerate(marks)],
                               "i int, ids string, creation string, journal_sc string, author_sc string")
    got = normalize.normalize_citations(df, "ids").orderBy("i").collect()
    assert [r.ids for r in got] == [
        {"omid": "br/1", "pmid": "7", "doi": "10.2/c"}, {"doi": "10.1/x"}, {}, {}, {},
    ]
    assert got[0].journal_self_citation is True and got[0].author_self_citation is False


def test_markdown_cleaning(spark):
    df = spark.createDataFrame([("a  \t\nb \n![cap](img/x.png) ![](y)\n",)], "markdown string")
    assert normalize.clean_converted_markdown(df).first()[0] == "a\nb\n![cap]() ![]()\n"


def test_wikipedia(spark, tmp_path):
    lines = ['["q",["A","B"],["",""],["u1","u2","u3"]]', '["q",["A"]]', '{"error":1}', '["e",[],[],[]]']
    hits = dumps.read_wikipedia_search(spark, write(tmp_path, "search", "\n".join(lines))).orderBy("pos").collect()
    assert [(r.title, r.url) for r in hits] == [("A", "u1"), ("B", "u2")]
    docs = [{"title": "Red Fox", "type": "disambiguation", "content_urls": {"desktop": {"page": "u"}}}, {"title": "Bare"}]
    pages = normalize.normalize_summaries(
        dumps.read_wikipedia(spark, write(tmp_path, "pages", "\n".join(map(json.dumps, docs))))
    )
    asked = spark.createDataFrame([(0, " red fox "), (1, "bare"), (2, "none")], "request_id int, title string")
    got = {r.request_id: tuple(r)[1:5] for r in metadata.page_status(asked, pages).collect()}
    assert got == {
        0: ("Red Fox", True, True, "u"), 1: ("Bare", True, False, ""), 2: ("none", False, False, None),
    }


def test_openalex_and_crossref_answers(spark, tmp_path):
    works = [{"doi": "https://doi.org/10.1/A", "title": "one", "abstract_inverted_index": {"b": [1], "a": [0, 2]}},
             {"results": [{"doi": "https://doi.org/10.1/B", "title": "two"}]}]
    read = dumps.read_openalex(spark, write(tmp_path, "oa", "\n".join(map(json.dumps, works))))
    got = {r._canonical_id: r.abstract for r in metadata.abstracts(read, "openalex").collect()}
    assert got == {"10.1/a": "a b a", "10.1/b": None}
    item = lambda doi, **k: {"DOI": doi, "title": ["T"], **k}
    answers = [
        {"message": item("10.1/A", author=[{}, {"family": "F"}], **{"published-online": {"date-parts": [[2001, 2]]}})},
        {"message": {"items": [item("10.1/B", author=[{"given": "G", "family": "F"}], **{
            "published-print": {"date-parts": [[1999]]}, "published-online": {"date-parts": [[2001]]}}), item("10.1/C")]}},
    ]
    slim = metadata.triage_crossref(dumps.read_crossref(spark, write(tmp_path, "cr", "\n".join(map(json.dumps, answers)))))
    assert sorted(map(tuple, slim.collect())) == [
        ("10.1/A", "T", "F", 2, 2001), ("10.1/B", "T", "G F", 1, 1999), ("10.1/C", "T", None, 0, None),
    ]


def test_markdown_files_and_pdfs(spark, tmp_path):
    for ns, name, body in [("arxiv", "hep-th_9901001.md", b"# T\n"), ("manual", "a+b c.md", b"bad \xff byte"), ("arxiv", "x.txt", b"no")]:
        folder = tmp_path / "store" / ns / "markdown"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(body)
    root = str(tmp_path / "store")
    got = {r.canonical_id: r.markdown for r in files.read_markdown_corpus(spark, root).collect()}
    assert got == {"hep-th/9901001": "# T\n", "a+b c": "bad � byte"}
    assert files.read_markdown_corpus(spark, root, "manual").count() == 1
    pdfs = tmp_path / "pdfs"
    pdfs.mkdir()
    for name, body in [("ok.pdf", b"%PDF-1.7 x"), ("fake.pdf", b"<html>"), ("big.pdf", b"%PDF-" + b"x" * 100)]:
        (pdfs / name).write_bytes(body)
    blobs = {r.path.rsplit("/", 1)[1]: r for r in files.read_pdf_blobs(spark, str(pdfs), 50).collect()}
    assert bytes(blobs["ok.pdf"].content) == b"%PDF-1.7 x" and blobs["ok.pdf"].error is None
    assert "header" in blobs["fake.pdf"].error
    assert "exceeds 50" in blobs["big.pdf"].error and blobs["big.pdf"].content is None


def test_reference_sources(spark):
    doi = lambda *d: spark.createDataFrame([(x,) for x in d], "doi string")
    counts = graph.reference_counts(
        doi("more", "tie", "less", "cr-failed", "oc-failed", "none", "empty"),
        doi("more", "more", "tie", "oc-failed"),
        doi("more", "tie", "less", "oc-failed", "empty"),
        doi("more", "tie", "less", "cr-failed", "extra"),
        doi("more", "tie", "less", "cr-failed", "empty", "extra"),
    )
    rows = {r.doi: r for r in counts.collect()}
    assert set(rows) == {"more", "tie", "less", "cr-failed", "oc-failed", "none", "empty"}
    assert (rows["empty"].crossref_count, rows["empty"].opencitations_count) == (0, 0)
    assert rows["cr-failed"].crossref_error and rows["cr-failed"].opencitations_count == 1
    best = {r.doi: (r.best_source, r.best_count) for r in graph.best_reference_source(counts).collect()}
    assert best == {
        "more": ("crossref", 2), "tie": ("crossref", 1), "less": ("opencitations", 1),
        "cr-failed": ("opencitations", 1), "oc-failed": ("crossref", 1), "none": (None, None), "empty": ("crossref", 0),
    }


def test_bibtex_entries(spark, tmp_path):
    work = {
        "doi": "https://doi.org/10.48550/arXiv.1706.03762", "title": "Fast & Loose_1", "type": "preprint",
        "publication_year": 2017, "ids": {"openalex": "https://openalex.org/W1"},
        "authorships": [{"author": {"display_name": "Henk van Til"}, "institutions": [{"display_name": "U"}]}],
    }
    more = [
        {**work, "type": "dissertation", "doi": "https://doi.org/10.1/d"},
        {**work, "doi": "https://doi.org/10.1/p"},
        {"doi": "https://doi.org/10.1/e", "type": "mystery", "title": None, "authorships": []},
        {**work, "type": "book-chapter", "doi": "https://doi.org/10.1/c", "biblio": {"first_page": "1"},
         "primary_location": {"source": {"display_name": "Venue & Co"}}},
    ]
    read = dumps.read_openalex(spark, write(tmp_path, "works", "\n".join(json.dumps(w) for w in [work, *more])))
    got = {r._canonical_id: r.bibtex for r in bibliography.bibtex_openalex(read).collect()}
    assert got["10.48550/arxiv.1706.03762"] == (
        "@misc{vantil2017fast,\n  title={Fast \\& Loose\\_1},\n  author={van Til, Henk},\n  year={2017},\n"
        "  doi={10.48550/arXiv.1706.03762},\n  eprint={1706.03762},\n  archiveprefix={arXiv}\n}"
    )
    assert "@phdthesis" in got["10.1/d"] and "  school={U}" in got["10.1/d"]
    assert "  howpublished={\\url{https://doi.org/10.1/p}}" in got["10.1/p"]
    assert got["10.1/e"] == "@misc{unknownuntitled,\n  title={},\n  doi={10.1/e}\n}"
    assert "@incollection" in got["10.1/c"] and "  booktitle={Venue \\& Co}" in got["10.1/c"] and "  pages={1}" in got["10.1/c"]


def test_field_search_operators(spark):
    papers = spark.createDataFrame(
        [("http://arxiv.org/abs/1", "Graph nets", [("Ada",)], "s", ["cs.LG"], "2020"),
         ("http://arxiv.org/abs/2", "Graph theory", [("Bob",)], "s", ["math.CO"], "x")],
        "id string, title string, authors array<struct<name:string>>, summary string, categories array<string>, published string",
    )
    find = lambda **k: [(r.arxiv_id, r.total_results) for r in search.search_papers(papers, **k).collect()]
    assert find(ti="GRAPH", au="ada") == [("1", 1)]
    assert find(ti="theory", cat="cs.LG", op="OR") == [("1", 2), ("2", 2)]
    assert find(ti="graph", cat="cs.LG", op="ANDNOT") == [("2", 1)]
    assert find(ti="graph", max_results=1) == [("1", 2)]


def test_error_classes_and_delays(spark):
    log = spark.createDataFrame(
        [(0, "arXiv", 429, "7", "", None), (1, "arXiv", 429, "soon", "", None), (2, "arXiv", 503, None, "", None),
         (3, "arXiv", 404, None, "b" * 300, None), (4, "arXiv", None, None, "reset", "network"),
         (9, "arXiv", 404, None, None, None),
         (5, "arXiv", None, None, "", "timeout"), (6, "arXiv", 200, None, "", None), (7, "arXiv", 429, "999", "", None),
         (8, "arXiv", 429, "-1", "", None)],
        "id int, provider string, status int, retry_after string, body string, failure string",
    )
    got = {r.id: r for r in telemetry.classify_errors(log).collect()}
    assert got[0].retry_after_seconds == 7.0 and "rate limit" in got[0].error
    assert got[1].retry_after_seconds is None and got[8].retry_after_seconds is None
    assert "server error (HTTP 503)" in got[2].error
    assert got[3].error == "arXiv HTTP 404: " + "b" * 200
    assert got[4].error == "arXiv network error: reset" and "timed out" in got[5].error and got[6].error is None
    assert got[9].error == "arXiv HTTP 404: "
    waits = {r.id: r.delay for r in telemetry.retry_delay(log, 2.0).collect()}
    assert waits == {0: 7.0, 1: 2.0, 2: 2.0, 3: None, 4: 2.0, 5: 2.0, 6: None, 7: 60.0, 8: 2.0, 9: None}


def test_author_pages_and_profiles(spark, tmp_path):
    author = lambda n, *inst: {"author": {"display_name": n}, "institutions": [{"display_name": i} for i in inst]}
    work = {"doi": "https://doi.org/10.1/A", "authorships": [author("A", "U", None), author("B", "V", "U"), author("C", "", "W"), {"author": {"display_name": "D"}}]}
    read = dumps.read_openalex(spark, write(tmp_path, "w", json.dumps(work)))
    pages = [metadata.authors_page(read, p, 2).first() for p in (1, 2, 3)]
    assert [[a.name for a in p.authors] for p in pages] == [["A", "B"], ["C", "D"], []]
    assert [p.has_more for p in pages] == [True, False, False]
    assert [p.page_institutions for p in pages] == [["U", "V"], ["W"], []]
    assert [a.institutions for a in pages[0].authors] == [["U"], ["V", "U"]] and pages[2].author_count == 4
    people = [
        {"id": "A1", "display_name": "N", "topics": [{"display_name": f"t{i}", "count": 9 - i} for i in range(7)],
         "affiliations": [{"institution": {"display_name": "U"}, "years": [2003, 2001]}, {"institution": {"display_name": "V"}}],
         "last_known_institutions": [{"display_name": ""}, {"display_name": "U"}], "summary_stats": {"h_index": 3}},
        {"id": "A2", "display_name": "M"},
    ]
    raw = dumps.read_openalex(spark, write(tmp_path, "a", "\n".join(map(json.dumps, people))), "authors")
    full, bare = metadata.author_profiles(raw).orderBy("openalex_id").collect()
    assert [t.name for t in full.top_topics] == ["t0", "t1", "t2", "t3", "t4"] and full.h_index == 3
    assert [(a.institution, a.years) for a in full.affiliations] == [("U", [2001, 2003]), ("V", [])]
    assert full.current_institutions == ["U"]
    assert (bare.top_topics, bare.affiliations, bare.current_institutions, bare.h_index) == ([], [], [], None)


def test_reference_pages(spark):
    doi = lambda *d: spark.createDataFrame([(x,) for x in d], "doi string")
    cr = spark.createDataFrame([("a", i, f"c{i}") for i in range(5)], "citing string, pos int, ref string")
    oc = spark.createDataFrame([("a", 0, "o0"), ("b", 1, "o1"), ("b", 0, "o0")], "citing string, pos int, cited string")
    known = doi("a", "b", "empty")
    named = lambda df: df.select(F.col("citing").alias("doi"))
    counts = graph.reference_counts(doi("a", "b", "empty", "lost"), named(cr), known, named(oc), known)
    page = lambda n, **k: {r.doi: r for r in graph.references_page(counts, cr, oc, ["pos"], n, 2, **k).collect()}
    first = page(1)
    assert [x.ref for x in first["a"].references] == ["c0", "c1"] and first["a"].has_more and first["a"].total == 5
    assert (first["b"]._source, [x.cited for x in first["b"].references]) == ("opencitations", ["o0", "o1"])
    assert first["b"].has_more is False and first["empty"].references == [] and first["lost"].error == graph.BOTH_FAILED
    assert [x.ref for x in page(3)["a"].references] == ["c4"] and page(9)["a"].references == []
    pinned = page(1, source="opencitations")
    assert (pinned["a"].total, [x.cited for x in pinned["a"].references]) == (1, ["o0"])
