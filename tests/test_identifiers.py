import hashlib

import pytest
from pyspark.sql import functions as F

from litlake.functions import identifiers as ids
from litlake.operators.identifiers import plan_downloads, resolve_identifiers, route_imports

SPELLINGS = [
    # raw, source, namespace, canonical id
    ("2301.00001v2", "arxiv", "arxiv", "2301.00001"),
    ("https://arxiv.org/abs/2301.00001v3", "arxiv", "arxiv", "2301.00001"),
    ("http://arxiv.org/pdf/2301.00001.pdf", "arxiv", "arxiv", "2301.00001"),
    ("hep-th/0412345v1", "arxiv", "arxiv", "hep-th/0412345"),
    ("math.GT/0309136", None, "manual", "math.gt/0309136"),
    ("HEP-TH/0412345", None, "manual", "hep-th/0412345"),
    ("10.1101/2022.05.06.123457", "biorxiv", "biorxiv", "10.1101/2022.05.06.123457"),
    ("DOI:10.1101/2022.05.06.123457", "biorxiv", "biorxiv", "10.1101/2022.05.06.123457"),
    ("https://www.biorxiv.org/content/10.1101/2024.05v3.full.pdf", "biorxiv", "biorxiv", "10.1101/2024.05"),
    ("https://medrxiv.org/content/10.1101/2020.01v2.full", "biorxiv", "biorxiv", "10.1101/2020.01"),
    ("10.18653/v1/2019.demo-short.17", "openalex", "acl_anthology", "10.18653/v1/2019.demo-short.17"),
    ("10.18653/V1/2019.demo-short.17", "openalex", "manual", "10.18653/v1/2019.demo-short.17"),
    ("https://doi.org/10.1234/ABC", "openalex", "manual", "10.1234/abc"),
    ("  doi:10.1234/ABC ", "openalex", "manual", "10.1234/abc"),
    ("https://dx.doi.org/10.1234/ABC", "openalex", "manual", "10.1234/abc"),
    ("My Paper", None, "manual", "my paper"),
]


def test_routes(spark):
    raw = spark.createDataFrame([(s[0],) for s in SPELLINGS], "raw string")
    got = {r.raw: r for r in resolve_identifiers(raw).collect()}
    for text, source, namespace, canonical in SPELLINGS:
        r = got[text]
        assert (r.source, r.namespace, r.canonical_id) == (source, namespace, canonical)
        assert r.key_sha == hashlib.sha256(canonical.encode()).hexdigest()


@pytest.mark.parametrize(
    "namespace, stem, restored",
    [
        ("arxiv", "hep-th_0412345", "hep-th/0412345"),
        ("arxiv", "cs_0301001", "cs_0301001"),
        ("arxiv", "2301.00001", "2301.00001"),
        ("biorxiv", "10.1101_2024_05", "10.1101/2024_05"),
        ("acl_anthology", "10.18653_v1_x_1", "10.18653/v1/x_1"),
        ("manual", "10.1101_x", "10.1101_x"),
    ],
)
def test_stems(spark, namespace, stem, restored):
    row = spark.createDataFrame([(namespace, stem)], "n string, s string")
    assert row.select(ids.canonical_from_stem(F.col("n"), F.col("s"))).first()[0] == restored


def test_author_keys(spark):
    raw = ["A123", "https://openalex.org/A123", "https://orcid.org/0000-0001-6187-661X"]
    df = spark.createDataFrame([(r,) for r in raw], "a string")
    assert [r[0] for r in df.select(ids.author_key(F.col("a"))).collect()] == [
        "a123", "a123", "https://orcid.org/0000-0001-6187-661x",
    ]


def test_download_plan(spark):
    raw = ["hep-th/0412345", "10.1101/x", "doi:10.18653/v1/2019.demo-short.17", "10.1234/a"]
    got = {r.raw: r for r in plan_downloads(spark.createDataFrame([(r,) for r in raw], "raw string")).collect()}
    assert got[raw[0]].pdf_url == "https://arxiv.org/pdf/hep-th/0412345"
    assert got[raw[1]].pdf_url == "https://www.biorxiv.org/content/10.1101/xv1.full.pdf"
    assert got[raw[2]].pdf_url == "https://aclanthology.org/2019.demo-short.17.pdf"
    assert got[raw[3]].pdf_url is None and got[raw[3]].error and got[raw[3]].suggestion


def test_import_routes(spark):
    paths = {"/a/b.PDF": "pdf", "x.md": "markdown", "/d.v1/y.Markdown": "markdown", "/a/.md": None, "/a.md/b": None}
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r.path: (r.route, r.error) for r in route_imports(df).collect()}
    assert {p: r for p, (r, _) in got.items()} == paths
    assert all((route is None) == (error is not None) for route, error in got.values())
