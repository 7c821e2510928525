"""Bulk provider dumps with explicit schemas (never inferred)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMED = "struct<id:string,display_name:string>"

ARXIV_ENTRY = (
    "id string, title string, summary string, published string, updated string, "
    "author array<struct<name:string,affiliation:array<string>>>, "
    "category array<struct<_term:string>>, primary_category struct<_term:string>, "
    "link array<struct<_href:string,_rel:string,_title:string>>, "
    "comment string, journal_ref string, doi string"
)
BIORXIV_RECORD = (
    "struct<doi:string,title:string,authors:string,author_corresponding:string,"
    "author_corresponding_institution:string,date:string,version:string,type:string,"
    "license:string,category:string,abstract:string,server:string,published:string,"
    "jatsxml:string>"
)
OPENALEX_WORK = (
    "id string, doi string, title string, publication_year int, publication_date string, "
    "type string, language string, "
    f"authorships array<struct<author:{NAMED},author_position:string,is_corresponding:boolean,"
    "institutions:array<struct<display_name:string>>>>, "
    "primary_location struct<source:struct<display_name:string,host_organization_name:string>>, "
    "open_access struct<is_oa:boolean,oa_status:string,oa_url:string>, "
    "biblio struct<volume:string,issue:string,first_page:string,last_page:string>, "
    "ids struct<openalex:string,doi:string>, "
    "abstract_inverted_index map<string,array<int>>"
)
OPENALEX_AUTHOR = (
    "id string, display_name string, orcid string, works_count int, cited_by_count int, "
    "summary_stats struct<h_index:int,i10_index:int>, "
    "last_known_institutions array<struct<display_name:string>>, "
    "topics array<struct<display_name:string,count:int>>, "
    "affiliations array<struct<institution:struct<display_name:string,country_code:string>,"
    "years:array<int>>>"
)
CROSSREF_DATE = "struct<`date-parts`:array<array<int>>>"
CROSSREF_REFERENCE = (
    "struct<DOI:string,author:string,`article-title`:string,year:string,`journal-title`:string,"
    "volume:string,`first-page`:string,unstructured:string>"
)
CROSSREF_WORK = (
    "DOI:string,title:array<string>,author:array<struct<given:string,family:string>>,"
    f"`published-print`:{CROSSREF_DATE},`published-online`:{CROSSREF_DATE},"
    f"reference:array<{CROSSREF_REFERENCE}>,type:string"
)
OPENCITATIONS_EDGE = (
    "oci string, citing string, cited string, creation string, journal_sc string, author_sc string"
)
WIKIPEDIA_SUMMARY = (
    "title string, description string, extract string, type string, pageid bigint, "
    "content_urls struct<desktop:struct<page:string>>"
)


def read_arxiv_atom(spark: SparkSession, path: str) -> DataFrame:
    """One row per Atom ``entry``; namespace prefixes are dropped from names."""
    return (
        spark.read.format("xml")
        .schema(ARXIV_ENTRY)
        .option("rowTag", "entry")
        .option("ignoreNamespace", "true")
        .load(path)
    )


def read_biorxiv_details(spark: SparkSession, path: str) -> DataFrame:
    """``{"collection": [...]}`` documents, one row per version with its list position."""
    docs = spark.read.schema(f"collection array<{BIORXIV_RECORD}>").json(path)
    return docs.select(F.posexplode("collection").alias("pos", "r")).select("pos", "r.*")


def read_openalex(spark: SparkSession, path: str, entity: str = "works") -> DataFrame:
    """Works or authors: one record per line, or batch answers with ``results``."""
    fields = {"works": OPENALEX_WORK, "authors": OPENALEX_AUTHOR}[entity]
    empty = spark.createDataFrame([], fields)
    record = empty.schema.simpleString()
    lines = spark.read.schema(f"{fields}, results array<{record}>").json(path)
    # One scan: a single record is an answer with one result.
    single = F.array(F.struct(*empty.columns))
    return lines.select(F.inline(F.coalesce("results", single)))


def read_crossref(spark: SparkSession, path: str) -> DataFrame:
    """Work answers (``message``) and search answers (``message.items``) alike."""
    lines = spark.read.schema(
        f"message struct<{CROSSREF_WORK},items:array<struct<{CROSSREF_WORK}>>>"
    ).json(path)
    names = [f.name for f in lines.schema["message"].dataType.fields if f.name != "items"]
    single = lines.where("message is not null and message.items is null").select(
        *(F.col("message").getField(n).alias(n) for n in names)
    )
    listed = lines.where("message.items is not null").select(F.inline("message.items"))
    return single.unionByName(listed)


def read_opencitations(spark: SparkSession, path: str, direction: str) -> DataFrame:
    """Raw edge records with the DOI they were asked for.

    References carry the cited side's ``ids`` and were asked by the citing side,
    citations the other way round; ``asked`` is that side's DOI.
    """
    field = {"references": "cited", "citations": "citing"}[direction]
    edges = spark.read.schema(OPENCITATIONS_EDGE).json(path)
    near = {"cited": "citing", "citing": "cited"}[field]
    doi = F.regexp_extract(near, r"(?:^|\s)doi:(\S+)", 1)
    return edges.select(
        "oci",
        F.when(doi != "", F.lower(doi)).alias("asked"),
        F.col(field).alias("ids"),
        "creation",
        "journal_sc",
        "author_sc",
    )


def read_wikipedia(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(WIKIPEDIA_SUMMARY).json(path)


def read_wikipedia_search(spark: SparkSession, path: str) -> DataFrame:
    """Search answers ``[query, [titles], [descriptions], [urls]]``, one row per hit.

    Answers with fewer than four elements give no rows.
    """
    raw = spark.read.text(path).select(
        F.from_json("value", "array<string>").alias("parts")
    )
    lists = raw.where(F.size("parts") >= 4).select(
        F.get("parts", F.lit(0)).alias("query"),
        F.from_json(F.get("parts", F.lit(1)), "array<string>").alias("titles"),
        F.from_json(F.get("parts", F.lit(3)), "array<string>").alias("urls"),
    )
    pairs = F.slice(
        F.arrays_zip("titles", "urls"), F.lit(1), F.least(F.size("titles"), F.size("urls"))
    )
    return lists.select("query", F.posexplode(pairs).alias("pos", "hit")).select(
        "query", "pos", F.col("hit.titles").alias("title"), F.col("hit.urls").alias("url")
    )
