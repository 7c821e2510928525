"""Provider records to the common column shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litlake.functions import text as tx
from litlake.operators.spread import first_per_key


def _text(c: Column) -> Column:
    """Trimmed element text; empty elements count as absent."""
    return tx.blank_to_null(tx.strip(c))


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def normalize_arxiv(entries: DataFrame) -> DataFrame:
    """Atom entries to papers; required texts default to ``''``, optional ones to null."""
    no_text = F.array().cast("array<string>")
    return entries.select(
        _or_empty(_text(F.col("id"))).alias("id"),
        _or_empty(tx.collapse(F.col("title"))).alias("title"),
        _or_empty(tx.collapse(F.col("summary"))).alias("summary"),
        _or_empty(_text(F.col("published"))).alias("published"),
        _or_empty(_text(F.col("updated"))).alias("updated"),
        F.coalesce(
            F.transform(
                "author",
                lambda a: F.struct(
                    _or_empty(tx.strip(a["name"])).alias("name"),
                    F.coalesce(
                        F.filter(
                            F.transform(a["affiliation"], tx.strip),
                            lambda x: x.isNotNull() & (x != ""),
                        ),
                        no_text,
                    ).alias("affiliations"),
                ),
            ),
            F.array().cast("array<struct<name:string,affiliations:array<string>>>"),
        ).alias("authors"),
        F.coalesce(
            F.filter(
                F.transform("category", lambda c: c["_term"]), lambda t: t.isNotNull() & (t != "")
            ),
            no_text,
        ).alias("categories"),
        _or_empty(F.col("primary_category._term")).alias("primary_category"),
        F.coalesce(
            F.transform(
                "link",
                lambda k: F.struct(
                    _or_empty(k["_href"]).alias("href"),
                    _or_empty(k["_rel"]).alias("rel"),
                    tx.blank_to_null(k["_title"]).alias("title"),
                ),
            ),
            F.array().cast("array<struct<href:string,rel:string,title:string>>"),
        ).alias("links"),
        _text(F.col("comment")).alias("comment"),
        _text(F.col("journal_ref")).alias("journal_ref"),
        _text(F.col("doi")).alias("doi"),
    )


def split_arxiv_errors(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Papers and error entries: a failed lookup arrives as a normal-looking entry."""
    failed = F.coalesce(F.col("id"), F.lit("")).contains("api/errors")
    return entries.where(~failed), entries.where(failed)


def parse_author_string(c: Column) -> Column:
    """``"Last, First; Last, First"`` to ``array<struct<name>>``; only the first comma splits."""

    def person(part: Column) -> Column:
        last = tx.strip(F.substring_index(part, ",", 1))
        first = tx.strip(F.substr(part, F.instr(part, ",") + 1))
        return F.struct(
            F.when(
                part.contains(",") & (first != ""), tx.strip(F.concat(first, F.lit(" "), last))
            )
            .when(part.contains(","), last)
            .otherwise(part)
            .alias("name")
        )

    parts = F.filter(
        F.transform(F.split(F.coalesce(c, F.lit("")), ";", -1), tx.strip), lambda p: p != ""
    )
    return F.transform(parts, person)


def normalize_biorxiv(df: DataFrame) -> DataFrame:
    server = F.when(F.lower("server").contains("medrxiv"), F.lit("medrxiv")).otherwise(
        F.lit("biorxiv")
    )
    version = F.coalesce(F.col("version"), F.lit("1"))
    doi = _or_empty(F.col("doi"))
    return df.select(
        doi.alias("doi"),
        _or_empty(F.col("title")).alias("title"),
        parse_author_string(F.col("authors")).alias("authors"),
        "author_corresponding",
        "author_corresponding_institution",
        _or_empty(F.col("abstract")).alias("abstract"),
        "date",
        version.alias("version"),
        "type",
        "license",
        "category",
        server.alias("server"),
        F.nullif(F.col("published"), F.lit("NA")).alias("published_doi"),
        "jatsxml",
        F.concat(
            F.lit("https://www."), server, F.lit(".org/content/"), doi, F.lit("v"), version,
            F.lit(".full.pdf"),
        ).alias("pdf_url"),
    )


def latest_version(df: DataFrame, *position: str) -> DataFrame:
    """One row per DOI: the highest numeric version, the first in ``position`` on ties."""
    number = F.coalesce(F.col("version").try_cast("int"), F.lit(0))
    return first_per_key(df, ["doi"], [number.desc(), *(F.col(c).asc() for c in position)])


def parse_ids(c: Column) -> Column:
    """Space-separated ``prefix:value`` marks to a map; the last of equal prefixes wins."""

    def build(toks: Column) -> Column:
        prefix = F.transform(toks, lambda t: F.substring_index(t, ":", 1))
        return tx.let(
            F.reverse(prefix),
            lambda back: F.map_from_entries(
                F.filter(
                    F.transform(
                        toks,
                        lambda t, i: F.when(
                            F.array_position(back, F.substring_index(t, ":", 1))
                            == F.size(toks) - i,
                            F.struct(
                                F.substring_index(t, ":", 1).alias("key"),
                                F.substr(t, F.instr(t, ":") + 1).alias("value"),
                            ),
                        ),
                    ),
                    lambda e: e.isNotNull(),
                )
            ),
        )

    marks = F.filter(tx.words(F.coalesce(c, F.lit(""))), lambda t: t.contains(":"))
    return tx.let(marks, build)


def normalize_citations(df: DataFrame, id_field: str) -> DataFrame:
    """Raw edge records to parsed ids, creation date and two self-citation flags."""
    yes = lambda name: F.coalesce(F.col(name) == "yes", F.lit(False))
    rest = [c for c in df.columns if c not in ("ids", "journal_sc", "author_sc", "creation")]
    return df.select(
        *rest,
        parse_ids(F.col(id_field)).alias("ids"),
        "creation",
        yes("journal_sc").alias("journal_self_citation"),
        yes("author_sc").alias("author_self_citation"),
    )


def normalize_summaries(df: DataFrame) -> DataFrame:
    return df.select(
        _or_empty(F.col("title")).alias("title"),
        "description",
        _or_empty(F.col("extract")).alias("extract"),
        _or_empty(F.col("content_urls.desktop.page")).alias("url"),
        _or_empty(F.col("type")).alias("type"),
        "pageid",
    )


def cleaned_markdown(c: Column) -> Column:
    """Right-trim every line; keep image captions but drop image paths."""
    trimmed = F.regexp_replace(c, rf"(?mdU){tx.WS_INLINE}+$", "")
    return F.regexp_replace(trimmed, r"!\[([^\]]*)\]\([^)]*\)", r"![$1]()")


def clean_converted_markdown(df: DataFrame, col: str = "markdown") -> DataFrame:
    return df.withColumn(col, cleaned_markdown(F.col(col)))
