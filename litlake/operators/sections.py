"""Markdown sections: segmentation, selection, slices, staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litlake.functions import text as tx
from litlake.operators.spread import match_keys, keyed_join
from litlake.session import pin

DOC = ["namespace", "canonical_id"]
DEFAULT_SLICE = 16000


def document_key(*cols: str) -> Column:
    """One string that identifies a stored document."""
    return F.concat_ws("\x00", *(cols or DOC))


def parse_sections(corpus: DataFrame) -> DataFrame:
    """One row per section; a pure projection, documents are never shuffled."""
    return corpus.select(
        *DOC, F.inline(tx.section_array(F.col("markdown")))
    ).select(*DOC, "index", "title", "h3s", "approx_tokens", "content")


def section_content(sections: DataFrame) -> DataFrame:
    """Stripped text with its own size; tokens here count the stripped text."""
    return sections.select(
        *DOC,
        "index",
        "title",
        "content",
        F.length("content").alias("total_chars"),
        tx.approx_tokens(F.col("content")).alias("approx_tokens"),
    )


def section_totals(sections: DataFrame) -> DataFrame:
    return sections.groupBy(*DOC).agg(
        F.count(F.lit(1)).alias("total_sections"),
        F.sum("approx_tokens").alias("total_approx_tokens"),
    )


def slice_of(content: Column, offset: Column, max_chars: Column) -> dict[str, Column]:
    """Columns of one slice of a section text, with the bounds checks."""
    total = F.length(content)
    # Message texts that clients read.
    error = (
        F.when(max_chars <= 0, F.concat(F.lit("max_chars must be positive, got "), max_chars.cast("string")))
        .when(offset < 0, F.concat(F.lit("offset must be non-negative, got "), offset.cast("string")))
        .when(
            offset > total,
            F.format_string("offset %d is beyond section length %d", offset, total),
        )
    )
    ok = error.isNull() & content.isNotNull()
    end = F.least(offset + max_chars, total)
    return {
        "content": F.when(ok, F.substr(content, offset + 1, max_chars)),
        "offset": F.when(ok, offset),
        "chars_returned": F.when(ok, end - offset),
        "total_chars": F.when(ok, total),
        "has_more": F.when(ok, end < total),
        "next_offset": F.when(ok & (end < total), end),
        "error": error,
    }


def slice_sections(sections: DataFrame, offset: int = 0, max_chars: int = DEFAULT_SLICE) -> DataFrame:
    """The same slice of every section, beside the size of the whole section."""
    parts = slice_of(F.col("content"), F.lit(offset), F.lit(max_chars))
    return sections.select(
        *DOC, "index", "title", "approx_tokens", *(c.alias(n) for n, c in parts.items())
    )


def chunk_sections(sections: DataFrame, max_chars: int = DEFAULT_SLICE) -> DataFrame:
    """All successive slices of every section; their concatenation is the section."""
    starts = F.sequence(F.lit(0), F.length("content") - 1, F.lit(max_chars))
    return sections.select(*DOC, "index", "title", "content", F.posexplode(starts)).select(
        *DOC,
        "index",
        "title",
        F.col("pos").alias("chunk"),
        F.col("col").alias("offset"),
        F.substr("content", F.col("col") + 1, F.lit(max_chars)).alias("text"),
        (F.col("col") + max_chars < F.length("content")).alias("has_more"),
    )


def select_sections(
    requests: DataFrame,
    corpus: DataFrame,
    offset: int = 0,
    max_chars: int = DEFAULT_SLICE,
) -> DataFrame:
    """Resolve ``(namespace, canonical_id, section)`` requests to section slices.

    ``section`` is an index when it is all digits (optionally signed), else a
    case-insensitive part of a title. Only requested documents are cut up, and
    each request meets its document once, as an array of sections, so a
    document's sections never multiply the rows.
    ``request_id`` identifies a request.
    """
    wanted = match_keys(corpus, requests, DOC, "left_semi")
    docs = wanted.select(
        document_key().alias("_doc"), tx.section_array(F.col("markdown")).alias("_sections")
    )
    asked = requests.withColumn("_doc", document_key())
    joined = keyed_join(asked, docs, "_doc", "left", spread=["request_id"])

    number = F.col("section").try_cast("int")
    numeric = F.col("section").rlike(r"^\s*[+-]?\d+\s*$")
    count = F.size("_sections")
    titles = F.array_join(F.transform("_sections", lambda s: s["title"]), ", ")
    hits = F.filter(
        "_sections", lambda s: F.lower(s["title"]).contains(F.lower(F.col("section")))
    )
    chosen = F.when(
        numeric, F.when((number >= 0) & (number < count), F.get("_sections", number))
    ).when(F.size(hits) == 1, F.get(hits, F.lit(0)))
    error = (
        F.when(F.col("_sections").isNull(), F.lit("Paper not converted yet"))
        .when(
            numeric & chosen.isNull(),
            F.format_string("Section index %s out of range (0-%d)", F.trim("section"), count - 1),
        )
        .when(
            ~numeric & (F.size(hits) > 1),
            F.concat(
                F.lit("Ambiguous section title. Matches: "),
                F.array_join(F.transform(hits, lambda s: s["title"]), ", "),
            ),
        )
        .when(~numeric & (F.size(hits) == 0), F.concat(F.lit("No section matching. Available: "), titles))
    )
    picked = joined.select(
        *requests.columns, chosen.alias("_chosen"), error.alias("_error")
    )
    parts = slice_of(F.col("_chosen.content"), F.lit(offset), F.lit(max_chars))
    slice_error = parts.pop("error")
    return picked.select(
        *requests.columns,
        F.col("_chosen.index").alias("index"),
        F.col("_chosen.title").alias("title"),
        *(c.alias(n) for n, c in parts.items()),
        F.coalesce("_error", slice_error).alias("error"),
    )


def titles(corpus: DataFrame) -> DataFrame:
    return corpus.select(*DOC, tx.first_title(F.col("markdown")).alias("title"))


def section_at_offset(corpus: DataFrame, offsets: DataFrame) -> DataFrame:
    """``offsets(namespace, canonical_id, offset)`` with the section they fall in.

    A document's headings go to its requests, not its text.
    """
    docs = corpus.select(
        document_key().alias("_doc"), tx.section_starts(F.col("markdown")).alias("_starts")
    )
    asked = offsets.withColumn("_doc", document_key())
    joined = keyed_join(asked, docs, "_doc")
    return joined.select(
        *offsets.columns, tx.title_at(F.col("_starts"), F.col("offset")).alias("section")
    )


def document_stats(corpus: DataFrame) -> DataFrame:
    return corpus.select(
        *DOC,
        F.length("markdown").alias("char_count"),
        F.sha2("markdown", 256).alias("md_sha256"),
    )


def section_index(corpus: DataFrame) -> DataFrame:
    """Stored form of a document's sections: one row, with the text's checksum."""
    return corpus.select(
        *DOC,
        F.transform(
            tx.section_array(F.col("markdown")),
            lambda s: F.struct(
                s["index"].alias("index"),
                s["title"].alias("title"),
                s["h3s"].alias("h3s"),
                s["approx_tokens"].alias("approx_tokens"),
            ),
        ).alias("sections"),
        F.sha2("markdown", 256).alias("md_sha256"),
    )


def refresh_sections(corpus: DataFrame, stored: DataFrame) -> DataFrame:
    """Re-segment only documents whose stored checksum is missing or different.

    Keys and checksums alone decide (a stored ``md_sha256`` of the corpus is
    used where there is one); text is read for stale documents only.
    ``refreshed`` tells which rows were recomputed.
    """
    checksum = (
        F.col("md_sha256") if "md_sha256" in corpus.columns else F.sha2("markdown", 256)
    )
    current = corpus.select(*DOC, checksum.alias("_now"))
    checked = pin(
        current.join(stored.select(*DOC, "md_sha256"), DOC, "left").select(
            *DOC, F.coalesce(F.col("md_sha256") == F.col("_now"), F.lit(False)).alias("_same")
        ),
        "checked",
    )
    fresh = stored.join(checked.where("_same").select(*DOC), DOC).select(
        *DOC, "sections", "md_sha256", F.lit(False).alias("refreshed")
    )
    stale = match_keys(corpus, checked.where("not _same"), DOC, "left_semi")
    return fresh.unionByName(section_index(stale).withColumn("refreshed", F.lit(True)))


def cascade_invalidate(
    corpus: DataFrame, stored: DataFrame, downloads: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Drop text and sections of papers whose file was really replaced.

    ``downloads(namespace, canonical_id, cached, forced, error)``; a served-from
    -store file or a failed download changes nothing.
    """
    replaced = (
        downloads.where(F.col("forced") & F.col("error").isNull() & (F.col("cached") == F.lit(False)))
        .select(*DOC)
    )
    return (
        match_keys(corpus, replaced, DOC, "left_anti"),
        match_keys(stored, replaced, DOC, "left_anti"),
    )
