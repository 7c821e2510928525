"""Literal search inside documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litlake.functions import text as tx
from litlake.operators.sections import DOC
from litlake.operators.spread import at_least_one

SIDE = 60


def find_in_documents(
    corpus: DataFrame,
    query: str,
    max_results: int = 20,
    case_sensitive: bool = False,
    whole_words: bool = False,
) -> DataFrame:
    """First ``max_results`` hits of every document, in document order.

    Offsets count characters of the section's stripped text, so they can be fed
    back to the section slices. The whole search runs inside each document's
    row; an empty query gives no rows.
    """
    limit = at_least_one("max_results", max_results)
    if not query:
        corpus = corpus.where(F.lit(False))
    pattern = tx.literal_pattern(
        query or " ", case_sensitive=case_sensitive, whole_words=whole_words
    )
    per_section = F.transform(
        tx.section_array(F.col("markdown")),
        lambda s: F.transform(
            tx.match_spans(s["content"], pattern, limit),
            lambda m: F.struct(
                s["index"].alias("section_index"),
                s["title"].alias("section"),
                m["pos"].alias("char_offset"),
                m["match"].alias("match"),
                tx.strip(
                    F.replace(
                        F.substr(
                            s["content"],
                            F.greatest(m["pos"] - SIDE, F.lit(0)) + 1,
                            F.least(m["pos"], F.lit(SIDE)) + F.length(m["match"]) + SIDE,
                        ),
                        F.lit("\n"),
                        F.lit(" "),
                    )
                ).alias("snippet"),
            ),
        ),
    )
    hits = F.slice(F.flatten(per_section), 1, limit)
    return corpus.select(*DOC, F.posexplode(hits).alias("hit", "h")).select(*DOC, "hit", "h.*")
