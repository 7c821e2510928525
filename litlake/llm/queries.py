"""The registered queries of this subpackage; each runs over its whole tables.

Scores of classifiers, text extraction, repeated bytes and approximate neighbours
have no SQL; they are tested against brute force, exact round trips or held-out rows.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from litlake.llm import sql
from litlake.llm.common import table

QUERIES = {}
ORACLES = {
    "op4_decontamination": sql.CONTAMINATION,
    "op5_jaccard_join": sql.DUPLICATE_GROUPS,
    "op7_mixing": sql.MIX,
    "op8_url_filter": sql.URLS,
    "op9_warc": sql.WARC,
    "op13_prefix_trie": sql.PREFIX_TRIE,
}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litlake.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litlake.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litlake.llm.decontamination import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Rules of the url query, and words of a host that put it on the block list.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
BAD_WORDS = ("adult", "ads", "bets", "casino", "pills", "spam", "porn", "warez")


@query
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litlake.llm.url_filter import Rule, judge_urls

    rules = [Rule(*r) for r in RULES]
    return judge_urls(table(spark, sf_dir, "pages"), rules, BAD_WORDS)


@query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litlake.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


@query
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litlake.llm.near_duplicates import duplicate_groups

    groups = duplicate_groups(table(spark, sf_dir, "documents"), size=3, similarity=Fraction(9, 10))
    return groups.select("doc_id", "n_shingles", "component_id")


@query
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litlake.llm.suffix_dedup import repeated_bytes

    return repeated_bytes(table(spark, sf_dir, "documents"))


@query
def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litlake.llm.neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


@query
def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litlake.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages"))


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litlake.llm.warc import archive_round_trip

    return archive_round_trip(table(spark, sf_dir, "pages"))


@query
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litlake.llm.alignment import align

    return align(table(spark, sf_dir, "documents"))


@query
def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litlake.llm.packing import packed_pieces

    return packed_pieces(table(spark, sf_dir, "documents"))


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litlake.llm.prefix_trie import rebuilt_trie

    return rebuilt_trie(table(spark, sf_dir, "conversations"))
