"""Literature-shaped views over the star-schema and text tables.

Each view derives, with plain column expressions, the record shape an operator
expects: identifier spellings from orders, a markdown corpus from documents, a
citation graph from line items, store entries and request logs from events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litlake.functions import text as tx
from litlake.operators.bibliography import ENTRY_TYPES

NAMESPACES = ("openalex", "crossref", "wikipedia", "arxiv", "biorxiv", "opencitations", "acl_anthology")
CORPUS_NAMESPACES = ("arxiv", "biorxiv", "acl_anthology", "manual")
STATUSES = (200, 404, 408, 425, 429, 500, 503)
METRIC_OF_EVENT = {
    "view": "cache_hits",
    "click": "cache_misses",
    "signup": "http_calls",
    "purchase": "negative_hits",
    "error": "http_retries",
}
NOW = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values, index: Column) -> Column:
    return F.get(F.array(*(F.lit(v) for v in values)), index.cast("int"))


def _cat(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def arxiv_number(k: Column) -> Column:
    """New-style id of a number: four digits, dot, five digits."""
    high = F.lpad((F.floor(k / 100000) + 1000).cast("string"), 4, "0")
    return F.concat(high, F.lit("."), F.lpad((k % 100000).cast("string"), 5, "0"))


def ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pos, raw``: every order as a paper id, in one of nine spellings."""
    k = F.col("o_orderkey")
    spellings = [
        _cat("10.1234/O", k),
        _cat("https://doi.org/10.1234/O", k),
        _cat("http://dx.doi.org/10.1234/O", k),
        _cat("doi:10.1234/O", k),
        _cat("10.1101/2024.01.01.", k),
        _cat("https://www.biorxiv.org/content/10.1101/2024.01.01.", k, "v2.full.pdf"),
        _cat("10.18653/v1/2023.acl-long.", k),
        F.concat(arxiv_number(k), F.lit("v"), (k % 3 + 1).cast("string")),
        _cat("my-paper-", k),
    ]
    return table(spark, sf_dir, "orders").select(
        k.alias("pos"), F.get(F.array(*spellings), (k % 9).cast("int")).alias("raw")
    )


def markdown_of(doc_id: Column, text: Column) -> Column:
    """Document text with derived headings: level 1, 2 and 3."""
    lines = F.transform(
        F.split(text, "\n", -1),
        lambda line, i: F.when(i % 6 == 2, F.concat(F.lit("## Sec "), i.cast("string"), F.lit("\n"), line))
        .when(i % 6 == 4, F.concat(F.lit("### Sub "), i.cast("string"), F.lit("\n"), line))
        .otherwise(line),
    )
    head = F.when(doc_id % 2 == 0, _cat("# Doc ", doc_id, "\n")).otherwise(F.lit(""))
    return F.concat(head, F.array_join(lines, "\n"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``namespace, canonical_id, markdown, doc_id``."""
    d = F.col("doc_id")
    names = [
        arxiv_number(d),
        _cat("10.1101/2024.01.01.", d),
        _cat("10.18653/v1/2023.acl-long.", d),
        _cat("my-paper-", d),
    ]
    return table(spark, sf_dir, "documents").select(
        _pick(CORPUS_NAMESPACES, d % 4).alias("namespace"),
        F.coalesce(F.get(F.array(*names), (d % 4).cast("int")), names[3]).alias("canonical_id"),
        markdown_of(d, F.col("text")).alias("markdown"),
        "doc_id",
    )


EDGE_ORDER = ["line", "part", "supp", "creation", "journal_sc", "author_sc"]


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citation edges; the columns of ``EDGE_ORDER`` order the references of a paper."""
    p = F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").select(
        _cat("10.1234/o", F.col("l_orderkey")).alias("citing"),
        _cat("10.1234/p", p).alias("cited"),
        _cat("omid:br/06", p, " doi:10.1234/p", p, " openalex:W", p).alias("ids"),
        F.col("l_shipdate").cast("date").cast("string").alias("creation"),
        F.when(F.col("l_returnflag") == "R", "yes").otherwise("no").alias("journal_sc"),
        F.when(F.col("l_linestatus") == "O", "yes").otherwise("no").alias("author_sc"),
        F.col("l_orderkey").alias("ord"),
        F.col("l_linenumber").alias("line"),
        p.alias("part"),
        F.col("l_suppkey").alias("supp"),
    )


def crossref_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second reference source: some edges missing, some listed twice."""
    e = edges(spark, sf_dir).withColumn(
        "copies",
        F.when(F.col("journal_sc") == "yes", 0).when(F.col("author_sc") == "yes", 2).otherwise(1),
    )
    return e.select(
        "*", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("_c")
    ).drop("copies", "_c")


def known_dois(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    """DOIs a source has a record for; the others are failed lookups."""
    orders = table(spark, sf_dir, "orders")
    has = {
        "crossref": F.col("o_orderpriority") != "5-LOW",
        "opencitations": F.col("o_orderstatus") != "P",
    }[source]
    return orders.where(has).select(_cat("10.1234/o", F.col("o_orderkey")).alias("doi"))


def _author_names(text: Column, k: Column) -> Column:
    """Up to three names from a text, with surname particles on some."""
    particle = _pick(("van", "de la", None, "Von", None), k % 5)
    return tx.let(
        tx.first_words(text, 11),
        lambda w: F.filter(
            F.array(
                F.concat_ws(" ", F.get(w, F.lit(6)), particle, F.get(w, F.lit(7))),
                F.coalesce(F.get(w, F.lit(8)), F.lit("")),
                F.concat_ws(" ", F.get(w, F.lit(9)), F.get(w, F.lit(10))),
            ),
            lambda n: n != "",
        ),
    )


def _title(text: Column) -> Column:
    return F.array_join(tx.first_words(text, 6), " ")


def inverted_index(text: Column) -> Column:
    """word -> positions map of a whole text, built inside the row."""

    def runs(s: Column) -> Column:
        starts = F.filter(
            F.transform(s, lambda x, i: i),
            lambda i: (i == 0) | (F.get(s, i)["w"] != F.get(s, i - 1)["w"]),
        )
        return tx.let(
            starts,
            lambda st: F.transform(
                st,
                lambda at, i: F.struct(
                    F.get(s, at)["w"].alias("key"),
                    F.transform(
                        F.slice(s, at + 1, F.coalesce(F.get(st, i + 1), F.size(s)) - at),
                        lambda x: x["i"],
                    ).alias("value"),
                ),
            ),
        )

    placed = F.sort_array(
        F.transform(tx.words(text), lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    )
    return F.map_from_entries(tx.let(placed, runs))


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work records: every document, with the order, customer and nation of its number if there are."""
    k = F.col("doc_id")
    # What is taken from the head of a text is taken here, so that the joins don't move texts for it.
    documents = table(spark, sf_dir, "documents").select(
        k, "lang", "text", _title(F.col("text")).alias("title"), _author_names(F.col("text"), k).alias("names")
    )
    joined = (
        documents.join(table(spark, sf_dir, "orders"), k == F.col("o_orderkey"), "left")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    )
    inst = lambda *names: F.array(*(F.struct(n.alias("display_name")) for n in names))
    institutions = F.array(
        inst(F.col("n_name")), inst(F.col("n_name"), F.col("c_mktsegment")), F.slice(inst(F.col("n_name")), 1, 0)
    )
    return joined.select(
        _cat("https://openalex.org/W", k).alias("id"),
        _cat("https://doi.org/10.1234/O", k).alias("doi"),
        "title",
        F.year("o_orderdate").alias("publication_year"),
        F.col("o_orderdate").cast("date").cast("string").alias("publication_date"),
        _pick(tuple(ENTRY_TYPES), k % len(ENTRY_TYPES)).alias("type"),
        F.col("lang").alias("language"),
        F.transform(
            "names",
            lambda n, i: F.struct(
                F.struct(
                    _cat("https://openalex.org/A", k, "-", i).alias("id"), n.alias("display_name")
                ).alias("author"),
                F.when(i == 0, F.lit("first")).otherwise(F.lit("middle")).alias("author_position"),
                (i == 0).alias("is_corresponding"),
                F.get(institutions, i).alias("institutions"),
            ),
        ).alias("authorships"),
        F.struct(
            F.struct(
                F.col("c_mktsegment").alias("display_name"),
                F.col("n_name").alias("host_organization_name"),
            ).alias("source")
        ).alias("primary_location"),
        F.struct(
            (F.col("o_orderstatus") == "O").alias("is_oa"),
            F.lower("o_orderstatus").alias("oa_status"),
            _cat("https://oa.example/", k).alias("oa_url"),
        ).alias("open_access"),
        F.struct(
            (k % 50).cast("string").alias("volume"),
            (k % 12).cast("string").alias("issue"),
            k.cast("string").alias("first_page"),
            (k + 9).cast("string").alias("last_page"),
        ).alias("biblio"),
        F.struct(
            _cat("https://openalex.org/W", k).alias("openalex"),
            _cat("https://doi.org/10.1234/O", k).alias("doi"),
        ).alias("ids"),
        inverted_index(F.col("text")).alias("abstract_inverted_index"),
        k.alias("k"),
    )


def preprint_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What tells preprint records apart, one row per version; ``pos`` is the listing order."""
    k, p, s = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    return table(spark, sf_dir, "lineitem").select(
        _cat("10.1101/2024.01.01.", k).alias("doi"),
        F.col("l_linenumber").cast("string").alias("version"),
        F.col("l_shipdate").cast("date").cast("string").alias("date"),
        (p * 10_000_000 + s).alias("pos"),
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_returnflag",
    )


def preprints_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw preprint records, one per version; ``pos`` is the listing order."""
    return preprint_records(preprint_versions(spark, sf_dir))


def preprint_records(versions: DataFrame) -> DataFrame:
    """The whole records of rows of ``preprint_versions``."""
    k, p, s = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    return versions.select(
        "doi",
        _cat("Preprint ", k, " on part_", p).alias("title"),
        _cat("van Berg", s, ", Anna; Li", p, "; , ; Solo,").alias("authors"),
        _cat("Anna van Berg", s).alias("author_corresponding"),
        _cat("Institute ", s).alias("author_corresponding_institution"),
        "date",
        "version",
        F.lit("new results").alias("type"),
        F.lit("cc_by").alias("license"),
        F.lower("l_returnflag").alias("category"),
        _cat("Abstract of ", k).alias("abstract"),
        F.when(s % 2 == 0, "bioRxiv").otherwise("medRxiv").alias("server"),
        F.when(k % 3 == 0, _cat("10.1234/O", k)).otherwise("NA").alias("published"),
        _cat("https://jats.example/", k).alias("jatsxml"),
        "pos",
    )


def arxiv_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised arXiv papers from documents."""
    d, text = F.col("doc_id"), F.col("text")
    number = F.concat(arxiv_number(d), F.lit("v"), (d % 3 + 1).cast("string"))
    link = lambda href, rel, title: F.struct(
        href.alias("href"), F.lit(rel).alias("rel"), F.lit(title).cast("string").alias("title")
    )
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("http://arxiv.org/abs/"), number).alias("id"),
        _title(text).alias("title"),
        F.array_join(tx.words(text), " ").alias("summary"),
        F.concat((d % 25 + 2000).cast("string"), F.lit("-01-02T00:00:00Z")).alias("published"),
        F.lit("2024-06-01T00:00:00Z").alias("updated"),
        F.transform(
            _author_names(text, d),
            lambda n, i: F.struct(
                n.alias("name"),
                F.when(i == 0, F.array(_cat("Lab ", F.col("source"))))
                .otherwise(F.array().cast("array<string>"))
                .alias("affiliations"),
            ),
        ).alias("authors"),
        F.array(F.lit("cs.CL"), _cat("lang.", F.col("lang"))).alias("categories"),
        F.lit("cs.CL").alias("primary_category"),
        F.array(
            link(F.concat(F.lit("http://arxiv.org/abs/"), number), "alternate", None),
            link(F.concat(F.lit("http://arxiv.org/pdf/"), number), "related", "pdf"),
        ).alias("links"),
        F.when(d % 4 == 0, _cat(F.col("n_chars"), " chars")).alias("comment"),
        F.when(d % 3 == 0, _cat("J. Test & Lang ", F.col("source"))).alias("journal_ref"),
        F.when(d % 2 == 0, _cat("10.1234/O", d)).alias("doi"),
        d.alias("doc_id"),
    )


def crossref_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crossref-shaped records of the works, with print or online dates."""
    date = lambda y: F.struct(F.array(F.array(y)).alias("date-parts"))
    year = F.col("publication_year")
    return works(spark, sf_dir).select(
        _cat("10.1234/O", F.col("k")).alias("DOI"),
        F.array("title").alias("title"),
        F.transform(
            "authorships",
            lambda a, i: F.struct(
                F.when(i != 0, a["author"]["display_name"]).alias("given"),
                F.when(i == 2, F.lit("Family")).alias("family"),
            ),
        ).alias("author"),
        F.when(F.col("k") % 2 == 0, date(year)).alias("published-print"),
        date(year + 1).alias("published-online"),
    )


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def store_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        _pick(NAMESPACES, F.col("user_id") % 7).alias("namespace"),
        F.lit("papers").alias("entity"),
        F.concat_ws("-", "user_id", _k()).alias("key"),
        "event_id",
        "event_type",
        "ts",
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored entries: the latest view or click of a key."""
    return (
        store_events(spark, sf_dir)
        .where(F.col("event_type").isin("view", "click"))
        .groupBy("namespace", "entity", "key")
        .agg(F.max("ts").alias("stored_at"))
    )


def negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not-found entries: an error keeps a key negative for a day."""
    return store_events(spark, sf_dir).where(F.col("event_type") == "error").select(
        "namespace", "entity", "key", (F.col("ts") + F.expr("interval 24 hours")).alias("expires_at")
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_events(spark, sf_dir).select(
        F.col("event_id").alias("request_id"), "namespace", "entity", "key"
    )


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    metric = F.lit(None).cast("string")
    for event, name in METRIC_OF_EVENT.items():
        metric = F.when(F.col("event_type") == event, F.lit(name)).otherwise(metric)
    k = _k()
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"),
        "ts",
        _pick(NAMESPACES, F.col("user_id") % 7).alias("provider"),
        metric.alias("metric"),
        _pick(STATUSES, k % 7).alias("status"),
        F.col("value").cast("string").alias("retry_after"),
        F.col("props").alias("body"),
        F.when((F.col("event_type") == "error") & (k < 30), F.lit("timeout"))
        .when((F.col("event_type") == "error") & (k < 60), F.lit("network"))
        .alias("failure"),
        F.when(F.col("event_type").isin("view", "signup"), F.lit("start"))
        .when(F.col("event_type").isin("click", "purchase"), F.lit("finish"))
        .alias("phase"),
    )


def summaries_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encyclopedia summary documents from parts."""
    title = F.concat_ws(" ", "p_name", "p_partkey")
    return table(spark, sf_dir, "part").select(
        title.alias("title"),
        F.col("p_type").alias("description"),
        F.concat_ws(" ", "p_brand", "p_type").alias("extract"),
        F.when(F.col("p_partkey") % 10 == 0, "disambiguation").otherwise("standard").alias("type"),
        F.col("p_partkey").alias("pageid"),
        F.struct(
            F.struct(
                F.concat(
                    F.lit("https://en.wikipedia.org/wiki/"), F.replace(title, F.lit(" "), F.lit("_"))
                ).alias("page")
            ).alias("desktop")
        ).alias("content_urls"),
    )
