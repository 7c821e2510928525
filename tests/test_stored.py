"""Tables stored for many readers: clustered texts, places in lists, papers by key, changes."""

from pyspark.sql import functions as F

from litlake.operators import bibliography, changes, graph, index, metadata, search, sections, spread
from litlake.operators.spread import stored_page_items, store_ordinals
from litlake.session import scratch_path
from litlake.sources.corpus import write_clustered

DOC = ["namespace", "canonical_id"]


def scanned_rows(df):
    """Rows that the file scans of ``df`` gave up after it ran."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if "AdaptiveSparkPlan" in plan.getClass().getName():
        plan = plan.executedPlan()
    total, todo = 0, [plan]
    while todo:
        node = todo.pop()
        if "FileSourceScan" in node.getClass().getName():
            total += node.metrics().apply("numOutputRows").value()
        todo += [node.children().apply(i) for i in range(node.children().length())]
    return total


def big_corpus(spark, n=4000):
    body = F.expr("array_join(transform(sequence(1, 60), i -> sha2(concat(id, '-', i), 512)), ' ')")
    text = F.concat(F.lit("# T "), F.col("id"), F.lit("\n\n"), body)
    return spark.range(n).select(
        F.lit("manual").alias("namespace"), F.format_string("d%06d", "id").alias("canonical_id"), text.alias("markdown")
    )


def test_few_texts_of_a_clustered_corpus_are_read(spark):
    root = scratch_path(spark, "clustered")
    write_clustered(big_corpus(spark), root)
    stored = spark.read.parquet(root)
    ranked = [r for r in stored.limit(3).select(*DOC, F.lit(1.0).alias("score")).collect()]
    wanted = stored.where(F.col("canonical_id").isin("d000007", "d003999"))
    assert wanted.count() == 2
    assert scanned_rows(wanted.select("markdown")) < 2500
    found = search.fetch_texts(stored, ranked)
    assert {r.canonical_id for r in found.collect()} == {r.canonical_id for r in ranked}


def test_a_deep_page_reads_its_places_only(spark):
    rows = spark.range(60_000).selectExpr("IF(id % 3 = 0, 'hot', CONCAT('p', id % 400)) AS doi", "id AS line", "sha2(string(id), 512) AS cited")
    path = scratch_path(spark, "ordinals")
    stored = store_ordinals(rows.repartition(4), path, ["doi"], ["line"])
    for page in (1, 21, 200):
        got = {r.doi: [i.line for i in r.items] for r in stored_page_items(stored, ["doi"], page, 50, ["line"]).collect()}
        expected = {}
        for r in rows.orderBy("line").collect():
            expected.setdefault(r.doi, []).append(r.line)
        places = {k: v[50 * (page - 1) : 50 * page] for k, v in expected.items()}
        assert got == {k: v for k, v in places.items() if v}
    deep = stored.where("ordinal_block = 20")
    plan = deep._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(ordinal_block,20)" in plan


def test_asking_stored_papers_shuffles_requests_only(spark):
    papers = spark.range(500).selectExpr(
        "'openalex' AS _source", "CONCAT('10.1234/o', id) AS _canonical_id", "CONCAT('T', id) AS title", "CONCAT('20', 10 + id % 9) AS date"
    )
    papers = papers.unionByName(papers.where("_canonical_id = '10.1234/o7'").withColumn("date", F.lit("2999")).withColumn("title", F.lit("new")))
    stored = metadata.store_papers(papers, scratch_path(spark, "papers"), 8)
    asked = spark.createDataFrame([(1, "10.1234/O7"), (2, "10.1234/O9999"), (3, "10.1234/O7"), (4, "label")], "pos int, raw string")
    got = {r.pos: (r.title, r.error is None) for r in metadata.batch_metadata(asked, stored).collect()}
    assert got == {1: ("new", True), 2: (None, False), 3: ("new", True), 4: (None, False)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = metadata.batch_metadata(asked, stored)._jdf.queryExecution().sparkPlan().toString()
        whole = metadata.batch_metadata(asked, stored)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "to_json" not in plan and "Window" not in plan
    record_side = whole[whole.rindex("SortMergeJoin"):].split("\n")
    scan = next(i for i, line in enumerate(record_side) if "FileScan" in line and "Bucketed: true" in line)
    assert not any("Exchange" in line for line in record_side[max(scan - 3, 0) : scan])


def test_entries_of_records_without_ids(spark):
    """Without any id a record is a paper of its own, equal or missing titles notwithstanding."""
    rows = [("arxiv", None, "2020", "e1"), ("arxiv", None, "2020", "e1"), ("openalex", "x", "2020", "e2"), ("openalex", "x", "2021", "e3"), ("biorxiv", "x", "2001", "e4")]
    df = spark.createDataFrame(rows, "_source string, _key string, _date string, bibtex string").withColumn("_canonical_id", F.col("_key"))
    original = bibliography._arxiv, bibliography._biorxiv, bibliography._openalex
    try:
        bibliography._arxiv = lambda d: df.where("_source = 'arxiv'")
        bibliography._biorxiv = lambda d: df.where("_source = 'biorxiv'")
        bibliography._openalex = lambda d: df.where("_source = 'openalex'")
        got = sorted(r.bibtex for r in bibliography.all_entries(df, df, df).collect())
    finally:
        bibliography._arxiv, bibliography._biorxiv, bibliography._openalex = original
    assert got == ["e1", "e1", "e4"]


def test_title_search_keeps_records_without_doi(spark):
    author = "array<struct<given:string,family:string>>"
    date = "struct<`date-parts`:array<array<int>>>"
    rows = [
        ("10.1/A", ["Deep nets"], [("Ann", "Lee")]),
        ("10.1/A", ["Deep nets again"], [("Bo", "Li")]),
        (None, ["Deep thoughts"], [("Cy", "Ng")]),
        (None, ["Deep thoughts"], [("Cy", "Ng")]),
        ("10.1/B", ["Shallow nets"], []),
    ]
    works = spark.createDataFrame(rows, f"DOI string, title array<string>, author {author}")
    works = works.withColumn("published-print", F.lit(None).cast(date)).withColumn("published-online", F.lit(None).cast(date))
    found = search.search_titles(works, "deep", rows=5).collect()
    assert len(found) == 4 and {r.total_results for r in found} == {4}
    assert sorted(str(r.doi) for r in found) == ["10.1/A", "10.1/A", "None", "None"]
    few = search.search_titles(works, "deep nets", rows=2).collect()
    assert len(few) == 2 and few[0].total_results == 5


def test_changes_read_changed_texts_only(spark):
    root = scratch_path(spark, "derived")
    corpus = big_corpus(spark, 3000)
    first = f"{root}/one"
    write_clustered(corpus, first)
    assert changes.apply_changes(spark, root, spark.read.parquet(first)).count() == 3000
    assert changes.apply_changes(spark, root, spark.read.parquet(first)).count() == 0
    longer = F.when(F.col("canonical_id") == "d000500", F.concat("markdown", F.lit("\n## New\nfresh words"))).otherwise(F.col("markdown"))
    second = f"{root}/two"
    write_clustered(corpus.where("canonical_id <> 'd000600'").withColumn("markdown", longer), second)
    stored = spark.read.parquet(second)
    found = changes.changed_documents(stored, changes.manifest(spark, root))
    assert {(r.canonical_id, r.change) for r in found.collect()} == {("d000500", "changed"), ("d000600", "removed")}
    assert scanned_rows(changes.changed_texts(stored, found)) < 1500
    changes.apply_changes(spark, root, stored)
    now = {r.canonical_id: len(r.sections) for r in changes.current_sections(spark, root).collect()}
    assert len(now) == 2999 and now["d000500"] == 2 and "d000600" not in now
    built = index.open_index(spark, f"{root}/index")
    assert [r.canonical_id for r in index.search_index(built, "fresh").collect()] == ["d000500"]
    assert built.size()[0] == 2999 and sections.section_index(stored).count() == 2999


def test_reference_pages_from_stored_places(spark):
    edges = spark.range(300).selectExpr("CONCAT('d', id % 7) AS citing", "CONCAT('c', id) AS cited", "id AS line")
    counts = spark.createDataFrame([(f"d{i}", 3, 40) for i in range(8)], "doi string, crossref_count long, opencitations_count long")
    few = edges.where("line < 21")
    stored = graph.store_references(few, edges, scratch_path(spark, "refs"), ["line"])
    for page in (1, 3):
        expected = graph.references_page(counts, few, edges, ["line"], page, 10).collect()
        assert sorted(graph.stored_references_page(counts, stored, page, 10).collect()) == sorted(expected)


def test_pages_show_the_asked_columns_and_read_no_others(spark):
    edges = spark.range(90).selectExpr("CONCAT('d', id % 7) AS citing", "CONCAT('c', id) AS cited", "id AS line", "'x' AS note")
    counts = spark.createDataFrame([(f"d{i}", 9, 40) for i in range(8)], "doi string, crossref_count long, opencitations_count long")
    stored = graph.store_references(edges.where("line < 21"), edges, scratch_path(spark, "refs"), ["line"])
    few = graph.stored_references_page(counts, stored, 2, 4, columns=["cited"])
    whole = {r.doi: [(i.cited,) for i in r.references] for r in graph.stored_references_page(counts, stored, 2, 4).collect()}
    assert {r.doi: [tuple(i) for i in r.references] for r in few.collect()} == whole
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "note" not in plan and "line" not in plan


def test_only_rows_of_heavy_keys_are_dealt_in_pieces(spark, monkeypatch):
    rows = spark.range(60_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN CONCAT('p', id % 1000) END AS doi", "(id * 7) % 60000 AS line"
    )
    dealt = []
    in_pieces = spread.in_pieces
    monkeypatch.setattr(spread, "in_pieces", lambda df, *a: dealt.append(df.count()) or in_pieces(df, *a))
    expected = {}
    for r in rows.orderBy("line").collect():
        expected.setdefault(r.doi, []).append(r.line)
    for numbered in (
        store_ordinals(rows, scratch_path(spark, "heavy"), ["doi"], ["line"]),
        spread.with_ordinal(rows, ["line"], ["doi"]),
    ):
        got = {}
        for r in numbered.orderBy("ordinal").collect():
            assert r.ordinal == len(got.setdefault(r.doi, []))
            got[r.doi].append(r.line)
        assert got == expected
    assert len(dealt) == 2 and all(40_000 <= n < 41_000 for n in dealt)
    dealt.clear()
    light = rows.where("doi LIKE 'p%'")
    assert store_ordinals(light, scratch_path(spark, "light"), ["doi"], ["line"]).count() == 20_000
    assert not dealt
