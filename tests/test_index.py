"""The stored index against searches over the texts, through its whole life."""

import random

import pytest
from pyspark.sql import functions as F

from litlake.operators import index, search
from litlake.session import scratch_path

WORDS = [f"w{i}" for i in range(40)] + ["the", "rare"]


def some_docs(spark, names, seed=1):
    draw = random.Random(seed)
    rows = []
    for i in names:
        n = draw.choice([0, 1, 5, 30, 80])
        text = f"# Title {i}\n\n## Part\n\n" + " ".join(draw.choices(WORDS, k=n)) if n else "the of"
        rows.append(("arxiv" if i % 3 else "manual", f"d/{i}", text))
    return spark.createDataFrame(rows, "namespace string, canonical_id string, markdown string")


def ranked(rows):
    return [(r.namespace, r.canonical_id, round(r.score, 6)) for r in rows]


def check(built, corpus, queries, k=7):
    for i, text in enumerate(queries):
        namespace = (None, "arxiv")[i % 2]
        expected = ranked(search.rank_documents(corpus, text, k, namespace).collect())
        found = index.search_index(built, text, k, namespace, prune=i != 1)
        assert ranked(found.collect()) == expected


QUERIES = ["w1 w2 w3", "rare", "the of", "absent words", "W5 w5 w6"]


def test_segments_removals_and_merge(spark, monkeypatch):
    monkeypatch.setattr(index, "RANGE", 8)
    monkeypatch.setattr(index, "SEEDS", 1)
    path = scratch_path(spark, "index")
    first, second = some_docs(spark, range(60)), some_docs(spark, range(60, 110), 2)
    one = index.add_documents(spark, path, first, 3)
    check(one, first, QUERIES[:1])
    two = index.add_documents(spark, path, second, 2)
    whole = first.union(second)
    check(two, whole, QUERIES)
    # A reader keeps the version it opened while later ones are published.
    gone = whole.where("canonical_id like '%7'")
    three = index.remove_documents(spark, path, gone)
    left = whole.where("canonical_id not like '%7'")
    check(three, left, QUERIES[:2])
    check(two, whole, QUERIES[:1])
    check(index.open_index(spark, path, 1), first, QUERIES[:1])
    assert index.remove_documents(spark, path, gone).version == three.version
    four = index.merge_segments(spark, path, 2)
    assert len(four.segments) == 1 and not four.removals and four.sizes == three.sizes
    check(four, left, QUERIES[:2])
    # Documents that are added again replace their older copies.
    again = some_docs(spark, range(0, 40, 2), 9)
    five = index.add_documents(spark, path, again, 2)
    keys = again.select("namespace", "canonical_id")
    check(five, left.join(keys, ["namespace", "canonical_id"], "left_anti").union(again), QUERIES[:2])
    assert index.open_index(spark, path) == five


def test_batch_search_equals_single_search(spark, monkeypatch):
    monkeypatch.setattr(index, "RANGE", 4)
    corpus = some_docs(spark, range(50))
    built = index.add_documents(spark, scratch_path(spark, "index"), corpus, 3)
    asked = spark.createDataFrame(list(enumerate(QUERIES)), "query_id int, query string")
    expected = [ranked(search.rank_documents(corpus, text, 5).collect()) for text in QUERIES]
    for rows, prune in ((10**6, True), (0, False)):
        monkeypatch.setattr(index, "BROADCAST_ROWS", rows)
        batch = index.search_batch(built, asked, 5, prune=prune).collect()
        for qid, text in enumerate(QUERIES):
            many = sorted((r for r in batch if r.query_id == qid), key=lambda r: r.rank)
            assert ranked(many) == expected[qid]
            assert [r.rank for r in many] == list(range(1, len(many) + 1))


def test_scoring_moves_no_postings(spark):
    """Blocks are scored in the tasks that read them: what is shuffled is ranked documents."""
    corpus = some_docs(spark, range(50))
    built = index.add_documents(spark, scratch_path(spark, "index"), corpus, 3)
    segment = built.segments[0]
    known = lambda b: b.where("term = 'w1'").withColumns({"query_id": F.lit(0), "idf": F.lit(1.0)})
    _, scored = index._in_segment(built, segment, known, None, 10.0)
    plan = scored(lambda hit: hit)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "EqualTo(term,w1)" in plan


def test_described_hits(spark):
    corpus = some_docs(spark, range(30))
    built = index.add_documents(spark, scratch_path(spark, "index"), corpus, 2)
    expected = search.bm25_search(corpus, "w1 rare", 6).collect()
    assert index.search_described(built, "w1 rare", 6).collect() == expected
    assert index.search_described(built, "the", 6).collect() == []


def test_an_index_of_nothing(spark):
    path = scratch_path(spark, "index")
    empty = index.open_index(spark, path)
    asked = spark.createDataFrame([(1, "w1")], "query_id int, query string")
    assert index.search_index(empty, "w1").collect() == []
    assert index.search_batch(empty, asked).collect() == []
    built = index.add_documents(spark, path, some_docs(spark, range(3)).where("false"), 2)
    assert index.search_index(built, "w1").collect() == []
    with pytest.raises(ValueError):
        index.search_index(built, "w1", 0)


def test_two_writers(spark):
    path = scratch_path(spark, "index")
    built = index.add_documents(spark, path, some_docs(spark, range(3)), 1)
    with pytest.raises(ValueError, match="another writer"):
        index._publish(spark, path, built.version, built.segments, [], {})
    assert index.open_index(spark, path) == built
