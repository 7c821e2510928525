"""Text expressions against literal cases and a plain restatement of the rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from litlake.functions import text as tx
from litlake.operators import find, search, sections



def docs(spark, *texts):
    rows = [("manual", f"d{i}", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "namespace string, canonical_id string, markdown string")


def one(spark, text, *exprs):
    return spark.createDataFrame([(text,)], "t string").select(*exprs).first()


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Hello, World! (end) [1]", ["hello", "world", "end"]),
        ("self-attention and BM25 with 1.5x", ["self-attention", "bm25", "1.5x"]),
        ("The a of I x", []),
        ("café naïve under_score", ["caf", "na", "ve", "score"]),
        ("-lead trail- mid--dle a.b.", ["lead", "trail", "mid--dle", "a.b"]),
        ("", []),
    ],
)
def test_tokens(spark, text, expected):
    assert one(spark, text, tx.tokens(F.col("t")))[0] == expected
    assert search.query_terms(text) == sorted(set(expected))


def test_term_counts(spark):
    got = one(spark, "beta alpha beta gamma beta alpha", tx.term_counts(tx.tokens(F.col("t"))))[0]
    assert [(r.term, r.tf) for r in got] == [("alpha", 2), ("beta", 3), ("gamma", 1)]
    assert one(spark, "the of", tx.term_counts(tx.tokens(F.col("t"))))[0] == []


def test_strip_and_collapse_treat_unicode_spaces(spark):
    row = one(spark, "  \x1c a b \t\n", tx.strip(F.col("t")), tx.collapse(F.col("t")))
    assert tuple(row) == ("a b", "a b")


HEADING = re.compile(r"^(#{1,6})\s+(.+)$")


def plain_sections(md):
    """Walk the lines once; a level 1-2 heading closes the running section."""
    out, title, body, subs = [], "Preamble", [], []

    def close():
        text = "\n".join(body)
        if text.strip():
            out.append((len(out), title, list(subs), max(1, len(text) // 4), text.strip()))

    for line in md.split("\n"):
        m = HEADING.match(line)
        level = len(m[1]) if m else 0
        if level in (1, 2):
            close()
            title, body, subs = m[2].strip(), [], []
        else:
            if level == 3:
                subs.append(m[2].strip())
            body.append(line)
    close()
    return out


CASES = [
    "no headings at all\nsecond line",
    "# Title\n\n## A\ntext a\n### Sub one\nmore\n#### deep\n## B\n\n\n## C\nend\n",
    "before\n# One\n# Two\n\n\n# Three\n   \n# Four\nx",
    "##  \nblank title line\n#\nbare mark\n#######  seven\n## T\r\nwin\r\n",
    "\n\n## A\n\n## A\nsame title twice\n##   nbsp\nz",
    "",
    "## only heading",
    "text\n##nospace\n ## indented\n###\tTabbed\nlast\n",
]


def random_markdown(rng):
    pieces = ["# H1", "## H2 x", "### H3", "#### H4", "", "  ", "word word", "##  ", "#", "é ß "]
    return "\n".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))


def test_sections_match_the_line_walk(spark):
    rng = random.Random(7)
    texts = CASES + [random_markdown(rng) for _ in range(200)]
    got = {}
    for r in sections.parse_sections(docs(spark, *texts)).collect():
        got.setdefault(r.canonical_id, []).append((r["index"], r.title, r.h3s, r.approx_tokens, r.content))
    for i, text in enumerate(texts):
        assert sorted(got.get(f"d{i}", [])) == plain_sections(text), repr(text)


def plain_find(md, query, limit, flags, whole):
    pattern = re.escape(query)
    regex = re.compile(rf"\b{pattern}\b" if whole else pattern, flags)
    hits = []
    for index, title, _, _, text in plain_sections(md):
        for m in regex.finditer(text):
            lo, hi = max(0, m.start() - 60), m.end() + 60
            hits.append((index, title, m.start(), m[0], text[lo:hi].replace("\n", " ").strip()))
    return hits[:limit]


@pytest.mark.parametrize("query", ["ab", "A.b", "é", "\\E", "aa", "b a"])
@pytest.mark.parametrize("case_sensitive", [True, False])
@pytest.mark.parametrize("whole", [True, False])
def test_find_matches_a_plain_scan(spark, query, case_sensitive, whole):
    rng = random.Random(hash((query, whole)) % 1000)
    bits = ["ab", "AB", "a.b", "aab", "é", "É", "aé", "\\E", "aaa", " ", "\n", "\n## S\n", "b a", "x" * 70]
    texts = ["".join(rng.choice(bits) for _ in range(60)) for _ in range(40)]
    flags = 0 if case_sensitive else re.IGNORECASE
    got = {}
    for r in find.find_in_documents(docs(spark, *texts), query, 7, case_sensitive, whole).collect():
        got.setdefault(r.canonical_id, []).append(
            (r.hit, (r.section_index, r.section, r.char_offset, r.match, r.snippet))
        )
    for i, text in enumerate(texts):
        assert [h for _, h in sorted(got.get(f"d{i}", []))] == plain_find(text, query, 7, flags, whole)


def test_find_empty_query_gives_no_rows(spark):
    assert find.find_in_documents(docs(spark, "abc"), "").count() == 0


def test_find_offsets_feed_slices(spark):
    corpus = docs(spark, "# A\n\n  intro needle here\n## B\nneedle again")
    secs = {r["index"]: r.content for r in sections.parse_sections(corpus).collect()}
    for r in find.find_in_documents(corpus, "needle").collect():
        assert secs[r.section_index][r.char_offset :].startswith("needle")


def test_title_and_section_at(spark):
    md = "### sub\n\nhead\n# First\nbody\n## Second \nmore"
    corpus = docs(spark, md, "no headings", "#\nnext line is the title\n## B")
    assert {r.canonical_id: r.title for r in sections.titles(corpus).collect()} == {
        "d0": "First",
        "d1": None,
        "d2": "next line is the title",
    }
    start = md.index("## Second")
    asked = spark.createDataFrame(
        [("manual", "d0", o) for o in (0, start - 1, start, len(md))],
        "namespace string, canonical_id string, offset int",
    )
    got = {r.offset: r.section for r in sections.section_at_offset(corpus, asked).collect()}
    assert got == {0: None, start - 1: "First", start: "Second", len(md): "Second"}


def test_slice_bounds(spark):
    secs = sections.parse_sections(docs(spark, "0123456789"))
    shown = lambda o, n: sections.slice_sections(secs, o, n).first()
    first = shown(0, 4)
    assert (first.content, first.has_more, first.next_offset) == ("0123", True, 4)
    end = shown(10, 4)
    assert (end.content, end.has_more, end.next_offset, end.error) == ("", False, None, None)
    assert "beyond" in shown(11, 4).error
    assert "non-negative" in shown(-1, 4).error
    assert "positive" in shown(0, 0).error


def test_chunks_join_to_the_section(spark):
    secs = sections.parse_sections(docs(spark, "abcdefghij" * 7))
    parts = sorted(sections.chunk_sections(secs, 32).collect(), key=lambda r: r.chunk)
    assert "".join(p.text for p in parts) == "abcdefghij" * 7
    assert [p.has_more for p in parts] == [True, True, False]


def test_select_sections(spark):
    corpus = docs(spark, "# Intro\na\n## Methods\nb\n## More methods\nc\n## 2024\nd")
    wants = ["0", "9", "-1", "intro", "METHODS", "zzz", "2024", "3"]
    asked = spark.createDataFrame(
        [(i, "manual", "d0", w) for i, w in enumerate(wants)],
        "request_id long, namespace string, canonical_id string, section string",
    )
    got = {r.request_id: r for r in sections.select_sections(asked, corpus).collect()}
    assert got[0].content == "a" and got[3].content == "a" and got[7].content == "d"
    assert "out of range (0-3)" in got[1].error and "out of range" in got[2].error
    assert got[4].error == "Ambiguous section title. Matches: Methods, More methods"
    assert got[5].error.startswith("No section matching") and "2024" in got[5].error
    assert "out of range" in got[6].error  # digits are always an index


def plain_snippet(md, terms, window=200):
    hits = sorted(
        (m.start(), t) for t in terms for m in re.finditer(rf"\b{re.escape(t)}\b", md.lower())
    )
    if not hits:
        return md[:window].strip(), None
    near = lambda p: len({t for q, t in hits if abs(q - p) <= window // 2})
    at = min((-near(p), p) for p, _ in hits)[1]
    start = max(0, at - window // 2)
    return re.sub(r"\s+", " ", md[start : start + window].strip()), at


def test_snippets_match_a_plain_scan(spark):
    rng = random.Random(3)
    bits = ["alpha", "beta", "gamma", "alphabet", "x" * 30, "\n", " ", " ", "self-alpha", "filler words "]
    texts = [" ".join(rng.choice(bits) for _ in range(80)) for _ in range(30)] + ["nothing here"]
    corpus = docs(spark, *texts)
    terms = ["alpha", "beta", "gamma"]
    got = {r.canonical_id: (r.snippet, r.snippet_offset) for r in search.snippets(corpus, terms).collect()}
    assert got == {f"d{i}": plain_snippet(t, terms) for i, t in enumerate(texts)}


def test_bm25_rules(spark):
    corpus = docs(spark, "neural networks for vision", "neural neural search", "the of", "unrelated words")
    found = search.bm25_search(corpus, "Neural neural", 10).collect()
    assert [r.canonical_id for r in found] == ["d1", "d0"]
    assert found[0].score > found[1].score > 0
    assert search.bm25_search(corpus, "the of", 10).count() == 0
    assert search.bm25_search(corpus, "absent", 10).count() == 0
    with pytest.raises(ValueError):
        search.bm25_search(corpus, "neural", 0)
    assert search.bm25_search(corpus, "neural", 10, namespace="arxiv").count() == 0


def test_many_matches_in_one_text(spark):
    """A hundred thousand hits: their offsets come from running sums, not from a growing list."""
    text = "ab " * 100_000
    df = spark.createDataFrame([(text,)], "t string").repartition(1)
    spans = df.select(F.inline(tx.match_spans(F.col("t"), "ab")))
    row = spans.agg(F.count("*"), F.max("pos"), F.sum("pos")).first()
    assert tuple(row) == (100_000, 299_997, 3 * (100_000 * 99_999 // 2))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 8, 9])
def test_running_sums(spark, n):
    values = [i % 4 + 1 for i in range(n)]
    df = spark.createDataFrame([(values,)], "v array<int>")
    assert df.select(tx.running_sums(F.col("v"))).first()[0] == [sum(values[: i + 1]) for i in range(n)]


def test_first_words_are_those_of_the_whole_text(spark):
    texts = ["", "  ", "a", " a b\x1cc  d ", " x y z", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(F.slice(tx.words(F.col("t")), 1, 2).alias("w"), tx.first_words(F.col("t"), 2).alias("f")).collect()
    assert [r.f for r in rows] == [r.w for r in rows]


def test_first_words_across_the_head_of_a_text(spark):
    long = "x" * (tx.HEAD + 50)
    texts = [" " * tx.HEAD + "a b c", f"a {long} c", f"{'b ' * 3}{long}", long, "a\n" * tx.HEAD, f"{'y' * (tx.HEAD - 2)} z {long}", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in (1, 2, 3, 6):
        for r in df.select(F.slice(tx.words(F.col("t")), 1, n).alias("w"), tx.first_words(F.col("t"), n).alias("f")).collect():
            assert r.w == r.f
