"""Operators over pages and embeddings: odd cases, exact round trips, brute force."""

import hashlib
import io
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from litlake.llm import html_text, neighbours, url_filter, warc
from tests.llm import cases

ARTICLE = "The fox and the dog were at the end of the road when it was dark and they had to go home for the night."


def plain(df):
    return [tuple(r) for r in df.collect()]


def page(body):
    return f"<html><head><title>t</title></head><body>{body}</body></html>"


@pytest.mark.parametrize(
    "body, expected",
    [
        ("", ""),
        (f"<article><h1>Title</h1><p>{ARTICLE}</p></article>", f"Title\n{ARTICLE}"),
        (f"<nav><a href=x>Home</a></nav><article><p>{ARTICLE}</p></article><footer>x</footer>", ARTICLE),
        (f"<article><p><b>Lead &amp; more<br>again<p>{ARTICLE}</article>", f"Lead & more again\n{ARTICLE}"),
        (f"<div class='ad'>Buy</div><main><p>{ARTICLE}</p><div id=comments><p>{ARTICLE}</p></div></main>", ARTICLE),
        (f"<article><script>var a='</p>';</script><p>{ARTICLE}</p><form><p>Name</p></form></article>", ARTICLE),
        (f"<p>{ARTICLE} {ARTICLE}</p><p>Short end.</p><p>{ARTICLE} {ARTICLE}</p>", f"{ARTICLE} {ARTICLE}\nShort end.\n{ARTICLE} {ARTICLE}"),
        (f"<div><a href=a>One</a> <a href=b>Two</a></div><p>{ARTICLE} {ARTICLE}</p>", f"{ARTICLE} {ARTICLE}"),
        (f"<article><p>{ARTICLE}&nbsp;\n x &lt;b&gt;</p><!-- no", f"{ARTICLE} x <b>"),
        ("<article><p>a</p><p>b</p></article>", "a\nb"),
    ],
)
def test_main_text(body, expected):
    assert html_text.main_text(page(body) if "<!-- no" not in body else f"<body>{body}") == expected


PROSE = f"{ARTICLE} {ARTICLE}"
WRAPPERS = [
    '<div class="content has-sidebar">',
    '<div class="post comments-open">',
    '<section class="social-science">',
    '<div id="search-results">',
    '<div class="no-ads">',
    "<form>",
    '<div class="widget">',
]


@pytest.mark.parametrize("wrapper", WRAPPERS)
@pytest.mark.parametrize("inner", ["{}", "<main>{}</main>", "<article>{}</article>"])
def test_wrappers_keep_their_article(wrapper, inner):
    """A word in the name of what holds the page costs nothing; comments beside it still go."""
    text = inner.format(f"<h1>T</h1><p>{PROSE}</p><p>{PROSE} b</p><div class='share-bar'>Share this now</div>")
    name = wrapper[1:].split()[0].rstrip(">")
    body = f"{wrapper}{text}</{name}><div class='comments'><article><p>{PROSE} c</p></article></div>"
    assert html_text.main_text(page(body)) == f"T\n{PROSE}\n{PROSE} b"


def test_unclosed_elements_cost_no_square():
    began = time.process_time()
    html_text.main_text("<b>x" * 20_000 + "</i></p>" * 20_000)
    assert time.process_time() - began < 2


POLISH = "Lis oraz pies byli przy końcu drogi gdy zapadł zmrok, więc musieli wracać przez las. " * 3
CODES = " ".join(f"part{chr(97 + i % 26)} model" for i in range(30))


@pytest.mark.parametrize(
    "body, expected",
    [
        # Main text in divs beside one teaser card.
        (
            f"<div><h1>T</h1><p>{PROSE}</p><p>{PROSE} a</p></div>"
            "<article><h3>More</h3><p>A card. <a href=x>Read on</a></p></article>",
            f"T\n{PROSE}\n{PROSE} a",
        ),
        # Text on either side of the edge of an article.
        (f"<div><p>{PROSE}</p></div><article><p>{ARTICLE}</p><p>{PROSE}</p></article>", f"{PROSE}\n{ARTICLE}\n{PROSE}"),
        # A long block with a copyright sign, and a short one.
        (f"<p>{PROSE} \N{COPYRIGHT SIGN} law</p><p>\N{COPYRIGHT SIGN} a.org</p>", f"{PROSE} \N{COPYRIGHT SIGN} law"),
        # A language without stop words here, with and without an article.
        (f"<div><p>{POLISH}</p></div><div><a href=a>Dom</a></div>", POLISH.strip()),
        (f"<article><p>{POLISH}</p></article>", POLISH.strip()),
        ("<p>" + "狐狸和狗在路的尽头。" * 30 + "</p>", "狐狸和狗在路的尽头。" * 30),
        # Density decides inside an article and outside: part lists, the inner one with links.
        (
            f"<article><p>{PROSE}</p><p>{PROSE} a</p><div>{CODES} <a href=x>{CODES[:200]}</a></div></article><div>{CODES}</div>",
            f"{PROSE}\n{PROSE} a",
        ),
    ],
)
def test_all_blocks_are_judged(body, expected):
    assert html_text.main_text(page(body)) == expected


@pytest.mark.parametrize("cut", range(0, 400, 7))
def test_cut_pages_do_not_fail(cut):
    whole = page(f"<article><p title='a>b'>{ARTICLE} &amp; &eacute;</p><script>x</script><!-- c --><p>end</article>")
    assert isinstance(html_text.main_text(whole[:cut]), str)


def pages(spark):
    big = page(f"<article><p>{cases.LONG}</p></article>")
    rows = [
        (1, "http://a.example.org/x", page(f"<article>{ARTICLE * 12}</article>")),
        (5, "https://A.Example.ORG/es/1?q#f", page(f"<article>{ARTICLE * 12}</article>")),
        (3, None, page(f"<article>{ARTICLE * 12}</article>")),
        (4, "no scheme", None),
        (6, "", ""),
        (7, "http://bets.example.com", "tiny"),
        (8, "http://x.com/fr/a\r\nb", "tiny"),
        (9, "http://x.com/de/", big),
        (None, "http://y.com/de", big),
        (9, "http://x.com/de/", big),
        (10, "ftp://example.org/en/12#x", "é" * 600),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for name in cases.CLASHING:
        df = df.withColumn(name, F.lit("x"))
    return df, rows


def test_extract(spark):
    df, rows = pages(spark)
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in html_text.extract(df).collect()}
    assert all(got[i, u] == (html_text.main_text(h), len(html_text.main_text(h))) for i, u, h in rows)
    assert got[4, "no scheme"] == ("", 0)
    assert plain(html_text.extract(cases.empty(df))) == []


def test_warc_round_trip(spark):
    df, rows = pages(spark)
    expected = []
    newest = {}
    for i, _, h in rows:
        data = (h or "").encode()
        if len(data) >= 1000 and i is not None:
            newest[data] = max(newest.get(data, i), i)
    for i, _, h in rows:
        data = (h or "").encode()
        revisit = len(data) >= 1000 and newest.get(data) != i
        expected.append(
            (i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", newest[data] if revisit else None)
        )
    assert cases.same(plain(warc.archive_round_trip(df)), expected)
    assert plain(warc.archive_round_trip(cases.empty(df))) == []


def test_chunks_give_the_payload_back(spark, tmp_path):
    df, rows = pages(spark)
    folder = f"file://{tmp_path}/w"
    archives = warc.write_archives(warc.chunks(warc.with_revisits(df), 1000), folder, most=5000)
    got = {}
    for r in warc.read_archives(archives, folder).where("record_type = 'response'").collect():
        got.setdefault((r.page_id, r.declared), {})[r.chunk_no] = bytes(r.data)
    payloads = {b"".join(v for _, v in sorted(parts.items())) for parts in got.values()}
    assert payloads == {(h or "").encode() for _, _, h in rows}
    assert archives.count() > 1


def test_a_record_is_read_in_chunks():
    row = {"page_id": 3, "url": "http://a/\n", "payload_bytes": 1_000_000, "digest": "00" * 20, "kind": "response", "refers_to": None}
    data = bytes(range(256)) * 3907
    row["payload_bytes"] = len(data)
    import zlib

    member = zlib.compressobj(3, zlib.DEFLATED, 31)
    raw = member.compress(warc.header(row) + data + b"\r\n\r\n") + member.flush()
    found = list(warc.records(io.BytesIO(raw * 2), 4096))
    assert max(len(r["data"]) for r in found) <= 4096
    assert b"".join(r["data"] for r in found) == data * 2
    assert found[-1]["digest"] == hashlib.sha1(data).hexdigest()


RULES = [url_filter.Rule(*r) for r in (("org", "/", "allow"), ("example.org", "/es/", "block"), ("com", "/de/", "block"))]


def test_judge_urls(spark):
    df, _ = pages(spark)
    got = {(r.page_id, r.host, r.path): (r.rule, r.verdict) for r in url_filter.judge_urls(df, RULES, ["bets"]).collect()}
    assert got == {
        (1, "a.example.org", "/x"): ("org/", "allow"),
        (5, "a.example.org", "/es/1"): ("example.org/es/", "block"),
        (3, "", ""): (None, "allow"),
        (4, "", ""): (None, "allow"),
        (6, "", ""): (None, "allow"),
        (7, "bets.example.com", ""): (None, "block"),
        (8, "x.com", "/fr/a\r\nb"): (None, "allow"),
        (9, "x.com", "/de/"): ("com/de/", "block"),
        (None, "y.com", "/de"): (None, "allow"),
        (10, "example.org", "/en/12"): ("org/", "allow"),
    }
    assert plain(url_filter.judge_urls(cases.empty(df), RULES, [])) == []


def test_cascade_is_exact(spark):
    keys = [f"k{i}" for i in range(5000)]
    frame = lambda k: spark.createDataFrame([(x,) for x in k], "key string")
    cascade = url_filter.build_cascade(frame([*keys[::7], keys[0]]), frame(keys))
    assert len(cascade.levels) > 1
    assert [k for k in keys if cascade.holds(k)] == keys[::7]
    assert not url_filter.build_cascade(frame([]), frame(keys)).holds("k1")


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((900, 16))
    vectors[100:400] = vectors[100]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (904, []), (None, [1.0] * 16), (920, [1.0, 2.0]), (921, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for name in cases.CLASHING:
        df = df.withColumn(name, F.lit("x"))
    got = {}
    for r in neighbours.nearest(df, block=300, query_block=20).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    hits = 0
    for q in range(0, 900, 20):
        score = vectors @ vectors[q]
        order = [i for i in np.lexsort((np.arange(900), -score.round(12))) if i != q][:20]
        assert sorted(got[q]) == list(range(1, 21))
        hits += len({v for v, _ in got[q].values()} & set(order))
        assert all(abs(s - score[v]) < 1e-9 for v, s in got[q].values())
        ranked = [got[q][k] for k in range(1, 21)]
        assert ranked == sorted(ranked, key=lambda p: (-p[1], p[0]))
    assert hits >= 0.9 * 20 * 45
    assert got[920] == {1: (921, 5.0)} and 900 not in got
    assert plain(neighbours.nearest(cases.empty(df))) == []


def test_stop_ratio():
    assert neighbours.stop_ratio(0.05, 8) == pytest.approx(15.507, abs=1e-3)


def test_equal_vectors_come_in_the_order_of_their_ids(spark):
    """Scores don't depend on where a vector stands, so ties are ties."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal((3, 37))
    rows = [(i, base[i % 3].tolist()) for i in range(700)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in neighbours.nearest(df, every=35).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert len(got) == 20
    for q, found in got.items():
        scores = [s for _, s in found]
        assert scores == sorted(scores, reverse=True)
        for score in set(scores):
            same = [v for v, s in found if s == score]
            assert same == sorted(same)
        alike = [i for i in range(700) if i % 3 == q % 3 and i != q]
        if found[0][0] % 3 == q % 3:
            assert [v for v, _ in found] == alike[:20]
