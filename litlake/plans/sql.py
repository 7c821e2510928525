"""The views of :mod:`litlake.plans.views` restated in SQL, as CTE text."""

from __future__ import annotations

from litlake.plans.views import CORPUS_NAMESPACES, METRIC_OF_EVENT, NAMESPACES, STATUSES


def with_(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def _case(index: str, values) -> str:
    arms = " ".join(
        f"WHEN {i} THEN {v if isinstance(v, int) else 'NULL' if v is None else repr(v)}"
        for i, v in enumerate(values)
    )
    return f"CASE {index} {arms} END"


def arxiv_number(k: str) -> str:
    return (
        f"(lpad(CAST(1000 + {k} // 100000 AS VARCHAR), 4, '0') || '.' || "
        f"lpad(CAST({k} % 100000 AS VARCHAR), 5, '0'))"
    )


# Unicode spaces and ASCII separators, as a character class.
WS = r"[\s\v\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({strip(c)}, '{WS}+'), lambda w: w <> '')"


IDS = f"""ids AS (
  SELECT o_orderkey AS pos, CASE o_orderkey % 9
    WHEN 0 THEN '10.1234/O' || o_orderkey
    WHEN 1 THEN 'https://doi.org/10.1234/O' || o_orderkey
    WHEN 2 THEN 'http://dx.doi.org/10.1234/O' || o_orderkey
    WHEN 3 THEN 'doi:10.1234/O' || o_orderkey
    WHEN 4 THEN '10.1101/2024.01.01.' || o_orderkey
    WHEN 5 THEN 'https://www.biorxiv.org/content/10.1101/2024.01.01.' || o_orderkey || 'v2.full.pdf'
    WHEN 6 THEN '10.18653/v1/2023.acl-long.' || o_orderkey
    WHEN 7 THEN {arxiv_number('o_orderkey')} || 'v' || (o_orderkey % 3 + 1)
    ELSE 'my-paper-' || o_orderkey END AS raw
  FROM orders)"""

RESOLVED = r"""bare AS (
  SELECT pos, raw,
    regexp_replace(regexp_replace(trim(raw), '^(?i:doi:)\s*', ''), '^(?i:https?://(dx\.)?doi\.org/)', '') AS b
  FROM ids),
shaped AS (
  SELECT pos, raw, b,
    CASE WHEN regexp_matches(b, '^https?://(www\.)?(bio|med)rxiv\.org/content/')
      THEN regexp_replace(regexp_replace(regexp_extract(b, 'content/(.*)$', 1), '\.full(\.pdf)?$', ''), 'v\d+$', '')
      ELSE b END AS pre,
    regexp_matches(b, '^\d{4}\.\d{4,5}(v\d+)?$') OR regexp_matches(b, '^[a-z-]+/\d{7}(v\d+)?$') AS is_arxiv
  FROM bare),
resolved AS (
  SELECT pos, raw,
    CASE WHEN is_arxiv THEN b WHEN starts_with(pre, '10.1101/') THEN pre ELSE b END AS normalized,
    CASE WHEN is_arxiv THEN 'arxiv' WHEN starts_with(pre, '10.1101/') THEN 'biorxiv'
         WHEN regexp_matches(b, '^10\.\d{4,}/\S+$') THEN 'openalex' END AS source,
    CASE WHEN is_arxiv THEN 'arxiv' WHEN starts_with(b, '10.18653/v1/') THEN 'acl_anthology'
         WHEN starts_with(pre, '10.1101/') THEN 'biorxiv' ELSE 'manual' END AS namespace,
    CASE WHEN is_arxiv THEN lower(regexp_replace(b, 'v\d+$', ''))
         WHEN starts_with(pre, '10.1101/') THEN lower(pre) ELSE lower(b) END AS canonical_id
  FROM shaped)"""

CORPUS = f"""corpus AS (
  SELECT {_case('doc_id % 4', CORPUS_NAMESPACES)} AS namespace,
    CASE doc_id % 4 WHEN 0 THEN {arxiv_number('doc_id')}
      WHEN 1 THEN '10.1101/2024.01.01.' || doc_id
      WHEN 2 THEN '10.18653/v1/2023.acl-long.' || doc_id
      ELSE 'my-paper-' || doc_id END AS canonical_id,
    CASE WHEN doc_id % 2 = 0 THEN '# Doc ' || doc_id || chr(10) ELSE '' END ||
    array_to_string(list_transform(string_split(text, chr(10)), lambda l, i:
      CASE (i - 1) % 6 WHEN 2 THEN '## Sec ' || (i - 1) || chr(10) || l
        WHEN 4 THEN '### Sub ' || (i - 1) || chr(10) || l ELSE l END), chr(10)) AS markdown,
    doc_id
  FROM documents)"""

# The words that are never index terms.
_STOP = ", ".join(
    f"'{w}'"
    for w in (
    "a an the and or but of to in on at for with by from as is are was were be been being "
    "this that these those it its we our their them they he she his her i you your if then "
    "than so such into about over under between"
    ).split()
)


def tokens(c: str) -> str:
    return (
        f"list_filter(regexp_extract_all(lower({c}), '[a-z0-9][a-z0-9\\-.]*[a-z0-9]|[a-z0-9]'), "
        f"lambda t: length(t) > 1 AND NOT list_contains([{_STOP}], t))"
    )


POSTINGS = f"""toks AS (
  SELECT namespace, canonical_id, {tokens('markdown')} AS t FROM corpus),
postings AS (
  SELECT namespace, canonical_id, term, count(*) AS tf, any_value(len(t)) AS doc_len
  FROM (SELECT namespace, canonical_id, t, unnest(t) AS term FROM toks)
  GROUP BY namespace, canonical_id, term),
docs AS (SELECT namespace, canonical_id, len(t) AS doc_len FROM toks WHERE len(t) > 0),
size AS (SELECT count(*) AS n_docs, avg(doc_len) AS avgdl FROM docs),
dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY term)"""

SCORE = (
    "ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * (tf * 2.5) / "
    "(tf + 1.5 * (0.25 + 0.75 * doc_len / avgdl))"
)

# Sections by a running count of heading lines, re-numbered after blanks are dropped.
SECTIONS = rf"""lines AS (
  SELECT namespace, canonical_id,
    unnest(string_split(markdown, chr(10))) AS line,
    generate_subscripts(string_split(markdown, chr(10)), 1) AS i
  FROM corpus),
marked AS (
  SELECT *, CASE WHEN regexp_matches(line, '^#{{1,2}}\s.') THEN 1 ELSE 0 END AS h FROM lines),
numbered AS (
  SELECT *, sum(h) OVER (PARTITION BY namespace, canonical_id ORDER BY i) AS sec FROM marked),
grouped AS (
  SELECT namespace, canonical_id, sec,
    coalesce(max(CASE WHEN h = 1 THEN {strip("regexp_replace(line, '^#+', '')")} END), 'Preamble') AS title,
    coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE h = 0), '') AS raw,
    list({strip("regexp_replace(line, '^#+', '')")} ORDER BY i)
      FILTER (WHERE regexp_matches(line, '^###\s.')) AS h3s
  FROM numbered GROUP BY namespace, canonical_id, sec),
sections AS (
  SELECT namespace, canonical_id,
    row_number() OVER (PARTITION BY namespace, canonical_id ORDER BY sec) - 1 AS index,
    title, coalesce(array_to_string(h3s, '|'), '') AS h3s,
    greatest(1, length(raw) // 4) AS approx_tokens, {strip('raw')} AS content
  FROM grouped WHERE {strip('raw')} <> '')"""

# Section-opening lines with their character offset; needs ``lines`` of SECTIONS.
HEADS = r"""heads AS (
  SELECT namespace, canonical_id, start_at, line FROM (
    SELECT namespace, canonical_id, i, line,
      coalesce(sum(length(line) + 1) OVER (PARTITION BY namespace, canonical_id ORDER BY i
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_at
    FROM lines) WHERE regexp_matches(line, '^#{1,2}\s.'))"""


def first_title(md: str) -> str:
    line = f"regexp_extract({md}, '(?m)^#{{1,2}}[ ].+$')"
    return f"nullif({strip(f"regexp_replace({line}, '^#+', '')")}, '')"


EDGES = """edges AS (
  SELECT '10.1234/o' || l_orderkey AS citing, '10.1234/p' || l_partkey AS cited,
    'omid:br/06' || l_partkey || ' doi:10.1234/p' || l_partkey || ' openalex:W' || l_partkey AS ids,
    strftime(l_shipdate, '%Y-%m-%d') AS creation,
    CASE WHEN l_returnflag = 'R' THEN 'yes' ELSE 'no' END AS journal_sc,
    CASE WHEN l_linestatus = 'O' THEN 'yes' ELSE 'no' END AS author_sc,
    l_orderkey AS ord, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp
  FROM lineitem)"""

CROSSREF_EDGES = """crossref_edges AS (
  SELECT * FROM edges WHERE journal_sc = 'no'
  UNION ALL SELECT * FROM edges WHERE journal_sc = 'no' AND author_sc = 'yes')"""

KNOWN = """cr_known AS (SELECT '10.1234/o' || o_orderkey AS doi FROM orders WHERE o_orderpriority <> '5-LOW'),
oc_known AS (SELECT '10.1234/o' || o_orderkey AS doi FROM orders WHERE o_orderstatus <> 'P')"""

COUNTS = """cr AS (SELECT doi, count(citing) AS n FROM cr_known LEFT JOIN crossref_edges ON doi = citing GROUP BY doi),
oc AS (SELECT doi, count(citing) AS n FROM oc_known LEFT JOIN edges ON doi = citing GROUP BY doi),
asked AS (SELECT '10.1234/o' || o_orderkey AS doi FROM orders),
counts AS (
  SELECT asked.doi, cr.n AS crossref_count, oc.n AS opencitations_count
  FROM asked LEFT JOIN cr ON asked.doi = cr.doi LEFT JOIN oc ON asked.doi = oc.doi)"""

# Kinds of works, in the order in which the works view deals them.
WORK_TYPES = (
    "article", "review", "letter", "editorial", "erratum", "preprint", "posted-content",
    "book", "book-chapter", "monograph", "dissertation", "proceedings-article", "proceedings",
    "report", "standard", "dataset", "other",
)
_TYPES = ", ".join(f"'{t}'" for t in WORK_TYPES)

NAMES = """list_filter([
      concat_ws(' ', w[7], {particle}, w[8]), coalesce(w[9], ''), concat_ws(' ', w[10], w[11])],
      lambda n: n <> '')"""


def author_names(k: str) -> str:
    particle = _case(f"{k} % 5", ("van", "de la", None, "Von", None))
    return NAMES.format(particle=particle)


WORKS = f"""src AS (
  SELECT doc_id AS k, doc_id, {words('text')} AS w, lang, o_orderdate, o_orderstatus, n_name, c_mktsegment
  FROM documents LEFT JOIN orders ON doc_id = o_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey),
works AS (
  SELECT k, 'https://doi.org/10.1234/O' || k AS doi, '10.1234/o' || k AS canonical_id,
    array_to_string(w[1:6], ' ') AS title, array_to_string(w, ' ') AS abstract,
    year(o_orderdate) AS publication_year, strftime(o_orderdate, '%Y-%m-%d') AS publication_date,
    [{_TYPES}][k % {len(WORK_TYPES)} + 1] AS type, lang AS language, c_mktsegment AS venue, n_name,
    c_mktsegment, o_orderstatus = 'O' AS is_oa, lower(o_orderstatus) AS oa_status,
    'https://oa.example/' || k AS oa_url, {author_names('k')} AS names
  FROM src)"""

ARXIV = f"""arxiv_src AS (SELECT doc_id, source, lang, n_chars, {words('text')} AS w FROM documents),
arxiv AS (
  SELECT doc_id, {arxiv_number('doc_id')} AS canonical_id,
    {arxiv_number('doc_id')} || 'v' || (doc_id % 3 + 1) AS arxiv_id,
    array_to_string(w[1:6], ' ') AS title, array_to_string(w, ' ') AS summary,
    (doc_id % 25 + 2000) || '-01-02T00:00:00Z' AS published, '2024-06-01T00:00:00Z' AS updated,
    {author_names('doc_id')} AS names, lang, source,
    CASE WHEN doc_id % 4 = 0 THEN n_chars || ' chars' END AS comment,
    CASE WHEN doc_id % 3 = 0 THEN 'J. Test & Lang ' || source END AS journal_ref,
    CASE WHEN doc_id % 2 = 0 THEN '10.1234/O' || doc_id END AS doi
  FROM arxiv_src)"""

PREPRINTS = """versions AS (
  SELECT l_orderkey AS k, '10.1101/2024.01.01.' || l_orderkey AS doi,
    'Preprint ' || l_orderkey || ' on part_' || l_partkey AS title,
    'Anna van Berg' || l_suppkey AS first_author, 'Li' || l_partkey AS second_author,
    'Anna van Berg' || l_suppkey || '|Li' || l_partkey || '||Solo' AS authors,
    'Institute ' || l_suppkey AS institution,
    strftime(l_shipdate, '%Y-%m-%d') AS date, CAST(l_linenumber AS VARCHAR) AS version,
    lower(l_returnflag) AS category, 'Abstract of ' || l_orderkey AS abstract,
    CASE WHEN l_suppkey % 2 = 0 THEN 'biorxiv' ELSE 'medrxiv' END AS server,
    CASE WHEN l_orderkey % 3 = 0 THEN '10.1234/O' || l_orderkey END AS published_doi,
    l_linenumber AS n, l_partkey * 10000000 + l_suppkey AS pos
  FROM lineitem),
preprints AS (
  SELECT *, 'https://www.' || server || '.org/content/' || doi || 'v' || version || '.full.pdf' AS pdf_url
  FROM versions QUALIFY row_number() OVER (PARTITION BY doi ORDER BY n DESC, pos, date) = 1)"""

_NS = _case("user_id % 7", NAMESPACES)
_KEYED = "user_id || '-' || CAST(json_extract(props, '$.k') AS VARCHAR)"

STORE = f"""store_events AS (
  SELECT {_NS} AS namespace, 'papers' AS entity, {_KEYED} AS key, event_id, event_type, ts FROM events),
records AS (
  SELECT namespace, entity, key, max(ts) AS stored_at FROM store_events
  WHERE event_type IN ('view', 'click') GROUP BY ALL),
negatives AS (
  SELECT namespace, entity, key, ts + INTERVAL 24 HOUR AS expires_at FROM store_events
  WHERE event_type = 'error'),
state AS (
  SELECT namespace, entity, key, max(stored_at) AS stored_at, max(expires_at) AS expires_at
  FROM (SELECT namespace, entity, key, stored_at, NULL AS expires_at FROM records
        UNION ALL SELECT namespace, entity, key, NULL, expires_at FROM negatives)
  GROUP BY ALL),
ttl AS (
  SELECT * FROM (VALUES ('openalex', 30), ('crossref', 30), ('wikipedia', 30), ('arxiv', 14),
    ('biorxiv', 7), ('opencitations', 7), ('acl_anthology', 100000)) v(namespace, days)),
answered AS (
  SELECT s.*, CASE WHEN stored_at + to_days(CAST(days AS INTEGER)) >= TIMESTAMP '2024-01-31' THEN 'hit'
    WHEN expires_at >= TIMESTAMP '2024-01-31' THEN 'negative' ELSE 'miss' END AS status
  FROM state s JOIN ttl USING (namespace))"""

_METRIC = "CASE event_type " + " ".join(
    f"WHEN '{e}' THEN '{m}'" for e, m in METRIC_OF_EVENT.items()
) + " END"

LOG = f"""log AS (
  SELECT event_id AS request_id, ts, {_NS} AS provider, {_METRIC} AS metric,
    {_case("k % 7", STATUSES)} AS status, value AS retry_after, props AS body,
    CASE WHEN event_type = 'error' AND k < 30 THEN 'timeout'
         WHEN event_type = 'error' AND k < 60 THEN 'network' END AS failure,
    CASE WHEN event_type IN ('view', 'signup') THEN 'start'
         WHEN event_type IN ('click', 'purchase') THEN 'finish' END AS phase
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events))"""

SUMMARIES = """summaries AS (
  SELECT p_name || ' ' || p_partkey AS title, p_type AS description, p_brand || ' ' || p_type AS extract,
    CASE WHEN p_partkey % 10 = 0 THEN 'disambiguation' ELSE 'standard' END AS type, p_partkey AS pageid,
    'https://en.wikipedia.org/wiki/' || replace(p_name || ' ' || p_partkey, ' ', '_') AS url
  FROM part)"""
