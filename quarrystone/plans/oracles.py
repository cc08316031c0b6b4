"""The registered queries in DuckDB's SQL."""

from __future__ import annotations

from ..functions import legal as L
from ..functions import text as T
from ..operators import answer as A
from ..operators import audit as U
from .queries import QUERIES, QUERY, TOP
from .structure_sql import PAGE_STRUCTURE

_TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]{{2,}}')"
_HASH = "left(sha256({}), 16)"
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _words(docs: str, docs_id: str) -> str:
    return f"SELECT {docs_id} AS id, {_TOKENS.format('text')} AS ws FROM {docs}"


def _bm25(queries: str, docs: str = "documents") -> str:
    """CTEs up to scores(qid, id, score); queries: SELECT qid, query."""
    return f"""
      queries AS ({queries}),
      terms AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({_TOKENS.format('query')}) AS term FROM queries) GROUP BY ALL),
      words AS ({_words(docs, 'doc_id')}),
      corpus AS (SELECT count(*) AS n, avg(CAST(len(ws) AS DOUBLE)) AS avgdl FROM words),
      hits AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(ws) AS dl, unnest(ws) AS term FROM words) WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
      df AS (SELECT term, count(*) AS df FROM hits GROUP BY term),
      scores AS (
        SELECT qid, id, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1.0) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
        FROM hits JOIN df USING (term) JOIN terms USING (term), corpus GROUP BY qid, id)"""


def _ranked(source: str, k: int, keep: str) -> str:
    return f"SELECT {keep}, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INTEGER) AS rank, score FROM {source} QUALIFY rank <= {k}"


_BY_QUERY = "(SELECT qid, id, round(score, 6) AS score FROM scores)"
BM25_TOPK = f"WITH {_bm25(f'SELECT 0 AS qid, {QUERY!r} AS query')} {_ranked(_BY_QUERY, 10, 'id AS doc_id')}"
BM25_BATCH = f"WITH {_bm25('SELECT item_id AS qid, text AS query FROM benchmark')} {_ranked(_BY_QUERY, 5, 'qid, id AS doc_id')}"
TERM_STATS = f"SELECT term, count(DISTINCT id) AS df, count(*) AS tf FROM (SELECT id, unnest(ws) AS term FROM ({_words('documents', 'doc_id')})) GROUP BY term"


def _vectors(where: str) -> str:
    dot = "round(list_inner_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6)"
    return f"(SELECT q.vec_id AS qid, e.vec_id AS id, {dot} AS score FROM embeddings e, embeddings q WHERE q.{where})"


VECTOR_TOPK = """
WITH parts AS (SELECT label, unnest(range(0, len(embedding))) AS i, unnest(embedding) AS x FROM embeddings),
mean AS (SELECT label, i, round(avg(CAST(x AS DOUBLE)), 6) AS x FROM parts GROUP BY ALL),
q AS (SELECT label, list(x ORDER BY i) AS v FROM mean GROUP BY label),
pairs AS (SELECT q.label, vec_id, round(list_inner_product(CAST(embedding AS DOUBLE[]), q.v), 6) AS s FROM embeddings e JOIN q ON true)
SELECT CAST(label AS BIGINT) AS label, vec_id, CAST(row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS INTEGER) AS rank, round(s, 4) AS score FROM pairs QUALIFY rank <= 10"""
VECTOR_TOPK_MULTI = _ranked(_vectors("vec_id % 50 = 0"), 5, "qid, id AS vec_id")

_CHUNK_ROWS = "SELECT doc_id, text, ['generic', 'article', 'heading', 'footnote', 'amendment'][doc_id % 5 + 1] AS chunk_type, doc_id % 30 + 1 AS page FROM documents"
HYBRID_TOPK = f"""
WITH {_bm25(f"SELECT vec_id AS qid, CASE WHEN vec_id % 100 = 0 THEN 'the amended thing' ELSE {QUERY!r} END AS query FROM embeddings WHERE vec_id % 50 = 0")},
chunk_rows AS ({_CHUNK_ROWS}),
near AS (SELECT qid, id, score AS vs FROM {_vectors("vec_id % 50 = 0")} WHERE id IN (SELECT doc_id FROM documents) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= 24),
lexical AS (SELECT qid, id, round(score / max(score) OVER (PARTITION BY qid), 9) AS bs FROM scores),
ids AS (SELECT qid, id FROM near UNION SELECT qid, id FROM (SELECT * FROM lexical QUALIFY row_number() OVER (PARTITION BY qid ORDER BY bs DESC, id) <= 24)),
scored AS (
  SELECT i.qid, i.id, round((0.7 * coalesce(vs, 0) + 0.3 * coalesce(bs, 0))
    * CASE WHEN chunk_type IN ('footnote', 'amendment') AND i.qid % 100 > 0 THEN 0.4 ELSE 1 END
    * CASE WHEN chunk_type = 'heading' THEN 0.7 ELSE 1 END
    * CASE WHEN page <= 10 AND regexp_matches(text, '(?i)^\\s*contents\\b') THEN 0.35 WHEN page <= 10 AND chunk_type = 'generic' THEN 0.6 ELSE 1 END, 6) AS score
  FROM ids i LEFT JOIN near USING (qid, id) LEFT JOIN lexical USING (qid, id) JOIN chunk_rows c ON c.doc_id = i.id)
SELECT qid, id AS doc_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INTEGER) AS rank, round(score, 4) AS score FROM scored QUALIFY rank <= 8
"""

_PACK = r"""
RECURSIVE pieces AS (
  SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ps FROM documents
), fold AS (
  SELECT doc_id, ps, 0 AS i, '' AS open, CAST([] AS VARCHAR[]) AS done FROM pieces
  UNION ALL
  SELECT doc_id, ps, i + 1,
    CASE WHEN length(grown) <= 700 THEN grown WHEN length(p) > 700 THEN '' ELSE p END,
    CASE WHEN length(grown) <= 700 THEN done
         ELSE done || CASE WHEN length(open) >= 80 THEN [open] ELSE [] END
                   || CASE WHEN length(p) > 700 THEN list_transform(range(0, length(p), 700), lambda k: substr(p, k + 1, 700)) ELSE [] END END
  FROM (SELECT *, ps[i + 1] AS p, CASE WHEN open = '' THEN ps[i + 1] ELSE open || chr(10) || ps[i + 1] END AS grown FROM fold WHERE i < len(ps))
), packed AS (
  SELECT doc_id, done || CASE WHEN length(open) >= 80 THEN [open] ELSE [] END AS cs FROM fold WHERE i = len(ps)
), numbered AS (
  SELECT doc_id, CAST(unnest(range(0, len(cs))) AS INTEGER) AS chunk_id, unnest(cs) AS text FROM packed
)"""
PACK_CHUNKS = f"WITH {_PACK} SELECT doc_id, chunk_id, text FROM numbered"
OVERLAP_CHUNKS = f"""
WITH {_PACK}, joined AS (
  SELECT doc_id, chunk_id, CASE WHEN chunk_id = 0 THEN text ELSE {_STRIP.format("right(lag(text) OVER (PARTITION BY doc_id ORDER BY chunk_id), 150) || ' ' || text")} END AS text FROM numbered)
SELECT doc_id, chunk_id, {_HASH.format('text')} AS hash, length(text) AS n FROM joined"""

def _folded(name: str, source: str, glue: str, least: int, cut: str) -> str:
    """CTEs up to name(k, cs): pieces of source (k, ps) joined with glue up to 700 characters; cut: what becomes of a longer piece p, whose number is i + 1."""
    grown = f"CASE WHEN open = '' THEN ps[i + 1] ELSE open || {glue} || ps[i + 1] END"
    return f"""{name}_fold AS (
  SELECT k, ps, 0 AS i, '' AS open, CAST([] AS VARCHAR[]) AS done FROM {source}
  UNION ALL
  SELECT k, ps, i + 1, CASE WHEN length(grown) <= 700 THEN grown WHEN length(p) > 700 THEN '' ELSE p END,
    CASE WHEN length(grown) <= 700 THEN done ELSE done || CASE WHEN length(open) >= {least} THEN [open] ELSE [] END || CASE WHEN length(p) > 700 THEN {cut} ELSE [] END END
  FROM (SELECT *, ps[i + 1] AS p, {grown} AS grown FROM {name}_fold WHERE i < len(ps))
), {name} AS (SELECT k, done || CASE WHEN length(open) >= {least} THEN [open] ELSE [] END AS cs FROM {name}_fold WHERE i = len(ps))"""


_PARAGRAPHS = r"""list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '(?m)^(#{1,4}\s)', chr(1) || '\1', 'g'), '\n{2,}', chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"""
_SENTENCES = r"""string_split(regexp_replace(p, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"""
CHUNK_DOCUMENTS = f"""
WITH RECURSIVE paragraphs AS (SELECT doc_id AS k, {_PARAGRAPHS} AS ps FROM documents),
long AS (SELECT {{'doc': k, 'n': n}} AS k, {_SENTENCES} AS ps FROM (SELECT k, unnest(range(1, len(ps) + 1)) AS n, unnest(ps) AS p FROM paragraphs) WHERE length(p) > 700),
{_folded('split', 'long', "' '", 1, 'list_transform(range(0, length(p), 550), lambda x: substr(p, x + 1, 700))')},
parts AS (SELECT k.doc AS doc, map_from_entries(list({{'k': k.n, 'v': cs}})) AS cut FROM split GROUP BY k.doc),
joint AS (SELECT {{'doc': k, 'cut': cut}} AS k, ps FROM paragraphs LEFT JOIN parts ON doc = k),
{_folded('packed', 'joint', "chr(10) || chr(10)", 80, 'k.cut[i + 1]')},
numbered AS (SELECT k.doc AS doc_id, unnest(range(0, len(cs))) AS chunk_id, unnest(cs) AS text FROM packed)
SELECT doc_id, CAST(chunk_id AS INTEGER) AS chunk_id, CASE WHEN chunk_id = 0 THEN text ELSE {_STRIP.format("right(lag(text) OVER (PARTITION BY doc_id ORDER BY chunk_id), 150) || ' ' || text")} END AS text FROM numbered"""


def _chain(text: str, steps: list[tuple[str, str]]) -> str:
    for pattern, to in steps:
        text = f"regexp_replace({text}, '{pattern}', '{to}', 'g')"
    return text


_RAW_PAGE = r"""'THE CONSTITUTION OF INDIA' || chr(10) || conv_id || chr(10) || '$^{2}[**' || replace(text, ' ', '  ') || '** $ ' || repeat(chr(10), 4) || '  end â€œx'"""
_REPAIRED = _RAW_PAGE
for _bad, _good in T.MOJIBAKE:
    _REPAIRED = f"replace({_REPAIRED}, {_quoted(_bad)}, {_quoted(_good)})"
NORMALIZE_TEXT = "SELECT conv_id, turn, " + _STRIP.format(_chain(_REPAIRED, [
    (r"\$\^\{\d+\}\[", ""), (r"\\mathrm\{([A-Z])\.\}", r"\1."), (r"\$", ""), (r"\*\*", ""), (r"(?m)^(\d+[A-Z]?\.\s+[^\n]{3,}?\.)\s*[-–—]\s*(\(.+)$", "\\1\n\\2"), (r"(?mi)^(?:THE\s+CONSTITUTION\s+OF\s+INDIA)\s*$", ""),
    (r"(?m)^\s*\d+\s*$", ""), (r"[ \t]+\n", "\n"), (r"\n[ \t]+", "\n"), (r"\n{3,}", "\n\n"), (r"[ \t]{2,}", " "), (r"(?m)[ \t\r]+$", ""),
])) + " AS text FROM conversations"

_CLAUSES = "'(1) ' || p_name || ' (a) ' || p_brand || ' and (b) ' || p_type || ' (2) sized ' || p_size"
CLAUSE_SPLIT = rf"""
WITH cut AS (SELECT p_partkey, list_filter(list_transform(string_split(regexp_replace({_CLAUSES}, '(\(\d+\)\s|\([a-z]\)\s)', chr(1) || '\1', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS cs FROM part)
SELECT p_partkey, CAST(unnest(range(0, len(cs))) AS INTEGER) AS pos, unnest(cs) AS clause FROM cut"""

_FOOTNOTED = r"p_name || repeat(' body text', p_size % 40) || chr(10) || 'Section ' || p_size || repeat(chr(10) || '1. Subs. by the Act of ' || p_size || ' w.e.f. 3-1-1977', p_partkey % 4)"
CLASSIFY_CHUNK = f"""
WITH rows AS (SELECT p_partkey, {_FOOTNOTED} AS t, ['text_block', 'article', 'list_heading', 'entry'][p_partkey // 4 % 4 + 1] AS kind FROM part),
counted AS (SELECT *, len(regexp_extract_all(t, '(?im){T.FOOTNOTE}')) AS m, length(t) - length(replace(t, chr(10), '')) + 1 AS n FROM rows)
SELECT p_partkey, CASE WHEN kind = 'list_heading' THEN 'heading' WHEN kind = 'article' THEN 'article' WHEN m > 0 AND (m / n > 0.3 OR m >= 3 AND length(t) < 600) THEN 'amendment'
  WHEN m > 0 AND length(t) < 300 THEN 'footnote' ELSE 'generic' END AS chunk_type, regexp_extract(t, '(?i){T.SECTION}', 1) AS section_id, m AS notes FROM counted"""
SQL_FUNCTIONS = CLASSIFY_CHUNK
EDITORIAL_TAIL = f"""
WITH rows AS (SELECT p_partkey, string_split({_FOOTNOTED}, chr(10)) AS ls FROM part),
found AS (SELECT *, list_position(list_transform(ls, lambda x: regexp_matches(x, '(?i){T.EDITORIAL_LINE}')), true) AS k FROM rows)
SELECT p_partkey, {_STRIP.format("array_to_string(CASE WHEN coalesce(k, 0) = 0 THEN ls ELSE ls[1:k - 1] END, chr(10))")} AS body,
  {_STRIP.format("array_to_string(CASE WHEN coalesce(k, 0) = 0 THEN [] ELSE ls[k:] END, chr(10))")} AS notes FROM found"""

_CUT = "list_transform(range(0, length(p), 700), lambda k: substr(p, k + 1, 700))"
_PARTED = rf"list_filter(list_transform(string_split_regex({{}}, '\n{{{{2,}}}}'), lambda x: {_STRIP.format('x')}), lambda x: x <> '')"
ARTICLE_SUBCHUNKS = rf"""
WITH RECURSIVE named AS (
  SELECT p_partkey AS k, CASE WHEN p_partkey % 7 > 0 THEN CAST(p_partkey % 395 AS VARCHAR) ELSE '' END AS article, CASE WHEN p_partkey % 2 = 0 THEN 'Of parts' ELSE '' END AS heading,
    CASE WHEN p_partkey % 5 = 0 THEN 'Article ' || (p_partkey % 395) || '. ' ELSE '' END || CASE WHEN p_partkey % 3 > 0
      THEN '(1) ' || repeat(p_name || ' of ' || p_brand || ' ', p_size % 9 + 1) || '(a) ' || repeat(p_name || ' of ' || p_brand || ' ', p_size % 31) || 'and so on. (2) ' || repeat(p_name || ' of ' || p_brand || ' ', CAST(p_partkey % 4 AS INTEGER)) || 'the end'
      ELSE repeat(p_type || ' and ', p_size % 12 + 1) || chr(10) || chr(10) || repeat(p_name || '; ', CAST(p_partkey % 60 AS INTEGER)) || chr(10) || chr(10) || p_brand END AS text FROM part),
marked AS (SELECT *, CASE WHEN article <> '' THEN '[Article ' || article || '] (continued) ' ELSE '' END AS mark, list_filter(list_transform(string_split(regexp_replace(text, '(\(\d+\)\s|\([a-z]\)\s)', chr(1) || '\1', 'g'), chr(1)), lambda x: {_STRIP.format('x')}), lambda x: x <> '') AS clauses FROM named),
pieces AS (SELECT k, clauses AS ps FROM marked WHERE length(text) > 700 AND len(clauses) > 1),
{_folded('packed', 'pieces', 'chr(10)', 80, '[p]')},
numbered AS (SELECT k, unnest(range(0, len(cs))) AS i, unnest(cs) AS c FROM packed),
prefixed AS (SELECT k, i, CASE WHEN i > 0 THEN mark ELSE '' END || c AS c, mark FROM numbered JOIN marked USING (k)),
long AS (
  SELECT ROW(k, i) AS k, {_PARTED.format('c')} AS ps FROM prefixed WHERE length(c) > 700
  UNION ALL SELECT ROW(k, CAST(-1 AS BIGINT)), {_PARTED.format('text')} FROM marked WHERE length(text) > 700 AND len(clauses) <= 1),
{_folded('split', 'long', 'chr(10) || chr(10)', 80, _CUT)},
pairs AS (SELECT k[1] AS k, k[2] AS i, unnest(cs) AS c, unnest(range(0, len(cs))) AS j FROM split),
cut AS (
  SELECT k, i, 0 AS j, c AS text FROM prefixed WHERE length(c) <= 700
  UNION ALL SELECT p.k, p.i, j, mark || c FROM pairs p JOIN marked USING (k)
  UNION ALL SELECT k, 0, 0, CASE WHEN article = '' OR contains(substr(text, 1, 80), 'Article ' || article) THEN text ELSE '[Article ' || article || ']' || CASE WHEN heading <> '' THEN ' ' || heading ELSE '' END || chr(10) || text END FROM marked WHERE length(text) <= 700)
SELECT k AS p_partkey, CAST(row_number() OVER (PARTITION BY k ORDER BY i, j) - 1 AS INTEGER) AS pos, text FROM cut"""
MERGED_BATCHES = "SELECT conv_id AS doc_id, CAST(turn % 3 AS INTEGER) AS page, turn // 3 AS batch_no, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, turn % 3 ORDER BY turn // 3 DESC) = 1"
TELEMETRY = """
WITH rows AS (
  SELECT conv_id AS qid, turn, CASE WHEN conv_id % 2 = 0 THEN 'identifier' ELSE 'hybrid' END AS method,
    'p' || CASE WHEN turn % 3 > 0 THEN CAST(turn AS VARCHAR) ELSE '?' END || '/' || CASE WHEN turn % 2 = 0 THEN 'clause' ELSE 'generic' END || '/art' || CASE WHEN turn % 4 = 0 THEN '21' ELSE '' END || '/s' || CAST(round(1 / (turn + 1), 4) AS DOUBLE) AS told
  FROM conversations WHERE conv_id % 9 > 0)
SELECT q.conv_id AS qid, method, substr(q.text, 1, 60) AS query, coalesce(n, 0) AS n, coalesce(top, '') AS top
FROM conversations q LEFT JOIN (SELECT qid, method, count(*) AS n, string_agg(told, ', ' ORDER BY turn) FILTER (turn < 5) AS top FROM rows GROUP BY ALL) r ON r.qid = q.conv_id WHERE q.turn = 0"""
DEDUP_BY_HASH = f"SELECT min(doc_id) AS doc_id, {_HASH.format('text')} AS file_hash FROM documents GROUP BY 2"
PENDING_DOCS = f"""
SELECT doc_id, {_HASH.format('text')} AS file_hash FROM documents
WHERE file_hash NOT IN (SELECT {_HASH.format('text')} FROM documents JOIN labels USING (doc_id) WHERE quality > 0)"""

_QUESTION = """CASE o_orderkey % 5
  WHEN 0 THEN 'Compare Articles ' || (o_orderkey % 390 + 1) || ' to ' || (o_orderkey % 390 + 1 + o_orderkey % 7)
  WHEN 1 THEN 'articles ' || (o_orderkey % 390 + 1) || ', ' || (o_orderkey % 77 + 1) || 'A and ' || (o_orderkey % 53 + 1) || ' on arrest'
  WHEN 2 THEN 'What of Article 352 and art. ' || (o_orderkey % 3 + 19) || ' of Part III, a writ for custody?'
  WHEN 3 THEN (o_orderkey % 20 + 1) || ' & ' || (o_orderkey % 30 + 1) || 'B'
  ELSE 'between ' || (o_orderkey % 20 + 1) || ' and ' || (o_orderkey % 9 + 1) || ' footnotes omitted, no case law' END"""
_ASKED = f"asked AS (SELECT o_orderkey, {_QUESTION} AS q FROM orders)"


def _numbers(q: str, pattern: str) -> str:
    return f"flatten(list_transform(regexp_extract_all({q}, '(?i){pattern}', 1), lambda x: list_transform(regexp_extract_all(x, '(?i)\\d+[A-Z]?'), lambda y: upper(y))))"


def _distinct(key: str, source: str, column: str, name: str) -> str:
    """Rows (key, pos, name): the elements of a list column, each once, in order."""
    return f"""SELECT {key}, CAST(row_number() OVER (PARTITION BY {key} ORDER BY min(k)) - 1 AS INTEGER) AS pos, x AS {name}
      FROM (SELECT {key}, unnest({column}) AS x, unnest(range(0, len({column}))) AS k FROM {source}) GROUP BY {key}, x"""


def _range(k: int) -> str:
    pattern = L.ARTICLE_RANGE.replace("\\u2013", "–").replace("\\u2014", "—")
    return f"regexp_extract_all(q, '(?i){pattern}', {k})"


EXTRACT_ARTICLES = f"""
WITH {_ASKED}, found AS (
  SELECT o_orderkey, list_filter(list_concat(
    flatten(list_transform(list_zip({_range(1)}, {_range(2)}), lambda z: list_transform(range(CAST(z[1] AS BIGINT), CAST(z[2] AS BIGINT) + 1), lambda n: CAST(n AS VARCHAR)))),
    {_numbers('q', L.ARTICLE_SERIES)}, {_numbers('q', L.BARE_SERIES)}, {_numbers('q', L.COMPARED)}, {_numbers('q', L.ARTICLE_REF)}),
    lambda n: CAST(regexp_extract(n, '^(\\d+)', 1) AS INTEGER) <= 400) AS ids FROM asked)
{_distinct('o_orderkey', 'found', 'ids', 'article')}"""
EXPAND_RANGE = """
WITH ends AS (SELECT p_partkey, p_size % 60 + 1 AS a, p_partkey % 60 + 1 AS b, p_partkey % 7 = 0 AS lettered FROM part),
found AS (SELECT p_partkey, CASE WHEN lettered THEN [CAST(a AS VARCHAR), b || 'A']
  ELSE list_transform(CASE WHEN a <= b THEN range(a, b + 1) ELSE range(a, b - 1, -1) END, lambda n: CAST(n AS VARCHAR)) END AS ids FROM ends)
SELECT p_partkey, CAST(unnest(range(0, len(ids))) AS INTEGER) AS pos, unnest(ids) AS article FROM found"""
_UPPER = r"upper(regexp_replace(trim({}), '[\[\](){{}}.]', '', 'g'))"
CANONICAL_IDS = rf"""
WITH raw AS (
  SELECT p_partkey, p_size, ['Seventh', ' [viii] ', '9th', '12', '13', 'first', '', 'second.', '2nd', 'xyz'][p_partkey % 10 + 1] AS s, ['Union List', 'state list', '1', 'II', 'list 3', '4', 'l1', ' (iii) ', '11', ''][p_partkey % 10 + 1] AS l FROM part),
bare AS (SELECT p_partkey, p_size, regexp_replace({_UPPER.format('s')}, '^(\d+)(?:ST|ND|RD|TH)$', '\1') AS s, regexp_replace({_UPPER.format('l')}, '^LIST\s+', '') AS l FROM raw),
named AS (SELECT *, list_position({list(L.ORDINALS)}, s) AS nth, try_cast(s AS INTEGER) AS n, CASE WHEN regexp_matches(l, '^[I1]+$') THEN replace(l, '1', 'I') ELSE l END AS li FROM bare)
SELECT p_partkey, CASE WHEN nth > 0 THEN {list(L.ROMAN)}[nth] WHEN n BETWEEN 1 AND 12 THEN {list(L.ROMAN)}[n] WHEN regexp_matches(s, '^(\d+|[IVXLC]+)$') THEN s ELSE '' END AS schedule_id,
  CASE WHEN list_position({list(L.LISTS)}, li) > 0 THEN {list(L.ROMAN)}[list_position({list(L.LISTS)}, li)] WHEN li IN ('1', 'I') THEN 'I' WHEN li IN ('2', 'II') THEN 'II' WHEN li IN ('3', 'III') THEN 'III' ELSE '' END AS list_id,
  {_UPPER.format("' [' || p_size || 'a.] '")} AS entry_id FROM named"""
_PLAIN_QUERY = "q"
for _pattern in T.CONSTITUTION_ONLY:
    _PLAIN_QUERY = f"regexp_replace({_PLAIN_QUERY}, '(?i){_pattern}', ' ', 'g')"
_PLAIN_QUERY = rf"trim(regexp_replace({_PLAIN_QUERY}, '\s+', ' ', 'g'))"
QUERY_MODES = f"""
WITH {_ASKED}, plain AS (SELECT *, {_PLAIN_QUERY} AS p, regexp_matches(q, '(?i){T.REMEDY}') AND regexp_matches(q, '(?i){T.FUNDAMENTAL_RIGHTS}') AS more FROM asked)
SELECT o_orderkey, regexp_matches(q, '(?i){T.WANTS_AMENDMENTS}') AS amendments,
  CASE {' '.join(f"WHEN regexp_matches(q, '(?i){pattern}') THEN '{name}'" for name, pattern in T.AMENDMENT_LABELS)} ELSE 'amendment' END AS label,
  regexp_matches(q, '(?i){"|".join(T.CONSTITUTION_ONLY)}') AS "only",
  CASE WHEN p = '' AND NOT more THEN q WHEN more THEN trim(p || ' {T.REMEDY_TERMS}') ELSE p END AS lexical FROM plain"""
EXPAND_RULES = f"""
WITH {_ASKED}, base AS (
  SELECT o_orderkey, q, {_numbers('q', r'\bArticles?\s+([^\n?.;:]+)')} AS mentions, {_numbers('q', L.ARTICLE_REF)} AS refs FROM asked),
firsts AS (SELECT *, CASE WHEN len(mentions) > 0 THEN mentions ELSE refs END AS ids FROM base),
found AS (
  SELECT o_orderkey, list_concat(ids, refs,
    CASE WHEN list_contains(ids, '352') AND list_contains(ids, '19') THEN ['358'] ELSE [] END,
    CASE WHEN list_contains(ids, '352') AND (list_contains(ids, '20') OR list_contains(ids, '21')) THEN ['359'] ELSE [] END,
    CASE WHEN regexp_matches(q, '(?i){T.ARREST}') THEN ['22'] ELSE [] END,
    CASE WHEN regexp_matches(q, '(?i){T.ARREST}') AND regexp_matches(q, '(?i){T.REMEDY}') THEN ['32'] ELSE [] END) AS ids FROM firsts),
once AS ({_distinct('o_orderkey', 'found', 'ids', 'article')})
SELECT o_orderkey, coalesce(articles, '') AS articles FROM orders LEFT JOIN (SELECT o_orderkey, string_agg(article, ',' ORDER BY pos) AS articles FROM once GROUP BY o_orderkey) USING (o_orderkey)"""

_LEGAL = """legal AS (
  SELECT p_partkey AS chunk_pos, '[Article ' || (p_partkey % 395 + 1) || '] see article ' || (p_partkey % 391 + 1) || ' and Art. ' || (p_partkey % 395 + 1) || ' of part ' || ['i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix', 'x', 'xi', 'xii'][p_partkey % 12 + 1] || ' ' || p_name AS text,
    CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey % 395 + 1 AS VARCHAR) ELSE '' END AS article_id, CASE WHEN p_partkey % 4 = 1 THEN 'IX' ELSE '' END AS schedule_id,
    CASE WHEN p_partkey % 5 = 2 THEN 'II' ELSE '' END AS list_id, CASE WHEN p_partkey % 2 = 0 THEN (p_partkey % 40 + 1) || 'A' ELSE '' END AS entry_id FROM part),
postings AS (
  SELECT 'article' AS kind, article_id AS key, chunk_pos FROM legal WHERE article_id <> ''
  UNION SELECT 'schedule', CASE WHEN schedule_id <> '' THEN schedule_id ELSE 'VII' END, chunk_pos FROM legal WHERE schedule_id <> '' OR list_id <> ''
  UNION SELECT 'list', list_id, chunk_pos FROM legal WHERE list_id <> ''
  UNION SELECT 'entry', list_id || ':' || entry_id, chunk_pos FROM legal WHERE list_id <> '' AND entry_id <> ''
  UNION SELECT 'tag', 'ref_article_' || lower(r), chunk_pos FROM (SELECT *, upper(unnest(regexp_extract_all(text, '(?i)(?:Article|Art\\.?)\\s+(\\d+[A-Z]?)', 1))) AS r FROM legal) WHERE r <> article_id
  UNION SELECT 'part', upper(unnest(regexp_extract_all(text, '(?i)Part\\s+([IVXLC]+(?:-[A-Z])?)', 1))), chunk_pos FROM legal)"""
BUILD_POSTINGS = f"WITH {_LEGAL} SELECT kind, key, chunk_pos FROM postings"
PRIORITY_LOOKUP = f"""
WITH {_LEGAL}, named AS (
  SELECT o_orderkey AS qid, [CAST(o_orderkey % 390 + 1 AS VARCHAR), CAST(o_orderkey % 3 + 19 AS VARCHAR)] AS a FROM orders),
lists AS (
  SELECT qid, list_concat(CASE WHEN a[1] = a[2] THEN a[1:1] ELSE a END,
    CASE WHEN a[1] = '352' AND a[2] = '19' THEN ['358'] ELSE [] END, CASE WHEN a[1] = '352' AND a[2] IN ('20', '21') THEN ['359'] ELSE [] END,
    CASE WHEN qid % 2 = 0 THEN ['22', '32'] ELSE [] END) AS a FROM named),
asked AS (SELECT qid, key, min(ord) AS ord FROM (SELECT qid, unnest(a) AS key, unnest(range(0, len(a))) AS ord FROM lists) GROUP BY ALL),
hits AS (
  SELECT qid, ord, 0 AS d, chunk_pos FROM asked JOIN postings ON kind = 'article' AND postings.key = asked.key
  UNION ALL SELECT qid, ord, 1, chunk_pos FROM asked JOIN postings ON kind = 'tag' AND postings.key = 'ref_article_' || asked.key),
firsts AS (SELECT qid, chunk_pos, min(ROW(ord, d, chunk_pos)) AS place FROM hits GROUP BY ALL)
SELECT qid, chunk_pos, CAST(row_number() OVER (PARTITION BY qid ORDER BY place) AS INTEGER) AS rank FROM firsts"""
STRUCTURAL_LOOKUP = f"""
WITH {_LEGAL}, asked AS (
  SELECT o_orderkey AS qid, CASE o_orderkey % 5 WHEN 0 THEN 'What is entry ' || (o_orderkey % 40 + 1) || 'a of the State List and of list 3?' WHEN 1 THEN 'Entry ' || (o_orderkey % 40 + 1) || 'A, please'
    WHEN 2 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'All of the State  List' ELSE 'LIST 2 or the Union List' END WHEN 3 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'the Ninth Schedule' ELSE 'Sch. 7 and schedule IX' END
    ELSE 'Part ' || {list(L.ROMAN)}[o_orderkey % 12 + 1] END AS q FROM orders),
said AS (
  SELECT qid, list_transform(regexp_extract_all(q, '(?i)\\b(LIST\\s+(?:III|II|I|1|2|3)|UNION\\s+LIST|STATE\\s+LIST|CONCURRENT\\s+LIST)\\b', 1),
      lambda x: CASE WHEN regexp_matches(x, '(?i)union|list +(i|1)$') THEN 'I' WHEN regexp_matches(x, '(?i)state|(ii|2)$') THEN 'II' ELSE 'III' END) AS lists,
    list_transform(regexp_extract_all(q, '(?i)\\bEntry\\s+(\\d+[A-Z]?)\\b', 1), lambda x: upper(x)) AS entries,
    list_transform(list_concat(regexp_extract_all(q, '(?i)\\b(NINTH|SEVENTH)\\s+SCHEDULE\\b', 1), regexp_extract_all(q, '(?i)\\b(?:Schedule|Sch\\.?)\\s+([IVXLC]+|\\d+)\\b', 1)),
      lambda x: CASE WHEN upper(x) IN ('NINTH', 'IX', '9') THEN 'IX' WHEN upper(x) IN ('SEVENTH', 'VII', '7') THEN 'VII' END) AS schedules,
    list_transform(regexp_extract_all(q, '(?i)Part\\s+([IVXLC]+)', 1), lambda x: upper(x)) AS parts FROM asked),
keys AS (
  SELECT qid, 2 AS prio, 'part' AS kind, unnest(parts) AS key, unnest(range(0, len(parts))) AS ord FROM said
  UNION ALL SELECT qid, 3, 'entry', l || ':' || unnest(entries), ord * 1000 + unnest(range(0, len(entries))) FROM (SELECT qid, entries, unnest(lists) AS l, unnest(range(0, len(lists))) AS ord FROM said)
  UNION ALL SELECT qid, 4, 'schedule', unnest(schedules), unnest(range(0, len(schedules))) FROM said
  UNION ALL SELECT qid, 5, 'list', unnest(lists), unnest(range(0, len(lists))) FROM said WHERE len(entries) = 0
  UNION ALL SELECT qid, 6, 'any', unnest(entries), unnest(range(0, len(entries))) FROM said WHERE len(lists) = 0),
known AS (SELECT kind, key, chunk_pos FROM postings UNION ALL SELECT 'any', split_part(key, ':', 2), chunk_pos FROM postings WHERE kind = 'entry'),
firsts AS (SELECT qid, chunk_pos, min(ROW(prio, ord, chunk_pos)) AS place FROM keys JOIN known USING (kind, key) GROUP BY ALL)
SELECT qid, chunk_pos, CAST(row_number() OVER (PARTITION BY qid ORDER BY place) AS INTEGER) AS rank FROM firsts QUALIFY rank <= {TOP}"""
HEADS_FIRST = """
WITH n AS (SELECT l_orderkey, l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber) AS nth FROM lineitem)
SELECT l_orderkey, l_suppkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY nth > 1, l_suppkey, nth) AS INTEGER) AS rank FROM n"""
SYNTHETIC_FALLBACK = """
SELECT o_orderkey AS qid, CAST(o_orderkey % 395 + 1 AS VARCHAR) AS article_id, CAST(-1 AS BIGINT) AS chunk_pos, 'amendment' AS chunk_type,
  'No ' || ['footnote', 'omission/amendment note', 'insertion/amendment note', 'amendment/editorial note'][o_orderkey % 5 + 1] || ' for Article ' || (o_orderkey % 395 + 1) || ' was found in the retrieved Constitution context.' AS text
FROM orders WHERE o_orderkey % 5 < 4 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.05)"""
PAGE_WINDOW = """
SELECT d.doc_id, CAST(p.page AS INTEGER) AS page, coalesce(c.text, '') AS text, c.text IS NULL AS missing
FROM (SELECT DISTINCT conv_id AS doc_id FROM conversations) d CROSS JOIN (SELECT unnest(range(0, 6)) AS page) p
LEFT JOIN conversations c ON c.conv_id = d.doc_id AND c.turn = p.page"""
_PAGE_MARK = r"(?i)---\s*page\s+(\d+)\s*---"
SPLIT_PAGES = rf"""
WITH files AS (
  SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'preamble' || chr(10) || '--- page 1 ---' || chr(10) || p_name || chr(10) || chr(10) || '--- Page 7 ---' || chr(10) || ' ' || chr(10) || '--- page 12 ---' || chr(10) || p_type || chr(10)
    ELSE p_name || chr(12) || ' ' || chr(12) || p_brand END AS content FROM part),
cut AS (SELECT *, regexp_extract_all(content, '{_PAGE_MARK}', 1) AS marks, string_split_regex(content, '{_PAGE_MARK}') AS bodies, string_split(content, chr(12)) AS fed FROM files),
found AS (
  SELECT p_partkey, unnest(CASE WHEN len(marks) > 0 THEN list_transform(marks, lambda m: CAST(m AS INTEGER)) ELSE CAST(range(1, len(fed) + 1) AS INTEGER[]) END) AS page,
    unnest(CASE WHEN len(marks) > 0 THEN bodies[2:] ELSE fed END) AS body FROM cut)
SELECT p_partkey AS doc_id, page, {_STRIP.format('body')} AS text FROM found WHERE {_STRIP.format('body')} <> ''"""
JSON_BLOCKS = "SELECT event_id, json_extract_string(props, '$.page') AS page, json_valid(props) AS valid FROM events"
CITATION_HEADER = rf"""
WITH raw AS (
  SELECT p_partkey AS k, ' the  file ' || (p_partkey // 100) || '.pdf' AS name, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey % 395 + 1 AS VARCHAR) ELSE '' END AS article, CASE WHEN p_partkey % 4 = 1 THEN 'Ninth' ELSE '' END AS schedule,
    CASE WHEN p_partkey % 5 = 2 THEN 'State List' ELSE '' END AS list, CASE WHEN p_partkey % 2 = 0 THEN (p_partkey % 40 + 1) || 'a' ELSE '' END AS entry,
    p_partkey % 50 AS page, CASE WHEN p_partkey % 6 > 0 THEN p_partkey % 50 END AS page_start, p_partkey % 50 + p_partkey % 2 AS page_end, p_partkey % 11 > 0 AS cited, CASE WHEN p_partkey % 3 = 0 THEN 'footnote' ELSE 'generic' END AS kind FROM part),
parts AS (
  SELECT k, cited, concat_ws(' | ', nullif(trim(regexp_replace(name, '\s+', ' ', 'g')), ''), 'article:' || nullif(article, ''), 'schedule:' || nullif(schedule, ''), 'list:' || nullif(list, ''), 'entry:' || nullif(entry, ''),
    'p:' || coalesce(page_start, page) || CASE WHEN coalesce(page_end, page_start, page) <> coalesce(page_start, page) THEN '-' || page_end ELSE '' END, CASE WHEN kind NOT IN ('', 'generic', 'article') THEN kind END) AS parts FROM raw)
SELECT k AS chunk_pos, CASE WHEN cited AND parts <> '' THEN '[' || parts || ']' ELSE '' END AS header FROM parts"""
PROMPT_CONTEXT = """
SELECT conv_id AS qid, string_agg('--- Chunk ' || (turn + 1) || ' [' || role || ' | p:' || turn || ' | clause] ---' || chr(10) || substr(text, 1, 1500), chr(10) || chr(10) ORDER BY turn) AS context
FROM conversations GROUP BY conv_id"""
_TERMS = "['privacy', 'dignity', 'health', 'pollution-free environment', 'pollution free environment', 'maneka gandhi']"
_FOREIGN = " OR ".join(f"regexp_matches(lower(x), '(?i){p}') AND NOT regexp_matches(lower(context), '(?i){p}')" for p in T.EXTERNAL_LINES)
_TIDY = r"regexp_replace(regexp_replace({}, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"
CLEAN_ANSWER = rf"""
WITH raw AS (
  SELECT conv_id, turn, CASE WHEN turn % 4 < 3 THEN text || chr(10) || 'The right to Privacy and health.' || chr(10) ELSE '' END || '  Under the IPC. ' || chr(10)
      || CASE WHEN turn % 4 = 0 THEN 'A court held so.' || chr(10) || 'Not found in provided context.' || chr(10) || '<citation id="1">kept' || chr(10) || ' here</citation><citation a="synthetic">gone</citation>' || repeat(chr(10), 4) || 'End </analysis>' ELSE '</reasoning>' END AS answer,
    concat_ws(' ', CASE WHEN turn % 2 = 0 THEN 'on health and privacy' END, CASE WHEN turn % 3 = 1 THEN 'as the Penal Code and the ipc say' END, 'of all') AS context, turn % 3 < 2 AS only_here, turn % 7 = 6 AS noted FROM conversations),
opened AS (SELECT *, string_split(regexp_replace(replace(regexp_replace(regexp_replace(answer, '</?(?:think|thinking|analysis|reasoning)\b[^>]*>', '', 'gi'), '<citation\b[^>]*synthetic[^>]*>[^<]*</citation>', '', 'g'), 'kept' || chr(10) || ' here', 'kept here'), '</?citation[^>]*>', '', 'g'), chr(10)) AS ls FROM raw),
stripped AS (SELECT *, list_transform(ls, lambda x: {_STRIP.format('x')}) AS lines FROM opened),
backed AS (SELECT *, list_filter(lines, lambda x: x = '{T.NOT_FOUND}' OR len(list_filter({_TERMS}, lambda t: contains(lower(x), t) AND NOT contains(lower(context), t))) = 0) AS kept FROM stripped),
local AS (SELECT *, CASE WHEN only_here THEN list_transform(list_filter(kept, lambda x: x = '{T.NOT_FOUND}' OR NOT ({_FOREIGN})), lambda x: CASE WHEN x = '{T.NOT_FOUND}' THEN '{T.NOT_FOUND_HERE}' ELSE x END) ELSE kept END AS told FROM backed)
SELECT conv_id, turn, CASE WHEN noted THEN 'No footnote was found.' ELSE coalesce(nullif({_TIDY.format("array_to_string(told, chr(10))")}, ''), CASE WHEN only_here THEN '{T.NOT_FOUND_HERE}' ELSE '{T.NOT_FOUND}' END) END AS cleaned FROM local"""
CITATION_BRACKETS = rf"""
WITH texts AS (
  SELECT p_partkey, p_name || ' [p: ' || p_partkey || ' | Article:' || (p_partkey % 9) || ' | doc the  file.pdf | type:' || CASE WHEN p_partkey % 3 = 0 THEN 'Generic' ELSE 'clause' END || '] and [see above] [type: article] [entry:' || (p_partkey % 5) || '|list:II]' AS text FROM part),
cut AS (SELECT p_partkey, string_split_regex(text, '\[[^\]]*\]') AS between, regexp_extract_all(text, '\[[^\]]*\]') AS brackets FROM texts),
each AS (SELECT p_partkey, unnest(brackets) AS bracket, unnest(range(0, len(brackets))) AS i FROM cut),
bodies AS (SELECT *, trim(regexp_replace(bracket[2:-2], '\s+', ' ', 'g')) AS body FROM each),
parts AS (SELECT p_partkey, i, trim(unnest(string_split(body, '|'))) AS part, unnest(range(0, len(string_split(body, '|')))) AS nth FROM bodies),
told AS (
  SELECT p_partkey, i, nth, CASE WHEN contains(part, ':') THEN lower(trim(split_part(part, ':', 1))) WHEN regexp_matches(part, '(?i)^doc .|\.pdf') THEN 'doc' WHEN regexp_matches(part, '(?i)^type .') THEN 'type' ELSE '' END AS k,
    CASE WHEN contains(part, ':') THEN trim(part[strpos(part, ':') + 1:]) WHEN regexp_matches(part, '(?i)^(doc|type) .') THEN trim(part[strpos(part, ' ') + 1:]) WHEN regexp_matches(part, '(?i)\.pdf') THEN part ELSE '' END AS v FROM parts),
fields AS (SELECT p_partkey, i, map_from_entries(list((k, v) ORDER BY k)) AS f FROM (SELECT p_partkey, i, k, arg_max(v, nth) AS v FROM told WHERE v <> '' GROUP BY ALL) GROUP BY ALL),
formed AS (
  SELECT b.p_partkey, b.i, CASE WHEN NOT regexp_matches(body, '{A._SIGNAL}') THEN bracket WHEN said = '' THEN '' ELSE '[' || said || ']' END AS form
  FROM (SELECT b.*, concat_ws(' | ', f['doc'], {', '.join(f"'{k}:' || f['{k}']" for k in A._PARTS)}, CASE WHEN lower(f['type']) NOT IN ('generic', 'article') THEN f['type'] END) AS said FROM bodies b LEFT JOIN fields USING (p_partkey, i)) b)
SELECT p_partkey, array_to_string(list_transform(range(1, len(between) + 1), lambda n: between[n] || coalesce(forms[n], '')), '') AS text
FROM cut JOIN (SELECT p_partkey, list(form ORDER BY i) AS forms FROM formed GROUP BY p_partkey) USING (p_partkey)"""
_CITED = """cited AS (
  SELECT conv_id AS qid, turn + 1 AS rank, text, role AS filename, turn AS page, conv_id % 4 = 0 OR conv_id % 4 = 1 AND turn = 0 AS synthetic,
    '--- Chunk ' || (turn + 1) || CASE WHEN conv_id % 4 = 0 OR conv_id % 4 = 1 AND turn = 0 THEN ' (synthetic retrieval note for Article 7; reason: none) ---' ELSE ' [' || role || ' | article:7 | p:' || turn || ' | clause] ---' END AS header FROM conversations)"""
PROMPT_MESSAGES = f"""
WITH {_CITED}, per AS (
  SELECT qid, string_agg(header || chr(10) || substr(text, 1, 1500), chr(10) || chr(10) ORDER BY rank) AS context, bool_or(synthetic) AS noted, bool_and(synthetic) AS whole, qid % 3 = 0 AS only_here FROM cited GROUP BY qid)
SELECT qid, 'system' AS role, {_quoted(A.RULES)} || CASE WHEN only_here THEN {_quoted(A.ONLY_RULES)} ELSE '' END || CASE WHEN noted THEN {_quoted(A.NOTE_RULE)} ELSE '' END || CASE WHEN whole THEN {_quoted(A.ALL_NOTES_RULE)} ELSE '' END AS content FROM per
UNION ALL SELECT qid, 'user', 'CONTEXT:' || chr(10) || context || chr(10) || chr(10) || 'QUESTION: ' || CASE WHEN only_here THEN 'constitution only: why?' ELSE 'why?' END || chr(10) || chr(10)
  || CASE WHEN only_here THEN {_quoted(A.ONLY_NOTE)} ELSE '' END || {_quoted(A.CLOSING)} FROM per"""
ANSWER_GROUNDING = rf"""
WITH {_CITED}, lines AS (SELECT *, {_STRIP.format(r"regexp_replace(text, '\s+', ' ', 'g')")} AS said FROM cited)
SELECT qid, string_agg(text, chr(10) ORDER BY rank) AS context, CASE WHEN bool_and(synthetic) THEN min_by(said, rank) FILTER (said <> '') END AS note FROM lines GROUP BY qid"""
SHOWN_SOURCES = f"""
WITH {_CITED}, images AS (SELECT DISTINCT filename, page, filename || '/' || page AS image_path FROM cited WHERE page % 2 = 0)
SELECT qid, rank, synthetic AS note, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS text,
  CASE WHEN NOT synthetic AND row_number() OVER (PARTITION BY qid, filename, page ORDER BY rank) = 1 THEN image_path END AS image_path
FROM cited LEFT JOIN images USING (filename, page)"""
_STORED = """stored AS (
  SELECT *, page AS page_start, page + CASE WHEN chunk_id = 2 THEN -1 ELSE 1 END AS page_end FROM (
    SELECT CASE WHEN conv_id % 17 > 0 THEN conv_id END AS doc_id, 'f' || (conv_id % 3) || '.pdf' AS filename, turn - CASE WHEN conv_id % 11 = 0 THEN turn % 2 ELSE 0 END AS chunk_id, conv_id * 1000 + turn AS chunk_pos,
      CASE WHEN turn % 6 < 5 THEN turn * 3 % 7 END AS page, CASE WHEN turn % 4 = 3 THEN ' ' ELSE text END AS text, CASE role WHEN 'user' THEN 'generic' WHEN 'system' THEN 'heading' ELSE role END AS chunk_type,
      CASE WHEN turn % 2 = 0 THEN CAST(conv_id % 40 AS VARCHAR) ELSE '' END AS article_id, role AS source_extraction FROM conversations))"""
_WINDOWED = "rows AS (SELECT *, count(*) OVER (PARTITION BY doc_id, chunk_id) AS times, page < lag(page) OVER (PARTITION BY doc_id ORDER BY chunk_id, chunk_pos) AS back FROM stored)"
_ISSUES = {
    "missing_section_id": "true", **{f"missing_{c}": f"{c} IS NULL" for c in ("doc_id", "filename", "page", "chunk_id", "text", "page_start", "page_end", "chunk_type", "article_id", "source_extraction")},
    **{f"missing_{c}": "false" for c in ("image_path", "schedule_id", "list_id", "entry_id")}, "empty_text": "trim(text) = '' AND chunk_type <> 'heading'",
    "unknown_type": "chunk_type NOT IN ('article', 'clause', 'heading', 'footnote', 'amendment', 'generic')", "row_mismatch": "chunk_pos <> chunk_id", "duplicate_key": "times > 1", "page_order": "back",
    "page_range": "page IS NOT NULL AND (page <= 0 OR page_end <= 0 OR page NOT BETWEEN page_start AND page_end)",
}
VALIDATE_STORE = f"WITH {_STORED}, {_WINDOWED} " + " UNION ALL ".join(f"SELECT '{k}' AS issue, count(*) FILTER ({cond}) AS n FROM rows" for k, cond in _ISSUES.items())
STORE_COUNTERS = f"""
WITH {_STORED}, keys AS (SELECT unnest(['chunk_type', 'source_extraction', 'article']) AS section, unnest([chunk_type, source_extraction, article_id]) AS key FROM stored),
sums AS (SELECT section, key, count(*) AS n FROM keys WHERE section <> 'article' OR key <> '' GROUP BY ALL)
SELECT section, key, n FROM sums QUALIFY section <> 'article' OR row_number() OVER (PARTITION BY section ORDER BY n DESC, key) <= 20"""
STORE_DOCUMENTS = f"WITH {_STORED} SELECT doc_id, string_agg(DISTINCT filename, ',' ORDER BY filename) AS filenames FROM stored GROUP BY doc_id"
_VALID = """changed AS (
  SELECT chunk_pos, CASE WHEN chunk_pos % 7 = 0 THEN '1' ELSE article_id END AS article_id, CASE WHEN chunk_pos % 13 = 0 THEN 'X' ELSE schedule_id END AS schedule_id,
    CASE WHEN chunk_pos % 17 = 0 THEN 'I' ELSE list_id END AS list_id, entry_id FROM legal WHERE chunk_pos % 10 > 0)"""
VALIDATE_INDEX = f"""
WITH {_LEGAL}, {_VALID}, found AS (
  SELECT p.kind, p.key, p.chunk_pos, CASE WHEN c.chunk_pos IS NULL THEN 'out_of_range' WHEN kind = 'article' AND article_id <> key THEN 'article_mismatch'
    WHEN kind = 'schedule' AND schedule_id <> key AND key <> 'VII' THEN 'schedule_mismatch' WHEN kind = 'list' AND list_id <> key THEN 'list_mismatch'
    WHEN kind = 'entry' AND list_id || ':' || entry_id <> key THEN 'entry_mismatch' END AS issue FROM postings p LEFT JOIN changed c USING (chunk_pos))
SELECT kind, key, chunk_pos, issue FROM found WHERE issue IS NOT NULL"""
BEST_OF_ARTICLE = rf"""
WITH {_LEGAL}, own AS (
  SELECT chunk_pos, article_id, repeat(text, CAST(chunk_pos % 4 AS INTEGER)) || CASE WHEN chunk_pos % 5 = 0 THEN '(1) x' ELSE ' ' END AS text, ['article', 'generic', 'heading', 'footnote'][(chunk_pos // 3) % 4 + 1] AS kind,
    CASE WHEN chunk_pos % 50 > 0 THEN chunk_pos % 50 ELSE 1000000000 END AS page FROM legal WHERE article_id <> ''),
sized AS (SELECT *, length({_STRIP.format('text')}) AS n FROM own)
SELECT article_id, arg_min(chunk_pos, ROW(CASE WHEN page <= 10 AND n < 180 THEN 1 ELSE 0 END, CASE WHEN n >= 180 OR contains(text, '(1)') THEN 0 ELSE 1 END, CASE WHEN kind IN ('article', 'clause', 'amendment') THEN 0 ELSE 1 END, page, -n, chunk_pos)) AS chunk_pos
FROM sized GROUP BY article_id"""
STORED_INDEX = f"""
WITH {_LEGAL}, keyed AS (SELECT kind, key, chunk_pos, min(chunk_pos) OVER (PARTITION BY kind, key) % 7 AS m, row_number() OVER (PARTITION BY kind, key) = 1 AS one FROM postings)
SELECT kind, key, CAST(NULL AS BIGINT) AS chunk_pos, 'not_list' AS issue FROM keyed WHERE m = 0 AND one
UNION ALL SELECT kind, key, NULL, 'non_int' FROM keyed, range(CASE WHEN m = 3 THEN 2 ELSE 1 END) WHERE m IN (1, 3) AND one
UNION ALL SELECT kind, key, 1000000000, 'out_of_range' FROM keyed WHERE m = 2 AND one
UNION ALL SELECT kind, key, chunk_pos, 'out_of_range' FROM keyed WHERE m > 0 AND chunk_pos % 10 = 0"""
_HEADINGS = "headings AS (SELECT chunk_pos, regexp_extract(text, '^\\[Article (\\d+)', 1) AS article FROM legal)"
HEADING_AUDIT = f"""
WITH {_LEGAL}, {_HEADINGS}
SELECT article, count(*) AS n, article IN (SELECT key FROM postings WHERE kind = 'article') AS indexed FROM headings GROUP BY article"""
TARGET_ARTICLES = f"""
WITH {_LEGAL}, {_HEADINGS}, wanted AS (SELECT unnest([{', '.join(repr(a) for a in U.TARGET_ARTICLES)}]) AS article),
indexed AS (SELECT article, chunk_pos, 'index' AS source FROM postings JOIN wanted ON kind = 'article' AND key = article),
places AS (SELECT * FROM indexed UNION ALL SELECT article, chunk_pos, 'heading' FROM headings JOIN wanted USING (article) WHERE article NOT IN (SELECT article FROM indexed))
SELECT article, source, CAST(row_number() OVER (PARTITION BY article ORDER BY chunk_pos) AS INTEGER) AS nth, chunk_pos, CAST(chunk_pos % 50 AS INTEGER) AS page, 'generic' AS chunk_type, substr(text, 1, 140) AS text
FROM places JOIN legal USING (chunk_pos) QUALIFY nth <= 10"""
_REPORTED = {k: (f"{k.removeprefix('missing_')} IS NULL" if k.startswith("missing_") else cond) for k, cond in _ISSUES.items()}
STORE_REPORT = f"""
WITH {_LEGAL}, {_HEADINGS}, stored AS (
  SELECT chunk_pos, CAST(chunk_pos // 100 AS VARCHAR) AS doc_id, 'f' AS filename, chunk_pos % 100 AS chunk_id, chunk_pos % 50 AS page, chunk_pos % 50 AS page_start, chunk_pos % 50 AS page_end, text, 'generic' AS chunk_type, 'text' AS source_extraction,
    '' AS image_path, article_id, schedule_id, list_id, entry_id, '' AS section_id FROM legal),
{_WINDOWED}, keys AS (SELECT unnest(['chunk_type', 'source_extraction', 'article']) AS section, unnest([chunk_type, source_extraction, article_id]) AS key FROM stored),
sums AS (SELECT section, key, count(*) AS n FROM keys WHERE section <> 'article' OR key <> '' GROUP BY ALL),
counted AS (SELECT * FROM sums QUALIFY section <> 'article' OR row_number() OVER (PARTITION BY section ORDER BY n DESC, key) <= 20), raw AS (SELECT chunk_pos, CASE WHEN schedule_id <> '' THEN 'NINTH' ELSE '' END AS schedule_id, CASE WHEN list_id <> '' THEN 'STATE LIST' ELSE '' END AS list_id FROM legal),
bad AS (SELECT kind, CASE WHEN kind = 'schedule' AND raw.schedule_id <> key AND key <> 'VII' THEN 'schedule_mismatch' WHEN kind = 'list' AND raw.list_id <> key THEN 'list_mismatch' WHEN kind = 'entry' THEN 'entry_mismatch' END AS issue FROM postings JOIN raw USING (chunk_pos))
SELECT 'documents' AS section, 'documents' AS item, count(DISTINCT chunk_pos // 100) AS n FROM legal UNION ALL SELECT 'stability', 'chunks_told', count(*) FROM legal UNION ALL SELECT 'counts', 'chunks', count(*) FROM legal
UNION ALL SELECT 'counts', 'index_' || kind, count(DISTINCT key) FROM postings GROUP BY kind UNION ALL SELECT 'index', kind || '_' || issue, count(*) FROM bad WHERE issue IS NOT NULL GROUP BY kind, issue
UNION ALL SELECT 'articles', 'in_chunks', count(DISTINCT article_id) FROM legal WHERE article_id <> '' UNION ALL SELECT 'articles', 'in_headings', count(DISTINCT article) FROM headings
UNION ALL SELECT 'articles', 'missing_from_index', count(DISTINCT article) FROM headings WHERE article NOT IN (SELECT key FROM postings WHERE kind = 'article')
UNION ALL SELECT 'metadata', section || '_' || key, n FROM counted UNION ALL {" UNION ALL ".join(f"SELECT 'metadata', '{k}', count(*) FILTER ({cond}) FROM rows" for k, cond in _REPORTED.items())}"""
STRUCTURAL_SAMPLES = rf"""
WITH {_LEGAL}, firsts AS (SELECT kind, min(key) AS key FROM postings WHERE kind IN ('schedule', 'list', 'entry') GROUP BY kind),
placed AS (SELECT kind, key, chunk_pos, row_number() OVER (PARTITION BY kind ORDER BY chunk_pos) AS nth FROM postings JOIN firsts USING (kind, key))
SELECT kind, key, CAST(nth AS INTEGER) AS nth, chunk_pos, CAST(chunk_pos % 50 AS INTEGER) AS page, 'generic' AS chunk_type, substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 140) AS text FROM placed JOIN legal USING (chunk_pos) WHERE nth <= {U.SAMPLE_REFS}"""
ARTICLE_BUNDLES = f"""
WITH {_LEGAL}, own AS (SELECT article_id, min(chunk_pos) AS lead, max(chunk_pos) AS last, min(chunk_pos) // 100 AS doc, max(chunk_pos) // 100 AS last_doc, max(chunk_pos % 50) AS page FROM legal WHERE article_id <> '' GROUP BY article_id),
wanted AS (SELECT n AS qid, CAST(n AS VARCHAR) AS article_id, n % 5 = 0 AS notes FROM (SELECT unnest(range(1, 396)) AS n)),
lines AS (SELECT chunk_pos, article_id, CASE WHEN article_id = '' THEN '(2) ' || text ELSE text END AS body, CASE WHEN article_id <> '' AND chunk_pos % 2 = 0 THEN '1. Subs. by the Act of ' || chunk_pos ELSE '' END AS note FROM legal),
pairs AS (
  SELECT w.*, l.chunk_pos, l.body, l.note, l.article_id <> '' AS lead FROM wanted w JOIN own o USING (article_id) JOIN lines l ON l.chunk_pos = o.lead
  UNION ALL SELECT w.*, l.chunk_pos, l.body, l.note, false FROM wanted w JOIN own o USING (article_id) JOIN lines l
    ON o.doc = o.last_doc AND l.chunk_pos // 100 = o.doc AND l.chunk_pos > o.last AND l.article_id = '' AND NOT EXISTS (SELECT 1 FROM legal e WHERE e.article_id <> '' AND e.chunk_pos > o.last AND e.chunk_pos < l.chunk_pos)),
shown AS (SELECT qid, article_id, chunk_pos, CASE WHEN notes THEN 'amendment' WHEN lead THEN 'article' ELSE 'clause' END AS chunk_type, CASE WHEN notes THEN note ELSE body END AS text FROM pairs)
SELECT qid, article_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY chunk_pos) AS INTEGER) AS rank, chunk_pos, chunk_type, text FROM shown WHERE text <> ''"""
EVAL_SUMMARY = """
SELECT coalesce(lang, '(all)') AS category, CAST(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS BIGINT) AS passed, count(*) AS total
FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)"""
_EVALUATED = f"""{_CITED}, found AS (
  SELECT qid, list(CAST((qid + rank) % 5 + 1 AS VARCHAR) ORDER BY rank) AS every, list(CASE WHEN rank = 3 THEN 'footnote' ELSE 'clause' END) AS types, lower(string_agg(text, chr(10) ORDER BY rank)) AS text, bool_or(synthetic) AS noted, bool_and(synthetic) AS whole FROM cited GROUP BY qid),
facts AS (
  SELECT *, list_filter(every, lambda x, i: list_position(every, x) = i) AS articles, ['repaired_boundary', 'amendment_history', 'structural_routing'][qid % 3 + 1] AS category, qid % 4 = 0 AS amending, qid % 4 > 0 AS only_here FROM found),
own AS (SELECT *, CASE category WHEN 'repaired_boundary' THEN 'indexing' WHEN 'amendment_history' THEN 'amendment_evidence_handling' ELSE 'retrieval' END AS tag FROM facts),
checks AS (
  SELECT *, [
    CASE WHEN NOT list_has_all(articles, ['2', '3']) THEN 'retrieval:' || tag END, CASE WHEN qid % 2 = 0 THEN 'retrieval:structural_routing' END, CASE WHEN qid % 5 = 0 AND articles[1:2] <> ['1', '2'] THEN 'retrieval:' || tag END,
    CASE WHEN list_contains(articles, '4') THEN 'retrieval:' || tag END, CASE WHEN list_contains(types, 'footnote') THEN 'retrieval:' || tag END, CASE WHEN list_contains(types, 'footnote') THEN 'retrieval:' || tag END,
    CASE WHEN NOT contains(text, 'the') THEN 'retrieval:' || CASE WHEN category = 'structural_routing' THEN category ELSE tag END END, CASE WHEN contains(text, 'zzz') THEN 'retrieval:' || tag END, CASE WHEN contains(text, 'ing') THEN 'retrieval:' || tag END,
    CASE WHEN NOT amending THEN 'mode:amendment_mode' END, CASE WHEN NOT only_here THEN 'mode:constitution_only_enforcement' END, CASE WHEN whole <> (qid % 4 = 0) THEN 'answer:synthetic_fallback' END,
    CASE WHEN NOT noted THEN 'answer:synthetic_fallback' END, CASE WHEN NOT only_here THEN 'answer:constitution_only_enforcement' END, 'answer:answer_grounding', CASE WHEN only_here THEN 'answer:answer_grounding' END] AS all_issues FROM own),
evaluated AS (SELECT *, list_filter(all_issues, lambda x: x IS NOT NULL) AS issues FROM checks)"""
EVAL_ITEMS = f"""
WITH {_EVALUATED}
SELECT qid AS id, category, len(list_filter(issues, lambda x: starts_with(x, 'retrieval:'))) = 0 AS retrieval_pass, len(list_filter(issues, lambda x: starts_with(x, 'mode:'))) = 0 AS mode_pass,
  len(list_filter(issues, lambda x: starts_with(x, 'answer:'))) = 0 AS answer_pass, len(issues) = 0 AS passed, len(issues) AS n_issues, array_to_string(articles, ',') AS articles FROM evaluated"""
EVAL_TAGS = f"WITH {_EVALUATED} SELECT split_part(x, ':', 2) AS tag, count(*) AS n FROM (SELECT unnest(issues) AS x FROM evaluated) GROUP BY ALL"
AMENDMENTS = rf"""
WITH texts AS (
  SELECT p_partkey, 'By the Constitution (' || ['First', 'Second', 'Ninth', 'Twelfth'][p_size % 4 + 1] || ' Amendment' || CASE WHEN p_size % 3 = 0 THEN ')' ELSE '' END || ' Act or the ' || p_brand || ' Third Amendment Act, ' || p_name
    || CASE WHEN p_size % 2 = 0 THEN ' and THIRD amendment act, Third Amendment Act' ELSE '' END AS text FROM part),
found AS (SELECT p_partkey, regexp_extract_all(text, '(?i){L.AMENDMENT_REF}', 1) AS ids FROM texts)
{_distinct('p_partkey', 'found', 'ids', 'amendment')}"""
PAGE_IMAGES = "SELECT conv_id AS doc_id, CAST(turn + 1 AS INTEGER) AS page, CASE WHEN (turn + 1) % 3 > 0 THEN conv_id || '/' || (turn + 1) ELSE '' END AS image_path FROM conversations"
OCR_PAGES = rf"""
WITH latest AS (SELECT conv_id, turn % 3 AS page, text FROM conversations WHERE conv_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY conv_id, turn % 3 ORDER BY 'page_' || (turn % 3) || '_' || turn || '.md' DESC) = 1)
SELECT conv_id AS doc_id, CAST(page AS INTEGER) AS page, {_STRIP.format('text')} AS text FROM latest
UNION ALL SELECT conv_id, CAST(turn + 1 AS INTEGER), {_STRIP.format('text')} FROM conversations WHERE conv_id % 2 = 1 AND trim(text) <> ''"""
PAGE_FALLBACK = """
WITH pages AS (SELECT conv_id AS doc_id, turn + 1 AS page, text, turn // 3 = conv_id % 3 AS blank FROM conversations),
good AS (SELECT *, bool_or(NOT blank AND trim(text) <> '') OVER (PARTITION BY doc_id, (page - 1) // 3) AS good FROM pages)
SELECT doc_id, CAST(page AS INTEGER) AS page, CASE WHEN good THEN CASE WHEN blank THEN ' ' ELSE text END ELSE 'b: ' || text END AS text, CASE WHEN good THEN 'primary' ELSE 'secondary' END AS source FROM good"""
_BLOCKED = """CASE WHEN json_type(j) = 'OBJECT' AND json_type(j, '$.blocks') = 'ARRAY' THEN [json_extract(j, '$.blocks')]
  WHEN json_type(j) = 'ARRAY' AND json_array_length(j) > 0 AND len(list_filter(json_extract(j, '$[*]'), lambda x: json_type(x) IS DISTINCT FROM 'OBJECT' OR NOT list_contains(json_keys(x), 'blocks'))) = 0
    THEN list_transform(list_filter(json_extract(j, '$[*]'), lambda x: json_type(x, '$.blocks') = 'ARRAY'), lambda x: json_extract(x, '$.blocks'))
  WHEN json_type(j) = 'ARRAY' AND json_array_length(j) > 0 AND len(list_filter(json_extract(j, '$[*]'), lambda x: json_type(x) IS DISTINCT FROM 'OBJECT' OR NOT list_contains(json_keys(x), 'text'))) = 0 THEN [j] END"""
BLOCK_TEXT = rf"""
WITH RECURSIVE made AS (
  SELECT conv_id, turn, text, (conv_id + turn) % 8 AS c, to_json({{'text': text, 'reading_order': 2, 'layout_tag': 'footnote'}}) AS note,
    to_json({{'text': 'end of ' || turn, 'layout_tag': 'paragraph', 'coordinates': {{'y1': 5, 'x1': turn}}}}) AS last FROM conversations),
paged AS (
  SELECT *, '[' || note || ',' || last || ']' AS plain, '{{"blocks":[{{"text":"skip","layout_tag":"Header","reading_order":0}},' || last || ',' || note || ',7,{{"text":"5. Title","reading_order":"1","layout_tag":"paragraph"}}]}}' AS page FROM made),
raw AS (
  SELECT conv_id, turn, CASE c WHEN 0 THEN 'page: ' || page WHEN 1 THEN '```json' || chr(10) || page || chr(10) || '```' WHEN 2 THEN '{{"meta":{{"n":1}},"result":{{"pages":[' || page || ']}}}}' WHEN 3 THEN plain
    WHEN 4 THEN '[' || page || ',' || page || ']' WHEN 5 THEN '[{{"blocks":"none"}},' || page || ']' WHEN 6 THEN '{{"z":{{"blocks":' || plain || '}},"a":' || page || '}}' ELSE 'no JSON ' || text END AS content FROM paged),
chosen AS (
  SELECT conv_id, turn, list_filter([regexp_extract(content, '(?s)^```(?:json)?\s*(.*?)\s*```$', 1), content, regexp_extract(content, '(?s)\{{.*\}}'), regexp_extract(content, '(?s)\[.*\]')], lambda x: x <> '' AND json_valid(x))[1] AS j FROM raw),
nodes AS (
  SELECT conv_id, turn, CAST([] AS BIGINT[]) AS path, CAST(j AS JSON) AS j FROM chosen WHERE j IS NOT NULL
  UNION ALL
  SELECT conv_id, turn, path || [i], inside[i] FROM (
    SELECT conv_id, turn, path, inside, unnest(range(1, len(inside) + 1)) AS i FROM (
      SELECT *, CASE json_type(j) WHEN 'OBJECT' THEN list_transform(json_keys(j), lambda k: json_extract(j, '$."' || k || '"')) WHEN 'ARRAY' THEN json_extract(j, '$[*]') END AS inside FROM nodes WHERE {_BLOCKED} IS NULL))),
hits AS (SELECT conv_id, turn, path, {_BLOCKED} AS pages FROM nodes),
first AS (SELECT conv_id, turn, arg_min(pages, path) AS pages FROM hits WHERE len(pages) > 0 GROUP BY ALL),
rows AS (SELECT conv_id, turn, unnest(json_extract(pages[1], '$[*]')) AS b, unnest(range(0, CAST(json_array_length(pages[1]) AS BIGINT))) AS i FROM first WHERE len(pages) = 1),
told AS (
  SELECT conv_id, turn, i, coalesce(try_cast(b->>'reading_order' AS DOUBLE), 'infinity') AS place, coalesce(try_cast(b->>'$.coordinates.y1' AS DOUBLE), 'infinity') AS y, coalesce(try_cast(b->>'$.coordinates.x1' AS DOUBLE), 'infinity') AS x,
    lower(trim(coalesce(b->>'layout_tag', ''))) AS layout, {_STRIP.format("coalesce(b->>'text', '')")} AS text FROM rows WHERE json_type(b) = 'OBJECT'),
read AS (SELECT *, lag(layout) OVER (PARTITION BY conv_id, turn ORDER BY place, y, x, i) AS before FROM told WHERE text <> '' AND layout NOT IN ('header', 'image', 'image-caption', 'page-number', 'table')),
texts AS (
  SELECT conv_id, turn, string_agg(CASE WHEN layout IN ('section-title', 'title', 'headline') OR regexp_matches(text, '(?i)^(?:PART\s+[IVXLC]+|(?:Article|Art\.?)\s+\d+[A-Z]?\b|\d+[A-Z]?\.\s+[A-Z])') OR (before = 'footnote' AND layout <> 'footnote') THEN chr(10) ELSE '' END || text, chr(10) ORDER BY place, y, x, i) AS text
  FROM read GROUP BY ALL)
SELECT conv_id, turn, {_STRIP.format('found')} AS text FROM conversations c LEFT JOIN (SELECT conv_id, turn, text AS found FROM texts) t USING (conv_id, turn)"""

ORACLES: dict[str, str] = {
    name.lower(): sql for name, sql in list(globals().items())
    if name.isupper() and isinstance(sql, str) and not name.startswith("_") and name.lower() in QUERIES
}
