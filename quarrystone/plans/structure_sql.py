"""Segmentation of pages and the carry between them, in DuckDB's SQL: lines, folds and pages as rows.

Two recursive queries: one reads each page line by line in each of the five states that a page may begin in, the other
walks every document page by page. The patterns are the rules' fixed values; everything else is written anew here.
"""

from __future__ import annotations

import re

from ..functions import legal as L
from ..functions import structure as S
from ..functions import text as T

#: Pages with articles, schedules, lists, entries, notes and contents, by conversation and turn.
PAGES = """
SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS page, CASE (conv_id + turn) % 9
  WHEN 0 THEN (turn + 14) || '. Heading of this.-(1) ' || text
  WHEN 2 THEN 'SEVENTH SCHEDULE' || chr(10) || '(Article 246)' || chr(10) || 'LIST I-UNION LIST' || chr(10) || '1. Defence of ' || text
  WHEN 3 THEN '(SEVENTH SCHEDULE)' || chr(10) || (turn + 2) || '. Taxes on ' || text || chr(10) || '1. Subs. by the Act of 1956, w.e.f. 1-11-1956.' || chr(10) || (turn + 3) || '. Banking and insurance, ' || text
  WHEN 4 THEN text || chr(10) || 'STATE LIST' || chr(10) || '5. Police; ' || text || ' LIST III - CONCURRENT LIST 6. Trusts, ' || text
  WHEN 5 THEN 'CONTENTS' || chr(10) || 'FIRST SCHEDULE' || chr(10) || 'SECOND SCHEDULE' || chr(10) || 'LIST I' || chr(10) || text
  WHEN 6 THEN '1[FIRST SCHEDULE' || chr(10) || 'The States, as the Seventh Schedule says' || chr(10) || text || chr(10) || '7. Loans of ' || text
  WHEN 7 THEN 'UNION LIST Items follow' || chr(10) || 'SECOND SCHEDULE;' || chr(10) || 'Article ' || turn || '. Equality before law' || chr(10) || text
  WHEN 8 THEN '2[' || (turn + 300) || 'A. Right of ' || text || ']' || chr(10) || (turn + 301) || '. Arrest of all.-No person shall ' || text || chr(10) || 'PART IV-A of duties'
  ELSE text END AS text
FROM conversations"""


def _rx(pattern: str) -> str:
    """A pattern as a literal: lines end at \\n alone here, so the flag that says so goes."""
    flags = re.match(r"\(\?([a-z]+)\)", pattern)
    if flags:
        kept = flags[1].replace("d", "")
        pattern = (f"(?{kept})" if kept else "") + pattern[flags.end() :]
    return "'" + pattern.replace("'", "''") + "'"


def _has(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {_rx(pattern)})"


def _part(text: str, pattern: str, group: int) -> str:
    return f"regexp_extract({text}, {_rx(pattern)}, {group})"


def _cut(text: str, pattern: str) -> str:
    return f"regexp_replace({text}, {_rx(pattern)}, '')"


def _strip(text: str) -> str:
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


def _broken(text: str, before: str, ahead: str) -> str:
    """text with a line end before each place that is not after `before` and where `ahead` begins."""
    here = f"(i = 0 OR NOT regexp_matches(substr({text}, i, 1), {_rx(before)})) AND regexp_matches(substr({text}, i + 1), {_rx(ahead)})"
    return f"array_to_string(list_transform(range(0, length({text}) + 1), lambda i: CASE WHEN {here} THEN chr(10) ELSE '' END || substr({text}, i + 1, 1)), '')"


_ROMAN = str(list(L.ROMAN))
_BARE = r"upper(regexp_replace(trim({}), '[\[\](){{}}.]', '', 'g'))"


def _schedule_id(label: str) -> str:
    bare = rf"regexp_replace({_BARE.format(label)}, '^(\d+)(?:ST|ND|RD|TH)$', '\1')"
    number = f"try_cast({bare} AS INTEGER)"
    return f"CASE WHEN list_position({list(L.ORDINALS)}, {bare}) > 0 THEN {_ROMAN}[list_position({list(L.ORDINALS)}, {bare})] WHEN {number} BETWEEN 1 AND 12 THEN {_ROMAN}[{number}] ELSE {bare} END"


def _list_id(label: str) -> str:
    bare = _BARE.format(label)
    return rf"CASE WHEN regexp_matches({bare}, 'CONCURRENT\s+LIST') THEN 'III' WHEN regexp_matches({bare}, 'STATE\s+LIST') THEN 'II' WHEN regexp_matches({bare}, 'UNION\s+LIST') THEN 'I' WHEN {bare} IN ('I', '1') THEN 'I' WHEN {bare} IN ('2', 'II', '11', 'I1', '1I') THEN 'II' ELSE 'III' END"


def _alone(line: str, pattern: str) -> str:
    return f"{_has(line, pattern)} AND {_has(_strip(_cut(line, pattern)), S.HEADING_STANDS_ALONE)}"


_LISTED = f"""CASE WHEN {_has('line', S.LIST_HEADING)} THEN
    CASE WHEN {_part('line', S.LIST_HEADING, 2)} = '' AND length(line) > 12 THEN '' WHEN {_alone('line', S.LIST_HEADING)} THEN {_list_id(_part('line', S.LIST_HEADING, 1))} ELSE '' END
  WHEN {_alone('line', S.LIST_NAME_HEADING)} THEN {_list_id(_part('line', S.LIST_NAME_HEADING, 1))} ELSE '' END"""
_TITLE = _strip(_part("line", S.ENTRY_HEADING, 2))
_ENTERED = f"{_TITLE} <> '' AND NOT {_has(_TITLE, S.ENTRY_NOTE)}"

_LIST_AHEAD = "^" + S.LIST_INSIDE_LINE.replace(r"(?<!\n)(?=", "(?:")
_ENTRY_AHEAD = S.ENTRY_INSIDE_LINE.replace(r"(?<![\n\d])(?=", "^(?:")
_KEPT = f"(type IN ('part_heading', 'schedule_heading', 'list_heading') OR length(text) >= 80 OR {_has('text', '(?im)' + T.FOOTNOTE)})"
_NOTED = _has("text", "(?im)" + T.FOOTNOTE)
_GOES_ON = rf"""CASE WHEN text = '' OR {_has('text', '(?i)' + T.CONTINUATION_BLOCKER)} OR len(regexp_extract_all(text, '(?m)^\d+[A-Z]?\.\s+[A-Z]')) >= 2
  OR (regexp_matches(text, '^\d+[A-Z]?\.\s+[A-Z]') AND NOT {_NOTED}) THEN false ELSE length(text) >= 120 OR {_has('text', T.BODY_OPENER)} OR {_NOTED} END"""


def _matched(order: int, kind: str, pattern: str) -> str:
    found = lambda k: f"regexp_extract_all(text, {_rx(pattern)}, {k})"
    return f"SELECT doc_id, page, text, {order} AS o, '{kind}' AS kind, string_split(regexp_replace(text, {_rx(pattern)}, chr(1) || '\\0', 'g'), chr(1)) AS ps, {found(1)} AS ids, {found(2)} AS titles, {found(0)} AS wholes FROM pages"


_HINTS = " + ".join(f"CAST({_has('before', p)} AS INTEGER)" for p in S.OTHER_CONTEXTS)
_NUMBER = r"'(?i)^(?:\*{0,2})?(?:(?:Article|Art\.?)\s+)?' || article || '(?:\.\s*|\s+)'"

_CTES = f"""
RECURSIVE pages AS (SELECT * FROM ({PAGES}) WHERE {_strip('text')} <> ''),
softer AS (SELECT doc_id, page, {_broken('text', '[' + chr(92) + 'n]', _LIST_AHEAD.replace('^(?i)', '(?i)^'))} AS text FROM pages),
soft AS (SELECT doc_id, page, {_broken('text', '[' + chr(92) + 'n0-9]', _ENTRY_AHEAD)} AS text FROM softer),
split AS (SELECT doc_id, page, list_transform(string_split(text, chr(10)), lambda x: {_strip('x')}) AS ls FROM soft),
numbered AS (SELECT doc_id, page, unnest(range(1, len(ls) + 1)) AS nr, unnest(ls) AS line FROM split),
marked AS (
  SELECT *, CASE WHEN {_alone('line', S.SCHEDULE_HEADING)} THEN {_schedule_id(_part('line', S.SCHEDULE_HEADING, 1))} ELSE '' END AS schedule, {_LISTED} AS list,
    CASE WHEN {_ENTERED} THEN {_BARE.format(_part('line', S.ENTRY_HEADING, 1))} ELSE '' END AS entry, CASE WHEN {_ENTERED} THEN {_TITLE} ELSE '' END AS title,
    {_has('line', S.STRUCTURE_NOTE)} AS note, {_has('line', S.SCHEDULE_GOES_ON)} AS header,
    CASE WHEN line <> '' THEN sum(CAST(line <> '' AS INTEGER)) OVER (PARTITION BY doc_id, page ORDER BY nr) END AS nth
  FROM numbered),
kinds AS (
  SELECT doc_id, page, bool_or(nth <= 3 AND upper(line) = 'CONTENTS') AND count(*) FILTER (WHERE nth <= 30 AND (schedule <> '' OR list <> '')) >= 3 AS contents,
    bool_or(nth <= 16 AND (schedule <> '' OR list <> '')) AS heads, bool_or(nth <= 12 AND entry <> '') AS entries, bool_or(nth <= 8 AND contains(lower(line), 'schedule')) AS named
  FROM marked WHERE nth IS NOT NULL GROUP BY ALL),
states(state, article, heading, schedule, list, entry) AS (VALUES (0, '', '', '', '', ''), (1, '@', '@', '', '', ''), (2, '', '', '@', '', ''), (3, '', '', '@', '@', ''), (4, '', '', '@', '@', '@')),
reading AS (
  SELECT doc_id, page, state, s.entry AS came, 0 AS nr, s.schedule, s.list, false AS opened, CAST(NULL AS VARCHAR) AS type, '' AS heading, '' AS entry
  FROM kinds, states s WHERE NOT contents AND (heads OR (entries AND s.list <> '') OR (named AND s.schedule <> ''))
  UNION ALL
  SELECT doc_id, page, state, came, m_at, CASE WHEN type = 'schedule_heading' THEN m_schedule WHEN type = 'list_heading' AND schedule = '' THEN 'VII' ELSE schedule END,
    CASE WHEN type = 'schedule_heading' THEN '' WHEN type = 'list_heading' THEN m_list ELSE list END, opened OR type IS NOT NULL, type,
    CASE WHEN type IN ('schedule_heading', 'list_heading') THEN line WHEN type = 'entry' AND m_entry <> '' AND NOT carried THEN title ELSE '' END,
    CASE WHEN type <> 'entry' THEN '' WHEN carried THEN came ELSE m_entry END
  FROM (
    SELECT r.doc_id, r.page, r.state, r.came, r.schedule, r.list, r.opened, m.nr AS m_at, m.schedule AS m_schedule, m.list AS m_list, m.entry AS m_entry, m.line, m.title,
      CASE WHEN m.line = '' OR (NOT r.opened AND r.list <> '' AND r.came <> '' AND m.header) THEN NULL WHEN (r.schedule <> '' OR r.list <> '') AND m.note THEN 'text_block'
        WHEN m.schedule <> '' THEN 'schedule_heading' WHEN m.list <> '' THEN 'list_heading' WHEN r.list <> '' AND m.entry <> '' THEN 'entry'
        WHEN NOT r.opened THEN CASE WHEN r.list <> '' AND r.came <> '' THEN 'entry' ELSE 'text_block' END END AS type,
      NOT (r.list <> '' AND m.entry <> '') AS carried
    FROM reading r JOIN marked m ON m.doc_id = r.doc_id AND m.page = r.page AND m.nr = r.nr + 1)
),
opens AS (SELECT *, lead(nr) OVER (PARTITION BY doc_id, page, state ORDER BY nr) AS next_at FROM reading WHERE type IS NOT NULL),
structured AS (
  SELECT * FROM (SELECT doc_id, page, state, nr AS k, type, '' AS article, heading, schedule, list, entry, {_strip("array_to_string(ls[nr : coalesce(next_at - 1, len(ls))], chr(10))")} AS text FROM opens JOIN split USING (doc_id, page)) WHERE text <> ''),
found AS ({_matched(0, 'explicit', S.ARTICLE_EXPLICIT)} UNION ALL {_matched(1, 'numbered', S.ARTICLE_NUMBERED)} UNION ALL {_matched(2, 'footnoted', S.ARTICLE_GLUED)}),
places AS (SELECT *, unnest(range(1, len(ps))) AS k FROM found),
placed AS (
  SELECT doc_id, page, text, o, CAST(list_sum(list_transform(ps[1:k], lambda x: length(x))) AS BIGINT) AS start, upper(ids[k]) AS article, titles[k] AS title,
    CASE WHEN kind = 'numbered' AND {_has('wholes[k]', S.ARTICLE_FOOTNOTED)} THEN 'footnoted' ELSE kind END AS kind FROM places),
candidates AS (
  SELECT *, coalesce(lead(start) OVER (PARTITION BY doc_id, page ORDER BY start), length(text)) AS stop FROM (
    SELECT * FROM placed WHERE o = 0 OR (NOT {_has("ltrim(" + _strip('title') + ", '[')", S.EDITORIAL_TITLE)} AND try_cast(regexp_extract(article, '^[0-9]+') AS INTEGER) <= 400)
    QUALIFY row_number() OVER (PARTITION BY doc_id, page, start ORDER BY o) = 1)),
inlined AS (SELECT *, {_part(_strip('title'), S.INLINE_BODY, 2)} AS inl, list_filter(list_transform(string_split(substr(text, start + 1, stop - start), chr(10)), lambda x: {_strip('x')}), lambda x: x <> '') AS ls,
    substr(text, greatest(start - 800, 0) + 1, least(start, 800)) AS before FROM candidates),
titled AS (
  SELECT *, {_cut(_strip(f"CASE WHEN inl <> '' THEN {_part(_strip('title'), S.INLINE_BODY, 1)} ELSE title END"), S.TITLE_END)} AS own,
    {_strip(f"CASE WHEN inl <> '' THEN inl ELSE {_part(f"regexp_replace(coalesce(ls[1], ''), {_NUMBER}, '')", S.BODY_AFTER_TITLE, 2)} END")} AS body1,
    {_cut(_strip(_part("coalesce(ls[2], '')", S.WRAPPED_TITLE, 1)), S.WRAPPED_END)} AS tail, {_strip(_part("coalesce(ls[2], '')", S.WRAPPED_TITLE, 2))} AS tail_body FROM inlined),
bodied AS (
  SELECT *, body1 = '' AND tail <> '' AND tail_body <> '' AS wrapped, CASE WHEN wrapped THEN tail_body ELSE body1 END AS first_line, CASE WHEN wrapped THEN ls[3:] ELSE ls[2:] END AS rest,
    {_strip("array_to_string(CASE WHEN first_line <> '' THEN [first_line] ELSE [] END || rest, chr(10))")} AS body, {_has("CASE WHEN first_line <> '' THEN first_line ELSE coalesce(rest[1], '') END", S.BODY_HINT)} AS opens,
    {_has('body', S.CLAUSE_MARK)} AS clause FROM titled),
accepted AS (
  SELECT doc_id, page, text, start, article, CASE WHEN wrapped THEN trim(own || ' ' || tail) ELSE own END AS heading FROM bodied
  WHERE body <> '' AND CASE kind WHEN 'footnoted' THEN true
    WHEN 'numbered' THEN NOT {_has("array_to_string(string_split(text, chr(10))[1:12], chr(10))", S.SCHEDULE_OR_LIST)} AND {_HINTS} < 2 AND (clause OR (length(body) >= 40 AND opens))
    ELSE length(body) >= 30 OR clause OR opens END),
bounded AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY doc_id, page ORDER BY start), length(text)) AS stop FROM accepted),
heads AS (SELECT p.doc_id, p.page, {_strip("substr(p.text, 1, coalesce(min(start), length(p.text)))")} AS text, count(start) AS n FROM pages p LEFT JOIN accepted a USING (doc_id, page) GROUP BY p.doc_id, p.page, p.text),
plain AS (
  SELECT doc_id, page, -1 AS k, CASE WHEN n > 0 AND {_has('text', S.PART_HEADING)} THEN 'part_heading' ELSE 'text_block' END AS type, '' AS article,
    CASE WHEN n > 0 AND {_has('text', S.PART_HEADING)} THEN {_strip(_part('text', S.PART_HEADING, 2))} ELSE '' END AS heading, text FROM heads WHERE text <> ''
  UNION ALL SELECT doc_id, page, start, 'article', article, heading, {_strip('substr(text, start + 1, stop - start)')} FROM bounded),
firsts AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY k) = 1 AND type = 'text_block' AND {_GOES_ON} AS goes_on FROM plain),
segments AS (
  SELECT * FROM structured UNION ALL
  SELECT doc_id, page, s.state, k, CASE WHEN goes_on AND s.article <> '' THEN 'article' ELSE type END, CASE WHEN goes_on AND s.article <> '' THEN s.article ELSE p.article END,
    CASE WHEN goes_on AND s.article <> '' THEN s.heading ELSE p.heading END, '', '', '', text
  FROM firsts p, states s WHERE NOT EXISTS (FROM structured t WHERE t.doc_id = p.doc_id AND t.page = p.page AND t.state = s.state)),
tailed AS (SELECT *, string_split(text, chr(10)) AS ls, list_position(list_transform(string_split(text, chr(10)), lambda x: {_has('x', '(?i)' + T.EDITORIAL_LINE)}), true) AS cut FROM segments WHERE {_KEPT}),
pieces AS (
  SELECT * FROM (
    SELECT doc_id, page, state, k, 0 AS half, type, article, heading, schedule, list, entry, CASE WHEN (article <> '' OR entry <> '') AND cut > 0 THEN {_strip("array_to_string(ls[1 : cut - 1], chr(10))")} ELSE {_strip('text')} END AS text FROM tailed
    UNION ALL SELECT doc_id, page, state, k, 1, 'text_block', article, '', schedule, list, '', {_strip("array_to_string(ls[cut:], chr(10))")} FROM tailed WHERE (article <> '' OR entry <> '') AND cut > 0)
  WHERE text <> '' AND {_KEPT}),
handed AS (
  SELECT p.doc_id, p.page, s.state, coalesce(arg_max(i.article, (k, half)) FILTER (i.article <> ''), '') AS article, coalesce(arg_max(i.heading, (k, half)) FILTER (i.article <> ''), '') AS heading,
    coalesce(arg_max(i.schedule, (k, half)) FILTER (i.schedule <> ''), '') AS schedule, coalesce(arg_max(i.list, (k, half)) FILTER (i.list <> ''), '') AS list,
    coalesce(arg_max(i.entry, (k, half)) FILTER (i.entry <> '' OR i.type = 'list_heading'), '') AS entry
  FROM pages p CROSS JOIN states s LEFT JOIN pieces i ON i.doc_id = p.doc_id AND i.page = p.page AND i.state = s.state GROUP BY ALL),
ordered AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS nth FROM pages),
walked AS (
  SELECT doc_id, page, nth, 0 AS state, '' AS article, '' AS heading, '' AS schedule, '' AS list, '' AS entry FROM ordered WHERE nth = 1
  UNION ALL
  SELECT doc_id, page, nth, CASE WHEN article <> '' THEN 1 WHEN entry <> '' THEN 4 WHEN list <> '' THEN 3 WHEN schedule <> '' THEN 2 ELSE 0 END, article, heading, schedule, list, entry FROM (
    SELECT o.doc_id, o.page, o.nth, CASE WHEN h.article = '@' THEN w.article ELSE h.article END AS article, CASE WHEN h.heading = '@' THEN w.heading ELSE h.heading END AS heading,
      CASE WHEN h.schedule = '@' THEN w.schedule ELSE h.schedule END AS schedule, CASE WHEN h.list = '@' THEN w.list ELSE h.list END AS list, CASE WHEN h.entry = '@' THEN w.entry ELSE h.entry END AS entry
    FROM walked w JOIN handed h ON h.doc_id = w.doc_id AND h.page = w.page AND h.state = w.state JOIN ordered o ON o.doc_id = w.doc_id AND o.nth = w.nth + 1))"""

PAGE_STRUCTURE = f"""
WITH {_CTES}
SELECT p.doc_id, p.page, CAST(row_number() OVER (PARTITION BY p.doc_id, p.page ORDER BY k, half) - 1 AS INTEGER) AS pos, type, CASE WHEN p.article = '@' THEN w.article ELSE p.article END AS article,
  CASE WHEN p.heading = '@' THEN w.heading ELSE p.heading END AS heading, CASE WHEN p.schedule = '@' THEN w.schedule ELSE p.schedule END AS schedule, CASE WHEN p.list = '@' THEN w.list ELSE p.list END AS list,
  CASE WHEN p.entry = '@' THEN w.entry ELSE p.entry END AS entry, text
FROM pieces p JOIN walked w ON w.doc_id = p.doc_id AND w.page = p.page AND w.state = p.state"""
