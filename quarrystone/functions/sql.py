"""The text rules as functions of SQL: they are written in SQL and inlined into plans, with no Python behind them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import legal as L
from . import text as T


def _rx(pattern: str) -> str:
    return "r'" + pattern + "'"


_STRIP = r"regexp_replace({}, r'^\s+|\s+$', '')"
_BARE = r"upper(regexp_replace({}, r'[\[\](){{}}.]', ''))".format(_STRIP.format("coalesce(label, '')"))
_NAMES = ", ".join(f"'{x}'" for x in L.ORDINALS)
_ROMAN = ", ".join(f"'{x}'" for x in L.ROMAN)
_NOTES = f"regexp_count(t, {_rx('(?im)' + T.FOOTNOTE)})"

#: name(arguments), what it returns, and how.
FUNCTIONS = (
    ("content_hash(t STRING)", "STRING", "substr(sha2(t, 256), 1, 16)"),
    ("tokens(t STRING)", "ARRAY<STRING>", f"regexp_extract_all(lower(t), {_rx(T.TOKEN)}, 0)"),
    ("footnotes(t STRING)", "INT", _NOTES),
    (
        "chunk_type(t STRING, segment STRING)", "STRING",
        f"""CASE WHEN segment IN ('part_heading', 'schedule_heading', 'list_heading') THEN 'heading' WHEN segment = 'article' THEN 'article'
            WHEN {_NOTES} > 0 AND ({_NOTES} / (regexp_count(t, '\\n') + 1) > 0.3 OR ({_NOTES} >= 3 AND char_length(t) < 600)) THEN 'amendment'
            WHEN {_NOTES} > 0 AND char_length(t) < 300 THEN 'footnote' ELSE 'generic' END""",
    ),
    ("section_id(t STRING)", "STRING", f"regexp_extract(t, {_rx('(?i)' + T.SECTION)}, 1)"),
    ("wants_amendments(q STRING)", "BOOLEAN", f"q RLIKE {_rx('(?i)' + T.WANTS_AMENDMENTS)}"),
    ("constitution_only(q STRING)", "BOOLEAN", f"q RLIKE {_rx('(?i)' + '|'.join(T.CONSTITUTION_ONLY))}"),
    ("article_refs(t STRING)", "ARRAY<STRING>", f"array_distinct(transform(regexp_extract_all(t, {_rx('(?i)' + L.ARTICLE_REF)}, 1), x -> upper(x)))"),
    ("entry_refs(t STRING)", "ARRAY<STRING>", f"array_distinct(transform(regexp_extract_all(t, {_rx('(?i)' + L.ENTRY_REF)}, 1), x -> upper(x)))"),
    (
        "schedule_id(label STRING)", "STRING",
        f"""element_at(transform(array(regexp_replace({_BARE}, r'^(\\d+)(?:ST|ND|RD|TH)$', '$1')), x -> CASE
            WHEN array_contains(array({_NAMES}), x) THEN try_element_at(array({_ROMAN}), CAST(nullif(array_position(array({_NAMES}), x), 0) AS INT))
            WHEN try_cast(x AS INT) BETWEEN 1 AND 12 THEN try_element_at(array({_ROMAN}), nullif(try_cast(x AS INT), 0)) WHEN x RLIKE r'^(\\d+|[IVXLC]+)$' THEN x ELSE '' END), 1)""",
    ),
)

#: Functions that return a table: name(arguments), its columns, and its query.
TABLES = (
    ("tokens_of(t STRING)", "pos INT, token STRING", f"SELECT pos, col FROM posexplode(regexp_extract_all(lower(t), {_rx(T.TOKEN)}, 0))"),
    (
        "packed_lines(t STRING, size INT, least INT)", "pos INT, chunk STRING",
        rf"""SELECT pos, col FROM posexplode(filter(element_at(transform(array(filter(transform(split(t, '\n'), x -> {_STRIP.format("x")}), x -> x <> '')), ps ->
              transform(aggregate(ps, CAST(array() AS ARRAY<ARRAY<STRING>>), (s, p) -> CASE
                WHEN size(s) > 0 AND char_length(array_join(element_at(s, -1), '\n')) + 1 + char_length(p) <= size THEN concat(slice(s, 1, size(s) - 1), array(concat(element_at(s, -1), array(p))))
                ELSE concat(s, array(array(p))) END), x -> array_join(x, '\n'))), 1), x -> char_length(x) >= least))""",
    ),
)


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session's SQL; their names."""
    for name, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} RETURNS {kind} RETURN {body}")
    for name, columns, query in TABLES:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} RETURNS TABLE ({columns}) RETURN {query}")
    return [name.partition("(")[0] for name, *_ in (*FUNCTIONS, *TABLES)]
