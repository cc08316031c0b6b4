"""Rules for lines of legal pages: headings of articles, parts, schedules and lists, entries, notes, contents, as Columns.

A line is text without line ends and without blanks around it. Java's patterns run in their Unix mode ((?d)), where
only \\n ends a line, and ignore case where the rule does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..tables import let
from . import legal
from .text import strip

# The patterns of the rules. Their dashes are those of repaired and of unrepaired page text.
ARTICLE_EXPLICIT = r"(?imd)^(?:\*{0,2})(?:Article|Art\.?)\s+(\d+[A-Z]?)(?:\.\s*|\s+)(.*)"
ARTICLE_NUMBERED = "(?md)^(?:\\*{0,2})(?:\\d+\\[)?(\\d+[A-Z]?)\\.\\s+(?:\\d+\\[)?([A-Z][A-Za-z][^\\n]{2,}?(?:[.â€”“\\-]|\\s*$))"
ARTICLE_GLUED = "(?md)^(?:\\*{0,2})\\d(\\d{2,3}[A-Z]?)\\.\\s+(\\[[^\\n]{2,}?(?:[.â€”“\\-]|\\s*$))"
ARTICLE_FOOTNOTED = r"^(?:\*{0,2})?(?:\d+\[|\d+[A-Z]?\.\s+\d+\[)"
EDITORIAL_TITLE = (
    r"(?i)^(?:(?:Subs|Ins|Omitted|Added|Rep)\.?\b|(?:Subs|Ins|Omitted|Added|Rep)\.?\s+by\b|The\s+Constitution\b|Art\.?\s+\d+[A-Z]?\s+re(?:-?numbered)?\b|"
    r"Cl\.?\s*\(\d+\)\s+(?:re-?numbered|renumbered)\b|Clause\s+\(\d+\)\s+(?:re-?numbered|renumbered)\b)"
)
INLINE_BODY = (
    "(?id)^(.+?)(?:\\.\\s*[â€”“-]|[â€”“-])\\s*"
    r"((?:\(\d+\)|\([a-z]\)|No\b|The\b|There\b|Nothing\b|Notwithstanding\b|Subject\b|In\s+this\b|All\b|Any\b|Every\b|Provided\b).*)$"
)
BODY_AFTER_TITLE = r"(?id)^(.+?)\.[^A-Za-z0-9_]*((?:\(\d+\)|\([a-z]\)|No\b|The\b|There\b|Nothing\b|Notwithstanding\b|Subject\b|In\s+this\b|All\b|Any\b|Every\b|Provided\b).*)$"
WRAPPED_TITLE = (
    "(?d)^([a-z][^\\n]{2,}?)\\s*(?:â€”|â€“|—|–|-)\\s*"
    r"((?:\(\d+\)|\([a-z]\)|No\b|The\b|There\b|Nothing\b|Notwithstanding\b|Subject\b|In\s+this\b|All\b|Any\b|Every\b|Provided\b).*)$"
)
TITLE_END, WRAPPED_END = "[.*â€”“-]+$", "[.*â€”“—–-]+$"
BODY_HINT = r"(?i)^(?:\(\d+\)|\([a-z]\)|No\b|The\b|There\b|Nothing\b|Notwithstanding\b|Subject\b|In\s+this\b|All\b|Any\b|Every\b|Parliament\b)"
CLAUSE_MARK = r"\(\d+\)|\([a-z]\)"
OTHER_CONTEXTS = (r"(?i)\bschedule\b", r"(?i)\bparagraph\b", r"(?i)\bsub-paragraph\b", r"(?i)\bunion\s+list\b", r"(?i)\bstate\s+list\b", r"(?i)\bconcurrent\s+list\b", r"(?i)\blist\s+[IVXLC]+\b", r"(?i)\bentry\b")
SCHEDULE_OR_LIST = (
    r"(?imd)^(?:[\[(\s]*\*{0,2})?(?:(?:FIRST|SECOND|THIRD|FOURTH|FIFTH|SIXTH|SEVENTH|EIGHTH|NINTH|TENTH|ELEVENTH|TWELFTH)\s+SCHEDULE|SCHEDULE|LIST\s+[IVXLC]+|"
    r"UNION\s+LIST|STATE\s+LIST|CONCURRENT\s+LIST)\b"
)
PART_HEADING = r"(?imd)^(?:\*{0,2})PART\s+([IVXLC]+(?:-[A-Z])?)\b\s*(.*)"
SCHEDULE_HEADING = (
    r"(?i)^(?:[\[(\s]*)?(?:\d+\[)?(FIRST|SECOND|THIRD|FOURTH|FIFTH|SIXTH|SEVENTH|EIGHTH|NINTH|TENTH|ELEVENTH|TWELFTH|[IVXLC]+|\d{1,2}(?:ST|ND|RD|TH)?)\s+SCHEDULE\b"
)
SCHEDULE_GOES_ON = r"(?i)^\((?:FIRST|SECOND|THIRD|FOURTH|FIFTH|SIXTH|SEVENTH|EIGHTH|NINTH|TENTH|ELEVENTH|TWELFTH|[IVXLC]+)\s+SCHEDULE\)\s*$"
LIST_HEADING = r"(?i)^(?:[\[(\s]*)?LIST\s+([I1]{1,3}|2|3)\b(?:\s*[^A-Za-z0-9\n]{0,8}\s*(UNION\s+LIST|STATE\s+LIST|CONCURRENT\s+LIST))?"
LIST_NAME_HEADING = r"(?i)^(?:[\[(\s]*)?(UNION\s+LIST|STATE\s+LIST|CONCURRENT\s+LIST)\b(?:\s*[^A-Za-z0-9\n]{0,8}\s*LIST\s+(?:[I1]{1,3}|2|3))?"
ENTRY_HEADING = r"(?id)^(?:\d+\[)?(?:\^?\[)?(\d+[A-Z]?)\.(?:\]|\s)+(.+)"
ENTRY_NOTE = r"(?i)^(?:Entries?\b|Subs?\.|Ins?\.|Omitted\b|Added\b|Rep\.|The\s+(?:word|words|letter|letters|figure|figures)\b|Now\b|The\s+Constitution\b|Amendment\b)"
STRUCTURE_NOTE = (
    r"(?i)^(?:\d+\.\s+)?(?:Entries?\b|Entry\s+\d+[A-Z]?\b|The\s+(?:word|words|letter|letters|figure|figures)\b|Subs?\.|Ins?\.|Omitted\b|Added\b|Rep\.|Now\b|Amendment\b|w\.e\.f\.)"
)
LIST_INSIDE_LINE = r"(?i)(?<!\n)(?=\s*LIST\s+(?:[I1]{1,3}|2|3)\s*[^A-Za-z0-9\n]{0,8}\s*(?:UNION\s+LIST|STATE\s+LIST|CONCURRENT\s+LIST)\b)"
ENTRY_INSIDE_LINE = r"(?<![\n\d])(?=\s*(?:(?:\d+\[)?\^?\[?\d+[A-Z]?\.\s+[A-Z]))"
HEADING_STANDS_ALONE = r"^(?:[.;]?$|[\[(:\-—–])"

LINE_END = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]"


def soft_lines(text: Column) -> Column:
    """Line ends before list headings and entries that stand inside a line."""
    return F.regexp_replace(F.regexp_replace(text, LIST_INSIDE_LINE, "\n"), ENTRY_INSIDE_LINE, "\n")


def stands_alone(rest: Column) -> Column:
    """Whether what follows a structural heading on its line is nothing, one mark, or begins with a bracket, colon or dash."""
    return strip(rest).rlike(HEADING_STANDS_ALONE)


def _whole(line: Column, pattern: str, found: Column) -> Column:
    return F.when((line.rlike(pattern)) & stands_alone(F.regexp_replace(line, pattern, "")), found).otherwise("")


def schedule_of(line: Column) -> Column:
    """The schedule that a line is the heading of, or an empty id."""
    return _whole(line, SCHEDULE_HEADING, legal.schedule_id(F.regexp_extract(line, SCHEDULE_HEADING, 1)))


def list_of(line: Column) -> Column:
    """The list that a line is the heading of, or an empty id; a number alone heads a list on a short line only."""
    name = F.regexp_extract(line, LIST_HEADING, 2)
    numbered = F.when((name == "") & (F.char_length(line) > 12), "").otherwise(_whole(line, LIST_HEADING, legal.list_id(F.regexp_extract(line, LIST_HEADING, 1))))
    return F.when(line.rlike(LIST_HEADING), numbered).otherwise(_whole(line, LIST_NAME_HEADING, legal.list_id(F.regexp_extract(line, LIST_NAME_HEADING, 1))))


def entry_title(line: Column) -> Column:
    """The title of an entry, empty where a line is none or a note about one."""
    title = strip(F.regexp_extract(line, ENTRY_HEADING, 2))
    return F.when(title.rlike(ENTRY_NOTE), "").otherwise(title)


def _entry_number(line: Column) -> Column:
    return legal.entry_id(F.regexp_extract(line, ENTRY_HEADING, 1))


def entry_of(line: Column) -> Column:
    return F.when(entry_title(line) != "", _entry_number(line)).otherwise("")


def marked_lines(text: Column) -> Column:
    """Every line of a page with what it may be: array<struct<line,schedule,list,entry,title,note,header>>."""
    trimmed = F.transform(F.split(soft_lines(text), LINE_END), strip)

    def marked(x: Column, title: Column) -> Column:
        return F.struct(
            x.alias("line"), schedule_of(x).alias("schedule"), list_of(x).alias("list"), F.when(title != "", _entry_number(x)).otherwise("").alias("entry"), title.alias("title"),
            x.rlike(STRUCTURE_NOTE).alias("note"), x.rlike(SCHEDULE_GOES_ON).alias("header"),
        )

    return F.transform(trimmed, lambda x: let(entry_title(x), lambda title: marked(x, title)))


def contents_page(lines: Column) -> Column:
    """Whether filled lines say CONTENTS at the top and head three schedules or lists or more."""
    top = F.exists(F.slice(lines, 1, 3), lambda x: F.upper(x["line"]) == "CONTENTS")
    return top & (F.size(F.filter(F.slice(lines, 1, 30), lambda x: (x["schedule"] != "") | (x["list"] != ""))) >= 3)


def structural_page(lines: Column, schedule: Column, lst: Column) -> Column:
    """Whether filled lines are a page of schedules or lists, after a page that ended in the given schedule and list."""
    heads = F.exists(F.slice(lines, 1, 16), lambda x: (x["schedule"] != "") | (x["list"] != ""))
    entries = (lst != "") & F.exists(F.slice(lines, 1, 12), lambda x: x["entry"] != "")
    named = (schedule != "") & F.exists(F.slice(lines, 1, 8), lambda x: F.contains(F.lower(x["line"]), F.lit("schedule")))
    return ~contents_page(lines) & (heads | entries | named)
