"""Text expressions: everything here is a Column built from Spark's own functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..tables import let

# What the text rules look for, as stated by the rules themselves.
MOJIBAKE = (
    ("\u00e2\u20ac\u201d", "-"), ("\u00e2\u20ac\u201c", "-"), ("\u00e2\u20ac\u02dc", "'"), ("\u00e2\u20ac\u2122", "'"),
    ("\u00e2\u20ac\u0153", '"'), ("\u00e2\u20ac\u009d", '"'), ("\u00e2\u20ac\u00a6", "..."), ("\u00c2", ""), ("\u00a0", " "),
)
FOOTNOTE = r"Subs\.\s+by|Ins\.\s+by|Omitted\s+by|Added\s+by|w\.e\.f\.\s*\d|with\s+effect\s+from|Amendment\s+Act,?\s*\d{4}|^\d+\.\s+The\s+Constitution\s+\(|^\d+\.\s+(?:Subs\.|Ins\.|Omitted|Added|Rep\.)"
SECTION = r"(?:Section|Sec\.?|IPC|CrPC|Cr\.P\.C\.)\s+(\d+[A-Z]?)"
EDITORIAL_LINE = r"^\s*(?:\d+\.\s+(?:Subs\.|Ins\.|Omitted|Added|Rep\.|The\s+Constitution\s+\()|(?:Subs\.|Ins\.|Omitted|Added|Rep\.)\s+by|w\.e\.f\.)"
CONTINUATION_BLOCKER = (
    r"^(?:PART\s+[IVXLC]+(?:-[A-Z])?\b|CHAPTER\b|(?:FIRST|SECOND|THIRD|FOURTH|FIFTH|SIXTH|SEVENTH|EIGHTH|NINTH|TENTH|ELEVENTH|TWELFTH)\s+SCHEDULE\b|SCHEDULE\b|"
    r"LIST\s+[IVXLC]+\b|UNION\s+LIST\b|STATE\s+LIST\b|CONCURRENT\s+LIST\b)"
)
BODY_OPENER = r"^(?:\(\d+\)|\([a-z]\)|No\b|The\b|There\b|Nothing\b|Any\b|Every\b|Provided\b)"
WANTS_AMENDMENTS = r"\b(?:amendments?|amended|substitution|substituted|omission|omitted|insertion|inserted|footnotes?|editorial\s+note|history\s+of\s+change|constitutional\s+history|subs\.|ins\.)\b"
AMENDMENT_LABELS = (("footnote", r"\bfootnotes?\b"), ("substitution", r"\b(?:substitution|substituted)\b"), ("omission", r"\b(?:omission|omitted)\b"), ("insertion", r"\b(?:insertion|inserted)\b"))
CONSTITUTION_ONLY = (
    r"\bbased\s+only\s+on\s+(?:the\s+)?constitution(?:al\s+text)?\b", r"\banswer\s+only\s+from\s+(?:the\s+)?constitution(?:al\s+text)?\b", r"\bstrictly\s+from\s+(?:the\s+)?constitution(?:al\s+text)?\b",
    r"\bconstitution\s+only\b", r"\bonly\s+from\s+(?:the\s+)?constitutional\s+text\b", r"\bonly\s+use\s+(?:the\s+)?constitution\b", r"\bwithout\s+case\s+law\b", r"\bno\s+case\s+law\b",
    r"\b(?:do\s+not\s+use|without|no)\s+external\s+law\b", r"\b(?:do\s+not\s+use|without|no)\s+external\s+legal\s+knowledge\b",
)
ARREST = r"\b(?:arrest|arrested|detention|detained|custody|preventive detention|grounds of arrest)\b"
REMEDY = r"\b(?:remedy|remedies|enforce|enforcement|writ|writs|habeas corpus|constitutional remedy|move any court|approach (?:the )?(?:court|supreme court)|petition)\b"
FUNDAMENTAL_RIGHTS = r"\bfundamental\s+rights?\b"
REMEDY_TERMS = "constitutional remedies enforcement rights conferred by this part move supreme court"
REASONING = r"(?:think|thinking|analysis|reasoning)"
UNSUPPORTED_TERMS = ("privacy", "dignity", "health", "pollution-free environment", "pollution free environment", "maneka gandhi")
EXTERNAL_LINES = (
    r"\b(?:ipc|indian\s+penal\s+code|penal\s+code|crpc|cr\.?\s*p\.?\s*c\.?|code\s+of\s+criminal\s+procedure|evidence\s+act|indian\s+evidence\s+act|cpc|code\s+of\s+civil\s+procedure)\b",
    r"\b(?:case\s+law|precedent|precedents|judicial\s+precedent|judicial\s+precedents|supreme\s+court\s+held|high\s+court\s+held|court\s+held|judgment|judgement|ruling|ratio\s+decidendi)\b",
)

MIN_SIZE = 80
TOKEN = r"[\p{L}\p{N}_]{2,}"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def content_hash(c: Column) -> Column:
    """The first 16 hex digits of the SHA-256."""
    return F.substring(F.sha2(c, 256), 1, 16)


def page_text(c: Column) -> Column:
    """Page text for segmentation: repaired characters, no markup, no running headers or page numbers, tidy blanks."""
    for bad, good in MOJIBAKE:
        c = F.replace(c, F.lit(bad), F.lit(good))
    steps = (
        (r"\$\^\{\d+\}\[", ""), (r"\\mathrm\{([A-Z])\.\}", "$1."), (r"\$", ""), (r"\*\*", ""),
        (r"(?m)^(\d+[A-Z]?\.\s+[^\n]{3,}?\.)\s*[-\u2013\u2014]\s*(\(.+)$", "$1\n$2"),
        (r"(?mi)^(?:THE\s+CONSTITUTION\s+OF\s+INDIA)\s*$", ""), (r"(?m)^\s*\d+\s*$", ""),
        (r"[ \t]+\n", "\n"), (r"\n[ \t]+", "\n"), (r"\n{3,}", "\n\n"), (r"[ \t]{2,}", " "), (r"(?m)[ \t\r\f\x0B]+$", ""),
    )
    for pattern, to in steps:
        c = F.regexp_replace(c, pattern, to)
    return strip(c)


def footnotes(c: Column) -> Column:
    return F.regexp_count(c, F.lit("(?im)" + FOOTNOTE))


def chunk_type(text: Column, segment_type: Column) -> Column:
    """heading, article, amendment, footnote or generic."""
    size, lines = F.char_length(text), F.regexp_count(text, F.lit("\n")) + 1
    amended = lambda n: (n > 0) & ((n / lines > 0.3) | ((n >= 3) & (size < 600)))
    noted = let(footnotes(text), lambda n: F.when(amended(n), "amendment").when((n > 0) & (size < 300), "footnote").otherwise("generic"))
    return F.when(segment_type.isin("part_heading", "schedule_heading", "list_heading"), "heading").when(segment_type == "article", "article").otherwise(noted)


def section_id(c: Column) -> Column:
    return F.regexp_extract(c, "(?i)" + SECTION, 1)


def continues_article(c: Column, min_size: int = MIN_SIZE) -> Column:
    """Whether a text block goes on with the article of the page before."""
    text = strip(c)
    numbered = r"(?m)^\d+[A-Z]?\.\s+[A-Z]"
    noted = text.rlike("(?im)" + FOOTNOTE)
    return (
        F.when((text == "") | text.rlike("(?i)" + CONTINUATION_BLOCKER), False)
        .when(F.regexp_count(text, F.lit(numbered)) >= 2, False)
        .when(text.rlike(r"^\d+[A-Z]?\.\s+[A-Z]") & ~noted, False)
        .otherwise((F.char_length(text) >= max(min_size, 120)) | text.rlike(BODY_OPENER) | noted)
    )


def body_and_notes(c: Column) -> Column:
    """struct<body,notes>: the lines before the first editorial one, and the rest."""

    def cut(lines: Column) -> Column:
        first = F.array_position(F.transform(lines, lambda x: x.rlike("(?i)" + EDITORIAL_LINE)), F.lit(True)).cast("int")
        joined = lambda part: strip(F.array_join(part, "\n"))
        return let(first, lambda n: F.when(n > 0, F.struct(joined(F.slice(lines, F.lit(1), n - 1)).alias("body"), joined(F.slice(lines, n, F.size(lines))).alias("notes"))))

    whole = F.struct(strip(c).alias("body"), F.when(c.isNotNull(), "").alias("notes"))
    return F.when(c.rlike("(?im)" + EDITORIAL_LINE), F.coalesce(let(F.split(c, "\n"), cut), whole)).otherwise(whole)


def editorial_tail(c: Column) -> tuple[Column, Column]:
    """(body, notes): the lines before the first editorial one, and the rest."""
    parts = body_and_notes(c)
    return parts["body"], parts["notes"]


def with_article_prefix(text: Column, article: Column, heading: Column) -> Column:
    prefix = F.concat(F.lit("[Article "), article, F.lit("]"), F.when(heading != "", F.concat(F.lit(" "), heading)).otherwise(""))
    named = F.contains(F.substring(text, 1, 80), F.concat(F.lit("Article "), article))
    return F.when((F.coalesce(article, F.lit("")) == "") | named, text).otherwise(F.concat(prefix, F.lit("\n"), text))


def wants_amendments(q: Column) -> Column:
    return q.rlike("(?i)" + WANTS_AMENDMENTS)


def amendment_label(q: Column) -> Column:
    out = F.lit("amendment")
    for name, pattern in reversed(AMENDMENT_LABELS):
        out = F.when(q.rlike("(?i)" + pattern), name).otherwise(out)
    return out


def constitution_only(q: Column) -> Column:
    return q.rlike("(?i)" + "|".join(CONSTITUTION_ONLY))


def lexical_query(q: Column) -> Column:
    """The query for term matching: without control phrases, with terms added for remedies of fundamental rights."""
    text = q
    for pattern in CONSTITUTION_ONLY:
        text = F.regexp_replace(text, "(?i)" + pattern, " ")
    text = strip(F.regexp_replace(text, r"\s+", " "))
    more = q.rlike("(?i)" + REMEDY) & q.rlike("(?i)" + FUNDAMENTAL_RIGHTS)
    text = F.when(more, strip(F.concat(text, F.lit(" " + REMEDY_TERMS)))).otherwise(text)
    return F.when(text == "", q).otherwise(text)


def without_reasoning(c: Column) -> Column:
    c = F.regexp_replace(c, rf"(?is)<{REASONING}\b[^>]*>.*?</{REASONING}>", "")
    return strip(F.regexp_replace(c, rf"(?i)</?{REASONING}\b[^>]*>", ""))


_CITED = r"(?is)<citation\b[^>]*>(.*?)</citation>"


def without_citation_tags(c: Column) -> Column:
    """Citation tags are opened, their content in one line; those that speak of a synthetic source go with it."""
    inside = lambda tag: strip(F.regexp_replace(F.regexp_extract(tag, _CITED, 1), r"\s+", " "))
    opened = F.transform(F.regexp_extract_all(c, F.lit(_CITED), F.lit(0)), lambda t: F.when(F.contains(F.lower(t), F.lit("synthetic")), "").otherwise(inside(t)))
    return F.array_join(F.zip_with(F.split(c, _CITED), opened, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


NOT_FOUND, NOT_FOUND_HERE = "Not found in provided context.", "Not found in retrieved constitutional context."


def _kept_lines(answer: Column, keep: Callable[[Column], Column], shown: Callable[[Column], Column] = lambda x: x) -> Column:
    """Stripped lines that are blank or kept, as shown; at most one blank line in a row."""
    lines = F.transform(F.split(answer, r"\r\n|[\n\r]"), strip)
    told = F.transform(F.filter(lines, lambda x: (x == "") | keep(x)), shown)
    return strip(F.regexp_replace(F.array_join(told, "\n"), r"\n{3,}", "\n\n"))


def without_unsupported_lines(answer: Column, context: Column) -> Column:
    """Lines go that use one of the risky terms which the context lacks; the sentence that nothing was found stays."""
    low = F.lower(context)
    risky = lambda x: F.exists(F.array(*map(F.lit, UNSUPPORTED_TERMS)), lambda t: F.contains(F.lower(x), t) & ~F.contains(low, t))
    return _kept_lines(answer, lambda x: (x == NOT_FOUND) | ~risky(x))


def without_external_lines(answer: Column, context: Column) -> Column:
    """Lines go that speak of external law in a way that the context doesn't; the sentence that nothing was found says where."""
    low = F.lower(context)
    foreign = lambda x: F.exists(F.array(*(F.lit("(?i)" + p) for p in EXTERNAL_LINES)), lambda p: F.rlike(F.lower(x), p) & ~F.rlike(low, p))
    return _kept_lines(answer, lambda x: (x == NOT_FOUND) | ~foreign(x), lambda x: F.when(x == NOT_FOUND, NOT_FOUND_HERE).otherwise(x))
