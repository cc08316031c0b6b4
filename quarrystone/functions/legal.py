"""Identifiers of articles, parts, schedules, lists and entries, as Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..tables import let
from .text import ARREST, REMEDY, strip

# Names of schedules and lists, and the patterns of references.
ORDINALS = ("FIRST", "SECOND", "THIRD", "FOURTH", "FIFTH", "SIXTH", "SEVENTH", "EIGHTH", "NINTH", "TENTH", "ELEVENTH", "TWELFTH")
ROMAN = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII")
LISTS = ("UNION LIST", "STATE LIST", "CONCURRENT LIST")
ARTICLE_REF = r"(?:Article|Art\.?)\s+(\d+[A-Z]?)"
PART_REF = r"Part\s+([IVXLC]+(?:-[A-Z])?)"
ARTICLE_RANGE = r"\b(?:Articles?|Arts?\.?)\s+(\d{1,3}[A-Z]?)\s*(?:-|\u2013|\u2014|\bto\b)\s*(\d{1,3}[A-Z]?)"
ARTICLE_SERIES = r"\b(?:Articles?|Arts?\.?)\s+((?:\d{1,3}[A-Z]?\s*(?:,|/|&|\band\b)\s*)+\d{1,3}[A-Z]?)"
COMPARED = r"\b(?:compare|between|vs\.?|versus)\b[^\d]{0,20}((?:\d{1,3}[A-Z]?\s*(?:,|/|&|\band\b)\s*)+\d{1,3}[A-Z]?)"
BARE_SERIES = r"^\s*((?:\d{1,3}[A-Z]?\s*(?:,|/|&|\band\b)\s*)+\d{1,3}[A-Z]?)\s*$"
ENTRY_REF = r"\bEntry\s+(\d+[A-Z]?)\b"
SCHEDULE_NAMED = r"\b(FIRST|SECOND|THIRD|FOURTH|FIFTH|SIXTH|SEVENTH|EIGHTH|NINTH|TENTH|ELEVENTH|TWELFTH|[IVXLC]+|\d{1,2}(?:ST|ND|RD|TH)?)\s+SCHEDULE\b"
SCHEDULE_PREFIX = r"\b(?:Schedule|Sch\.?)\s+([IVXLC]+|\d{1,2}(?:ST|ND|RD|TH)?)\b"
LIST_REF = r"\b(LIST\s+(?:III|II|I|1|2|3)|UNION\s+LIST|STATE\s+LIST|CONCURRENT\s+LIST)\b"
AMENDMENT_REF = r"(?:Constitution\s+\()?((?:First|Second|Third|\w+)\s+Amendment)\s+Act"
MOST = 400


def _bare(c: Column) -> Column:
    return F.upper(F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"[\[\](){}.]", ""))


def _lookup(token: Column, names: tuple[str, ...], default: Column) -> Column:
    place = F.array_position(F.array(*map(F.lit, names)), token).cast("int")
    return F.when(place > 0, F.try_element_at(F.array(*map(F.lit, ROMAN)), F.nullif(place, F.lit(0)))).otherwise(default)


def schedule_id(c: Column) -> Column:
    """A schedule's Roman numeral from its ordinal, number or numeral; numbers over 12 stay, others give an empty id."""
    token = F.regexp_replace(_bare(c), r"^(\d+)(?:ST|ND|RD|TH)$", "$1")
    number = F.regexp_extract(token, r"^(\d+)$", 1).try_cast("int")
    roman = F.try_element_at(F.array(*map(F.lit, ROMAN)), F.when(number.between(1, 12), number))
    return _lookup(token, ORDINALS, F.coalesce(roman, F.when(token.rlike(r"^(?:\d+|[IVXLC]+)$"), token).otherwise("")))


def list_id(c: Column) -> Column:
    token = _bare(c)
    token = F.when(token.rlike("^[I1]+$"), F.replace(token, F.lit("1"), F.lit("I"))).when(token.startswith("LIST "), F.element_at(F.split(token, r"\s+"), -1)).otherwise(token)
    numeral = F.when(token.isin("1", "I"), "I").when(token.isin("2", "II"), "II").when(token.isin("3", "III"), "III").otherwise("")
    return _lookup(token, LISTS, numeral)


def entry_id(c: Column) -> Column:
    return _bare(c)


def _numbers(found: Column) -> Column:
    return F.flatten(F.transform(found, lambda x: F.transform(F.regexp_extract_all(x, F.lit(r"(?i)\d+[A-Z]?"), F.lit(0)), F.upper)))


def article_range(start: Column, end: Column) -> Column:
    """Articles from start to end, upwards or downwards; ends with a letter stand for themselves."""
    plain = start.rlike(r"^\d+$") & end.rlike(r"^\d+$")
    a, b = start.try_cast("int"), end.try_cast("int")
    within = lambda x: F.filter(x, lambda n: F.regexp_extract(n, r"^(\d+)", 1).try_cast("int") <= MOST)
    steps = F.transform(F.sequence(F.least(F.coalesce(a, F.lit(0)), F.lit(999)), F.least(F.coalesce(b, F.lit(0)), F.lit(999))), lambda n: n.cast("string"))
    return within(F.when(plain, steps).otherwise(F.array(F.upper(start), F.upper(end))))


def article_ids(q: Column) -> Column:
    """Articles of a query in the order ranges, series, bare and compared series, single references; each once."""
    starts, ends = (F.regexp_extract_all(q, F.lit("(?i)" + ARTICLE_RANGE), F.lit(k)) for k in (1, 2))
    ranges = F.flatten(F.zip_with(starts, ends, article_range))
    series = [_numbers(F.regexp_extract_all(q, F.lit("(?i)" + p), F.lit(1))) for p in (ARTICLE_SERIES, BARE_SERIES, COMPARED, ARTICLE_REF)]
    every = F.array_distinct(F.concat(ranges, *series))
    return F.filter(every, lambda n: F.regexp_extract(n, r"^(\d+)", 1).try_cast("int") <= MOST)


def explicit_articles(q: Column) -> Column:
    """Every number of a clause that begins with the word article."""
    return F.array_distinct(_numbers(F.regexp_extract_all(q, F.lit(r"(?i)\bArticles?\s+([^\n?.;:]+)"), F.lit(1))))


def expanded_articles(q: Column, articles: Column) -> Column:
    """Explicit mentions first, then the other identifiers, then articles that belong with them."""
    none = F.array().cast("array<string>")
    add = lambda cond, n: F.when(cond, F.array(F.lit(n))).otherwise(none)
    arrest = q.rlike("(?i)" + ARREST)

    def with_rules(x: Column) -> Column:
        has = lambda n: F.array_contains(x["first"], n)
        return F.array_distinct(F.concat(
            x["first"], x["articles"],
            add(has("352") & has("19"), "358"), add(has("352") & (has("20") | has("21")), "359"),
            add(arrest, "22"), add(arrest & q.rlike("(?i)" + REMEDY), "32"),
        ))

    found = F.struct(explicit_articles(q).alias("mentions"), articles.alias("articles"))
    return let(found, lambda x: let(F.struct(F.when(F.size(x["mentions"]) > 0, x["mentions"]).otherwise(x["articles"]).alias("first"), x["articles"].alias("articles")), with_rules))


def article_refs(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("(?i)" + ARTICLE_REF), F.lit(1)), F.upper))


def part_refs(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("(?i)" + PART_REF), F.lit(1)), F.upper))


def entry_refs(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("(?i)" + ENTRY_REF), F.lit(1)), F.upper))


def amendment_refs(text: Column) -> Column:
    """Amendments by their names, such as `Forty-second Amendment` of an act; each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?i)" + AMENDMENT_REF), F.lit(1)))


def _ids(text: Column, pattern: str, canonical: Callable[[Column], Column]) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit("(?i)" + pattern), F.lit(1)), lambda x: canonical(F.regexp_replace(x, r"\s+", " ")))
    return F.filter(F.array_distinct(found), lambda x: x != "")


def schedule_refs(text: Column) -> Column:
    return F.array_distinct(F.concat(_ids(text, SCHEDULE_NAMED, schedule_id), _ids(text, SCHEDULE_PREFIX, schedule_id)))


def list_refs(text: Column) -> Column:
    return _ids(text, LIST_REF, list_id)
