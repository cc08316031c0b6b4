"""OCR block payloads to page text, by Spark's own JSON functions: payloads of any depth, a level at a time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..tables import let, settled

# Blocks that are not read, blocks that start a paragraph.
SKIPPED = ("header", "image", "image-caption", "page-number", "table")
TITLES = ("section-title", "title", "headline")
STRUCTURAL = r"(?i)^(?:\*{0,2})?(?:PART\s+[IVXLC]+(?:-[A-Z])?\b|(?:Article|Art\.?)\s+\d+[A-Z]?\b|\d+[A-Z]?\.\s+[A-Z])"

_TEXTS, _VALUES = "array<string>", "array<variant>"


def decoded(content: Column) -> Column:
    """The JSON of a payload: what a fence holds, the whole, or what stands between braces or brackets; the first that is JSON."""
    whole = strip(F.regexp_replace(F.coalesce(content, F.lit("")), "^﻿+", ""))
    readings = F.array(F.regexp_extract(whole, r"(?s)^```(?:json)?\s*(.*?)\s*```$", 1), whole, F.regexp_extract(whole, r"(?s)\{.*\}", 0), F.regexp_extract(whole, r"(?s)\[.*\]", 0))
    return F.try_element_at(F.filter(readings, lambda r: (r != "") & F.try_parse_json(r).isNotNull()), F.lit(1))


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def _member(text: Column, name: str, kind: str) -> Column:
    """A member of a JSON object kept as text, as text or as a variant."""
    return F.try_element_at(F.from_json(text, f"map<string,{kind}>"), F.lit(name))


def _has(value: Column, text: Column, name: str) -> Column:
    return _is(value, "OBJECT") & F.coalesce(F.map_contains_key(F.from_json(text, "map<string,string>"), F.lit(name)), F.lit(False))


def _looked_at(nodes: DataFrame) -> DataFrame:
    """nodes (key, path, json) with `pages`, the block lists where a node is one of pages, and `inside`, its parts in the order of the text."""
    json, is_object = F.col("json"), F.col("json").startswith("{")
    texts = F.when(is_object, F.map_values(F.from_json(json, "map<string,string>"))).otherwise(F.from_json(json, _TEXTS))
    values = F.when(is_object, F.map_values(F.from_json(json, "map<string,variant>"))).otherwise(F.from_json(json, _VALUES))
    read = nodes.withColumn("parts", F.zip_with(texts, values, lambda t, v: F.struct(t.alias("text"), v.alias("value"))))
    every = lambda name: ~is_object & (F.size("parts") > 0) & F.forall("parts", lambda p: _has(p["value"], p["text"], name))
    own = F.filter(F.transform("parts", lambda p: F.when(_is(_member(p["text"], "blocks", "variant"), "ARRAY"), _member(p["text"], "blocks", "string"))), lambda b: b.isNotNull())
    pages = (
        F.when(is_object & _is(_member(json, "blocks", "variant"), "ARRAY"), F.array(_member(json, "blocks", "string")))
        .when(every("blocks"), own)
        .when(every("text"), F.array(json))
    )
    return read.select("key", "path", pages.alias("pages"), F.transform("parts", lambda p: F.when(_is(p["value"], "OBJECT") | _is(p["value"], "ARRAY"), p["text"])).alias("inside"))


def found_pages(rows: DataFrame, key: list[str], content: str) -> DataFrame:
    """The key columns and `pages`, the JSON lists of blocks at the first place that has some, for payloads that have any.

    A payload is searched in the order of its text and at any depth: every level is one step over what the levels above left.
    Keys are unique; null and empty payloads, and what is no JSON, have no pages.
    """
    whole = decoded(F.col(content))
    level = rows.select(F.struct(*key).alias("key"), F.array().cast("array<int>").alias("path"), whole.alias("json")).where("substr(json, 1, 1) IN ('{', '[')")
    hits = []
    while True:
        looked = settled(_looked_at(level))
        hits.append(looked.where(F.size("pages") > 0).select("key", "path", "pages"))
        level = looked.where("pages IS NULL").select("key", "path", F.posexplode("inside").alias("at", "json")).where("json IS NOT NULL").select("key", F.concat("path", F.array("at")).alias("path"), "json")
        if level.isEmpty():
            break
    first = reduce(DataFrame.unionByName, hits).groupBy("key").agg(F.min_by("pages", "path").alias("pages"))
    return first.select("key.*", "pages")


def blocks_of(page: Column) -> Column:
    """The blocks of a JSON list as structs of strings; what is no object in it is left out."""
    both = F.zip_with(F.from_json(page, _TEXTS), F.from_json(page, _VALUES), lambda t, v: F.when(_is(v, "OBJECT"), F.from_json(t, "map<string,string>")))

    def told(m: Column) -> Column:
        at = F.from_json(F.try_element_at(m, F.lit("coordinates")), "map<string,string>")
        got = lambda name: F.try_element_at(m, F.lit(name))
        name = F.when(F.map_contains_key(m, F.lit("block_id")), got("block_id")).otherwise("")
        return F.struct(got("reading_order").alias("place"), F.try_element_at(at, F.lit("y1")).alias("y"), F.try_element_at(at, F.lit("x1")).alias("x"), name.alias("id"), got("layout_tag").alias("layout"), got("text").alias("text"))

    return F.transform(F.filter(both, lambda m: m.isNotNull()), told)


def rendered(blocks: Column) -> Column:
    """Texts of blocks by reading order, then position; a blank line before titles and structure, and where footnotes end."""
    number = lambda c: F.coalesce(c.try_cast("double"), F.lit(float("inf")))
    keyed = F.transform(blocks, lambda b, i: F.struct(number(b["place"]).alias("place"), number(b["y"]).alias("y"), number(b["x"]).alias("x"), F.coalesce(b["id"], F.lit("None")).alias("id"), i.alias("at"), F.lower(strip(F.coalesce(b["layout"], F.lit("")))).alias("layout"), strip(F.replace(F.coalesce(b["text"], F.lit("")), F.lit("\r"), F.lit(""))).alias("text")))

    def joined(read: Column) -> Column:
        before = F.concat(F.array(F.lit("")), F.transform(read, lambda b: b["layout"]))
        pairs = F.zip_with(read, F.slice(before, F.lit(1), F.size(read)), lambda b, last: F.struct(b["text"].alias("text"), (b["layout"].isin(*TITLES) | b["text"].rlike(STRUCTURAL) | ((last == "footnote") & (b["layout"] != "footnote"))).alias("apart")))
        return strip(F.array_join(F.transform(pairs, lambda p: F.when(p["apart"], F.concat(F.lit("\n"), p["text"])).otherwise(p["text"])), "\n"))

    return let(F.filter(F.array_sort(keyed), lambda b: ~b["layout"].isin(*SKIPPED) & (b["text"] != "")), joined)


def readable_pages(rows: DataFrame, key: list[str], content: str) -> DataFrame:
    """The key columns and the text of payloads that hold exactly one page; null for others, and for pages without text."""
    one = found_pages(rows, key, content).where(F.size("pages") == 1)
    texts = one.select(*(F.col(k).alias(f"_{i}") for i, k in enumerate(key)), F.nullif(rendered(blocks_of(F.get("pages", F.lit(0)))), F.lit("")).alias("text"))
    met = reduce(lambda a, b: a & b, (rows[k].eqNullSafe(texts[f"_{i}"]) for i, k in enumerate(key)))
    return rows.join(texts, met, "left").select(*(rows[k] for k in key), texts["text"])
