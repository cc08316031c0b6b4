"""Checks of a stored corpus: integrity counts, the index against the chunks, and a report of both."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..tables import settled
from .answer import snippet

# What a chunk must have, the types it can be of, articles that a report shows, how a heading names an article.
REQUIRED = ("doc_id", "filename", "page", "chunk_id", "text", "image_path", "page_start", "page_end", "chunk_type", "article_id", "schedule_id", "list_id", "entry_id", "section_id", "source_extraction")
NUMBERS = ("chunk_id", "page", "page_start", "page_end")
CHUNK_TYPES = ("article", "clause", "heading", "footnote", "amendment", "generic")
TARGET_ARTICLES = ("21", "21A", "22", "32", "226", "352", "358", "359", "360", "368")
HEADING_ARTICLE = r"(?im)^\[Article\s+(\d+[A-Z]?)\]|^(?:Article|Art\.?)\s+(\d+[A-Z]?)\b|^(\d+[A-Z]?)\.\s+[A-Z]"
MOST_CHUNKED, SAMPLE_REFS, TARGET_REFS = 20, 5, 10


def _n(cond: Column) -> Column:
    return F.coalesce(F.sum(F.coalesce(cond, F.lit(False)).cast("long")), F.lit(0))


def store_issues(chunks: DataFrame) -> DataFrame:
    """(issue, n) of stored chunks: one pass, a window for page order and one for repeated keys.

    A column that is absent counts as missing in every row. `row_mismatch` counts chunks whose place in the
    store is not their number, `page_range` pages below one or outside their own bounds.
    """
    have = set(chunks.columns)
    rows = chunks.select("*", *[F.lit(None).cast("int" if c in NUMBERS else "string").alias(c) for c in REQUIRED if c not in have])
    before = Window.partitionBy("doc_id").orderBy("chunk_id", "chunk_pos")
    rows = rows.withColumn("_back", F.col("page") < F.lag("page").over(before)).withColumn("_times", F.count("*").over(Window.partitionBy("doc_id", "chunk_id")))
    lowest = F.least("page", "page_start", "page_end")
    known = F.col("page").isNotNull() & F.col("page_start").isNotNull() & F.col("page_end").isNotNull()
    found = rows.agg(
        *[_n(F.col(c).isNull()).alias(f"missing_{c}") for c in REQUIRED],
        _n((strip(F.coalesce("text", F.lit(""))) == "") & (F.coalesce("chunk_type", F.lit("")) != "heading")).alias("empty_text"),
        _n(~F.coalesce("chunk_type", F.lit("")).isin(*CHUNK_TYPES)).alias("unknown_type"), _n(F.col("chunk_pos") != F.col("chunk_id")).alias("row_mismatch"),
        _n(F.col("_times") > 1).alias("duplicate_key"), _n(F.col("_back")).alias("page_order"),
        _n(known & ((lowest <= 0) | ~F.col("page").between(F.col("page_start"), F.col("page_end")))).alias("page_range"),
    )
    return found.unpivot([], found.columns, "issue", "n")


def counters(chunks: DataFrame) -> DataFrame:
    """(section, key, n): chunks of each type and of each source of text, and the articles with most chunks."""
    said = lambda section, c: F.struct(F.lit(section).alias("section"), F.coalesce(c, F.lit("")).alias("key"))
    kinds = F.array(said("chunk_type", F.col("chunk_type")), said("source_extraction", F.col("source_extraction")), said("article", F.col("article_id")))
    sums = chunks.select(F.explode(kinds).alias("k")).groupBy("k.section", "k.key").agg(F.count("*").alias("n")).where("section <> 'article' OR key <> ''")
    place = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("n"), "key"))
    return sums.withColumn("place", place).where((F.col("section") != "article") | (F.col("place") <= MOST_CHUNKED)).drop("place")


def files_of_documents(chunks: DataFrame) -> DataFrame:
    """(doc_id, filenames): the sorted names under which each document is stored."""
    return chunks.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.coalesce("filename", F.lit("")))).alias("filenames"))


def chunks_of_articles(chunks: DataFrame) -> DataFrame:
    """(article_id, n, first, last): how many chunks each article has, and between which places; the places are its postings."""
    rows = chunks.where(F.coalesce("article_id", F.lit("")) != "")
    return rows.groupBy("article_id").agg(F.count("*").alias("n"), F.min("chunk_pos").alias("first"), F.max("chunk_pos").alias("last"))


def index_issues(postings: DataFrame, chunks: DataFrame) -> DataFrame:
    """(kind, key, chunk_pos, issue): postings without a chunk, and keys that disagree with the chunk's own.

    The seventh schedule may hold chunks of its lists that name no schedule.
    """
    own = chunks.select("chunk_pos", *[F.upper(F.coalesce(f"{k}_id", F.lit(""))).alias(k) for k in ("article", "schedule", "list", "entry")], F.lit(True).alias("there"))
    rows, key = postings.join(own, "chunk_pos", "left"), F.upper("key")
    entry = F.concat(F.col("list"), F.lit(":"), F.col("entry"))
    wrong = {"article": F.col("article") != key, "schedule": (F.col("schedule") != key) & (key != "VII"), "list": F.col("list") != key, "entry": entry != key}
    issue = F.when(F.col("there").isNull(), "out_of_range")
    for kind, cond in wrong.items():
        issue = issue.when((F.col("kind") == kind) & cond, f"{kind}_mismatch")
    return rows.select("kind", "key", "chunk_pos", issue.alias("issue")).where("issue is not null")


#: What stored indexes call their groups, and what postings call them.
GROUPS = {"articles": "article", "parts": "part", "schedules": "schedule", "lists": "list", "entries": "entry", "tags": "tag"}


def stored_index_issues(values: DataFrame, chunks: DataFrame) -> DataFrame:
    """(kind, key, chunk_pos, issue) of a stored index's values: no list, no whole number, and what index_issues() finds in the rest."""
    names = F.create_map(*(F.lit(x) for pair in GROUPS.items() for x in pair))
    known = settled(values.withColumn("kind", names[F.col("kind")]).where("kind IS NOT NULL").select("kind", "key", "place", "chunk_pos"))
    wrong = known.where("chunk_pos IS NULL").select("kind", "key", "chunk_pos", F.when(F.col("place").isNull(), "not_list").otherwise("non_int").alias("issue"))
    return wrong.unionByName(index_issues(known.where("chunk_pos IS NOT NULL").select("kind", "key", "chunk_pos"), chunks))


def heading_articles(chunks: DataFrame) -> DataFrame:
    """(article, chunk_pos): the article that each chunk's first heading names."""
    groups = [F.regexp_extract("text", HEADING_ARTICLE, k) for k in (1, 2, 3)]
    return chunks.select(F.upper(F.concat(*groups)).alias("article"), "chunk_pos").where("article <> ''")


def heading_audit(chunks: DataFrame, postings: DataFrame) -> DataFrame:
    """(article, n, indexed): articles that headings name, in how many chunks, and whether the index knows them."""
    known = postings.where("kind = 'article'").select(F.col("key").alias("article"), F.lit(True).alias("indexed")).distinct()
    return heading_articles(chunks).groupBy("article").agg(F.count("*").alias("n")).join(known, "article", "left").select("article", "n", F.coalesce("indexed", F.lit(False)).alias("indexed"))


def _shown(places: DataFrame, chunks: DataFrame, label: str, most: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(label).orderBy("chunk_pos"))
    first = places.withColumn("nth", nth).where(F.col("nth") <= most)
    return first.join(chunks.select("chunk_pos", F.col("page_start").alias("page"), "chunk_type", snippet(F.col("text")).alias("text")), "chunk_pos")


def target_articles(chunks: DataFrame, postings: DataFrame, targets: tuple[str, ...] = TARGET_ARTICLES) -> DataFrame:
    """(article, source, nth, chunk_pos, page, chunk_type, text): the first chunks of articles that matter, by the index or else by headings."""
    indexed = settled(postings.where((F.col("kind") == "article") & F.col("key").isin(*targets)).select(F.col("key").alias("article"), "chunk_pos", F.lit("index").alias("source")))
    shown = heading_articles(chunks.where(F.col("text").rlike(HEADING_ARTICLE))).where(F.col("article").isin(*targets))
    inferred = shown.join(indexed.select("article").distinct(), "article", "left_anti").withColumn("source", F.lit("heading"))
    return _shown(indexed.unionByName(inferred), chunks, "article", TARGET_REFS).select("article", "source", "nth", "chunk_pos", "page", "chunk_type", "text")


def structural_samples(chunks: DataFrame, postings: DataFrame) -> DataFrame:
    """(kind, key, nth, chunk_pos, page, chunk_type, text): the first key of schedules, lists and entries, with its first chunks."""
    of = postings.where(F.col("kind").isin("schedule", "list", "entry"))
    first = of.groupBy("kind").agg(F.min("key").alias("key"))
    return _shown(of.join(first, ["kind", "key"]), chunks, "kind", SAMPLE_REFS).select("kind", "key", "nth", "chunk_pos", "page", "chunk_type", "text")


def report(chunks: DataFrame, postings: DataFrame, manifest: DataFrame) -> DataFrame:
    """(section, item, n): the counts of a store's parts, its integrity, its index and its articles."""
    said = lambda df, section, item, n: df.select(F.lit(section).alias("section"), item.alias("item"), n.cast("long").alias("n"))
    postings = settled(postings)
    one = lambda df, section, item, n: said(df.agg(n.alias("v")), section, F.lit(item), F.col("v"))
    named, bad, headings = (lambda *c: F.concat_ws("_", *c)), index_issues(postings, chunks), settled(heading_audit(chunks, postings))
    counted = counters(chunks)
    parts = [
        one(manifest, "documents", "documents", F.count("*")), one(manifest, "stability", "chunks_told", F.coalesce(F.sum("chunk_count"), F.lit(0))), one(chunks, "counts", "chunks", F.count("*")),
        said(postings.groupBy("kind").agg(F.countDistinct("key").alias("v")), "counts", named(F.lit("index"), F.col("kind")), F.col("v")),
        said(store_issues(chunks), "metadata", F.col("issue"), F.col("n")), said(counted, "metadata", named(F.col("section"), F.col("key")), F.col("n")),
        said(bad.groupBy("kind", "issue").agg(F.count("*").alias("v")), "index", named(F.col("kind"), F.col("issue")), F.col("v")),
        one(chunks_of_articles(chunks), "articles", "in_chunks", F.count("*")), one(headings, "articles", "in_headings", F.count("*")), one(headings, "articles", "missing_from_index", _n(~F.col("indexed"))),
    ]
    return reduce(DataFrame.unionByName, parts)
