"""Pages of documents: splitting combined files, windows, fallbacks, and what has been ingested."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_hash, strip

BATCH_PAGES = 10
_MARK = r"(?im)^\s*---\s*page\s+(\d+)\s*---\s*$"


def batch_no(page: Column, size: int = BATCH_PAGES) -> Column:
    return F.floor((page - 1) / size)


def page_number(name: Column, default: Column) -> Column:
    """The first digits of a file's name without its ending."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.coalesce(F.nullif(F.regexp_extract(stem, r"(\d+)", 1), F.lit("")).try_cast("int"), default)


def split_pages(files: DataFrame, id_col: str = "doc_id", text_col: str = "content") -> DataFrame:
    """(doc_id, page, text): a combined file by its page marks (what precedes them goes), else by form feeds; empty pages go."""
    text = F.col(text_col)
    marks = F.regexp_extract_all(text, F.lit(_MARK), F.lit(1))
    bodies = F.split(text, _MARK)
    marked = F.zip_with(marks, F.slice(bodies, F.lit(2), F.greatest(F.size(bodies) - 1, F.lit(0))), lambda n, t: F.struct(n.cast("int").alias("page"), strip(F.coalesce(t, F.lit(""))).alias("text")))
    fed = F.transform(F.split(text, "\f"), lambda t, i: F.struct((i + 1).alias("page"), strip(t).alias("text")))
    rows = files.select(F.col(id_col).alias("doc_id"), F.explode(F.when(F.size(marks) > 0, marked).otherwise(fed)).alias("p"))
    return rows.select("doc_id", "p.page", "p.text").where("text <> ''")


def page_window(pages: DataFrame, first: int, last: int) -> tuple[DataFrame, DataFrame]:
    """(every page of the window for each document, missing ones empty; the pages outside it)."""
    docs = pages.select("doc_id").distinct().select("doc_id", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("page"))
    inside = docs.join(pages.select("doc_id", "page", "text"), ["doc_id", "page"], "left")
    filled = inside.select("doc_id", "page", F.coalesce("text", F.lit("")).alias("text"), F.col("text").isNull().alias("missing"))
    return filled, pages.where(~F.col("page").between(first, last))


def with_fallback(primary: DataFrame, secondary: DataFrame, size: int = BATCH_PAGES) -> DataFrame:
    """(doc_id, page, text, source): batches whose primary text is all blank come from the secondary source."""
    both = primary.select("doc_id", "page", F.col("text").alias("a")).join(secondary.select("doc_id", "page", F.col("text").alias("b")), ["doc_id", "page"], "full")
    whole = Window.partitionBy("doc_id", batch_no(F.col("page"), size))
    good = F.max(F.coalesce(strip(F.col("a")) != "", F.lit(False))).over(whole)
    return both.select("doc_id", "page", F.coalesce(F.when(good, F.col("a")).otherwise(F.col("b")), F.lit("")).alias("text"), F.when(good, "primary").otherwise("secondary").alias("source"))


def merged_pages(pages: DataFrame) -> DataFrame:
    """Of several texts for a page the one of the latest batch."""
    order = Window.partitionBy("doc_id", "page").orderBy(F.desc("batch_no"))
    return pages.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def ocr_pages(files: DataFrame) -> DataFrame:
    """(doc_id, page, text) of OCR results (doc_id, name, content): one page a file, by its name's number.

    Of files with one number the last by name counts. A document that is one file with one page
    may be a combined one and is split by its marks.
    """
    count = F.count("*").over(Window.partitionBy("doc_id"))
    number = page_number(F.col("name"), F.lit(1))
    rows = files.select("doc_id", "name", number.alias("page"), F.coalesce("content", F.lit("")).alias("content")).withColumn("_files", count)
    marked = F.col("content").rlike(_MARK) | F.contains("content", F.lit("\f"))
    combined = split_pages(rows.where((F.col("_files") == 1) & marked).select("doc_id", "content"))
    last = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(F.desc("name"))) == 1
    single = rows.where(~((F.col("_files") == 1) & marked)).withColumn("_last", last).where("_last").select("doc_id", "page", strip(F.col("content")).alias("text"))
    return combined.unionByName(single)


def with_images(pages: DataFrame, images: DataFrame) -> DataFrame:
    """pages (doc_id, page) with image_path: the document's image of that number, from 1; empty without one."""
    numbered = images.select("doc_id", F.col("image_no").alias("page"), "image_path")
    return pages.join(numbered, ["doc_id", "page"], "left").withColumn("image_path", F.coalesce("image_path", F.lit("")))


def first_of_each(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, file_hash) of the first document of each content."""
    return docs.groupBy(content_hash(F.col("text")).alias("file_hash")).agg(F.min(id_col).alias("doc_id")).select("doc_id", "file_hash")


def pending(docs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Documents whose content has no record with chunks in the manifest (file_hash, chunk_count)."""
    done = manifest.where("chunk_count > 0").select("file_hash").distinct()
    return docs.withColumn("file_hash", content_hash(F.col("text"))).join(done, "file_hash", "left_anti")
