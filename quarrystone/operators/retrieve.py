"""One call from queries to ranked chunks: by identifiers where a query has some, else by hybrid ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..tables import settled, shuffled
from . import bundle, index, search

TOP_K, TOLD = 8, 5
RESULT = ("qid", "rank", "chunk_pos", "chunk_type", "article_id", "text", "score", "method", "synthetic")
NOTE_REASON = "no_exact_amendment_evidence"


def retrieve(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = TOP_K) -> DataFrame:
    """RESULT rows for queries (qid, query, q) over chunks in the stored schema and vectors (id, v) by chunk_pos.

    Articles bring their whole bundles, in the order asked for and with no limit, each chunk once; a bundle that
    has none of the amendments asked for is a synthetic note. Schedules, lists and entries fill up to k
    chunks behind them, the first chunk of each identifier before the others; parts alone bring theirs. What no
    identifier answers falls to hybrid ranking, so each query takes one way only. Queries of one text and vector are
    answered once.
    """
    alike = settled(queries.groupBy("query", "q").agg(F.min("qid").alias("qid")))
    first = alike.select(F.col("query").alias("_query"), F.col("q").alias("_q"), F.col("qid").alias("_one"))
    every = queries.join(first, F.col("query").eqNullSafe(F.col("_query")) & F.col("q").eqNullSafe(F.col("_q"))).select("qid", "_one")
    return every.join(_answered(chunks, vectors, alike, k).withColumnRenamed("qid", "_one"), "_one").select(*RESULT)


def _answered(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """RESULT rows of retrieve() for queries that are each the only one of their text and vector."""
    asked = settled(index.identifiers(queries))
    articles = asked.where("kind = 'article'").select("qid", F.col("key").alias("article_id"), "ord")
    wanted = articles.join(queries.select("qid", "query", T.wants_amendments(F.col("query")).alias("notes")), "qid")
    found = settled(bundle.bundles(chunks, wanted))
    whole = found.unionByName(bundle.not_found(wanted, found)).join(articles, ["qid", "article_id"])
    once = F.row_number().over(Window.partitionBy("qid", "chunk_pos", F.when(F.col("chunk_pos") < 0, F.col("article_id"))).orderBy("ord")) == 1
    whole = whole.withColumn("_once", once).where("_once")
    order = Window.partitionBy("qid").orderBy("ord", "rank")
    bundled = settled(whole.select("qid", F.row_number().over(order).alias("rank"), "chunk_pos", "chunk_type", "article_id", "text"))
    counts = bundled.groupBy("qid").agg(F.count("*").alias("had"))
    placed = index.structural(asked, index.build_postings(chunks), articles.select("qid").distinct())
    new = placed.join(bundled.select("qid", "chunk_pos"), ["qid", "chunk_pos"], "left_anti").join(counts, "qid", "left")
    nth = F.row_number().over(Window.partitionBy("qid").orderBy("rank")) + F.coalesce("had", F.lit(0))
    texts = shuffled(chunks).select("chunk_pos", "chunk_type", "article_id", "text")
    direct = new.withColumn("rank", nth).where((F.col("rank") <= k) | (F.col("rank") == F.col("had") + 1)).select("qid", "rank", "chunk_pos").join(texts, "chunk_pos")
    routed = settled(bundled.unionByName(direct.select(*bundled.columns)).select("*", F.lit(1.0).alias("score"), F.lit("identifier").alias("method")))
    rest = queries.join(routed.select("qid").distinct(), "qid", "left_anti")
    rows = chunks.select(F.col("chunk_pos").alias("doc_id"), "text", "chunk_type", F.coalesce(F.nullif("page_start", F.lit(0)), "page").alias("page"))
    ranked = search.hybrid_topk(rows, vectors, rest, k).withColumnRenamed("id", "chunk_pos").join(texts, "chunk_pos").withColumn("method", F.lit("hybrid"))
    return routed.unionByName(ranked.select(*routed.columns)).withColumn("synthetic", F.col("chunk_pos") < 0).select(*RESULT)


def telemetry(results: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, method, query, n, top): of each query how it was answered, with how many chunks, and what the first TOLD are."""
    page = F.coalesce(F.nullif("page_start", F.lit(0)).cast("string"), F.col("page").cast("string"), F.lit("?"))
    told = F.concat(F.lit("p"), page, F.lit("/"), F.coalesce("chunk_type", F.lit("generic")), F.lit("/art"), F.coalesce("article_id", F.lit("")), F.lit("/s"), F.coalesce(F.col("score").cast("string"), F.lit("?")))
    per = results.groupBy("qid").agg(F.min("method").alias("method"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("rank") <= TOLD, F.struct("rank", told.alias("t"))))).alias("t"))
    named = per.select("qid", "method", "n", F.array_join(F.transform("t", lambda x: x["t"]), ", ").alias("top"))
    return queries.select("qid", F.substring("query", 1, 60).alias("query")).join(named, "qid", "left").select("qid", "method", "query", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("top", F.lit("")).alias("top"))
