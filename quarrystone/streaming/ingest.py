"""Continuous ingestion: documents come as a stream, each content is taken once, chunks are appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import content_hash
from ..operators import chunks
from ..operators.index import build_postings
from ..sources.store import Store, numbered, with_defaults
from ..tables import settled


def new_contents(docs: DataFrame, time_col: str | None = None, late: str = "1 day") -> DataFrame:
    """docs with file_hash, each content once; with a time column, state is kept for as long as rows may be late."""
    hashed = docs.withColumn("file_hash", content_hash(F.col("text")))
    if time_col is None:
        return hashed.dropDuplicates(["file_hash"])
    return hashed.withWatermark(time_col, late).dropDuplicatesWithinWatermark(["file_hash"])


def chunk_stream(docs: DataFrame) -> DataFrame:
    """(doc_id, file_hash, chunk_id, text) of a stream's new contents; no state beyond their hashes."""
    hashed = docs if "file_hash" in docs.columns else new_contents(docs)
    return hashed.select("doc_id", "file_hash", F.posexplode(chunks.chunk_text(F.col("text"))).alias("chunk_id", "text"))


def ingest(docs: DataFrame, path: str, checkpoint: str, chunker: Callable[[DataFrame], DataFrame] = chunk_stream) -> StreamingQuery:
    """Append the chunks of what has arrived to path, exactly once, and stop."""
    return chunker(docs).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def store_batch(store: Store, name: str, chunker: Callable[[DataFrame], DataFrame] = chunk_stream) -> Callable[[DataFrame, int], None]:
    """What to do with each micro-batch of documents (doc_id, text, filename) so that a store takes it once.

    Contents that the store or the batch has already are left out. The batch's number is kept in the same snapshot as
    its chunks, so a batch that is run again after a crash changes nothing.
    """

    def take(docs: DataFrame, number: int) -> None:
        if number <= store.batch(name):
            return
        hashed = docs.withColumns({"doc_id": F.col("doc_id").cast("string"), "file_hash": content_hash(F.coalesce("text", F.lit("")))})
        first = hashed.groupBy("file_hash").agg(F.min(F.struct("doc_id", "filename", "text")).alias("d")).select("file_hash", "d.*")
        if store.current():
            first = first.join(store.read("manifest").select("file_hash"), "file_hash", "left_anti")
        rows = settled(chunker(first).select("doc_id", "chunk_id", "text", F.lit(1).alias("page")))
        placed = settled(numbered(rows, store.next_position()))
        counts = placed.groupBy("doc_id").agg(F.count("*").cast("int").alias("chunk_count"))
        manifest = first.join(counts, "doc_id").select("doc_id", "filename", "file_hash", F.lit(1).alias("pages"), "chunk_count", F.current_timestamp().alias("ingestion_time"))
        stored = with_defaults(placed)
        store.append(stored, build_postings(stored), manifest, (name, number))

    return take


def ingest_into(docs: DataFrame, store: Store, checkpoint: str, name: str = "documents", chunker: Callable[[DataFrame], DataFrame] = chunk_stream) -> StreamingQuery:
    """Append what has arrived to a store, batch by batch, exactly once, and stop."""
    return docs.writeStream.foreachBatch(store_batch(store, name, chunker)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
