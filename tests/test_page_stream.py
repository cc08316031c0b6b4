import random

from pyspark.sql import functions as F

from quarrystone.operators import segment
from quarrystone.streaming.pages import carried_pages, chunk_pages_stream

from .test_segment import pages_of

PAGES = "doc_id long, page int, text string"


def settings(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else timers keep availableNow from ending


def test_any_batching_gives_the_same_chunks(spark, tmp_path):
    settings(spark)
    pages = [(d, p + 1, t) for d, p, t in pages_of(11) if d < 5]
    whole = segment.chunk_pages(spark.createDataFrame(pages, PAGES)).select("doc_id", "page", "text", "chunk_type", "article_id", "schedule_id", "list_id", "entry_id", "section_id")
    dealt = random.Random(3).sample(pages, len(pages))
    for k in range(3):
        spark.createDataFrame(dealt[k::3], PAGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = chunk_pages_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert len(query.recentProgress) >= 3
    got = spark.read.parquet(str(tmp_path / "out")).drop("pos")
    assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect())) and whole.count() > 30


def test_pages_wait_and_then_go_on_without_the_missing(spark, tmp_path):
    settings(spark)
    article = "21. Protection of life.—No person shall be deprived of his life or liberty, which shall apply to every person in the land."

    def run(rows):
        spark.createDataFrame(rows, PAGES).write.mode("append").parquet(str(tmp_path / "in"))
        stream = carried_pages(spark.readStream.schema(PAGES).parquet(str(tmp_path / "in")), late=1)
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.doc_id, r.page, r.article) for r in spark.read.parquet(str(tmp_path / "out")).select("doc_id", "page", F.col("carry.article").alias("article")).collect())

    assert run([(1, 1, article), (1, 3, "goes on"), (2, 2, "waits")]) == [(1, 1, "")]
    assert run([(3, 1, "x")]) == [(1, 1, ""), (1, 3, "21"), (2, 2, ""), (3, 1, "")]
    assert run([(1, 2, "too late"), (1, 4, "next")]) == [(1, 1, ""), (1, 2, ""), (1, 3, "21"), (1, 4, ""), (2, 2, ""), (3, 1, "")]
