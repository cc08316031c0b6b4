"""The stored corpus: chunks with their vectors in one table, postings and a manifest of documents, in snapshots.

A snapshot names the tables that it is made of, so appending writes what is new and deleting writes what is gone.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT = ("doc_id", "filename", "text", "image_path")
_IDS = ("article_id", "schedule_id", "list_id", "entry_id", "section_id", "source_extraction")
CHUNKS = T.StructType(
    [T.StructField(n, T.StringType()) for n in _TEXT]
    + [T.StructField(n, T.IntegerType()) for n in ("page", "chunk_id", "page_start", "page_end")]
    + [T.StructField("chunk_type", T.StringType())]
    + [T.StructField(n, T.StringType()) for n in _IDS]
    + [T.StructField("chunk_pos", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))]
)
MANIFEST = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("doc_id", "filename", "file_hash")]
    + [T.StructField(n, T.IntegerType()) for n in ("pages", "chunk_count")]
    + [T.StructField("ingestion_time", T.TimestampType())]
)


def with_defaults(chunks: DataFrame) -> DataFrame:
    """chunks in the stored schema: absent texts empty, absent page bounds 0, absent types generic."""
    have = set(chunks.columns)
    out = []
    for f in CHUNKS:
        c = F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
        default = "generic" if f.name == "chunk_type" else 0 if f.name in ("page_start", "page_end") else "" if f.name in _IDS + ("image_path", "filename") else None
        out.append((c if default is None else F.coalesce(c, F.lit(default))).alias(f.name))
    return chunks.select(*out)


def numbered(chunks: DataFrame, offset: int = 0) -> DataFrame:
    """chunks with chunk_pos: the place in the whole store, from per-document counts, not from one sorted stream."""
    sizes = chunks.groupBy("doc_id").agg(F.count("*").alias("n"))
    part = F.spark_partition_id()
    dealt = sizes.repartitionByRange("doc_id").withColumn("part", part)
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("doc_id")) - F.col("n")
    totals = dealt.groupBy("part").agg(F.sum("n").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))  # a row for each partition
    starts = dealt.withColumn("inside", inside).join(before, "part").select("doc_id", (F.col("before") + F.col("inside") + F.lit(offset)).alias("start"))
    return chunks.join(starts, "doc_id").withColumn("chunk_pos", F.col("start") + F.col("chunk_id")).drop("start")


def read_metadata(spark: SparkSession, path: str, schema: T.StructType = CHUNKS) -> DataFrame:
    """Metadata kept as a JSON array; a byte order mark at its start does no harm."""
    raw = spark.read.text(path, wholetext=True).select(F.ltrim(F.regexp_replace("value", "^﻿", "")).alias("v"))
    return raw.select(F.explode(F.from_json("v", T.ArrayType(schema))).alias("r")).select("r.*")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(kind, key, chunk_pos) of an index kept as a JSON object of maps; what cannot be read gives no rows."""
    return index_values(spark.read.text(path, wholetext=True)).where("chunk_pos IS NOT NULL").select("kind", "key", "chunk_pos")


def index_values(raw: DataFrame) -> DataFrame:
    """(kind, key, place, chunk_pos, type) of every value of indexes kept as JSON objects of maps in the column `value`.

    place counts from 0 in a key's list, and is null for a key without a list; chunk_pos is null unless the value is a
    whole number. Empty lists have no values, and neither have texts that are no JSON objects.
    """
    return raw.sparkSession.sql(
        """
        WITH parsed AS (SELECT try_parse_json(regexp_replace(value, '^\ufeff', '')) AS v FROM {raw}),
        kinds AS (SELECT k.key AS kind, k.value AS keys FROM parsed, LATERAL variant_explode(v) k WHERE schema_of_variant(v) LIKE 'OBJECT%'),
        found AS (SELECT kind, e.key, e.value, schema_of_variant(e.value) AS type FROM kinds, LATERAL variant_explode(keys) e WHERE schema_of_variant(keys) LIKE 'OBJECT%'),
        listed AS (
            SELECT kind, f.key, p.pos, p.value, CASE WHEN p.pos IS NULL THEN f.type ELSE schema_of_variant(p.value) END AS type
            FROM found f, LATERAL variant_explode_outer(CASE WHEN f.type LIKE 'ARRAY%' THEN f.value END) p WHERE p.pos IS NOT NULL OR f.type NOT LIKE 'ARRAY%'
        )
        SELECT kind, key, pos AS place, CASE WHEN pos IS NOT NULL AND type = 'BIGINT' THEN variant_get(value, '$', 'bigint') END AS chunk_pos, type FROM listed
        """,
        raw=raw,
    )


class Store:
    """Snapshots of a corpus below a folder of any file system that Spark writes.

    Tables are folders of Parquet that are written once. A snapshot is a small file that names those it is made of, and is put
    in its place by a rename that fails if the place is taken: readers see a whole snapshot or none, and of two writers
    one wins and the other one is told. Positions of chunks are never used again: the snapshot keeps the next free one.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(conf)
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)

    def current(self) -> str | None:
        """The snapshot in use."""
        return self._state().get("snapshot")

    def size(self) -> int:
        """Chunks in the current snapshot, by its manifest."""
        return int(self.read("manifest").agg(F.coalesce(F.sum("chunk_count"), F.lit(0))).first()[0]) if self.current() else 0

    def next_position(self) -> int:
        """The chunk_pos from which new chunks count on: larger than any that was ever given out."""
        return self._state().get("next_position", 0)

    def batch(self, stream: str) -> int:
        """The last batch of a stream that the store holds, -1 before the first."""
        return self._state().get("batches", {}).get(stream, -1)

    def save(self, chunks: DataFrame, postings: DataFrame, manifest: DataFrame) -> str:
        """Make these the whole of a new snapshot, unless manifest and chunks disagree in number."""
        state, name = self._state(), self._written(chunks, postings, manifest)
        return self._point(state, chunks=[name], postings=[name], manifest=[name], deleted=[], next_position=max(state.get("next_position", 0), self._after(name)))

    def append(self, chunks: DataFrame, postings: DataFrame, manifest: DataFrame, batch: tuple[str, int] | None = None) -> str:
        """A snapshot with more documents: only what is new is written, the tables of the current one are named again.

        chunk_pos counts on from next_position() in chunks and postings. With the (stream, number) of a batch, one that
        the store holds already changes nothing.
        """
        state = self._state()
        if batch and batch[1] <= self.batch(batch[0]):
            return state["snapshot"]
        name = self._written(chunks, postings, manifest, state.get("next_position", 0))
        more = {t: [*state.get(t, []), name] for t in ("chunks", "postings", "manifest")}
        batches = {**state.get("batches", {}), **({batch[0]: batch[1]} if batch else {})}
        return self._point(state, **more, batches=batches, next_position=max(state.get("next_position", 0), self._after(name)))

    def delete(self, file_hash: str) -> str:
        """A snapshot without the documents of this content: their chunks and postings are read no more, and go with compact()."""
        state, name = self._state(), self._new()
        manifest = self.read("manifest")
        gone = manifest.where(F.col("file_hash") == file_hash).select("doc_id").distinct()
        self.read("chunks").join(gone, "doc_id", "left_semi").select("chunk_pos").write.parquet(f"{self.root}/{name}/deleted")
        without_document(manifest, file_hash).write.parquet(f"{self.root}/{name}/manifest")
        return self._point(state, manifest=[name], deleted=[*state.get("deleted", []), name])

    def compact(self) -> str:
        """A snapshot of what is read now, in tables of its own, without deleted rows; positions stay."""
        state, name = self._state(), self._new()
        for table in ("chunks", "postings", "manifest"):
            self.read(table).write.parquet(f"{self.root}/{name}/{table}")
        return self._point(state, chunks=[name], postings=[name], manifest=[name], deleted=[])

    def read(self, table: str) -> DataFrame:
        """chunks, postings or manifest of the current snapshot."""
        state = self._state()
        if not state:
            raise FileNotFoundError(f"no snapshot in {self.root}")
        rows = self._tables(state[table], table)
        if table == "manifest" or not state.get("deleted"):
            return rows
        return rows.join(self._tables(state["deleted"], "deleted"), "chunk_pos", "left_anti").select(*rows.columns)

    def _tables(self, names: list[str], table: str) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.root}/{n}/{table}" for n in names))

    def _new(self) -> str:
        return f"tables-{uuid.uuid4().hex[:12]}"

    def _version(self) -> int:
        """The number of the newest snapshot, -1 if there is none."""
        folder = self._path(f"{self.root}/snapshots")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return max((int(n) for n in names if n.isdigit()), default=-1)

    def _state(self) -> dict:
        version = self._version()
        return json.loads(self.spark.read.text(f"{self.root}/snapshots/{version:08d}", wholetext=True).first().value) if version >= 0 else {}

    def _written(self, chunks: DataFrame, postings: DataFrame, manifest: DataFrame, least: int = 0) -> str:
        name = self._new()
        base = f"{self.root}/{name}"
        for table, rows in (("chunks", with_defaults(chunks)), ("postings", postings), ("manifest", manifest)):
            rows.write.parquet(f"{base}/{table}")
        stored = self.spark.read.parquet(f"{base}/chunks")
        there, placed, first = stored.agg(F.count("*"), F.count_distinct("chunk_pos"), F.min("chunk_pos")).first()
        told = self.spark.read.parquet(f"{base}/manifest").agg(F.coalesce(F.sum("chunk_count"), F.lit(0))).first()[0]
        wrong = None
        if there != told:
            wrong = f"{there} chunks are there, the manifest tells of {told}"
        elif placed != there or (first is not None and first < least):
            wrong = f"{there} chunks have {placed} positions from {first} on; the store's next one is {least}"
        if wrong:
            self._fs.delete(self._path(base), True)
            raise ValueError(wrong)
        return name

    def _after(self, name: str) -> int:
        return int(self._tables([name], "chunks").agg(F.coalesce(F.max("chunk_pos") + 1, F.lit(0))).first()[0])

    def _point(self, state: dict, **changes: object) -> str:
        """Put the next snapshot in its place, after the one that `state` is; another writer's fails to."""
        version = int(state["snapshot"].rpartition("-")[2]) + 1 if state else 0
        now = {**state, **changes, "snapshot": f"snapshot-{version}"}
        fresh, place = self._path(f"{self.root}/snapshots/_{uuid.uuid4().hex}"), self._path(f"{self.root}/snapshots/{version:08d}")
        out = self._fs.create(fresh, True)
        out.write(bytearray(json.dumps(now).encode()))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(getattr(self._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            self._context.rename(fresh, place, none)
        except Exception as e:
            self._fs.delete(fresh, False)
            if self._fs.exists(place):
                raise RuntimeError(f"another writer has made snapshot-{version}; read it and try again") from e
            raise
        return now["snapshot"]


def write_report(results: DataFrame, path: str) -> None:
    """Evaluation results as one JSON document a row, in whatever store Spark writes."""
    results.write.mode("overwrite").json(path)


def read_eval_items(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation items kept as a JSON array, flattened to one column for each criterion; a byte order mark does no harm."""
    strings, flag = T.ArrayType(T.StringType()), T.BooleanType()
    group = lambda names, kind: T.StructType([T.StructField(n, kind) for n in names])
    required = tuple(f"required_{k}_ids" for k in ("article", "schedule", "list", "entry"))
    retrieval = group((*required, "exact_article_set", "article_prefix", "forbidden_article_ids", "allowed_chunk_types_only", "forbidden_chunk_types", "required_text_substrings", "forbidden_text_substrings"), strings)
    mode = group(("amendment_expected", "constitution_only_expected"), flag)
    answer = T.StructType([T.StructField("synthetic_only_expected", flag), *group(("prompt_must_contain", "prompt_must_not_contain"), strings)])
    expected = tuple(f"expected_{k}_ids" for k in ("article", "schedule", "list", "entry"))
    item = T.StructType([*group(("id", "category", "query", "notes"), T.StringType()), T.StructField("top_k", T.IntegerType()), *group(expected, strings), T.StructField("retrieval_pass_criteria", retrieval), T.StructField("expected_mode", mode), T.StructField("answer_pass_criteria", answer)])
    rows = read_metadata(spark, path, item)
    either = [F.coalesce(f"retrieval_pass_criteria.{r}", e).alias(r) for r, e in zip(required, expected, strict=True)]
    rest = [F.col(f"retrieval_pass_criteria.{f.name}") for f in retrieval if f.name not in required]
    return rows.select("id", "category", "query", "notes", "top_k", *either, *rest, "expected_mode.*", "answer_pass_criteria.*")


def without_document(manifest: DataFrame, file_hash: str) -> DataFrame:
    return manifest.where(F.col("file_hash") != file_hash)
