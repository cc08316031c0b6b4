"""Co-bucketed table pair: two tables kept as one sorted Parquet file for each bucket of a shared key.

The rewrite is planned from metadata first. Numbers of rows by (starting file, bucket), counted from the key column
alone, are a contingency matrix; a starting file whose row and column of the matrix have one cell, the same, holds
exactly a final file's rows and stays as it is. All other final files are written from the files that the matrix
lists for them, and from no others.

Files of either kind are made in two steps. Spark deals rows into ranges of (file, key, other columns), sorts each
range and writes it as one run for each file in it, so a file of any size is sorted by many tasks. Then a task for
each file reads its runs in order, as a stream of Arrow batches: it hashes the keys in file order, and where a range's
border cut a file into several runs, appends them to one. What reaches the driver are names and digests of files.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import shared_dir

BUCKETS, SALT = 600, "s"
#: Rows of a sorted range, and of an Arrow batch that a writer holds.
RANGE_ROWS, BATCH_ROWS = 1_000_000, 1 << 16
SEALED = "number int, path string, n_rows long, ids_sha256 string"
RESULT = "table_name string, bucket long, path string, columns string, n_rows long, ids_sha256 string, lineage_sha256 string, n_joined long, rewritten boolean"


@dataclass(frozen=True)
class Side:
    """A table of the pair: its rows, and the number of the starting file of each."""

    name: str
    rows: DataFrame
    start: Column


def bucket(key: Column, known: Column | None = None, buckets: int = BUCKETS, salt: str = SALT) -> Column:
    """Bucket of a key; keys that are not `known` take the number after the last bucket, null ones the next."""
    own = (F.crc32(F.concat(F.lit(salt), key.cast("string")).cast("binary")) % buckets).cast("int")
    if known is not None:
        own = F.when(known, own).otherwise(buckets)
    return F.when(key.isNull(), buckets + 1).otherwise(own).cast("int")


def _free(name: str, *tables: DataFrame) -> str:
    """A column name that none of the tables has."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name in taken:
        name += "_"
    return name


def _order(key: str, df: DataFrame) -> list[str]:
    """The key and then the other columns from left to right; maps and variants have no order and are left out."""
    sortable = [f.name for f in df.schema.fields if not re.search("map<|variant", f.dataType.simpleString())]
    return [key, *(c for c in sortable if c != key)]


def _named(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


class Folder:
    """Files of one call, in a new folder of a shared file system; `staging` holds what is not final yet."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.staging = spark, path, f"{path}/_staging-{uuid.uuid4().hex[:8]}"
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        found = self._jvm.org.apache.hadoop.fs.Path(path)
        return found, found.getFileSystem(self._conf)

    def make(self, path: str) -> None:
        p, store = self._at(path)
        store.mkdirs(p)

    def move(self, old: str, new: str) -> None:
        p, store = self._at(old)
        if not store.rename(p, self._at(new)[0]):
            raise OSError(f"cannot rename {old} to {new}")

    def remove(self, path: str) -> None:
        p, store = self._at(path)
        store.delete(p, True)


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _seal(key: str, columns: list[str], arrow: pa.Schema, staging: str):
    """For each file: its runs as one file, with the number of rows and the digest of keys in file order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                digest, n_rows, target, writer = hashlib.sha256(), 0, runs[0], None
                if len(runs) > 1:  # a name for each attempt: a lost one leaves a file that goes with the staging folder
                    target = f"{staging}/joined-{number:05d}-{uuid.uuid4().hex}.parquet"
                    store, at = _opened(target)
                    writer = pq.ParquetWriter(at, arrow, filesystem=store, compression="zstd")
                for path in runs:
                    store, at = _opened(path)
                    with store.open_input_file(at) as source:
                        for part in pq.ParquetFile(source).iter_batches(BATCH_ROWS, columns=columns if writer else [key]):
                            ids = ",".join("" if k is None else str(k) for k in part.column(part.schema.get_field_index(key)).to_pylist())
                            digest.update(("," * (n_rows > 0) + ids).encode())
                            n_rows += part.num_rows
                            if writer:
                                writer.write_table(pa.Table.from_batches([part]).cast(arrow))
                if writer:
                    writer.close()
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([target]), pa.array([n_rows], pa.int64()), pa.array([digest.hexdigest()])], ["number", "path", "n_rows", "ids_sha256"])

    return run


def write_sorted(folder: Folder, rows: DataFrame, number: str, key: str, columns: list[str], name: str, prefix: str, n_rows: int, tie: list[str] | None = None) -> list[tuple[int, str, int, str]]:
    """One sorted Parquet file of `columns` for each value of the column `number`: (number, path, rows, digest of keys).

    A border between ranges may fall inside a file, between rows of one key, and with `tie` between equal rows.
    """
    spark = rows.sparkSession
    runs, kept = f"{folder.staging}/{name}-{prefix}", rows.select(*map(_named, columns))
    order = [_named(c).asc_nulls_first() for c in (number, *_order(key, kept), *(tie or []))]
    n_ranges = max(2 * spark.sparkContext.defaultParallelism, n_rows // RANGE_ROWS + 1)
    dealt = rows.repartitionByRange(n_ranges, *order).sortWithinPartitions(*order)
    dealt.select(_named(number), *map(_named, columns)).write.partitionBy(number).option("compression", "zstd").parquet(runs)

    found: dict[int, list[str]] = {}
    for path in spark.read.schema(kept.schema).option("recursiveFileLookup", True).parquet(runs).inputFiles():
        if place := re.search(r"=(\d+)/part-(\d+)-[^/]*$", path):
            found.setdefault(int(place[1]), []).append((int(place[2]), path))
    if not found:
        return []
    listed = spark.createDataFrame([(n, [p for _, p in sorted(own)]) for n, own in sorted(found.items())], "number int, runs array<string>")
    seal = _seal(key, columns, to_arrow_schema(kept.schema, timestamp_utc=True), runs)
    sealed = listed.repartition(min(len(found), 8 * spark.sparkContext.defaultParallelism)).mapInArrow(seal, SEALED).collect()  # a row for each file
    out = []
    for at, path, n, ids in sealed:
        target = f"{folder.path}/{name}/{prefix}-{at:05d}.parquet"
        folder.move(path, target)
        out.append((at, target, n, ids))
    return out


def lay_out(folder: Folder, side: Side, key: str) -> dict[int, tuple[str, int, str]]:
    """The table in numbered starting files: number -> (path, rows, digest of keys)."""
    folder.make(f"{folder.path}/{side.name}")
    number = _free("_start", side.rows)
    made = write_sorted(folder, side.rows.withColumn(number, side.start.cast("int")), number, key, side.rows.columns, side.name, "start", side.rows.count())
    return {n: (path, n_rows, ids) for n, path, n_rows, ids in made}


def _stored(folder: Folder, side: Side) -> DataFrame:
    """The rows of a table's starting files as they are stored, with `_metadata` of Spark's reader."""
    return folder.spark.read.schema(side.rows.schema).parquet(f"{folder.path}/{side.name}")


def _started(number: str) -> Column:
    return F.regexp_extract(F.col("_metadata.file_name"), r"start-(\d+)\.", 1).cast("int").alias(number)


def _held(folder: Folder, df: DataFrame, name: str) -> DataFrame:
    """df as a table of the staging folder. A join with one, not with an aggregate, is one whose hot partitions Spark splits."""
    df.write.parquet(f"{folder.staging}/{name}")
    return folder.spark.read.schema(df.schema).parquet(f"{folder.staging}/{name}")


def matrix(folder: Folder, first: Side, second: Side, key: str, buckets: int, salt: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells, joined, ids): rows by (table, start, bucket), inner-join rows by bucket, and the first table's keys."""
    counts = [_stored(folder, s).select(_started("start"), _named(key).alias("id")).groupBy("start", "id").agg(F.count("*").alias("n")) for s in (first, second)]
    ids = _held(folder, counts[0].where("id IS NOT NULL").groupBy("id").agg(F.sum("n").alias("n_first")), "ids")
    others = counts[1].where("id IS NOT NULL").groupBy("id").agg(F.sum("n").alias("n_second"))
    joined = ids.join(others, "id").groupBy(bucket(F.col("id"), None, buckets, salt).alias("bucket")).agg(F.sum(F.col("n_first") * F.col("n_second")).alias("n_joined"))
    own = counts[0].withColumn("bucket", bucket(F.col("id"), None, buckets, salt))
    met = counts[1].join(ids, "id", "left").withColumn("bucket", bucket(F.col("id"), F.col("n_first").isNotNull(), buckets, salt))
    cells = [df.groupBy("start", "bucket").agg(F.sum("n").alias("n")).select(F.lit(s.name).alias("table_name"), "start", "bucket", "n") for s, df in ((first, own), (second, met))]
    return cells[0].union(cells[1]), joined, ids.select("id")


def staying(cells: DataFrame) -> DataFrame:
    """(table_name, start, bucket) of the cells that are alone in their row and in their column of the matrix."""
    rows = cells.groupBy("table_name", "start").agg(F.count("*").alias("n_buckets"), F.first("bucket").alias("bucket")).where("n_buckets = 1")
    columns = cells.groupBy("table_name", "bucket").agg(F.count("*").alias("n_starts")).where("n_starts = 1")
    return rows.join(columns, ["table_name", "bucket"]).select("table_name", "start", "bucket")


def lineage(cells: DataFrame) -> DataFrame:
    """Digest of `start:rows` of each final file, starts ascending: at most as many as there are starting files."""
    each = F.array_sort(F.collect_list(F.struct("start", "n")))
    text = F.array_join(F.transform(each, lambda x: F.concat(x["start"].cast("string"), F.lit(":"), x["n"].cast("string"))), ",")
    return cells.groupBy("table_name", "bucket").agg(F.sha2(text, 256).alias("lineage_sha256"))


def _rewritten(folder: Folder, side: Side, key: str, kept: list[str], n_rows: int, known: DataFrame | None, buckets: int, salt: str) -> list[tuple[int, str, int, str]]:
    """Final files of the buckets that no starting file holds exactly, from the starting files that do not stay."""
    number, place, start, flag = (_free(c, side.rows) for c in ("_bucket", "_place", "_start", "_known"))
    rows = _stored(folder, side).where(~F.col("_metadata.file_name").isin(kept)) if kept else _stored(folder, side)
    rows = rows.select("*", _started(start), F.col("_metadata.row_index").alias(place))
    met = None
    if known is not None:
        rows = rows.join(known.select(F.col("id").alias(key), F.lit(True).alias(flag)), key, "left")
        met = _named(flag).isNotNull()
    rows = rows.withColumn(number, bucket(_named(key), met, buckets, salt))
    return write_sorted(folder, rows, number, key, side.rows.columns, side.name, "bucket", n_rows, [start, place])


def co_bucket(first: Side, second: Side, key: str, path: str | None = None, buckets: int = BUCKETS, salt: str = SALT) -> DataFrame:
    """Write both tables as numbered starting files, rewrite them as one file for each bucket, and describe the final files.

    A row for each table and bucket that has rows, with the columns of RESULT. Rows of the second table whose key the
    first one lacks are bucket `buckets`, null keys of either table the next; n_joined is 0 there. Repeated rows stay
    rows. Equal rows and keys may be any share of a table: they are counted before they are joined, Spark splits the
    join's hot partitions, and ranges split what is written. Tables may be empty, texts long, and columns bear any
    name. Files are read and written in tasks by pyarrow, so the folder (a new one under spark.checkpoint.dir unless a
    path is given, which is left in place) has to be in a store that pyarrow opens too.
    """
    spark = first.rows.sparkSession
    folder = Folder(spark, path or f"{shared_dir(spark)}/co_bucket-{uuid.uuid4().hex}")
    sides = (first, second)
    starts = {s.name: lay_out(folder, s, key) for s in sides}

    cells, joined, ids = matrix(folder, first, second, key, buckets, salt)
    cells = _held(folder, cells, "cells")
    stay = {s.name: {r["start"]: r["bucket"] for r in staying(cells).where(F.col("table_name") == s.name).collect()} for s in sides}  # at most a row for each file
    facts = [tuple(r) for r in lineage(cells).join(joined, "bucket", "left").select("table_name", "bucket", "lineage_sha256", F.coalesce("n_joined", F.lit(0))).collect()]  # likewise
    known = {(t, b): (digest, n) for t, b, digest, n in facts}

    finals = []
    for side in sides:
        own, kept = starts[side.name], stay[side.name]
        finals += [(side, b, *own[s], False) for s, b in kept.items()]
        if len(kept) < len(own):
            names = [own[s][0].rpartition("/")[2] for s in kept]
            n_rows = sum(n for s, (_, n, _) in own.items() if s not in kept)
            made = _rewritten(folder, side, key, names, n_rows, ids if side is second else None, buckets, salt)
            finals += [(side, *m, True) for m in made]
    for name, own in starts.items():
        for s, (file, *_) in own.items():
            if s not in stay[name]:
                folder.remove(file)
    folder.remove(folder.staging)
    rows = [(s.name, b, file, ",".join(s.rows.columns), n, digest, *known[s.name, b], changed) for s, b, file, n, digest, changed in finals]
    return spark.createDataFrame(sorted(rows), T._parse_datatype_string(RESULT))
