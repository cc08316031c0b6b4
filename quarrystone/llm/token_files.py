"""Token ids of a corpus as shards of one concatenated id array with Elias-Fano document boundaries.

A shard is one binary value of a Parquet table, so that any store that Spark writes holds it:
magic, version, bytes of an id (2 where the vocabulary allows it, else 4), rows without an id, the
smallest id; the Elias-Fano sequence of document ends in the array; that of the document ids less
the smallest; then the id array, little-endian. Shards are numbered (part, seq) in ascending
document order, a document is never cut, and a shard holds about SHARD_TOKENS ids, more only for
a single longer document.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import elias_fano
from .common import partitions, shared_path, small_batches
from .tokens import encoder

SHARD_TOKENS = 1 << 20
MAGIC = b"QSTK\x01"
_HEAD = struct.Struct("<5sBxxQq")
SCHEMA = "part int, seq int, n_docs long, n_tokens long, shard binary"


def build_shard(doc_ids: list[int | None], ids: list[bytes], wide: bool) -> bytes:
    """ids: for each document its ids as bytes of 32-bit numbers; doc_ids ascending, nulls first."""
    known = [d for d in doc_ids if d is not None]
    base = known[0] if known else 0
    ends = np.cumsum([len(x) // 4 for x in ids], dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    array = np.frombuffer(b"".join(ids), "<u4")
    names = np.array([d - base for d in known], np.uint64)
    return b"".join([
        _HEAD.pack(MAGIC, 4 if wide else 2, len(doc_ids) - len(known), base),
        elias_fano.encode(ends, total),
        elias_fano.encode(names, int(names[-1]) if len(names) else 0),
        array.tobytes() if wide else array.astype("<u2").tobytes(),
    ])


class Shard:
    """Random and whole access to one shard."""

    def __init__(self, data: bytes):
        magic, width, self.nameless, self.base = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.ends = elias_fano.Sequence(data, _HEAD.size)
        self.names = elias_fano.Sequence(data, self.ends.end)
        self.ids = np.frombuffer(data, "<u4" if width == 4 else "<u2", offset=self.names.end)

    def __len__(self) -> int:
        return self.ends.n

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nameless + (self.names.all() + self.base).tolist()

    def document(self, i: int) -> np.ndarray:
        """Ids of document i of the shard, found by select()."""
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode docs in ascending id order into shards at path. Null texts are empty; null ids come first."""
    spark = docs.sparkSession
    small_batches(spark)
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq = encoder(tokenizer), TaskContext.get().partitionId(), 0
        wide = max(enc.size - 1, end_id) >= 1 << 16
        names: list[int | None] = []
        ids: list[bytes] = []
        held = 0

        def shard() -> pa.RecordBatch:
            values = [[part], [seq], [len(names)], [held // 4], [build_shard(names, ids, wide)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["part", "seq", "n_docs", "n_tokens", "shard"])

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                new = enc.encode(text or "") + end
                if ids and held + len(new) > 4 * shard_tokens:
                    yield shard()
                    names, ids, held, seq = [], [], 0, seq + 1
                names.append(name)
                ids.append(new)
                held += len(new)
        if ids:
            yield shard()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = rows.repartitionByRange(partitions(spark, rows), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    dealt.mapInArrow(run, SCHEMA).write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone.

    start counts the ids of all documents before: over parts, then over a part's shards, then inside.
    """
    files = spark.read.schema(SCHEMA).parquet(path)
    sizes = files.select("part", "seq", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each partition of the writer
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    starts = sizes.withColumn("inside", inside).join(before, "part").select("part", "seq", (F.col("before") + F.col("inside")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Shard(batch.column(2)[row].as_py())
                ends = shard.ends.all()
                begins = np.concatenate(([0], ends[:-1])) if len(ends) else ends
                crcs = [zlib.crc32(shard.ids[a:b].astype("<u4").tobytes()) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                n = len(ends)
                same = [pa.array(np.full(n, batch.column(k)[row].as_py(), np.int32)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(shard.doc_ids(), pa.int64()), pa.array(begins, pa.int64()), pa.array(ends - begins, pa.int64()), pa.array(crcs, pa.int64())], ["part", "seq", "doc_id", "local", "n_tokens", "ids_crc32"])

    found = files.select("part", "seq", "shard").mapInArrow(run, "part int, seq int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return found.join(starts, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None) -> DataFrame:
    """Write docs as shards, in the shared folder unless a path is given, and return what read() finds there.

    Empty and null texts have the end id alone. Rows with one id stand next to each other in any
    order; those with a null id stand first. No rows give an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    path = path or shared_path(spark, "token_files")
    write(docs, tokenizer, path, end_id)
    return read(spark, path)
