"""What the operators of this subpackage share: tables in the shared folder, words, input sizes."""

from __future__ import annotations

import atexit
import itertools
import os
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, and a word, as patterns for Spark and Python alike.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_count = itertools.count()
_run = uuid.uuid4().hex[:12]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read by Spark alone, from whatever store sf_dir names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own where the session names none and is a single machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file:///tmp/checkpoints/quarrystone-{os.getpid()}"
    return found.rstrip("/")


#: Paths of this process's tables in the shared folder, with the catalog's name of those that have one.
_made: dict[str, str | None] = {}


def _drop(spark: SparkSession, path: str) -> None:
    name = _made.pop(path, None)
    try:
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended: the folder goes with it
        pass


def shared_path(spark: SparkSession, name: str, as_table: bool = False) -> str:
    """A new path in the shared folder, deleted when this Python process ends, if not before."""
    path = f"{shared_dir(spark)}/quarrystone-{_run}/{name}-{next(_count)}"
    _made[path] = f"quarrystone_{_run}_{path.rpartition('/')[2].replace('-', '_')}" if as_table else None
    atexit.register(_drop, spark, path)
    return path


def table_name(path: str) -> str:
    return str(_made[path])


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends here, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a table of written() that nothing will read any more."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()} & _made.keys():
        _drop(df.sparkSession, path)


def last_only(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """make()'s rows as a table; whatever tables it needed on the way are deleted."""
    before = set(_made)
    df = make()
    out = written(df, name)
    kept = max(_made.keys() - before, key=lambda p: int(p.rpartition("-")[2]))  # the one just written
    for path in [p for p in _made if p not in before and p != kept]:
        _drop(df.sparkSession, path)
    return out


#: Bytes of a table that one task of a shuffle gets, about.
TASK_BYTES = 256 << 20


def partitions(spark: SparkSession, rows: DataFrame | None = None) -> int:
    """Tasks of a shuffle: as many as the session says, or as the bytes of the scanned `rows` ask for, if those are more.

    Spark's estimate for a plan without joins is the size of its files; for other plans the session's number counts.
    """
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if rows is None:
        return least
    plan = rows._jdf.queryExecution().optimizedPlan()
    size = int(str(plan.stats().sizeInBytes()))
    return least if "Join" in plan.toString() or size >= 1 << 60 else max(least, size // TASK_BYTES)  # rows of unknown size count as 2**63 - 1 bytes


def unused(name: str, rows: DataFrame) -> str:
    """A column name that rows do not have."""
    taken = {c.lower() for c in rows.columns}
    while name in taken:
        name += "_"
    return name


def texts(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Each batch with its whole texts as UTF-8; null is empty."""
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary()).to_pylist()
        yield batch, [v or b"" for v in values]


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts travel to Python, so a batch is bounded by rows and by bytes.

    Plans are made when their rows are asked for, so the session keeps the lower bounds; lower ones stay.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", 32 << 20)):
        now = int(re.sub(r"\D", "", spark.conf.get(key) or "") or 0)
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def checked_broadcast(df: DataFrame, rows: int, bound: int) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the bound, else as it is."""
    return F.broadcast(df) if rows <= bound else df
