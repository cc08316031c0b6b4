"""Best-fit packing of tokenised documents into sequences of a fixed capacity, in bulk-synchronous steps.

Documents are range-sorted over the cluster by length and numbered within each, sequences are
known by the gap that they have left. Lengths and gaps are whole numbers of at most the capacity, so both are tables of
runs: documents of one length and consecutive ranks, sequences of one gap and consecutive numbers. A superstep
deals both by ranges of size. Each range is swept by itself, from the longest document down: a run of documents
takes the successor, the smallest gap that holds it, as many documents to a gap as fit; where several want a gap, the
ranks of documents and gaps decide. Matched gaps shrink and move to their new range. What the ranges leave over is
swept again in wider ranges, where documents of lower ones meet gaps of higher ones, until one range is all sizes. What
no gap holds then opens new sequences, and the next superstep begins; supersteps go on from bands of long
documents to bands of short ones. A table of runs is bounded by the capacity, not by the documents; the
matches, as rank intervals, are applied where the documents are.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import spread
from .common import partitions, small_batches, written
from .tokens import encoder

CAPACITY = 4096
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, and ids (32-bit, little-endian) if asked for."""
    small_batches(docs.sparkSession)
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = enc.encode(text or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, value in zip(out, (name, k, at // 4, len(part) // 4, zlib.crc32(part), part), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            n = 6 if with_ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out[:n], kinds[:n], strict=True)], names[:n])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return spread(rows, "doc_id", "text").mapInArrow(run, PIECE + ", ids binary" * with_ids)


#: Documents in a sequence up to which openings are estimated by number.
TOGETHER = 16
#: Ranges of sizes that are swept side by side, and how many of them become one for the next sweep.
RANGES, MERGED = 16, 4
#: A run: what it is (d: documents, g: gaps, m: a match), its size, its first rank or sequence, and how many; for a
#: match also the first sequence, the place in it, and the documents that each sequence takes.
RUN = "kind string, size long, first long, n long, sequence long, offset long, per long"
_NAMES = [f.split()[0] for f in RUN.split(", ")]
Run = tuple[str, int, int, int, int, int, int]


class _Gaps:
    """Runs of gaps by size; documents take the smallest gap that holds them, as many to a gap as fit."""

    def __init__(self, capacity: int, reuse: int):
        """reuse: shrunk gaps of at least that size can be taken again, others are told as u."""
        self.capacity, self.reuse = capacity, reuse
        self.sizes: list[int] = []
        self.runs: dict[int, list[tuple[int, int]]] = {}
        self.out: list[Run] = []

    def put(self, size: int, first: int, n: int) -> None:
        if size not in self.runs:
            bisect.insort(self.sizes, size)
            self.runs[size] = []
        self.runs[size].append((first, n))

    def _shrunk(self, size: int, first: int, n: int) -> None:
        if size >= self.reuse:
            self.put(size, first, n)
        else:
            self.out.append(("u", size, first, n, 0, 0, 0))

    def take(self, size: int, rank: int, n: int) -> list[Run]:
        """Match documents, in order of rank; the run of those that no gap holds."""
        while n and self.sizes and self.sizes[-1] >= size:
            gap = self.sizes[bisect.bisect_left(self.sizes, size)]
            first, many = self.runs[gap].pop()
            if not self.runs[gap]:
                del self.runs[gap]
                self.sizes.remove(gap)
            each = gap // size
            full, used = min(many, n // each), 0
            parts = [(full, each)] + ([(1, n - full * each)] if full < many and n > full * each else [])
            for sequences, per in parts:
                if sequences:
                    self.out.append(("m", size, rank, sequences * per, first + used, self.capacity - gap, per))
                    self._shrunk(gap - per * size, first + used, sequences)
                    rank, n, used = rank + sequences * per, n - sequences * per, used + sequences
            if used < many:
                self.put(gap, first + used, many - used)
        return [("d", size, rank, n, 0, 0, 0)] if n else []

    def left(self) -> list[Run]:
        return self.out + [("g", size, first, n, 0, 0, 0) for size, runs in self.runs.items() for first, n in sorted(runs)]


def _order(run: Run) -> tuple:
    """By size, the largest first, then by rank."""
    return -run[1], run[2]


def sweep(runs: list[Run], capacity: int, low: int) -> list[Run]:
    """One range, down to the size `low`, by itself: matches (m), shrunk gaps (u), and what is left of gaps (g) and documents (d).

    A gap that has shrunk within the range is there again for the documents to come.
    """
    gaps, rest = _Gaps(capacity, max(low, 1)), []
    for _, size, first, n, *_ in sorted((r for r in runs if r[0] == "g"), key=_order):
        gaps.put(size, first, n)
    for _, size, first, n, *_ in sorted((r for r in runs if r[0] == "d"), key=_order):
        rest += gaps.take(size, first, n)
    return gaps.left() + rest


def _runs(rows: list[Run]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(_NAMES)
    return pa.table([pa.array(c, pa.string() if i == 0 else pa.int64()) for i, c in enumerate(columns)], names=_NAMES)


def _rows(table: pa.Table) -> list[Run]:
    return list(zip(*[table[n].to_pylist() for n in _NAMES], strict=True))


def _swept(capacity: int, width: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        own = _rows(table)
        told, open_ = [r for r in own if r[0] == "m"], [r for r in own if r[0] != "m"]
        low = (min(r[1] for r in open_) - 1) // width * width + 1 if open_ else 1
        return _runs(told + sweep(open_, capacity, low))

    return run


def superstep(runs: DataFrame, capacity: int, ranges: int = RANGES) -> DataFrame:
    """Runs after sweeps of all documents (d) over all gaps (g), in ever wider ranges; what is matched already is passed on."""
    while True:
        width = -(-capacity // ranges)
        runs = runs.withColumn("part", F.floor((F.col("size") - 1) / width)).groupBy("part").applyInArrow(_swept(capacity, width), RUN)
        runs = runs.withColumn("kind", F.when(F.col("kind") == "u", "g").otherwise(F.col("kind"))).where("kind <> 'g' OR size > 0")
        if ranges <= 1:
            return runs
        ranges = -(-ranges // MERGED)


def match(counts: DataFrame, capacity: int = CAPACITY, ranges: int = RANGES) -> DataFrame:
    """(length, rank, n, sequence, offset, per): documents `rank` ... of a `length` go, `per` to each, to `sequence` ... from `offset` on.

    counts: (length, n), a row for each length. Bands of lengths quarter from the capacity down; a band ends when its documents
    are placed. New sequences are as many as the documents left need at least: by their tokens, and as no k + 1 of those
    longer than a (k + 1)th of the capacity share one.
    """
    spark = counts.sparkSession
    zero = [F.lit(0).cast("long").alias(n) for n in _NAMES[4:]]
    docs = written(counts.select(F.lit("d").alias("kind"), F.col("length").cast("long").alias("size"), F.lit(0).cast("long").alias("first"), F.col("n").cast("long").alias("n"), *zero), "lengths")
    waiting, size, n = F.col("kind") == "d", F.col("size"), F.col("n")
    whole = lambda c: F.coalesce(F.sum(F.when(waiting & c, n)), F.lit(0))
    needs = [F.ceil(F.coalesce(F.sum(F.when(waiting, n * size)), F.lit(0)) / capacity), *[F.ceil(whole((k + 1) * size > capacity) / k) for k in range(1, TOGETHER + 1)]]
    facts = [whole(F.lit(True)).alias("left"), F.greatest(*needs).alias("needs"), F.min(F.when(waiting, size)).alias("least"), F.max(F.when(F.col("kind") == "g", size)).alias("widest")]
    state, done, opened, band = spark.createDataFrame([], RUN), [], 0, capacity
    while band > 0:
        low = band // 4 if band > max(1, capacity >> 4) else 0
        state = state.unionByName(docs.where((size > low) & (size <= band)))
        while (now := state.agg(*facts).first()).left:
            if not now.widest or now.widest < now.least:  # no gap holds any of them
                state = state.unionByName(spark.createDataFrame([("g", capacity, opened, now.needs, 0, 0, 0)], RUN))
                opened += now.needs
            after = written(superstep(state, capacity, ranges), "runs")
            done.append(after.where("kind = 'm'"))
            state = after.where("kind <> 'm'")
        band = low
    found = reduce(DataFrame.unionByName, done) if done else spark.createDataFrame([], RUN)
    return found.select(F.col("size").alias("length"), F.col("first").alias("rank"), "n", "sequence", "offset", "per")


def _ranked(rows: DataFrame) -> DataFrame:
    """rows with `part` and `nth`: the place among the part's rows of one length, in range-sorted order."""
    keys = [F.col("length"), F.col("doc_id"), F.col("piece"), F.col("ids_crc32")]
    dealt = rows.repartitionByRange(partitions(rows.sparkSession, rows), *keys).sortWithinPartitions(*keys)
    at = dealt.columns.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), -1, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = batch.column(at).to_numpy()
            place = np.arange(len(lengths))
            new = np.concatenate(([lengths[0] != last], lengths[1:] != lengths[:-1]))
            begin = np.maximum.accumulate(np.where(new, place, -1))
            nth = np.where(begin < 0, place + seen, place - begin)
            last, seen = lengths[-1], int(nth[-1]) + 1
            more = [pa.array(np.full(len(lengths), part, np.int32)), pa.array(nth, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "part", "nth"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema)
    return dealt.mapInArrow(run, f"{kinds}, part int, nth long")


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """rows (doc_id, piece, length, ids_crc32 and any others) with sequence_id and offset.

    Sequences have at most `capacity` tokens, without holes from 0 on. Lengths must be from 1 to
    the capacity. Equal rows are packed each for itself.
    """
    spark = rows.sparkSession
    rows = written(rows, "pieces")  # range-sorting looks at its input twice
    ranked = written(_ranked(rows), "ranked")
    per_part = ranked.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    offsets = written(per_part.withColumn("before", before), "ranks")
    found = match(offsets.groupBy("length").agg(F.sum("n").alias("n")), capacity)
    known = found.toPandas()  # runs, bounded by the capacity
    intervals = spark.sparkContext.broadcast({c: known[c].to_numpy()[np.lexsort((known["rank"], known["length"]))] for c in known.columns})
    numbered = ranked.join(offsets.select("length", "part", "before"), ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth")).drop("part", "nth", "before")
    names = rows.columns
    numbered = numbered.select(*names, "rank")
    at = names.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = intervals.value
        lengths = np.unique(known["length"])
        stride = int(known["rank"].max(initial=0)) + 1
        order = np.searchsorted(lengths, known["length"]) * stride + known["rank"]
        for batch in batches:
            own, rank = batch.column(at).to_numpy(), batch.column(len(names)).to_numpy()
            klass = np.searchsorted(lengths, own)
            i = np.searchsorted(order, klass * stride + np.minimum(rank, stride - 1), side="right") - 1
            nth = rank - known["rank"][i]
            more = [pa.array(known["sequence"][i] + nth // known["per"][i], pa.int64()), pa.array(known["offset"][i] + nth % known["per"][i] * own, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *more], [*names, "sequence_id", "offset"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return numbered.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def packed(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Documents cut into pieces and packed: one row for each piece, with its sequence and place.

    Null and empty texts have the end id alone. Rows with a null or repeated id are packed each for
    itself. No rows give none. Other columns of docs are not read.
    """
    return pack(pieces(docs, tokenizer, end_id, capacity, with_ids), capacity)
