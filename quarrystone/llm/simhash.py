"""SimHash near-duplicates, found through deletion-variant signatures.

A fingerprint has 64 bits. It is cut into two segments of 32 bits: of two fingerprints that differ in
at most three bits, one segment differs in at most one. Each segment is indexed under its 32
variants with one bit as a wildcard; two segments within one bit share a variant, so an equality join
on variants, followed by a count of the differing bits, finds every linked pair.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import spread
from .common import partitions, small_batches, texts, unused, written
from .components import components

SEGMENT = 32
MAX_BITS = 3
SEED = 42


def fingerprint(text: bytes, width: int = 3) -> int:
    """The 64-bit majority of the XXH64 values of all word shingles, repeats included; 0 without words."""
    words = text.lower().split()  # of bytes: A-Z alone, and the six white-space bytes
    if not words:
        return 0
    n, buf = len(words), b" ".join(words)
    h = xxhash.xxh64_intdigest
    if n < width:
        return h(buf, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[: n - width] + 1))
    hashes = np.array([h(buf[a:b], SEED) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, fp): one row per document, null texts as empty ones; h is a 64-bit hash of the text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in texts(batches, "text"):
            fps = np.fromiter((fingerprint(v) for v in values), np.uint64, len(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], ["doc_id", "h", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    return spread(rows, "doc_id", "h").mapInArrow(run, "doc_id long, h long, fp long")


def _variants(distinct: DataFrame) -> DataFrame:
    """(key, rest, fp): key has the segment's place, the wildcard's place and the other 31 bits; rest is the other segment."""
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    two = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), a.alias("own"), b.alias("rest")) for k, (a, b) in enumerate(((low, high), (high, low)))])
    pieces = distinct.select("fp", F.explode(two).alias("s")).select("fp", "s.*")
    wild = F.explode(F.sequence(F.lit(0), F.lit(SEGMENT - 1)))
    masked = F.expr("own & ~shiftleft(1L, w)")
    return pieces.select("*", wild.alias("w")).select((F.col("k") * F.lit(SEGMENT << 32) + F.shiftleft(F.col("w").cast("long"), 32) + masked).alias("key"), "rest", "fp")


#: Parts (offset, width) of what is left of the other segment, at each level: four parts, so that
#: fingerprints within three bits agree on one. After all levels 50 bits are fixed, and a group
#: has at most 2**14 distinct fingerprints.
_LEVELS = (((0, 8), (8, 8), (16, 8), (24, 8)), ((0, 6), (6, 6), (12, 6), (18, 6)), ((0, 5), (5, 5), (10, 4), (14, 4)))


def _refined(rows: DataFrame, level: int) -> DataFrame:
    parts = []
    for k, (offset, width) in enumerate(_LEVELS[level]):
        value = F.expr(f"shiftrightunsigned(rest, {offset}) & {(1 << width) - 1}L")
        rest = F.expr(f"shiftleft(shiftrightunsigned(rest, {offset + width}), {offset}) | (rest & {(1 << offset) - 1}L)")
        parts.append(F.struct((F.lit(k << 8).cast("long") + value).alias("part"), rest.alias("rest")))
    cut = rows.select("key", "fp", F.explode(F.array(*parts)).alias("p"))
    width = 10 if level == 0 else 8
    packed = F.expr(f"shiftleft(key, {width})") + (F.col("p.part") if level == 0 else F.expr("shiftleft(shiftrightunsigned(p.part, 8), 6) | (p.part & 63L)"))
    return cut.select(packed.alias("key"), F.col("p.rest").alias("rest"), "fp")


def _forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the graph that links the fingerprints within three bits: fewer than len(fps)."""
    n = len(fps)
    left, outs_u, outs_v = np.arange(1, n), [], []
    queue = np.array([0])
    while len(queue):  # breadth first: each fingerprint enters once
        found = []
        for i in queue:
            if not len(left):
                break
            near = np.bitwise_count(fps[left] ^ fps[i]) <= MAX_BITS
            hit = left[near]
            if len(hit):
                outs_u.append(np.full(len(hit), fps[i]))
                outs_v.append(fps[hit])
                found.append(hit)
                left = left[~near]
        queue = np.concatenate(found) if found else left[:1]
        if not found:
            left = left[1:]
    return (np.concatenate(outs_u), np.concatenate(outs_v)) if outs_u else (fps[:0], fps[:0])


def _links(groups: DataFrame, n: int) -> DataFrame:
    """(a, b) of linked fingerprints: enough of each group's links to connect what they connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((2, 0), np.int64)
        for batch in batches:
            new = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            held = np.concatenate([held, new], axis=1)
            last = np.searchsorted(held[0], held[0, -1]) if held.shape[1] else 0
            if last:
                yield from done(held[:, :last])
                held = held[:, last:]
        if held.shape[1]:
            yield from done(held)

    def done(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        key, fps = rows[0], rows[1].view(np.uint64)
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.concatenate((starts, [len(key)])))
        pairs = starts[sizes == 2]
        near = np.bitwise_count(fps[pairs] ^ fps[pairs + 1]) <= MAX_BITS
        a, b = [fps[pairs[near]]], [fps[pairs[near] + 1]]
        for s, k in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            u, v = _forest(fps[s : s + k])
            a.append(u)
            b.append(v)
        a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    dealt = groups.select("key", "fp").repartition(n, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def links(distinct: DataFrame, group: int = 1024) -> DataFrame:
    """(a, b): links between the distinct fingerprints fp that join the same components as all links do.

    A variant shared by more than `group` fingerprints is refined by parts of the other segment,
    which a linked pair must share as well; so no task gets more than 2**14 fingerprints at once.
    """
    n = partitions(distinct.sparkSession, distinct)
    rows, out = _variants(distinct.repartition(n, "fp")), None  # a small table would else be one task, and 64 times as many rows after it
    for level in range(len(_LEVELS) + 1):
        counts = written(rows.groupBy("key").count().where("count > 1"), "variants")
        last = level == len(_LEVELS)
        small = rows.join(counts if last else counts.where(F.col("count") <= group), "key", "left_semi")
        found = _links(small, n)
        out = found if out is None else out.union(found)
        large = counts.where(F.col("count") > group)
        if last or not large.head(1):
            return out
        rows = _refined(written(rows.join(large, "key", "left_semi"), "hot_variants"), level)
    return out


def _components(fps: DataFrame, group: int) -> DataFrame:
    """(fp, root) of the distinct fingerprints that link to others, root one fingerprint of each component."""
    distinct = written(fps.select("fp").distinct(), "distinct")
    return components(links(distinct, group).toDF("u", "v")).select(F.col("node").alias("fp"), "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = 1024) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row.

    Fingerprints link at three or fewer differing bits; component_id is the smallest id that is
    reachable, the document itself included. Null and empty texts, and those without words, have
    fingerprint zero and link like any other. Equal texts are one class from the start. A row whose
    id is null keeps its fingerprint and its links, and takes the smallest id that it reaches, null if
    there is none. Repeated ids give a row each. No rows give none; other columns are not read.
    """
    fps = written(fingerprints(docs, id_col, text_col), "fingerprints")
    roots = _components(fps, group)
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")).join(roots, "fp", "left"), "classes")
    whole = classes.where("root is not null").groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(whole, "root", "left").select("fp", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return fps.join(named, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = 1024) -> DataFrame:
    """docs with one document of each component: the one with the smallest id, a null id coming last.

    A row is known by its id and its text, so rows that share an id alone are told apart; of rows that
    share both, the one whose other columns come first in order stays, maps being ordered as JSON. A component is
    decided on ids and hashes only. The texts move once, to meet the rows that stay, whatever the size. Other columns
    may have any names and types; null and empty texts are texts without words; no rows give none.
    """
    fps = written(fingerprints(docs, id_col, text_col), "fingerprints")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")
    classes = written(fps.groupBy("fp").agg(F.min(place).alias("first"), F.count("*").alias("n")).join(_components(fps, group), "fp", "left"), "classes")
    alone = classes.where("root is null").select("first.doc_id", "first.h")
    chosen = classes.where("root is not null").groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.h")
    copies = fps.groupBy("doc_id", "h").agg(F.count("*").alias("_rows")).where("_rows > 1")
    keep = alone.union(chosen).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"))
    keep = written(keep.join(copies, keep["_id"].eqNullSafe(copies["doc_id"]) & (keep["_h"] == copies["h"]), "left").select("_id", "_h", F.coalesce("_rows", F.lit(1)).alias("_rows")), "kept")
    name = unused("_kept", docs)  # whatever names docs have, one column of ours is another one
    stay = keep.select(F.struct("_id", "_h", "_rows").alias(name))
    same = docs[id_col].cast("long").eqNullSafe(F.col(f"{name}._id")) & (F.xxhash64(docs[text_col]) == F.col(f"{name}._h"))
    out = docs.join(stay.where(f"{name}._rows = 1").hint("shuffle_hash"), same, "left_semi")
    again = stay.where(f"{name}._rows > 1")
    if again.head(1):
        twice = docs.join(again, same, "left_semi")
        ordered = [F.to_json(f.name) if re.search("map<|variant", f.dataType.simpleString()) else F.col(f.name) for f in docs.schema]
        first = F.min_by(F.struct(*twice.columns), F.struct(*(c.alias(f"c{i}") for i, c in enumerate(ordered))))
        out = out.unionByName(twice.groupBy(F.col(id_col).alias("i"), F.xxhash64(text_col).alias("t")).agg(first.alias("row")).select("row.*"))
    return out
