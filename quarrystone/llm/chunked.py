"""Documents in chunks that stay where they are while small keys and marks travel.

Operators that look for repeated pieces of text need several looks at every document. The texts are dealt
once into a bucketed table in the shared folder; each look groups a bucket's rows by chunk
without a shuffle. A chunk sends its distinct keys, ordered, to the buckets of the key space, and gets
back one mark for each. Keys that occur often in a chunk are sent once, so a key that a third of
all documents share costs one entry for each chunk.

The key space has FAN ** levels buckets, as many as the bytes of text ask for, yet a chunk writes at most FAN rows
of a kind: a row holds the entries of one FANth of the key space. With more than one level, relays take the rows of FAN
chunks for one part, turn them by the next digit of the bucket, and pass on FAN rows again; marks come
back the same way. So rows grow in proportion to the texts, whatever their size, and no task holds
more than a relay's FAN rows or a bucket's entries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, shared_path, table_name, written

#: Bytes of text in a chunk, of all texts for each bucket of the key space, and in a task's share of the table, about.
CHUNK_BYTES, BUCKET_BYTES, TASK_BYTES = 4 << 20, 16 << 20, 256 << 20
#: Bits of a digit of the bucket number: rows of a kind that a chunk or a relay writes are at most 2 ** FAN_BITS.
FAN_BITS = 6
SENT = "sender long, kind int, path long, body binary"
_FIELDS = [("sender", pa.int64()), ("kind", pa.int32()), ("path", pa.int64()), ("body", pa.binary())]


def _enc(parts: dict[int, bytes]) -> bytes:
    """Numbered bodies in one."""
    heads = np.array([(k, len(v)) for k, v in parts.items()], "<u4").reshape(-1, 2)
    return np.uint32(len(parts)).tobytes() + heads.tobytes() + b"".join(parts.values())


def _dec(body: bytes) -> dict[int, bytes]:
    n = int(np.frombuffer(body, "<u4", 1)[0])
    heads, at, out = np.frombuffer(body, "<u4", 2 * n, 4).reshape(n, 2).tolist(), 4 + 8 * n, {}
    for k, size in heads:
        out[k] = body[at : at + size]
        at += size
    return out


def _table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(_FIELDS)
    return pa.table([pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS, strict=True)], names=[n for n, _ in _FIELDS])


class Space:
    """The buckets of the key space: 2 ** bits to the power of levels; a bucket is a key's first bits * levels bits."""

    def __init__(self, total: int, bits: int, bucket_bytes: int):
        self.bits, self.levels = bits, 1
        while total > bucket_bytes << (bits * self.levels):
            self.levels += 1

    def rows(self, chunk: int, parts: Iterable[tuple[int, int, bytes]]) -> list[tuple]:
        """SENT rows of a chunk for (kind, bucket, body)."""
        rest = self.bits * (self.levels - 1)
        grouped: dict[tuple[int, int], dict[int, bytes]] = {}
        for kind, bucket, body in parts:
            grouped.setdefault((kind, bucket >> rest), {})[bucket & ((1 << rest) - 1)] = body
        return [(chunk, kind, digit, _enc(own) if rest else own[0]) for (kind, digit), own in grouped.items()]

    def found(self, kinds: list[int], paths: list[int], bodies: list[bytes]) -> dict[tuple[int, int], bytes]:
        """Bodies that came back to a chunk, by kind and bucket."""
        rest = self.bits * (self.levels - 1)
        out = {}
        for kind, digit, body in zip(kinds, paths, bodies, strict=True):
            for sub, own in (_dec(body) if rest else {0: body}).items():
                out[kind, digit << rest | sub] = own
        return out

    def lift(self, level: int) -> Callable[[pa.Table], pa.Table]:
        """A relay: rows of up to 2 ** bits senders for a path of `level` digits become rows of one sender for paths of one more."""
        left, fan = self.bits * (self.levels - level - 1), (1 << self.bits) - 1

        def run(rows: pa.Table) -> pa.Table:
            senders, kind, path = rows["sender"].to_pylist(), rows["kind"][0].as_py(), rows["path"][0].as_py()
            turned: dict[int, dict[int, dict[int, bytes]]] = {}
            for sender, body in sorted(zip(senders, rows["body"].to_pylist(), strict=True)):
                for rest, own in _dec(body).items():
                    turned.setdefault(rest >> left, {}).setdefault(rest & ((1 << left) - 1), {})[sender & fan] = own
            told = {d: {r: _enc(x) for r, x in own.items()} for d, own in turned.items()}
            return _table([(senders[0] >> self.bits, kind, path << self.bits | d, _enc(own) if left else own[0]) for d, own in told.items()])

        return run

    def lower(self, level: int) -> Callable[[pa.Table], pa.Table]:
        """The way back: rows of one sender for paths of `level` + 1 digits become rows of its senders for the path of `level`."""
        left, fan = self.bits * (self.levels - level - 1), (1 << self.bits) - 1

        def run(rows: pa.Table) -> pa.Table:
            group, kind, paths = rows["sender"][0].as_py(), rows["kind"][0].as_py(), rows["path"].to_pylist()
            turned: dict[int, dict[int, bytes]] = {}
            for path, body in zip(paths, rows["body"].to_pylist(), strict=True):
                for rest, own in (_dec(body) if left else {0: body}).items():
                    for sender, leaf in _dec(own).items():
                        turned.setdefault(sender, {})[(path & fan) << left | rest] = leaf
            return _table([(group << self.bits | s, kind, paths[0] >> self.bits, _enc(own)) for s, own in turned.items()])

        return run

    def leaves(self, body: bytes, depth: int | None = None) -> list[bytes]:
        """The chunks' bodies in a body that has reached its bucket."""
        depth = self.levels - 1 if depth is None else depth
        return [leaf for own in _dec(body).values() for leaf in self.leaves(own, depth - 1)] if depth else [body]

    def like(self, body: bytes, leaves: Iterator[bytes], depth: int | None = None) -> bytes:
        """A body of the same build, with other leaves."""
        depth = self.levels - 1 if depth is None else depth
        return _enc({k: self.like(own, leaves, depth - 1) for k, own in _dec(body).items()}) if depth else next(leaves)


class Chunks:
    """The bucketed table: chunk, row (a number of its own for every row), doc_id, text as bytes, and kept columns."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = False):
        spark = docs.sparkSession
        total = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
        most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
        self.tasks = max(partitions(spark), -(-total // TASK_BYTES))
        deal, count = min(most, self.tasks), max(1, -(-total // CHUNK_BYTES))
        self.space = Space(total, FAN_BITS, BUCKET_BYTES)
        rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("binary"), F.lit(b"")).alias("text"), *([F.struct(*[docs[c] for c in docs.columns]).alias("own")] if keep else []))
        if keep:
            rows = rows.withColumn("own", F.col("own").dropFields(text_col) if len(docs.columns) > 1 else F.lit(None).cast("int"))
        rows = rows.withColumn("row", F.monotonically_increasing_id())
        rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text", "row"), F.lit(count)).cast("int"))
        path = shared_path(spark, "chunks", as_table=True)
        name = table_name(path)
        rows.repartition(deal, "chunk").write.option("path", path).option("compression", "zstd").bucketBy(deal, "chunk").saveAsTable(name)
        self.rows = spark.table(name)

    def send(self, look: Callable[[pa.Table, dict], Iterable[tuple[int, int, bytes]]], masks: DataFrame | None = None) -> DataFrame:
        """SENT rows: the (kind, bucket, body) that look() makes of each chunk's rows, in their order, and its marks so far."""
        space = self.space

        def table(rows: pa.Table, marks: dict) -> pa.Table:
            return _table(space.rows(rows["chunk"][0].as_py(), look(rows.sort_by("row"), marks)) if rows.num_rows else [])

        return self._grouped(table, masks, SENT)

    def finish(self, look: Callable[[pa.Table, dict], pa.Table], masks: DataFrame, schema: str) -> DataFrame:
        """Rows of look() over each chunk."""
        return self._grouped(lambda rows, marks: look(rows.sort_by("row"), marks), masks, schema)

    def _grouped(self, run: Callable[[pa.Table, dict], pa.Table], masks: DataFrame | None, schema: str) -> DataFrame:
        space = self.space
        if masks is None:
            slim = self.rows.select("chunk", "row", "text")
            return slim.groupBy("chunk").applyInArrow(lambda rows: run(rows, {}), schema)

        def both(rows: pa.Table, marks: pa.Table) -> pa.Table:
            return run(rows, space.found(marks["kind"].to_pylist(), marks["path"].to_pylist(), marks["body"].to_pylist()))

        back = masks.withColumn("chunk", F.col("sender").cast("int"))
        return self.rows.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(both, schema)

    def _dealt(self, df: DataFrame, *keys: str) -> DataFrame:
        """df dealt by keys over tasks of a bounded share, where Spark's own number of them would be too small."""
        return df.repartition(self.tasks, *keys) if self.tasks > partitions(df.sparkSession) else df

    def collect(self, sent: DataFrame, resolve: Callable[[int, list[bytes]], list[bytes]], name: str) -> DataFrame:
        """SENT rows back at the chunks: the marks that resolve(kind, bodies) gives for the bodies of one kind and bucket, one for one."""
        space = self.space

        def run(rows: pa.Table) -> pa.Table:
            bodies = rows["body"].to_pylist()
            marks = iter(resolve(rows["kind"][0].as_py(), [leaf for b in bodies for leaf in space.leaves(b)]))
            return pa.table([rows["sender"], rows["kind"], rows["path"], pa.array([space.like(b, marks) for b in bodies], pa.binary())], names=[n for n, _ in _FIELDS])

        for level in range(1, space.levels):
            group = F.shiftright("sender", space.bits)
            sent = self._dealt(sent.withColumn("part", group), "kind", "path", "part").groupBy("kind", "path", "part").applyInArrow(space.lift(level), SENT)
        marks = self._dealt(sent, "kind", "path").groupBy("kind", "path").applyInArrow(run, SENT)
        for level in range(space.levels - 1, 0, -1):
            parent = F.shiftright("path", space.bits)
            marks = self._dealt(marks.withColumn("part", parent), "kind", "part", "sender").groupBy("kind", "part", "sender").applyInArrow(space.lower(level), SENT)
        return written(marks, name)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Keys:
    """A chunk's distinct keys in order, and where the buckets' shares of them begin; `more` has 64 further bits of each key."""

    def __init__(self, keys: np.ndarray, space: Space, more: np.ndarray | None = None):
        if more is not None:
            both = np.empty(len(keys), [("a", np.uint64), ("b", np.uint64)])
            both["a"], both["b"] = keys, more
            keys = both
        self.keys, self.inverse, self.counts = np.unique(keys, return_inverse=True, return_counts=True)
        first = self.keys["a"] if more is not None else self.keys
        bucket = (first >> np.uint64(64 - space.bits * space.levels)).astype(np.int64)
        starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(bucket)), bool), bucket[1:] != bucket[:-1])))
        self.buckets, self.cuts = bucket[starts].tolist(), [*starts.tolist(), len(bucket)]
        self.bucket = bucket

    def split(self, kind: int, entries: np.ndarray) -> Iterable[tuple[int, int, bytes]]:
        """entries, one for each distinct key, as bodies by bucket."""
        for bucket, at, to in zip(self.buckets, self.cuts[:-1], self.cuts[1:], strict=True):
            yield kind, bucket, entries[at:to].tobytes()

    def marks(self, kind: int, found: dict, kinds: str = "?") -> np.ndarray:
        """The marks of all distinct keys, put together again: truth values packed to bits, or numbers."""
        out = np.zeros(len(self.keys), bool if kinds == "?" else kinds)
        for bucket, at, to in zip(self.buckets, self.cuts[:-1], self.cuts[1:], strict=True):
            data = np.frombuffer(found[kind, bucket], np.uint8)
            out[at:to] = np.unpackbits(data, count=to - at).astype(bool) if kinds == "?" else data.view(kinds)
        return out


#: An entry of a key of 128 bits, the last of which is a flag.
WIDE = np.dtype([("a", "<u8"), ("b", "<u8")])


def flagged(keys: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Entries of wide keys whose last bit is the flag."""
    out = keys.astype(WIDE)
    out["b"] |= flags.astype(np.uint64)
    return out


def flags(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys without the flag, flags) of wide entries."""
    keys = entries.copy()
    keys["b"] &= ~np.uint64(1)
    return keys, (entries["b"] & np.uint64(1)).astype(np.int64)


def pooled(bodies: list[bytes], kind: str | np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All entries of some bodies in one array, and the edges between the bodies."""
    edges = np.cumsum([0] + [len(b) // np.dtype(kind).itemsize for b in bodies])
    return np.frombuffer(b"".join(bodies), kind), edges


def packed(marks: np.ndarray, edges: np.ndarray) -> list[bytes]:
    return [np.packbits(marks[a:b]).tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def repeated(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each key the sum of weights over its equals; with the order and the group number used."""
    order = np.lexsort((keys["b"], keys["a"])) if keys.dtype.names else np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(keys) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    sums = np.bincount(group, weights[order]) if len(keys) else np.zeros(0)
    out = np.empty(len(keys), np.int64)
    out[order] = sums[group].astype(np.int64)
    which = np.empty(len(keys), np.int64)
    which[order] = group
    return out, order, which


def covered(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Truth values for n places: those within `length` from one of the starts on."""
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + length, n), -1)
    return np.cumsum(change[:n]) > 0
