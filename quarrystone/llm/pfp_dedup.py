"""Repeated byte strings over a whole corpus, by prefix-free parsing.

A rolling hash triggers phrase ends: an end is placed where the hash of the next bytes is the least of
a stretch, so equal strings are cut alike and a phrase has at most REACH bytes. A string of WINDOW
bytes belongs to the first least place in it; what stands before that place in the string is a suffix of
a phrase (of the dictionary), what follows is a prefix of the phrases to come (of the parse).

Strings whose following bytes occur once cannot repeat and go no further. The others meet by
those bytes: there the following bytes are sorted with their longest common prefixes (the suffix
array of the parse, as deep as a window), the phrase suffixes get their classes byte by byte (that of
the dictionary), and the two together give the corpus order: windows are equal if their suffix
class and their interval of the parse order are. A place that very many rows share is split into
keys of single windows instead, 127 bits of a hash of each, so its work and that of its rows stay bounded.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunked import WIDE, Chunks, Keys, Space, covered, flagged, flags, mix, packed, pooled, repeated

WINDOW = 400
#: Bytes hashed at a place to compare it with others.
GRAM = 12
#: Rows beyond which a place is split into single windows.
HOT = 4096
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_h = xxhash.xxh3_64_intdigest
_wide = xxhash.xxh3_128_digest


def _least(values: np.ndarray, reach: int) -> np.ndarray:
    """For each place the least of `reach` values from it on."""
    n = len(values)
    padded = np.full(-(-n // reach) * reach + reach, np.iinfo(np.int64).max)
    padded[:n] = values
    blocks = padded.reshape(-1, reach)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    behind = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    return np.minimum(ahead[:n], behind[reach - 1 : n + reach - 1])


class _Parse:
    """A chunk's texts in one buffer and its rows: runs of windows (first, last) that share a place."""

    def __init__(self, texts: list[bytes], window: int):
        self.reach = window // 2
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.edges = np.concatenate(([0], np.cumsum(self.sizes)))
        self.text = b"".join(texts)
        n, gram = len(self.text), min(GRAM, window - self.reach)
        padded = np.frombuffer(self.text + bytes(16), np.uint8)
        grams = np.zeros(n, np.uint64)
        for k in range(gram):
            grams = grams * np.uint64(0x100000001B3) + padded[k : k + n]
        place = np.arange(n)
        least = _least((mix(grams) >> np.uint64(33)).astype(np.int64) << np.int64(32) | place, self.reach) & np.int64(0xFFFFFFFF)
        starts = np.concatenate([np.arange(a, b - window + 1) for a, b in zip(self.edges[:-1].tolist(), self.edges[1:].tolist(), strict=True)] or [place[:0]])
        own = least[starts]
        new = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)))) if len(starts) else place[:0]
        self.place, self.first = own[new], starts[new]
        self.last = starts[np.concatenate((new[1:], [len(starts)])) - 1] if len(starts) else place[:0]

    def keys(self, window: int, space: Space) -> Keys:
        """Of the bytes that follow each row's place and lie in all its windows."""
        deep = window - self.reach + 1
        return Keys(np.array([_h(self.text[p : p + deep]) for p in self.place.tolist()], np.uint64), space)


def _entries(parse: _Parse, keys: Keys) -> np.ndarray:
    low = (keys.keys & np.uint64((1 << 24) - 1)).astype(np.uint32)
    return low << np.uint32(8) | np.minimum(keys.counts, 255).astype(np.uint32)


def _rows(parse: _Parse, keys: Keys, found: dict, window: int, space: Space):
    """The rows that go on: which, in key order and once for equal bytes, and the hot windows' keys."""
    state = keys.marks(0, found, "u1")[keys.inverse]
    cold, hot = np.flatnonzero(state == 1), np.flatnonzero(state == 2)
    text, first, last, place = parse.text, parse.first, parse.last, parse.place
    bodies: dict[tuple, int] = {}
    slot = np.empty(len(cold), np.int64)
    for i, r in enumerate(cold.tolist()):
        slot[i] = bodies.setdefault((int(keys.inverse[r]), int(place[r] - first[r]), text[first[r] : last[r] + window]), len(bodies))
    times = np.bincount(slot, minlength=len(bodies))
    windows = np.concatenate([np.arange(first[r], last[r] + 1) for r in hot.tolist()] or [first[:0]])
    wide = np.array([_wide(text[i : i + window]) for i in windows.tolist()], "S16").view(WIDE) if len(windows) else np.zeros(0, WIDE)
    single = Keys(wide["a"], space, wide["b"] & ~np.uint64(1))
    return cold, list(bodies), slot, times, windows, single


def _bucketed(bodies: list[tuple], keys: Keys) -> list[tuple[int, np.ndarray]]:
    """(bucket, numbers of the bodies whose key is in it)."""
    bucket = keys.bucket[np.array([b[0] for b in bodies], np.int64)]
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    return [(int(bucket[part[0]]), part) for part in np.split(order, cuts) if len(part)]


def _first(window: int, space: Space):
    def look(rows: pa.Table, _: dict):
        parse = _Parse(rows["text"].to_pylist(), window)
        keys = parse.keys(window, space)
        yield from keys.split(0, _entries(parse, keys))

    return look


def _second(window: int, space: Space):
    def look(rows: pa.Table, found: dict):
        parse = _Parse(rows["text"].to_pylist(), window)
        keys = parse.keys(window, space)
        _, bodies, _, times, _, single = _rows(parse, keys, found, window, space)
        for bucket, part in _bucketed(bodies, keys):
            heads = np.array([(bodies[i][1], len(bodies[i][2]), times[i] > 1) for i in part], "<u4")
            yield 1, bucket, np.uint32(len(part)).tobytes() + heads.tobytes() + b"".join([bodies[i][2] for i in part])
        yield from single.split(2, flagged(single.keys, single.counts > 1))

    return look


def repeats(texts: list[bytes], before: np.ndarray, many: np.ndarray, window: int) -> list[np.ndarray]:
    """For each text, which of its windows occur again at the same distance from a place: truth values.

    before: bytes of each text before its place; many: whether the text itself occurs more than once.
    """
    n = len(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    count = sizes - window + 1  # windows; window w of a text starts `before - w` bytes ahead of the place
    out = np.repeat(many, count)
    at = np.concatenate(([0], np.cumsum(count)))[:-1]
    flat = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    after = np.zeros((n, window), np.uint8)  # the parse's side, padded
    for i, t in enumerate(texts):
        after[i, : sizes[i] - before[i]] = np.frombuffer(t, np.uint8, offset=before[i])
    order = np.argsort(after.view(f"S{window}").reshape(-1), kind="stable")
    common = np.full(n, -1, np.int64)  # with the one before in the order
    for a in range(1, n, 4096):
        b = min(n, a + 4096)
        differ = after[order[a:b]] != after[order[a - 1 : b - 1]]
        common[a:b] = np.where(differ.any(axis=1), differ.argmax(axis=1), window)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    suffix = np.zeros(n, np.int64)  # the dictionary's side: class of the last `length` bytes before the place
    rows = np.arange(n)
    for length in range(int(before.max(initial=0)) + 1):
        rows = rows[before[rows] >= length]
        if length:
            suffix[rows] = np.unique(suffix[rows] << np.int64(8) | flat[begin[rows] + before[rows] - length], return_inverse=True)[1]
        w = before[rows] - length
        now, w = rows[w < count[rows]], w[w < count[rows]]
        interval = np.cumsum(common < window - length)
        _, inverse, times = np.unique(suffix[now] * np.int64(n + 1) + interval[rank[now]], return_inverse=True, return_counts=True)
        out[at[now] + w] |= times[inverse] > 1
    return np.split(out, at[1:])


def _resolve(window: int, hot: int):
    def resolve(kind: int, bodies: list[bytes]) -> list[bytes]:
        if kind == 0:
            entries, edges = pooled(bodies, "<u4")
            total, _, _ = repeated(entries >> np.uint32(8), (entries & np.uint32(255)).astype(np.int64))
            marks = ((total > 1).astype(np.uint8) + (total > hot)).astype(np.uint8)
            return [marks[a:b].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        if kind == 2:
            entries, edges = pooled(bodies, WIDE)
            keys, many = flags(entries)
            total, _, _ = repeated(keys, 1 + many)
            return packed(total > 1, edges)
        texts, heads, cuts = [], [], [0]
        for body in bodies:
            n = int(np.frombuffer(body, "<u4", 1)[0])
            own = np.frombuffer(body, "<u4", 3 * n, 4).reshape(n, 3)
            at = 4 + 12 * n
            for size in own[:, 1].tolist():
                texts.append(body[at : at + size])
                at += size
            heads.append(own)
            cuts.append(len(texts))
        whole = np.concatenate(heads).astype(np.int64)
        marks = repeats(texts, whole[:, 0], whole[:, 2] > 0, window)
        return [np.packbits(np.concatenate(marks[a:b])).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    return resolve


def _repeated_starts(parse: _Parse, found: dict, window: int, space: Space) -> np.ndarray:
    keys = parse.keys(window, space)
    cold, bodies, slot, _, windows, single = _rows(parse, keys, found, window, space)
    starts = [windows[single.marks(2, found)[single.inverse]]]
    marks: list[np.ndarray] = [np.zeros(0, bool)] * len(bodies)
    for bucket, part in _bucketed(bodies, keys):
        counts = [len(bodies[i][2]) - window + 1 for i in part]
        bits = np.unpackbits(np.frombuffer(found[1, bucket], np.uint8), count=sum(counts)).astype(bool)
        for i, own in zip(part, np.split(bits, np.cumsum(counts)[:-1]), strict=True):
            marks[i] = own
    for r, s in zip(cold.tolist(), slot.tolist(), strict=True):
        starts.append(parse.first[r] + np.flatnonzero(marks[s]))
    return np.concatenate(starts)


def _marked(docs: DataFrame, window: int, keep: bool, id_col: str, text_col: str) -> DataFrame:
    chunks = Chunks(docs, id_col, text_col, keep)
    space, resolve = chunks.space, _resolve(window, HOT)
    places = chunks.collect(chunks.send(_first(window, space)), resolve, "places")
    marks = chunks.collect(chunks.send(_second(window, space), places), resolve, "marks")

    def look(rows: pa.Table, found: dict) -> pa.Table:
        texts = rows["text"].to_pylist()
        parse = _Parse(texts, window)
        gone = covered(len(parse.text), _repeated_starts(parse, found, window, space), window)
        removed, spans, digests, kept = [], [], [], []
        for text, a, b in zip(texts, parse.edges[:-1].tolist(), parse.edges[1:].tolist(), strict=True):
            own = gone[a:b]
            k = int(own.sum())
            rest = text if not k else np.frombuffer(text, np.uint8)[~own].tobytes()
            removed.append(k)
            spans.append(int(own[0]) + int((own[1:] & ~own[:-1]).sum()) if k else 0)
            digests.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest)
        if keep:
            return pa.table({"own": rows["own"], "kept": pa.array([x.decode(errors="ignore") for x in kept], pa.string()), "n_removed": pa.array(removed, pa.int64())})
        return pa.table({"doc_id": rows["doc_id"], "n_bytes": pa.array(parse.sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digests, pa.string())})

    schema = f"own {chunks.rows.schema['own'].dataType.simpleString()}, kept string, n_removed long" if keep else RESULT
    return chunks.finish(look, places.unionByName(marks), schema)


def marked(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row.

    Every byte is removed that a string of `window` bytes covers which starts anywhere else too, in
    the same document or another; strings don't cross documents, and the input is judged, not what is
    left. Null and empty texts have no bytes. Repeated rows are documents of their own. Null ids stay
    null. No rows give none.
    """
    return _marked(docs, window, False, id_col, text_col)


def stripped(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with what is left of their texts; a character that is cut in two goes, a null text becomes an empty one.

    `length_col`, where docs have it, becomes the code points of the text that is left.
    """
    left = _marked(docs, window, True, id_col, text_col)
    others = [F.col(f"own.`{c}`") for c in docs.columns if c != text_col]
    found = left.select(*others, F.col("kept").alias(text_col))
    if length_col in docs.columns:
        found = found.withColumn(length_col, F.char_length(text_col).cast(docs.schema[length_col].dataType))
    return found.select(*docs.columns)
