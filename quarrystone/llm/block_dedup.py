"""Substring deduplication with fixed-block anchors.

Non-overlapping blocks of BLOCK words are the index; every rolling window of as many words is a
probe. A repeated passage of at least 2 * BLOCK - 1 words contains a whole block of each of its copies,
which the other copies' rolling windows hit. Hits are extended to maximal exact repeats window by window: around
the hits, and only there, each window of full length asks whether its word sequence occurs anywhere else, told apart
by 127 bits of two independent hashes, and the windows that do are merged into maximal runs. The texts of two
copies never meet in one task, so a passage in a third of all documents makes no pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .chunked import WIDE, Chunks, Keys, Space, covered, flagged, flags, mix, packed, pooled, repeated

WINDOW = 35
_STEP, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


class _Words:
    """The words of a chunk in one row, their documents' edges, and hashes of all windows of `block` words."""

    def __init__(self, texts: list[bytes], block: int, window: int, both: bool = True):
        self.words = [t.split() for t in texts]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.edges = np.concatenate(([0], np.cumsum(self.sizes)))
        n = int(self.edges[-1])
        h = xxhash.xxh3_64_intdigest
        ids = np.fromiter((h(x) for w in self.words for x in w), np.uint64, n)
        full = max(0, n - block + 1)
        rolled = np.zeros(full, np.uint64)
        for k in range(block):
            rolled = rolled * _STEP + ids[k : k + full]
        self.rolled, self.second = mix(rolled), None
        if both:
            again = np.zeros(full, np.uint64)
            for k in range(block):
                again = again * _OTHER + mix(ids[k : k + full])
            self.second = mix(again)
        place = np.arange(n) - np.repeat(self.edges[:-1], self.sizes)
        rest = np.repeat(self.sizes, self.sizes) - place
        self.probes = np.flatnonzero(rest >= block)
        self.is_block = place[self.probes] % block == 0
        self.long = rest >= window  # windows of full length start here


def _first(block: int, space: Space):
    def look(rows: pa.Table, _: dict):
        words = _Words(rows["text"].to_pylist(), block, block, both=False)
        keys = Keys(words.rolled[words.probes], space)
        anchor = np.bincount(keys.inverse, words.is_block, len(keys.keys)) > 0
        low = (keys.keys & np.uint64((1 << 30) - 1)).astype(np.uint32)
        yield from keys.split(0, low << np.uint32(2) | anchor.astype(np.uint32) << np.uint32(1) | (keys.counts > 1).astype(np.uint32))

    return look


def _candidates(words: _Words, found: dict, block: int, window: int, space: Space) -> tuple[np.ndarray, Keys]:
    """Starts of full windows with a hit inside, and their keys: of the blocks' worth of words that cover them."""
    keys = Keys(words.rolled[words.probes], space)
    hits = words.probes[keys.marks(0, found)[keys.inverse]]
    near = covered(len(words.long), np.maximum(hits - (window - block), 0), window - block + 1)
    starts = np.flatnonzero(near & words.long)
    whole, second = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
    for at in [*range(0, window - block, block), window - block]:
        whole = mix(whole * _STEP + words.rolled[starts + at])
        second = mix(second * _OTHER + words.second[starts + at])
    return starts, Keys(whole, space, second & ~np.uint64(1))


def _second(block: int, window: int, space: Space):
    def look(rows: pa.Table, found: dict):
        _, keys = _candidates(_Words(rows["text"].to_pylist(), block, window), found, block, window, space)
        yield from keys.split(1, flagged(keys.keys, keys.counts > 1))

    return look


def _resolve(kind: int, bodies: list[bytes]) -> list[bytes]:
    if kind == 0:
        entries, edges = pooled(bodies, "<u4")
        total, _, which = repeated(entries >> np.uint32(2), 1 + (entries & np.uint32(1)).astype(np.int64))
        anchored = np.bincount(which, entries >> np.uint32(1) & np.uint32(1)) > 0 if len(entries) else np.zeros(0, bool)
        return packed((total > 1) & anchored[which], edges)
    entries, edges = pooled(bodies, WIDE)
    keys, many = flags(entries)
    total, _, _ = repeated(keys, 1 + many)
    return packed(total > 1, edges)


def marked(docs: DataFrame, window: int = WINDOW, text_col: str = "text", id_col: str = "doc_id", keep_words: bool = False) -> DataFrame:
    """A row for each document: doc_id, n_words, n_removed, kept_sha256, and the kept words' text if asked for.

    Every word is removed that a window of `window` words covers whose word sequence also starts
    anywhere else, in the same document too; the input is judged, not what is left. Words are bytes
    between ASCII white space, compared as they are. Null and empty texts have none. Repeated rows are
    documents of their own. Null ids stay null. No rows give none.
    """
    block = (window + 1) // 2
    chunks = Chunks(docs, id_col, text_col)
    space = chunks.space
    hits = chunks.collect(chunks.send(_first(block, space)), _resolve, "hits")
    marks = chunks.collect(chunks.send(_second(block, window, space), hits), _resolve, "marks")

    def look(rows: pa.Table, found: dict) -> pa.Table:
        words = _Words(rows["text"].to_pylist(), block, window)
        starts, keys = _candidates(words, found, block, window, space)
        gone = covered(len(words.long), starts[keys.marks(1, found)[keys.inverse]], window)
        removed = np.add.reduceat(np.concatenate((gone, [0])), words.edges[:-1]) * (words.sizes > 0) if len(words.sizes) else []
        kept, digests = [], []
        for own, a, b, k in zip(words.words, words.edges[:-1].tolist(), words.edges[1:].tolist(), removed, strict=True):
            text = b" ".join(own if not k else [w for w, g in zip(own, gone[a:b].tolist(), strict=True) if not g])
            digests.append(hashlib.sha256(text).hexdigest())
            kept.append(text.decode() if keep_words else None)
        columns = {"doc_id": rows["doc_id"], "n_words": pa.array(words.sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        return pa.table(columns | ({"kept_text": pa.array(kept, pa.string())} if keep_words else {}))

    return chunks.finish(look, hits.unionByName(marks), RESULT + ", kept_text string" * keep_words)
