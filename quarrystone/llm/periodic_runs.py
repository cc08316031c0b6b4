"""Periodic runs in the words of documents: stretches that repeat themselves three times or more.

Candidates come from blocks. A text's words are cut into aligned blocks of 8, 16, 32, ... words, an automaton of the
distinct blocks of one size, as keys of eight integers, is searched across the text, and a block found again at a distance that fits its size
(B to 2B - 1; from 1 for blocks of 8) is the seed of a period. A run of period q and a length of max(24, 3q) or more holds a whole
aligned block of the largest size not above q, and the block's copy q words on, so no run lacks a seed. A seed is
extended word by word to both sides as long as words q apart are equal; what comes out is exact.

Only words inside a stretch of 16 words that occurs twice in the text can be in a run, and only those are searched.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import spread
from .chunked import covered, mix
from .common import small_batches, texts

#: A run has this many words and this many periods at least; GRAM words of every run occur twice.
MIN_WORDS, MIN_PERIODS, GRAM = 24, 3, 16
#: Parts of a block, which are words in the smallest blocks, and blocks in one automaton.
PARTS, KEYS = 8, 1 << 16
#: Places at which a seed is probed on either side before it is extended.
PROBES = 8
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RESULT = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, text string"
_STEP = np.uint64(0x9E3779B97F4A7C15)

Run = tuple[int, int, int]


def _repeating(words: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, end) of the longest stretches made of windows of GRAM words whose hash occurs twice."""
    full = len(words) - GRAM + 1
    if full < 2:
        return
    rolled = np.zeros(full, np.uint64)
    for k in range(GRAM):
        rolled = rolled * _STEP + words[k : k + full].astype(np.uint64)
    _, inverse, times = np.unique(mix(rolled), return_inverse=True, return_counts=True)
    starts = np.flatnonzero(times[inverse] > 1)
    if len(starts):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], covered(len(words), starts, GRAM).astype(np.int8), [0]))))
        yield from ((a, b) for a, b in edges.reshape(-1, 2).tolist() if b - a >= MIN_WORDS)


def _doubled(names: np.ndarray, size: int) -> np.ndarray:
    """Names of all windows of 2 * size words, from those of size: equal names are equal words."""
    left, right = names[: max(0, len(names) - size)], names[size:]
    return np.unique(left * (int(names.max(initial=0)) + 1) + right, return_inverse=True)[1]


def _occurrences(names: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, blocks, numbers): where aligned blocks occur, which ones, and the number of each aligned block.

    names has the name of every window of `step` words; a block is a key of PARTS of them, `step` apart. So keys stay
    short at every size, and the automaton's way back from a mismatch is short in periodic text too.
    """
    own, numbers = [], {}
    aligned = names[::step].tolist()
    for at in range(0, len(aligned) - PARTS + 1, PARTS):
        own.append(numbers.setdefault(tuple(aligned[at : at + PARTS]), len(numbers)))
    none = int(names.max(initial=0)) + 1
    lanes = [np.append(names[k::step], none) for k in range(step)]
    sequence, edges = tuple(np.concatenate(lanes).tolist()), np.cumsum([0, *map(len, lanes)])
    keys, found = list(numbers), []
    for first in range(0, len(keys), KEYS):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for key in keys[first : first + KEYS]:
            automaton.add_word(key, numbers[key])
        automaton.make_automaton()
        found.append(np.array(list(automaton.iter(sequence)), np.int64).reshape(-1, 2))
    ends, blocks = np.concatenate(found).T
    lane = np.searchsorted(edges, ends, "right") - 1
    return lane + (ends - edges[lane] - PARTS + 1) * step, blocks, np.array(own, np.int64)


def _seeds(words: np.ndarray, names: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(start of an aligned block, distance of a copy that fits the size), by distance and start."""
    size = PARTS * step
    places, blocks, own = _occurrences(names, step)
    starts, copies = [], []
    for back in (0, 1) if step == 1 else (1,):
        start = (places // size - back) * size
        fits = (start >= 0) & (start < places)
        fits[fits] = own[start[fits] // size] == blocks[fits]
        starts.append(start[fits])
        copies.append(places[fits])
    start = np.concatenate(starts)
    distance = np.concatenate(copies) - start
    able = _probed(words, start, distance)
    start, distance = start[able], distance[able]
    order = np.lexsort((start, distance))
    return start[order], distance[order]


def _probed(words: np.ndarray, start: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Whether a run may go on for a period to the right or the left of its seed, as one of three periods does."""
    n, sides = len(words), []
    for left in (0, 1):
        same = np.ones(len(start), bool)
        for t in range(PROBES):
            at = start - left * distance + distance * t // PROBES
            inside = (at >= 0) & (at + distance < n)
            same &= inside
            same[inside] &= words[at[inside]] == words[at[inside] + distance[inside]]
        sides.append(same)
    return sides[0] | sides[1]


def _within(runs: list[Run], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether a run contains [start, end)."""
    if not runs:
        return np.zeros(len(start), bool)
    known = np.array(sorted((s, s + n) for s, n, _ in runs), np.int64)
    furthest = np.maximum.accumulate(known[:, 1])
    place = np.searchsorted(known[:, 0], start, "right") - 1
    return (place >= 0) & (furthest[np.maximum(place, 0)] >= end)


def _agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements of a and b are equal from the first on."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        unlike = np.flatnonzero(a[at : at + step][: n - at] != b[at : at + step][: n - at])
        if len(unlike):
            return at + int(unlike[0])
        at, step = min(n, at + step), 2 * step
    return n


def _extended(words: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """(start, end) of the longest stretch around `at` whose words a period apart are equal."""
    right = at + _agreeing(words[at:], words[at + period :])
    left = at - _agreeing(words[:at][::-1], words[: at + period][::-1])
    return left, right + period


def _smallest(words: np.ndarray, start: int, period: int) -> bool:
    """Whether no divisor of the period is a period too."""
    rest, factor = period, 2
    while rest > 1:
        if factor * factor > rest:
            factor = rest
        if rest % factor == 0:
            less = period // factor
            if np.array_equal(words[start : start + period - less], words[start + less : start + period]):
                return False
            while rest % factor == 0:
                rest //= factor
        factor += 1
    return True


def find_runs(words: np.ndarray) -> list[Run]:
    """(start, length, period) of every run of a sequence of integers, by start and period."""
    out: list[Run] = []
    for first, last in _repeating(words):
        part, runs, step = words[first:last], [], 1
        names = part
        while MIN_PERIODS * PARTS * step <= len(part):
            size = PARTS * step
            start, distance = _seeds(part, names, step)
            # what lies in a run of a period up to the block's size has that period itself, not a new one
            new = ~_within(runs, start, start + distance + size)
            end, before = 0, 0
            for at, period in zip(start[new].tolist(), distance[new].tolist(), strict=True):
                if period != before:
                    end, before = 0, period
                if at + period + size <= end:
                    continue
                if step == 1 and any(s <= at and at + period + size <= s + n for s, n, q in runs if q <= size):
                    continue
                left, end = _extended(part, at, period)
                if end - left >= max(MIN_WORDS, MIN_PERIODS * period) and _smallest(part, left, period):
                    runs.append((left, end - left, period))
            names, step = _doubled(names, step), 2 * step
        out += [(first + s, n, q) for s, n, q in runs]
    return sorted(out, key=lambda r: (r[0], r[2]))


def repeated_words(n: int, runs: list[Run]) -> np.ndarray:
    """Which of n words a run contains after its first period."""
    steps = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return np.cumsum(steps[:-1]) > 0


def planted_period(doc_id: int | None, n: int) -> np.ndarray | None:
    """For a tenth of ids: which of a text's n words stands at each place when its end repeats one period; else None."""
    mark = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if mark % 10 or not n:
        return None
    chosen = mark // 10
    first = chosen % n
    period = 1 + (n - first) // (3 + chosen % 8)
    return np.concatenate((np.arange(first), first + np.arange(n - first) % period))


def detect(docs: DataFrame, arrange: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """doc_id, n_words, all runs, and the text without what repeats in them, for every row of docs.

    `arrange` may put other words of a text in its places first. The text is the kept words, joined by one space.
    Null and empty texts have no words and no runs, and become empty; null ids stay null and are never arranged. Repeated
    rows are judged each. A text is worked on as a whole in one task, however long; other columns are not read.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in texts(batches):
            ids, counts, found, kept = batch.column(0).to_pylist(), [], [], []
            for doc_id, value in zip(ids, values, strict=True):
                words, numbers = value.split(), {}
                own = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
                places = arrange(doc_id, len(words)) if arrange else None
                if places is not None:
                    own, words = own[places], [words[i] for i in places.tolist()]
                runs = find_runs(own)
                if runs:
                    words = [words[i] for i in np.flatnonzero(~repeated_words(len(words), runs)).tolist()]
                counts.append(len(own))
                found.append(runs)
                kept.append(b" ".join(words).decode())
            flat = np.array([r for runs in found for r in runs], np.int64).reshape(-1, 3)
            edges = np.cumsum([0, *map(len, found)])
            runs = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays([pa.array(c) for c in flat.T], fields=list(RUN)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), runs, pa.array(kept, pa.string())], ["doc_id", "n_words", "runs", "text"])

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", "text").mapInArrow(run, RESULT)


def digests(found: DataFrame) -> DataFrame:
    """Of detect()'s rows: the number of runs, the run of most periods (first start, then smaller period), and digests."""
    unlike = lambda a, b: b["length"] * a["period"] - a["length"] * b["period"]  # noqa: E731  exact fractions
    better = lambda a, b: (unlike(a, b) < 0) | ((unlike(a, b) == 0) & ((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["period"] < b["period"]))))
    best = F.aggregate("runs", F.element_at("runs", 1), lambda a, x: F.when(better(x, a), x).otherwise(a))
    top = F.when(F.size("runs") > 0, best)
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
    return rows.select(
        "doc_id", "n_runs", "top.start", "top.length", "top.period", F.expr("1000 * top.length div top.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
