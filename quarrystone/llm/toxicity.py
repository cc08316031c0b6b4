"""Toxicity by a support vector machine on a subsequence string kernel with Nystroem landmarks.

The kernel of two words counts their common subsequences of ORDER letters, each discounted by DECAY for
every letter that it spans, so gaps and inserted letters lower a match but don't lose it. A sentence is
the sum of its words (a convolution kernel); letters alone count, and letters set apart one by one
are read as a word. Landmarks are short strings from the training sentences; the Nystroem map makes the
kernel a vector, on which a linear machine is trained. Because documents bear the labels, a toxic
document stands for its most toxic sentence (multiple-instance training), and copies of these with
inserted letters are added. A document scores as its most toxic sentence, calibrated to a probability.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import spread
from .common import small_batches, texts

ORDER, DECAY = 3, 0.6
#: Powers of the kernel that are added up: the low one is tolerant, the high one strict.
POWERS = (3, 12)
#: Bounds of the training sample: documents of either class, and bytes of one; and of the landmarks.
TOXIC_DOCS, CLEAN_DOCS, DOC_BYTES = 1000, 1500, 6144
LANDMARKS, PLAIN_LANDMARKS = 26, 4
#: Landmarks that should find each toxic document.
COVER = 3
SHORTEST, LONGEST = 4, 8
#: Letters of a word that are compared at once; longer words are read in overlapping parts.
SPAN = 12
#: Words of a sentence that are read at once; a longer one is read in pieces.
SENTENCE = 32
MEMO = 600_000
_LETTERS = re.compile(r"[\W\d_]+")
_END = "\x00"


def _common(same: Callable[[int, int], np.ndarray], size: int, width: int, shape: tuple[int, int], order: int, decay: float) -> np.ndarray:
    """Discounted common subsequences of pairs of strings of `size` and up to `width` letters; same(i, j): where their letters agree."""
    step, square = np.float32(decay), np.float32(decay * decay)
    # before[i][j]: subsequences of i letters in the first string so far and the second up to j, discounted to both ends
    before = [[np.ones(shape, np.float32)] * (width + 1)] + [[np.zeros(shape, np.float32) for _ in range(width + 1)] for _ in range(order - 1)]
    total = np.zeros(shape, np.float32)
    for at in range(size):
        now = [same(at, j) for j in range(width)]
        for j in range(width):
            total += np.where(now[j], before[order - 1][j], 0) * square
        for i in range(order - 1, 0, -1):
            running = np.zeros(shape, np.float32)
            fresh = []
            for j in range(width):
                running = running * step + np.where(now[j], before[i - 1][j], 0) * square
                fresh.append(running)
            for j in range(width):
                before[i][j + 1] = before[i][j + 1] * step + fresh[j]
    return total


def _by_size(words: list[str], order: int, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers, letters) of words of one length and of at least `order` letters, some at once."""
    sizes = np.array([len(w) for w in words])
    for size in np.unique(sizes[sizes >= order]).tolist():
        of = np.flatnonzero(sizes == size)
        for part in np.array_split(of, -(-len(of) // rows)):
            yield part, np.array([[ord(c) for c in words[r]] for r in part.tolist()], np.int32)


def kernel(words: list[str], marks: list[str], order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """The subsequence kernel of each word with each mark, not normalised."""
    out = np.zeros((len(words), len(marks)))
    width = max(map(len, marks))
    codes = np.full((len(marks), width), -1, np.int32)
    for j, m in enumerate(marks):
        codes[j, : len(m)] = [ord(c) for c in m]
    for rows, own in _by_size(words, order, 2048):
        out[rows] = _common(lambda i, j, own=own: own[:, i, None] == codes[None, :, j], own.shape[1], width, (len(rows), len(marks)), order, decay)
    return out


def norms(words: list[str], order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """The kernel of each word with itself; 0 for those of fewer than `order` letters."""
    out = np.zeros(len(words))
    for rows, own in _by_size(words, order, 65_536):
        out[rows] = _common(lambda i, j, own=own: (own[:, i] == own[:, j])[:, None], own.shape[1], own.shape[1], (len(rows), 1), order, decay)[:, 0]
    return out


def normalised(words: list[str], marks: list[str], mark_norms: np.ndarray) -> np.ndarray:
    """The kernel of unit length, from 0 to 1: K(w, m) / sqrt(K(w, w) K(m, m))."""
    scale = np.sqrt(norms(words)[:, None] * mark_norms[None, :])
    return np.divide(kernel(words, marks), scale, out=np.zeros((len(words), len(marks))), where=scale > 0)


def features(words: list[str], marks: list[str], mark_norms: np.ndarray) -> np.ndarray:
    """Each word's normalised kernel with each landmark in all powers; a word longer than SPAN takes its parts' largest."""
    parts = [(i, p) for i, w in enumerate(words) for p in _parts(w)]
    ratio = normalised([p for _, p in parts], marks, mark_norms)
    if len(parts) > len(words):
        whole = np.zeros((len(words), len(marks)))
        np.maximum.at(whole, np.array([i for i, _ in parts]), ratio)
        ratio = whole
    return np.hstack([ratio**p for p in POWERS])


def tokens(text: str) -> list[str]:
    """Words of the lower-cased text, with an end mark after each sentence."""
    text = text.lower().replace("\n", f" {_END} ")
    for mark in ".!?":
        text = text.replace(mark + " ", f" {_END} ")
    return text.split()


def letters(token: str) -> str:
    return _LETTERS.sub("", token)


def _parts(word: str) -> list[str]:
    return [word] if len(word) <= SPAN else [word[i : i + SPAN] for i in range(0, len(word) - SPAN // 2, SPAN // 2)]


def _spelled(words: list[str], sizes: np.ndarray) -> list[tuple[int, str]]:
    """(place, word) of three or more letters that stand one by one."""
    ones = np.flatnonzero(sizes == 1)
    if len(ones) < 3:
        return []
    found = []
    for run in np.split(ones, np.flatnonzero(np.diff(ones) != 1) + 1):
        word = letters("".join(words[i] for i in run.tolist()))
        if len(word) >= ORDER:
            found.append((int(run[0]), word))
    return found


def _starts(n: int, ends: np.ndarray) -> np.ndarray:
    """Where sentences begin, of at most SENTENCE words each."""
    begins = np.concatenate(([0], ends))
    sizes = np.diff(np.concatenate((begins, [n])))
    if sizes.max() <= SENTENCE:
        return begins
    pieces = np.maximum(1, -(-sizes // SENTENCE))
    first = np.repeat(begins, pieces)
    return first + SENTENCE * (np.arange(len(first)) - np.repeat(np.cumsum(pieces) - pieces, pieces))


class Model:
    """Weights of landmarks, and of the calibration; scores whole texts."""

    def __init__(self, marks: list[str], weights: np.ndarray, bias: float, slope: float, shift: float):
        self.marks, self.weights, self.bias, self.slope, self.shift = marks, weights, bias, slope, shift
        self.norms = norms(marks) if marks else np.zeros(0)
        self.memo: dict[str, float] = {_END: float("nan")}
        self.cores: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": {_END: float("nan")}, "cores": {}}

    def _values(self, words: list[str]) -> None:
        new = sorted({w for w in words if w not in self.cores})
        if new:
            values = features(new, self.marks, self.norms) @ self.weights if self.marks else np.zeros(len(new))
            self.cores.update(zip(new, values.tolist(), strict=True))

    def _learn(self, lists: list[list[str]]) -> None:
        """Values of all words that the memo lacks, in one go."""
        if len(self.memo) > MEMO or len(self.cores) > MEMO:
            self.memo, self.cores = {_END: float("nan")}, {}
        new = {w: letters(w) for words in lists for w in words if w not in self.memo}
        self._values(list(new.values()))
        self.memo.update((w, self.cores[c]) for w, c in new.items())

    def _margin(self, words: list[str]) -> float:
        if not words:
            return self.bias
        values = np.fromiter(map(self.memo.__getitem__, words), np.float64, len(words))
        ends = np.flatnonzero(np.isnan(values))
        values[ends] = 0
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        sizes[ends] = 0
        for at, word in _spelled(words, sizes):
            self._values([word])
            values[at] += self.cores[word]
        starts = _starts(len(words), ends)
        return float(np.add.reduceat(values, starts).max()) + self.bias

    def margins(self, texts: list[str]) -> np.ndarray:
        """For each text the margin of its most toxic sentence."""
        out = []
        for at in range(0, len(texts), 256):
            lists = [tokens(t) for t in texts[at : at + 256]]
            self._learn(lists)
            out += [self._margin(words) for words in lists]
        return np.array(out)

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.shift, -500, 500)))


def _sentences(text: str, known: dict[str, str]) -> list[list[str]]:
    """A text's sentences as words of letters; equal words are one string, kept in `known`."""
    out: list[list[str]] = [[]]
    for w in tokens(text):
        if w == _END or len(out[-1]) == SENTENCE:
            out.append([])
        if w != _END:
            core = letters(w)
            out[-1].append(known.setdefault(core, core))
    return [[w for w in s if w] for s in out if any(s)] or [[]]


def landmarks(toxic: list[set[str]], clean: list[set[str]], most: int = LANDMARKS, plain: int = PLAIN_LANDMARKS) -> list[str]:
    """Strings of letters that set toxic documents apart, until all are covered, and the most common clean words."""
    bad, good = (Counter(w for d in docs for w in d) for docs in (toxic, clean))
    ratio = max(1, len(clean)) / max(1, len(toxic))
    gain: dict[str, float] = {}
    against: dict[str, int] = {}
    for k in range(SHORTEST, LONGEST + 1):  # one length at a time, so few strings are held
        grams: Counter[str] = Counter()
        for w, n in bad.items():
            for g in {w[i : i + k] for i in range(len(w) - k + 1)}:
                grams[g] += n
        grams = Counter({g: n for g, n in grams.items() if n >= 3})
        other: Counter[str] = Counter()
        for w, n in good.items():
            for g in (w[i : i + k] for i in range(len(w) - k + 1)):
                if g in grams:
                    other[g] += n
        best = sorted(((n - 4 * other[g] / ratio, g) for g, n in grams.items()), reverse=True)[:1000]
        gain |= {g: v for v, g in best if v > 0}
        against |= {g: other[g] for _, g in best}
    tried = sorted(gain, key=lambda g: (-gain[g], -len(g), g))[:2000]
    within: dict[str, list[int]] = {g: [] for g in tried}
    for i, d in enumerate(toxic):
        for g in {w[a : a + k] for w in d for k in range(SHORTEST, LONGEST + 1) for a in range(len(w) - k + 1)} & within.keys():
            within[g].append(i)
    found: list[str] = []
    times = np.zeros(len(toxic))
    held = {g: np.array(within[g], np.int64) for g in tried}
    alike = lambda a, b: any(a[i : i + SHORTEST] in b for i in range(len(a) - SHORTEST + 1))
    while len(found) < most and tried:
        worth = np.maximum(0, 1 - times / COVER)
        value = {g: worth[held[g]].sum() - 4 * against[g] / ratio for g in tried}
        best = max(tried, key=lambda g: (value[g] * (1 + 0.06 * len(g)), g))  # whole words rather than their parts
        if value[best] < max(1, 0.002 * len(toxic)):
            break
        found.append(best)
        times[held[best]] += 1
        tried = [g for g in tried if not alike(g, best)]
    common = [w for w, _ in sorted(good.items(), key=lambda x: (-x[1], x[0])) if SHORTEST <= len(w) <= LONGEST and w not in found]
    return found + common[:plain]


def _machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
    """A linear support vector machine with squared hinge loss, by Newton steps."""
    z = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w = np.zeros(z.shape[1])
    ridge = np.eye(z.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        active = y * (z @ w) < 1
        za, ca = z[active].astype(np.float64), cost[active]
        after = np.linalg.solve(ridge + 2 * (za * ca[:, None]).T @ za, 2 * za.T @ (ca * y[active]))
        if np.abs(after - w).max() < 1e-9:
            break
        w = after
    return w[:-1], float(w[-1])


def _calibration(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve with the least loss, of a grid of slopes and of the middles between margins."""
    places = np.unique(np.quantile(margin, np.linspace(0, 1, 401)))
    middles = np.concatenate(([0.0], (places[1:] + places[:-1]) / 2))
    loss = lambda a, m: np.logaddexp(0, -a * y * (margin - m)).sum()
    _, a, m = min((loss(a, m), a, m) for a in (1.0, 2.0, 4.0, 8.0) for m in middles.tolist())
    return a, -a * m


def fit(rows: list[tuple[str, int]]) -> Model:
    """Train on (text, label) rows. Without both labels all scores are those of the one seen, or 0.5 - a little."""
    rows = sorted(rows)
    known: dict[str, str] = {}
    docs = [(_sentences(t or "", known), 1 if y else -1) for t, y in rows]
    toxic, clean = [[{w for s in d for w in s} for d, y in docs if y == k] for k in (1, -1)]
    if not toxic or not clean:
        return Model([], np.zeros(0), 0.0, 1.0, 3.0 if toxic else -3.0 if clean else -0.001)
    marks = landmarks(toxic, clean)
    cores = sorted({w for d, _ in docs for s in d for w in s})
    rng = np.random.default_rng(11)

    def twisted(word: str) -> str:
        at = int(rng.integers(1, max(2, len(word))))
        return word[:at] + "aeiklmnorstuxyz"[rng.integers(15)] + word[at:]

    mark_norms = norms(marks)
    own = normalised(marks, marks, mark_norms)
    blocks = []
    for power in POWERS:  # the Nystroem map of each power
        value, vector = np.linalg.eigh(own**power)
        blocks.append(vector / np.sqrt(np.maximum(value, 1e-2)) @ vector.T)
    k = len(marks)
    whiten = np.zeros((k * len(POWERS),) * 2)
    for i, block in enumerate(blocks):
        whiten[i * k : (i + 1) * k, i * k : (i + 1) * k] = block
    number = {w: i for i, w in enumerate(cores)}
    table = np.concatenate([(features(cores[i : i + 8192], marks, mark_norms) @ whiten).astype(np.float32) for i in range(0, len(cores), 8192)])
    # all sentences in one row of words, with the edges between sentences and between documents
    sentences = [s for d, _ in docs for s in d]
    words = np.array([number[w] for s in sentences for w in s], np.int64)
    sizes = np.array([len(s) for s in sentences])
    x = np.zeros((len(sentences), table.shape[1]), np.float32)
    for i in range(0, len(words), 65_536):
        np.add.at(x, np.repeat(np.arange(len(sentences)), sizes)[i : i + 65_536], table[words[i : i + 65_536]])
    edges = np.cumsum([0] + [len(d) for d, _ in docs])
    y = np.array([label for _, label in docs])
    of = np.repeat(np.arange(len(docs)), np.diff(edges))
    negative = np.flatnonzero(y[of] < 0)
    # at first a sentence's sum over the toxic landmarks, strictly taken
    toxic_marks = np.array([m in bad_marks for m in marks], float) if (bad_marks := set(marks[: k - min(PLAIN_LANDMARKS, k)])) else np.ones(k)
    weights, bias = np.linalg.solve(whiten, np.concatenate([0 * toxic_marks] * (len(POWERS) - 1) + [toxic_marks])), 0.0
    for _ in range(3):
        value = x @ weights
        picked = [int(a + value[a:b].argmax()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        sure = np.flatnonzero((y[of] > 0) & (value + bias > 0)) if bias else []
        positive = sorted({picked[i] for i in np.flatnonzero(y > 0).tolist()} | {int(i) for i in sure})
        worst = [max(sentences[i], key=lambda w: table[number[w]] @ weights) if sentences[i] else "" for i in positive]
        new = features([twisted(w) if w else "" for w in worst], marks, mark_norms) @ whiten
        changed = np.array([x[i] - (table[number[w]] if w else 0) for i, w in zip(positive, worst, strict=True)]) + new
        every = np.vstack([x[positive], changed.astype(np.float32), x[negative]])
        label = np.concatenate([np.ones(2 * len(positive)), -np.ones(len(negative))])
        share = np.concatenate([np.full(len(positive), 0.8), np.full(len(positive), 0.2), np.full(len(negative), 1.5 * len(positive) / max(1, len(negative)))])
        weights, bias = _machine(every, label, 40 * share)
    model = Model(marks, whiten @ weights, bias, 1.0, 0.0)
    model.slope, model.shift = _calibration(model.margins([t or "" for t, _ in rows]), y)
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC_DOCS, clean: int = CLEAN_DOCS, doc_bytes: int = DOC_BYTES) -> list[tuple[str, int]]:
    """At most `toxic` and `clean` labelled documents of at most `doc_bytes` bytes, none of them held out."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.withColumn("place", F.xxhash64("doc_id"))
    parts = [known.where(cond).orderBy("place").limit(2 * n) for cond, n in ((F.col("toxic") == 1, toxic), (F.col("toxic") != 1, clean))]
    ids = parts[0].union(parts[1])  # a bounded number of ids
    fits = docs.where(F.col("text").isNotNull() & (F.octet_length("text") <= doc_bytes)).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = fits.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "toxic", "place")
    out: list[tuple[str, int]] = []
    for cond, n in ((F.col("toxic") == 1, toxic), (F.col("toxic") != 1, clean)):
        out += [(r["text"], int(r["toxic"] == 1)) for r in rows.where(cond).orderBy("place", "doc_id").limit(n).collect()]
    return out


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every whole text; null texts as empty ones, which score as a sentence without words."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch, values in texts(batches):
            scores = own.scores([v.decode() for v in values])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    rows = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", "text")
    return rows.mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs, by a model of the labels that are not held out.

    Null and empty texts score as a sentence without words. Repeated rows are scored each; a label
    given twice counts as toxic if one is. Null labels and labels of unknown documents are left out.
    Without labels of both kinds all documents score alike. No rows give none.
    """
    found = scored(docs, fit(sample(docs, labels)))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text and any other columns, kept as they are) without those that the model rejects.

    Null and empty texts score as a sentence without words, so they stay unless all documents are toxic. Repeated rows
    and null ids stay or go each by their own text. No rows give none.
    """
    model = fit(sample(docs, labels))
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            yield batch.filter(pa.array(own.scores([t or "" for t in batch.column(at).to_pylist()]) < 0.5))

    return spread(docs, "doc_id", "text").mapInArrow(run, docs.schema)
