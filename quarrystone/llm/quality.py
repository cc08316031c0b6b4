"""Quality rules with line sequence labelling: a linear-chain conditional random field over lines.

Each line has features of its own; the field joins them with weights for the passage from one label to
the next. Labels of a bounded sample are known for documents, not for lines, so lines are labelled in turn: at
first all lines bear their document's label and weights of lines alone are fitted; then lines that
look like the other label take it, as long as most words of a document agree with its own label; on these the
whole field is trained, by gradient steps on the likelihood, and labels them anew by Viterbi decoding.
Viterbi decoding marks every line of a text as content or boilerplate, and the share of words in content lines
decides whether a document is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import spread
from .chunked import covered, mix
from .common import small_batches, texts

#: Bounds of the training sample: documents of either label, and bytes of one, which is used whole.
GOOD_DOCS, BAD_DOCS, DOC_BYTES = 1500, 1500, 8192
#: Lines, with padding, that are worked on at once, in training and in decoding; a longer text is by itself.
CELLS = 200_000
#: Gradient steps of the first fit, and of each of the fits of the whole field.
STEPS, ROUNDS = (60, 40), 2
#: Words of a document that keep its label, of all, at least, while lines are labelled in training.
OWN_SHARE = 0.6
#: A document is kept if at least this share of its words is in content lines.
CONTENT_SHARE = 0.5
MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
SYMBOLS = b"#*$%&|<>"
RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"
_STEP = np.uint64(0x9E3779B97F4A7C15)

_BLANK, _UPPER, _LOWER, _DIGIT, _SYMBOL, _BANG, _STOP = range(7)
_classes = np.full((7, 256), 0, np.int32)
for _k, _chars in ((_BLANK, b" \t\n\v\f\r"), (_UPPER, bytes(range(65, 91))), (_LOWER, bytes(range(97, 123)) + bytes(range(128, 256))), (_DIGIT, b"0123456789"), (_SYMBOL, SYMBOLS + b"{}[]=;_/\\@"), (_BANG, b"!"), (_STOP, b".?:,")):
    _classes[_k, list(_chars)] = 1


class Lines:
    """Counts and line features of some whole texts, for all of them together."""

    def __init__(self, values: list[bytes]):
        self.words = [v.split() for v in values]
        self.n_words = np.array([len(w) for w in self.words], np.int64)
        self.n_symbols = np.array([sum(map(v.count, (SYMBOLS[i : i + 1] for i in range(len(SYMBOLS))))) for v in values], np.int64)
        self.word_chars = np.array([len(v.decode()) - sum(map(v.count, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"))) for v in values], np.int64)
        edges = np.concatenate(([0], np.cumsum(self.n_words)))
        repeated = self._repeated(edges)
        counted = np.concatenate(([0], np.cumsum(repeated)))
        self.n_repeat = counted[edges[1:]] - counted[edges[:-1]]
        lines = [v.split(b"\n") for v in values]
        self.sizes = np.array([len(x) for x in lines], np.int64)
        self.edges = np.concatenate(([0], np.cumsum(self.sizes)))
        flat = [x for own in lines for x in own]
        self.line_words = np.array([len(x.split()) for x in flat], np.int64)
        self.duplicate = np.zeros(len(flat), bool)
        at = 0
        for own in lines:
            seen: set[bytes] = set()
            for x in own:
                self.duplicate[at] = x in seen and self.line_words[at] > 0
                seen.add(x)
                at += 1
        marks = np.concatenate(([0], np.cumsum(self.duplicate)))
        self.n_dup = marks[self.edges[1:]] - marks[self.edges[:-1]]
        word_edges = np.concatenate(([0], np.cumsum(self.line_words)))
        self.features = self._features(flat, counted[word_edges[1:]] - counted[word_edges[:-1]])

    def _repeated(self, edges: np.ndarray) -> np.ndarray:
        n = int(edges[-1])
        h = xxhash.xxh3_64_intdigest
        ids = np.fromiter((h(x) for w in self.words for x in w), np.uint64, n)
        doc = np.repeat(np.arange(len(self.words)), self.n_words)
        full = max(0, n - WINDOW + 1)
        rolled = doc[:full].astype(np.uint64)
        for k in range(WINDOW):
            rolled = rolled * _STEP + ids[k : k + full]
        starts = np.flatnonzero(doc[:full] == doc[WINDOW - 1 :]) if full else np.zeros(0, np.int64)
        _, inverse, times = np.unique(mix(rolled[starts]), return_inverse=True, return_counts=True)
        return covered(n, starts[times[inverse] > 1], WINDOW)

    def _features(self, flat: list[bytes], repeats: np.ndarray) -> np.ndarray:
        sizes = np.array([len(x) for x in flat], np.int64)
        edges = np.concatenate(([0], np.cumsum(sizes)))
        text = np.frombuffer(b"".join(flat), np.uint8)
        counts = []
        for k in range(len(_classes)):
            sums = np.concatenate(([0], np.cumsum(_classes[k][text])))
            counts.append(sums[edges[1:]] - sums[edges[:-1]])
        words, last = self.line_words, np.zeros(len(flat), np.uint8)
        full = np.array([i for i, x in enumerate(flat) if x], np.int64)
        last[full] = text[edges[full + 1] - 1] if len(full) else 0
        each = np.maximum(words, 1)
        letters = np.maximum(counts[_UPPER] + counts[_LOWER], 1)
        long = (sizes - counts[_BLANK]) / each
        upper, digits = counts[_UPPER] / letters, counts[_DIGIT] / np.maximum(sizes, 1)
        symbols, bangs, stops = counts[_SYMBOL] / each, counts[_BANG] / each, counts[_STOP] / each
        columns = [
            np.ones(len(flat), bool), words == 0, (words > 0) & (words <= 2), (words > 2) & (words <= 5), (words > 5) & (words <= 12), words > 40,
            symbols == 0, (symbols > 0) & (symbols <= 0.2), (symbols > 0.2) & (symbols <= 0.6), (symbols > 0.6) & (symbols <= 1.5), symbols > 1.5,
            upper > 0.9, (upper > 0.3) & (upper <= 0.9), digits > 0.3, (digits > 0.08) & (digits <= 0.3), bangs > 0.3, (bangs > 0) & (bangs <= 0.3),
            stops == 0, stops > 0.5, (last == 46) | (last == 63), self.duplicate, repeats > 0.3 * each, (long < 3) & (words > 0), long > 10, long > 20,
        ]
        return np.stack(columns, axis=1).astype(np.float64)


def _padded(lines: Lines, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, present): for each chosen document the numbers of its lines, padded."""
    width = int(lines.sizes[chosen].max(initial=0))
    place = np.arange(width)
    present = place < lines.sizes[chosen][:, None]
    return np.where(present, lines.edges[chosen][:, None] + place, 0), present


class Field:
    """Emission weights (features x 2) and passage weights (2 x 2) of labels 0 (boilerplate) and 1 (content)."""

    def __init__(self, emit: np.ndarray, pass_on: np.ndarray):
        self.emit, self.pass_on = emit, pass_on

    def viterbi(self, lines: Lines, chosen: np.ndarray) -> np.ndarray:
        """Label of every line of the chosen documents; -1 for other lines. Ties go to content."""
        out = np.full(len(lines.features), -1)
        scores = lines.features @ self.emit
        for group in (chosen[alike] for alike in _alike(lines.sizes[chosen]) if len(alike)):
            rows, present = _padded(lines, group)
            own = scores[rows]
            best, back = own[:, 0], []
            for t in range(1, rows.shape[1]):
                steps = best[:, :, None] + self.pass_on  # from, to
                came = (steps[:, 1] >= steps[:, 0]).astype(np.int64)
                after = np.where(came == 1, steps[:, 1], steps[:, 0]) + own[:, t]
                live = present[:, t]
                back.append(np.where(live[:, None], came, [0, 1]))
                best = np.where(live[:, None], after, best)
            label = (best[:, 1] >= best[:, 0]).astype(np.int64)
            for t in range(rows.shape[1] - 1, -1, -1):
                live = present[:, t]
                out[rows[live, t]] = label[live]
                if t:
                    label = back[t - 1][np.arange(len(group)), label]
        return out

    def gradient(self, features: np.ndarray, rows: np.ndarray, present: np.ndarray, labels: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-likelihood of labels for the lines (padded, as rows are), and its derivatives."""
        n, width = rows.shape
        part = features[rows[present]]
        own = np.zeros((n, width, 2))
        own[present] = part @ self.emit
        ahead, behind = np.zeros((n, width, 2)), np.zeros((n, width, 2))
        ahead[:, 0] = own[:, 0]
        for t in range(1, width):
            step = np.logaddexp(ahead[:, t - 1, 0, None] + self.pass_on[0], ahead[:, t - 1, 1, None] + self.pass_on[1]) + own[:, t]
            ahead[:, t] = np.where(present[:, t, None], step, ahead[:, t - 1])
        for t in range(width - 2, -1, -1):
            right = behind[:, t + 1] + own[:, t + 1]
            step = np.logaddexp(right[:, 0, None] + self.pass_on[:, 0], right[:, 1, None] + self.pass_on[:, 1])
            behind[:, t] = np.where(present[:, t + 1, None], step, 0)
        whole = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        chance = np.exp(ahead + behind - whole[:, None, None]) * present[:, :, None]
        true = np.stack((labels == 0, labels == 1), axis=2) * present[:, :, None].astype(float)
        emit = part.T @ (true - chance)[present]
        pass_on, value = np.zeros((2, 2)), (own * true).sum() - whole.sum()
        for t in range(1, width):
            pair = np.exp(ahead[:, t - 1, :, None] + self.pass_on + (own[:, t] + behind[:, t])[:, None, :] - whole[:, None, None]) * present[:, t, None, None]
            seen = np.einsum("ni,nj->ij", true[:, t - 1], true[:, t])
            pass_on += seen - pair.sum(axis=0)
            value += (seen * self.pass_on).sum()
        return float(value), emit, pass_on


def _alike(sizes: np.ndarray, cells: int = CELLS) -> list[np.ndarray]:
    """Texts by their number of lines, in groups of at most `cells` lines with padding, or of one text."""
    groups: list[list[int]] = [[]]
    for i in np.argsort(sizes, kind="stable"):
        if groups[-1] and (len(groups[-1]) + 1) * sizes[i] > cells:
            groups.append([])
        groups[-1].append(i)
    return [np.array(g) for g in groups]


def _by_line(field: Field, features: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray]:
    """The slope of the emission weights while lines do not know their neighbours."""
    scores = features @ field.emit
    wrong = labels - 1 / (1 + np.exp(scores[:, 0] - scores[:, 1]))
    return (features.T @ np.stack((-wrong, wrong), axis=1),)


def _climb(field: Field, lines: Lines, groups: list[tuple], labels: np.ndarray, steps: int, chained: bool) -> Field:
    """Gradient steps on the likelihood of line labels; without `chained` each line is by itself."""
    weight = 1 / max(1, lines.sizes.sum())
    names = ("emit", "pass_on") if chained else ("emit",)
    moment, square = ({n: np.zeros_like(getattr(field, n)) for n in names} for _ in range(2))
    for step in range(1, steps + 1):
        parts = [field.gradient(lines.features, at, present, labels[at])[1:] for _, at, present in groups] if chained else [_by_line(field, lines.features, labels)]
        for i, name in enumerate(names):
            own = getattr(field, name)
            g = sum(p[i] for p in parts) * weight - 1e-4 * own
            moment[name] = 0.9 * moment[name] + 0.1 * g
            square[name] = 0.99 * square[name] + 0.01 * g * g
            setattr(field, name, own + 0.1 * (moment[name] / (1 - 0.9**step)) / (np.sqrt(square[name] / (1 - 0.99**step)) + 1e-8))
    return field


def _relabelled(lines: Lines, own: np.ndarray, against: np.ndarray) -> np.ndarray:
    """Labels of lines whose documents bear the labels `own`: lines with a positive `against` take the other one, those
    with the most of it first, until OWN_SHARE of a document's words is left with its own."""
    doc = np.repeat(np.arange(len(lines.sizes)), lines.sizes)
    order = np.lexsort((-against, doc))
    words = np.cumsum(lines.line_words[order])
    before = np.concatenate(([0], words))[lines.edges[:-1]]
    spent = words - np.repeat(before, lines.sizes)
    turned = np.empty(len(doc), bool)
    turned[order] = (against[order] > 0) & (spent <= (1 - OWN_SHARE) * lines.n_words[doc])
    return np.where(turned, 1 - own[doc], own[doc])


def fit(rows: list[tuple[str, int]], steps: tuple[int, int] = STEPS) -> Field:
    """Train on (text, label) rows; without both labels every line is content."""
    if len({y for _, y in rows}) < 2:
        return Field(np.zeros((len(Lines([b""]).features[0]), 2)), np.zeros((2, 2)))
    rows = sorted(rows)
    own = np.array([y for _, y in rows])
    lines = Lines([t.encode() for t, _ in rows])
    groups = [(g, *_padded(lines, g)) for g in _alike(lines.sizes)]
    each = np.repeat(own, lines.sizes)
    field = Field(np.zeros((lines.features.shape[1], 2)), np.zeros((2, 2)))
    _climb(field, lines, groups, each, steps[0], False)
    labels = each
    for turn in range(ROUNDS):
        margin = lines.features @ (field.emit[:, 1] - field.emit[:, 0])
        if turn:  # by now the field knows its neighbours
            margin = np.where(field.viterbi(lines, np.arange(len(rows))) == 1, 1.0, -1.0) * np.maximum(np.abs(margin), 1e-3)
        labels = _relabelled(lines, own, np.where(each == 1, -margin, margin))
        _climb(field, lines, groups, labels, steps[1], True)
    return field


def sample(docs: DataFrame, labels: DataFrame, good: int = GOOD_DOCS, bad: int = BAD_DOCS, doc_bytes: int = DOC_BYTES) -> list[tuple[str, int]]:
    """At most so many documents of either quality label, of at most `doc_bytes` bytes, in a seeded order of ids."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.withColumn("place", F.xxhash64("doc_id"))
    parts = [known.where(cond).orderBy("place").limit(2 * n) for cond, n in ((F.col("quality") == 1, good), (F.col("quality") != 1, bad))]
    fits = docs.where(F.col("text").isNotNull() & (F.octet_length("text") <= doc_bytes)).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = fits.join(F.broadcast(parts[0].union(parts[1])), "doc_id")  # a bounded number of ids
    out: list[tuple[str, int]] = []
    for cond, n in ((F.col("quality") == 1, good), (F.col("quality") != 1, bad)):
        out += [(r["text"], int(r["quality"] == 1)) for r in rows.where(cond).orderBy("place", "doc_id").limit(n).select("text", "quality").collect()]
    return out


def _judged(values: list[bytes], field: Field, content_share: float) -> tuple[Lines, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    lines = Lines(values)
    failed = (lines.n_words < MIN_WORDS) | (100 * lines.n_repeat > REPEAT_PERCENT * lines.n_words)
    labels = field.viterbi(lines, np.flatnonzero(~failed))
    content = np.concatenate(([0], np.cumsum(lines.line_words * (labels == 1))))
    share = (content[lines.edges[1:]] - content[lines.edges[:-1]]) / np.maximum(lines.n_words, 1)
    return lines, failed, ~failed & (share >= content_share), np.where(failed, np.nan, share), labels


def judge(docs: DataFrame, labels: DataFrame, content_share: float = CONTENT_SHARE) -> DataFrame:
    """The counts, base_failed, kept and content_share (null where base_failed) of every row of docs.

    Null and empty texts have no words and fail. Repeated rows are judged each. Windows of words are told apart by 64 bits
    of a hash. Null labels, and
    labels of unknown documents, are left out; without labels of both kinds every line is content.
    Null ids stay null. No rows give none.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(fit(sample(docs, labels)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in texts(batches):
            lines, failed, kept, share, _ = _judged(values, shared.value, content_share)
            columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in (lines.n_words, lines.word_chars, lines.n_symbols, lines.n_dup, lines.n_repeat)), pa.array(failed), pa.array(kept), pa.array(share, pa.float64(), mask=failed)]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in RESULT.split(", ")])

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", "text").mapInArrow(run, RESULT)
