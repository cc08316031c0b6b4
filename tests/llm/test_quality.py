import itertools
import random
import re

import numpy as np

from quarrystone.llm import quality


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    again = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            again.update(range(i, i + 8))
    failed = len(words) < 20 or 100 * len(again) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again), failed


def corpus():
    rng = random.Random(4)
    prose = lambda: " ".join(rng.choice(["the", "river", "été", "runs", "over", "stones"]) + str(rng.randrange(9)) for _ in range(rng.randrange(6, 14))) + "."
    junk = lambda: " | ".join("Link%d" % rng.randrange(99) for _ in range(rng.randrange(4, 9))) + " |"
    rows = []
    for i in range(240):
        good = i % 2
        lines = [prose() if good else junk() for _ in range(rng.randrange(4, 9))]
        rows.append((i, "\n".join(lines), good))
    return rows


EDGE = [None, "", "\n\n", "a b", "x " * 300, "same line here\nsame line here\n\nother\n \nsame line here", "é\xa0ñ # $ % & | < > *\t\v\f\r" * 5, "one two three four five six seven eight " * 2 + " ".join(map(str, range(40))), "y" * 60_000]


def test_counts_verdicts_and_held_out_share(spark):
    rows = corpus()
    texts = [(i, t) for i, t, _ in rows] + [(1000 + i, t) for i, t in enumerate(EDGE)]
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in texts], "doc_id long, text string, kept string, n_words int")
    labels = spark.createDataFrame([(i, g, 0) for i, _, g in rows[:120]] + [(None, 1, 0), (5, None, 0), (777, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    for i, t in texts:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(t)
        assert not (r.base_failed and r.kept) and (r.content_share is None) == r.base_failed
    held = [(i, g) for i, _, g in rows[120:] if not got[i].base_failed]
    assert sum(got[i].kept == bool(g) for i, g in held) >= 0.97 * len(held)


def test_viterbi_and_likelihood_against_all_labellings():
    rng = np.random.default_rng(2)
    lines = quality.Lines([b"a b c.\nX | Y\n\nq!", b"one", b"z\nz\nz 1 2 3"])
    field = quality.Field(rng.normal(size=(lines.features.shape[1], 2)), rng.normal(size=(2, 2)))
    scores = lines.features @ field.emit

    def value(d, path):
        own = scores[lines.edges[d] : lines.edges[d + 1]]
        return sum(own[t, k] for t, k in enumerate(path)) + sum(field.pass_on[a, b] for a, b in itertools.pairwise(path))

    found = field.viterbi(lines, np.arange(3))
    for d in range(3):
        paths = list(itertools.product((0, 1), repeat=int(lines.sizes[d])))
        assert tuple(found[lines.edges[d] : lines.edges[d + 1]]) == max(paths, key=lambda p: value(d, p))
    rows, present = quality._padded(lines, np.arange(3))
    flat = rng.integers(0, 2, len(lines.features))
    labels = flat[rows]
    at, emit, pass_on = field.gradient(lines.features, rows, present, labels)
    want = sum(value(d, flat[lines.edges[d] : lines.edges[d + 1]]) - np.log(sum(np.exp(value(d, p)) for p in itertools.product((0, 1), repeat=int(lines.sizes[d])))) for d in range(3))
    assert np.isclose(at, want)
    for array, slope, place in ((field.emit, emit, (4, 1)), (field.emit, emit, (0, 0)), (field.pass_on, pass_on, (0, 1)), (field.pass_on, pass_on, (1, 1))):
        array[place] += 1e-5
        assert np.isclose((field.gradient(lines.features, rows, present, labels)[0] - at) / 1e-5, slope[place], atol=1e-3)
        array[place] -= 1e-5


def test_no_labels_repeats_and_no_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    text = " ".join("w%d" % i for i in range(25))
    got = quality.judge(spark.createDataFrame([(1, text), (1, text), (None, None)], "doc_id long, text string"), labels).collect()
    assert sorted(((r.doc_id, r.kept) for r in got), key=str) == [(1, True), (1, True), (None, False)]
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string"), labels).collect() == []


def test_training_reads_the_ends_of_texts():
    """Only what follows the 64th line tells the labels apart."""
    prose, junk = "the river runs over stones.", "Link1 | Link2 | Link3 |"
    good, bad = "\n".join([prose] * 104), "\n".join([prose] * 64 + [junk] * 40)
    field = quality.fit([(good, 1), (bad, 0)] * 20)
    lines = quality.Lines([prose.encode(), junk.encode()])
    assert list(field.viterbi(lines, np.arange(2))) == [1, 0]


def test_groups_of_texts_have_the_gradient_of_all(monkeypatch):
    rows = [(("a b.\n" * (i % 7) + "X | Y") if i % 2 else "c d e.\n" * (i % 5), i % 2) for i in range(40)]
    whole = quality.fit(rows, steps=(5, 5))
    assert len(quality._alike(np.array([3, 1, 9, 1]), 4)) == 3
    alike = quality._alike
    monkeypatch.setattr(quality, "_alike", lambda sizes: alike(sizes, 20))
    parted = quality.fit(rows, steps=(5, 5))
    assert np.allclose(whole.emit, parted.emit) and np.allclose(whole.pass_on, parted.pass_on)


def test_documents_of_both_kinds_of_lines():
    """Training knows documents only, yet lines are told apart within one."""
    rng = random.Random(8)
    prose = lambda: " ".join(rng.choice(["the", "river", "runs", "over", "grey", "stones"]) for _ in range(rng.randrange(7, 14))) + "."
    junk = lambda: " | ".join("Link%d" % rng.randrange(99) for _ in range(rng.randrange(4, 8))) + " |"
    rows = []
    for i in range(160):
        good = i % 2
        most, few = ((prose, junk) if good else (junk, prose))
        lines = [most() for _ in range(rng.randrange(6, 12))]
        at = rng.randrange(len(lines))
        rows.append(("\n".join(lines[:at] + [few() for _ in range(rng.randrange(1, 3))] + lines[at:]), good))
    field = quality.fit(rows)
    text = [prose(), prose(), junk(), junk(), prose(), prose(), prose(), junk()]
    lines = quality.Lines(["\n".join(text).encode()])
    assert field.viterbi(lines, np.arange(1)).tolist() == ["|" not in x for x in text]
    assert field.pass_on[0, 0] + field.pass_on[1, 1] > field.pass_on[0, 1] + field.pass_on[1, 0]


def test_verdicts_follow_the_lines_of_each_whole_text(spark):
    """judge() against the field decoded over each text by itself, all labellings tried."""
    rows = corpus()[:60]
    texts = [(i, "\n".join(t.split("\n")[:7])) for i, t, _ in rows]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, g, 0) for i, _, g in rows], "doc_id long, quality int, toxic int")
    field = quality.fit(quality.sample(docs, labels))
    for r in quality.judge(docs, labels).collect():
        text = dict(texts)[r.doc_id]
        lines = quality.Lines([text.encode()])
        scores, size = lines.features @ field.emit, int(lines.sizes[0])
        best = max(itertools.product((0, 1), repeat=size), key=lambda p: sum(scores[t, k] for t, k in enumerate(p)) + sum(field.pass_on[a, b] for a, b in itertools.pairwise(p)))  # noqa: B023
        share = sum(len(x.split()) for x, k in zip(text.split("\n"), best, strict=True) if k) / max(1, len(text.split()))
        assert r.kept == (not r.base_failed and share >= quality.CONTENT_SHARE)
