import random
import zlib

import numpy as np

from quarrystone.llm import toxicity

INSULTS = ["numbskull", "dimwit", "vermin"]


def plain_kernel(s, t, n, decay):
    """All common subsequences, by their places."""
    from itertools import combinations

    total = 0.0
    for a in combinations(range(len(s)), n):
        for b in combinations(range(len(t)), n):
            if all(s[i] == t[j] for i, j in zip(a, b, strict=True)):
                total += decay ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
    return total


def test_kernel_against_all_subsequences():
    words, marks = ["idiot", "idxiot", "riot", "ab", "", "toidi", "iiiddd", "été"], ["idiot", "iot", "étéé"]
    got = toxicity.kernel(words, marks)
    want = [[plain_kernel(w, m, toxicity.ORDER, toxicity.DECAY) for m in marks] for w in words]
    assert np.allclose(got, want, rtol=1e-4)
    own = [plain_kernel(w, w, toxicity.ORDER, toxicity.DECAY) for w in words]
    assert np.allclose(toxicity.norms(words), own, rtol=1e-4)
    unit = toxicity.normalised(words, marks, toxicity.norms(marks))
    assert np.allclose(unit, [[k / np.sqrt(a * plain_kernel(m, m, toxicity.ORDER, toxicity.DECAY)) if a else 0 for k, m in zip(row, marks, strict=True)] for row, a in zip(want, own, strict=True)], rtol=1e-4)
    assert unit.max() <= 1 + 1e-5 and np.isclose(unit[0, 0], 1)
    # the map of the landmarks keeps their kernel: products of mapped landmarks are the kernel between them
    for power in toxicity.POWERS:
        between = toxicity.normalised(marks, marks, toxicity.norms(marks)) ** power
        value, vector = np.linalg.eigh(between)
        mapped = between @ (vector / np.sqrt(value) @ vector.T)
        assert np.allclose(mapped @ mapped.T, between, atol=1e-4)


def corpus(n, seed):
    rng = random.Random(seed)
    syllables = ["ba", "den", "ko", "ril", "su", "ta", "mor", "fen"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(5, 60))]
        bad = i % 4 == 0
        for _ in range(rng.randrange(1, 4) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        rows.append((i, ". ".join(" ".join(words[k : k + 9]) for k in range(0, len(words), 9)), int(bad)))
    return rows


def test_held_out_accuracy_and_disguised_insults(spark):
    rows = corpus(800, 5)
    docs = spark.createDataFrame([(i, t, "s", 2.0) for i, t, _ in rows], "doc_id long, text string, source string, score double")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in rows)
    held = [(i, y) for i, _, y in rows if got[i].held_out]
    assert sum(got[i].predicted == y for i, y in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    kept = toxicity.clean(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}
    model = toxicity.fit([(t, y) for i, t, y in rows if not got[i].held_out])
    plain, hidden = model.scores(["ba den ko sutafen"])[0], model.scores(["ba den numbsxkull ko n.u.m.b.s.k.u.l.l", "koril d i m w i t su vermxin", ""])
    assert (hidden[:2] > 0.5).all() and plain < 0.5 and 0 <= hidden[2] < 0.5


def test_nulls_long_texts_missing_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (None, ""), (2, "dimwit " * 40_000), (3, "x" * 100_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, 1), (99, 0)], "doc_id long, toxic int")
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == 5 and {r.predicted for r in got} == {0}
    empty = spark.createDataFrame([], docs.schema)
    assert toxicity.classify(empty, labels).collect() == [] and toxicity.clean(empty, labels).collect() == []


def test_extra_columns_with_clashing_names(spark):
    rows = corpus(200, 6)
    docs = spark.createDataFrame([(i if i % 9 else None, t, i, "p", None) for i, t, _ in rows] + [(None, None, 1, "q", 2.0)], "doc_id long, text string, toxic long, predicted string, score double")
    labels = spark.createDataFrame([(i, 1, y, "x") for i, _, y in rows], "doc_id long, quality int, toxic int, text string")
    kept = toxicity.clean(docs, labels)
    assert kept.columns == docs.columns and kept.where("predicted = 'q'").count() == 1
    assert toxicity.classify(docs, labels).count() == 201
