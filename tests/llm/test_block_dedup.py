import hashlib
import random
import re
from collections import Counter

from quarrystone.llm import block_dedup, chunked


def plain(texts, window):
    docs = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]
    seen = Counter(tuple(d[i : i + window]) for d in docs for i in range(len(d) - window + 1))
    out = []
    for d in docs:
        gone = set()
        for i in range(len(d) - window + 1):
            if seen[tuple(d[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(w for i, w in enumerate(d) if i not in gone)
        out.append((len(d), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, window):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "cé", "Dd", "e.", "f f", "g\th"])
    passages = [" ".join(word() + str(rng.randrange(30)) for _ in range(n)) for n in (window - 1, window, window + 1, 2 * window, 5 * window)]
    texts = [None, "", " \n ", "x", "la " * (3 * window), "la la " * 4000, passages[1], passages[1]]
    for _ in range(60):
        parts = [" ".join(word() + str(rng.randrange(30)) for _ in range(rng.randrange(40))) for _ in range(3)]
        texts.append(rng.choice([" ", "\n", "  "]).join(x for p in parts for x in (p, rng.choice(passages))))
    return texts


def test_against_brute_force(spark, monkeypatch):
    for window, sizes in ((35, None), (35, (20_000, 40_000, 1)), (6, (10_000, 2_000, 2))):
        for name, value in zip(("CHUNK_BYTES", "BUCKET_BYTES", "FAN_BITS"), sizes or (), strict=bool(sizes)):
            monkeypatch.setattr(chunked, name, value)
        texts = corpus(window, window)
        docs = spark.createDataFrame([(i, t, i, "c") for i, t in enumerate(texts)], "doc_id long, text string, row int, chunk string")
        got = sorted(map(tuple, block_dedup.marked(docs, window).collect()))
        assert [g[1:] for g in got] == plain(texts, window)
        assert [g[0] for g in got] == list(range(len(texts)))


def test_nulls_repeats_and_no_rows(spark):
    schema = "doc_id long, text string"
    assert block_dedup.marked(spark.createDataFrame([], schema)).collect() == []
    text = " ".join("w%d" % i for i in range(40))
    got = block_dedup.marked(spark.createDataFrame([(None, text), (4, text + " more"), (4, "short")], schema), keep_words=True).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=str) == [(4, 1, 0, "short"), (4, 41, 40, "more"), (None, 40, 40, "")]
