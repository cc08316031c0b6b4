import hashlib
import random
from collections import Counter

from quarrystone.llm import chunked, pfp_dedup


def plain(texts, window):
    docs = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + window] for d in docs for i in range(len(d) - window + 1))
    out = []
    for d in docs:
        gone = bytearray(len(d))
        for i in range(len(d) - window + 1):
            if seen[d[i : i + window]] > 1:
                gone[i : i + window] = b"\x01" * window
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return out


def corpus(seed, window):
    rng = random.Random(seed)
    noise = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    passages = [noise(n) for n in (window - 2, window - 1, window, window + 1, window + 7, 2 * window, 4 * window)]
    texts = [None, "", "x", "a" * (3 * window), "ab" * (4 * window), "\0" * (2 * window), passages[2], passages[2] + "q", noise(20 * window)]
    for _ in range(50):
        parts = [noise(rng.randrange(2 * window)) for _ in range(3)]
        texts.append("".join(x for p in parts for x in (p, rng.choice(passages))))
    edited = list(noise(6 * window))
    for _ in range(12):
        edited[rng.randrange(len(edited))] = "Z"
        texts.append("".join(edited))
    return texts


def test_against_brute_force(spark, monkeypatch):
    for window, hot, sizes in ((400, 4096, None), (40, 4096, (9000, 9000, 2)), (40, 3, (4000, 1500, 1))):
        monkeypatch.setattr(pfp_dedup, "HOT", hot)
        for name, value in zip(("CHUNK_BYTES", "BUCKET_BYTES", "FAN_BITS"), sizes or (), strict=bool(sizes)):
            monkeypatch.setattr(chunked, name, value)
        texts = corpus(window, window)
        docs = spark.createDataFrame([(i, t, i, "k") for i, t in enumerate(texts)], "doc_id long, text string, bucket int, kind string")
        got = sorted(map(tuple, pfp_dedup.marked(docs, window).collect()))
        assert [g[0] for g in got] == list(range(len(texts)))
        assert [g[1:] for g in got] == plain(texts, window)


def test_nulls_repeats_no_rows_and_what_is_left(spark):
    schema = "doc_id long, text string, own string, n_chars int"
    assert pfp_dedup.marked(spark.createDataFrame([], schema)).collect() == []
    assert pfp_dedup.stripped(spark.createDataFrame([], schema)).collect() == []
    rng = random.Random(1)
    text = "".join(rng.choice("xyzé") for _ in range(500))
    docs = spark.createDataFrame([(None, "<" + text, "p", 501), (4, text + ">", "q", 501), (4, "short", "r", 5), (5, None, "s", 0)], schema)
    got = sorted(((r.doc_id, r.text, r.own, r.n_chars) for r in pfp_dedup.stripped(docs).collect()), key=str)
    assert got == sorted([(None, "<", "p", 1), (4, ">", "q", 1), (4, "short", "r", 5), (5, "", "s", 0)], key=str)
    assert pfp_dedup.stripped(docs).columns == docs.columns
