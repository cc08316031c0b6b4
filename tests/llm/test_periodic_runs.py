import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from quarrystone.llm import periodic_runs, queries


def brute_runs(words):
    """Every maximal stretch of every period, kept if no smaller period has it."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(24, 3 * q) and not any(all(words[k] == words[k + p] for k in range(i, j + q - p)) for p in range(1, q)):
                found[i, length] = q
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def plain(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    milli = 1000 * best[1] // best[2] if runs else None
    return (len(runs), *best, milli, sha("".join(f"{s},{m},{q}\n" for s, m, q in sorted(runs, key=lambda r: (r[0], r[2]))).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def sequences():
    r = random.Random(5)
    yield [0] * 100
    yield list(range(100))
    yield [0] * 23
    yield [0] * 24
    yield ([0] * 30 + [1]) * 5
    yield ([0] * 40 + [1] + [0] * 33) * 3 + [2] + ([0, 1] * 14 + [2]) * 4
    for _ in range(150):
        letters, seq = r.choice((1, 2, 3, 50)), []
        while len(seq) < r.randrange(20, 260):
            unit = [r.randrange(letters) for _ in range(r.choice((1, 2, 3, 7, 8, 9, 15, 16, 17, 31, 33)))]
            times = r.choice((1, 2, 3, 4, 9))
            seq += unit * times + unit[: r.randrange(len(unit) + 1)] + [r.randrange(letters) for _ in range(r.randrange(4))]
        yield seq


def test_runs_equal_brute_force():
    some = 0
    for seq in sequences():
        found = periodic_runs.find_runs(np.array(seq, np.int64))
        assert found == brute_runs(seq), seq
        some += len(found)
    assert some > 200


def test_several_automata(monkeypatch):
    monkeypatch.setattr(periodic_runs, "KEYS", 3)
    for seq in list(sequences())[:60]:
        assert periodic_runs.find_runs(np.array(seq, np.int64)) == brute_runs(seq)


def test_long_texts_end_soon():
    """One word, one line and two long runs of one line, some hundred thousand words each."""
    line = np.arange(12)
    assert periodic_runs.find_runs(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    assert periodic_runs.find_runs(np.tile(line, 30_000)) == [(0, 360_000, 12)]
    both = np.concatenate((np.tile(line, 9_000), [99], np.tile(line, 11_000), [98], np.tile(line, 9_000)))
    assert len(periodic_runs.find_runs(both)) == 3


def rows_of(spark):
    r, rows = random.Random(3), []
    for i in range(160):
        words = [r.choice("abcdefghij") + r.choice(("", "é", "x")) for _ in range(r.randrange(0, 90))]
        rows.append((i, " ".join(words) + r.choice(("", "\n", " \t", " " + "go on " * 20)), 0))
    rows += [(None, "na " * 60, 1), (200, None, 2), (201, "", 3), (5, "ha ha", 4), (5, "ha ha", 4), (202, "\x0b\x0cа b " * 30, 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, runs int")


def test_digests_equal_plain_version(spark, tmp_path):
    docs = rows_of(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op13_periodic_runs(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = sorted(((r["doc_id"], *plain(r["doc_id"], r["text"])) for r in docs.collect()), key=str)
    assert sorted((tuple(r) for r in out.collect()), key=str) == want
    assert sum(w[1] for w in want) > 30


def test_texts_without_repeats_stay(spark):
    found = {r["doc_id"]: r for r in periodic_runs.detect(rows_of(spark)).where("doc_id >= 200").collect()}
    assert (found[200]["text"], found[201]["text"], found[201]["n_words"]) == ("", "", 0)
    assert [tuple(r) for r in found[202]["runs"]] == [(0, 30, 1)] and found[202]["text"] == "а b"


@pytest.mark.parametrize("columns", ("doc_id long, text string", "doc_id int, text string, n_words string, top int"))
def test_empty(spark, columns):
    assert periodic_runs.digests(periodic_runs.detect(spark.createDataFrame([], columns))).collect() == []
