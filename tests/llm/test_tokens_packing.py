import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from quarrystone.llm import elias_fano, packing, token_files
from quarrystone.llm.common import shared_path
from quarrystone.llm.tokens import Encoder

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
TEXTS = [
    None, "", " ", "a", "One two, three. it's WE'LL 12 345", "a  b", " lead", "trail ", "x\ny", "x\n\ny", "x \ny", "x\n y", "tab\there", "é ́x İ ΣΑΣ",
    "a\x1cb c", "nb sp ace", "<|endoftext|> x <|startoftext|>", "line\r\nend", "\n", "日本 語 text", "long " * 3000, "z" * 9000,
    "Éclair, ÀB! straße. naïve?! A. b_ c' don't, x́ y1, (q) w;; ﬁ é, \u0130stanbul. K. ẞ,", "word. Word, WORD! word",
]


def library(path, end):
    tokenizer = Encoder(path).tokenizer
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, end] for t in TEXTS]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_memo_gives_the_librarys_ids(path):
    enc = Encoder(path, memo=3)
    for _ in range(2):
        for text, want in zip(TEXTS, library(path, 0), strict=True):
            assert np.frombuffer(enc.encode(text or ""), "<u4").tolist() == want[:-1]


def test_elias_fano():
    rng = random.Random(1)
    for n, most in ((0, 0), (1, 0), (1, 9), (5, 3), (700, 100_000), (3000, 50)):
        values = np.array(sorted(rng.randrange(most + 1) for _ in range(n)), np.int64)
        data = b"xx" + elias_fano.encode(values, most)
        seq = elias_fano.Sequence(data, 2)
        assert seq.all().tolist() == values.tolist()
        assert [seq.select(i) for i in range(n)] == values.tolist()
        assert seq.end == len(data)
    sparse = np.array([0, 1 << 20, (1 << 20) + 1])
    assert [elias_fano.Sequence(elias_fano.encode(sparse, 1 << 21)).select(i) for i in range(3)] == sparse.tolist()


def frame(spark, texts=TEXTS):
    order = list(enumerate(texts))
    random.Random(5).shuffle(order)
    return spark.createDataFrame([(i, t, i, "p") for i, t in order], "doc_id long, text string, length int, part string")


def test_token_files_round_trip(spark):
    want, start = {}, 0
    for i, ids in enumerate(library(BYTE, 2)):
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    path = shared_path(spark, "test")
    token_files.write(frame(spark), BYTE, path, 2, shard_tokens=500)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.read(spark, path).collect()}
    assert got == want
    shards = [token_files.Shard(bytes(r.shard)) for r in spark.read.parquet(path).orderBy("part", "seq").collect()]
    assert [shard.document(i).tolist() for shard in shards for i in range(len(shard))] == library(BYTE, 2)
    assert token_files.round_trip(spark.createDataFrame([], "doc_id long, text string"), BYTE, 2).collect() == []
    odd = spark.createDataFrame([(None, "a"), (7, "b c"), (7, "b c"), (-3, None)], "doc_id long, text string")
    assert sorted((r.start, r.doc_id, r.n_tokens) for r in token_files.round_trip(odd, BYTE, 2).collect()) == [(0, None, 2), (2, -3, 1), (3, 7, 3), (6, 7, 3)]


def plain_gaps(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        gap = min(fits) if fits else capacity
        if fits:
            gaps.remove(gap)
        gaps.append(gap - n)
    return gaps


def check_packing(rows, capacity):
    filled = defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
    for spans in filled.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(filled)


def test_packing_cuts_and_packs_every_document(spark):
    rows = packing.packed(frame(spark), WORD, with_ids=True).collect()
    check_packing(rows, 4096)
    got = defaultdict(dict)
    for r in rows:
        got[r.doc_id][r.piece] = r
        assert (zlib.crc32(bytes(r.ids)), len(r.ids)) == (r.ids_crc32, 4 * r.length)
        assert r.length == 4096 or r.piece == max(x.piece for x in rows if x.doc_id == r.doc_id)
    for i, ids in enumerate(library(WORD, 1)):
        parts = [got[i][k] for k in range(len(got[i]))]
        assert [p.start for p in parts] == list(range(0, len(ids), 4096))
        assert np.frombuffer(b"".join(bytes(p.ids) for p in parts), "<u4").tolist() == ids
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string"), WORD).collect() == []


def test_packing_with_a_hot_length_equals_best_fit_decreasing(spark):
    rng = random.Random(2)
    lengths = [rng.randrange(1, 101) for _ in range(2000)] + [37] * 1000
    rows = [(i if i % 50 else None, 0, n, 5) for i, n in enumerate(lengths)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, piece int, length long, ids_crc32 long"), 100).collect()
    assert len(out) == 3000
    assert check_packing(out, 100) == len(plain_gaps(lengths, 100))


def test_match_equals_best_fit_decreasing(spark):
    rng = random.Random(4)
    cases = [[rng.randrange(1, 21) for _ in range(60)], [20] * 5, [1] * 47, [7, 7, 7, 6, 6, 14, 13, 3, 3, 1], [11, 9] * 30 + [10] * 7]
    for lengths in cases:
        counts = spark.createDataFrame(sorted(Counter(lengths).items()), "length long, n long")
        filled, placed = defaultdict(list), Counter()
        for r in packing.match(counts, 20, ranges=3).collect():
            placed[r.length] += r.n
            for k in range(r.n):
                filled[r.sequence + k // r.per].append((r.offset + k % r.per * r.length, r.length))
        assert placed == Counter(lengths) and len(filled) == len(plain_gaps(lengths, 20))
        for spans in filled.values():
            at = 0
            for offset, length in sorted(spans):
                assert offset == at
                at += length
            assert at <= 20
    assert packing.match(spark.createDataFrame([], "length long, n long"), 20).collect() == []


def test_a_range_is_swept_by_itself():
    runs = [("g", 9, 0, 2, 0, 0, 0), ("g", 7, 2, 1, 0, 0, 0), ("d", 8, 0, 1, 0, 0, 0), ("d", 6, 0, 4, 0, 0, 0), ("d", 5, 3, 1, 0, 0, 0)]
    got = sorted(packing.sweep(runs, 12, 5))
    assert got == sorted([("m", 8, 0, 1, 0, 3, 1), ("u", 1, 0, 1, 0, 0, 0), ("m", 6, 0, 1, 2, 5, 1), ("u", 1, 2, 1, 0, 0, 0), ("m", 6, 1, 1, 1, 3, 1), ("u", 3, 1, 1, 0, 0, 0), ("d", 6, 2, 2, 0, 0, 0), ("d", 5, 3, 1, 0, 0, 0)])
