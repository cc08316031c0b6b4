import random
import re

import xxhash

from quarrystone.llm import simhash


def plain_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if bin(fps[a] ^ fps[b]).count("1") <= 3:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: find(i) for i in ids}


def test_whole_table_against_brute_force(spark):
    rng = random.Random(7)
    words = ["ab", "Cd", "éf", "gh", "ij", "kl", "mn o"]
    base = " ".join(rng.choice(words) for _ in range(400)).split(" ")
    texts = [None, "", " \t\n", "one", "One", "one two", "x" * 50_000, " ".join(base * 40)]
    for _ in range(40):
        copy = list(base)
        copy[rng.randrange(400)] = "new%d" % rng.randrange(9)
        texts.append(rng.choice([" ", "\n"]).join(copy))
    texts += [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 30))) for _ in range(60)] + texts[5:12]
    docs = spark.createDataFrame([(i, t, "fp", 1) for i, t in enumerate(texts)], "doc_id long, text string, fp string, key int")
    want = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    for group in (1024, 3):
        got = {r.doc_id: r for r in simhash.near_duplicates(docs, group=group).collect()}
        assert {i: int(r.fingerprint, 16) for i, r in got.items()} == want
        assert {i: r.component_id for i, r in got.items()} == plain_components(want)


def test_dense_ball_is_refined(spark):
    rng = random.Random(3)
    fps = {0x0123456789ABCDEF}
    while len(fps) < 120:
        f = rng.choice(sorted(fps))
        for _ in range(rng.randrange(1, 5)):
            f ^= 1 << rng.randrange(64)
        fps.add(f)
    ids = dict(enumerate(sorted(fps)))
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in ids.values()]
    found = simhash.links(spark.createDataFrame(signed, "fp long"), group=2).collect()
    back = {(f - (1 << 64) if f >> 63 else f): i for i, f in ids.items()}
    root = {i: i for i in ids}
    for _ in ids:
        for r in found:
            a, b = back[r.a], back[r.b]
            root[a] = root[b] = min(root[a], root[b])
    assert root == plain_components(ids)


def test_empty_repeated_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    docs = spark.createDataFrame([(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (2, "A B C D"), (None, "zz yy xx ww vv")], schema)
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 2), (5, 2), (None, 2), (2, 2), (None, None)], key=str)
    twice = spark.createDataFrame([(9, "q r s t u"), (9, "q r s t u"), (10, "Q R S T U")], schema)
    assert [tuple(r) for r in simhash.deduplicated(twice).collect()] == [(9, "q r s t u")]
    kept = simhash.deduplicated(docs.withColumn("fingerprint", docs.text))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(2, "A B C D"), (None, "zz yy xx ww vv")], key=str)


def test_one_id_with_different_texts_and_links_through_a_row_without_id(spark):
    rows = [(1, "q r s t u", "b"), (1, "q r s t u", "a"), (1, "quite another text of its own", "c"), (None, "third text without any id here", "d"), (None, "third text without any id here", None)]
    kept = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, root string"))
    assert kept.columns == ["doc_id", "text", "root"]
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[1], rows[2], rows[4]], key=str)
    schema = "doc_id long, text string"
    assert simhash.deduplicated(spark.createDataFrame([], schema)).collect() == []
    # a fingerprint between two others, three bits from either: only its null row joins them
    bridge = spark.createDataFrame([(4, 0, 0b111), (None, 0, 0), (3, 0, 0b111000), (8, 0, 1 << 40 | 0b1111 << 50)], "doc_id long, h long, fp long")
    found = {r.fp: r.root for r in simhash._components(bridge, 1024).collect()}
    assert found.keys() == {0b111, 0, 0b111000} and len(set(found.values())) == 1


def test_any_other_columns(spark):
    rows = [(1, "q r s t u", 5, 6, 7, {"a": 1}, b"x"), (1, "q r s t u", 5, 6, 7, {"a": 0}, b"x"), (1, "q r s t u", 5, 6, 7, None, b"y"), (2, "Q R S T U", 0, 0, 0, None, None), (3, "another text of its own here", 1, 1, 1, {}, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id int, _h long, _rows int, _kept map<string,int>, fp binary")
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted((tuple(r) for r in kept.collect()), key=str) == sorted([rows[2], rows[4]], key=str)
