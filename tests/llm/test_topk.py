import math
import random

import numpy as np

from quarrystone.llm import topk
from quarrystone.llm.common import written


def plain(rows, k):
    fine = [(i, [math.floor(64 * np.float32(x).astype(float)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(fine):
        if i % 20 == 0:
            scored = sorted((-sum(x * y for x, y in zip(q, v, strict=False)), j) for b, (j, v) in enumerate(fine) if a != b)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.1, 0.9]) if i % 3 else rng.gauss(0, 1) for _ in range(6)]) for i in range(300)]
    rows += [(300, None), (301, [1.0, None]), (320, [float("nan"), 1.0]), (321, [float("inf")]), (None, [1.0] * 6), (340, []), (341, [2.0, 1.0]), (342, [0.5] * 9), (7, rows[7][1]), (20, rows[20][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.search(df).collect())) == plain(rows, 20)
    small = written(topk.quantised(df), "small")
    got = topk.top_k(small.where("vec_id % 20 = 0"), small, k=20, shard=50, group=3)
    assert sorted(map(tuple, got.collect())) == plain(rows, 20)


def test_blocks_are_pruned_without_loss():
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 40, (20, 16))
    m = np.floor(centres[rng.integers(0, 20, 6000)] + rng.normal(0, 2, (6000, 16))).astype(np.int64)
    ids = np.arange(6000)
    rows, found, scores, scored = topk.search_shard(ids[:40], m[:40], ids, ids, m, 10)
    for i in range(40):
        s = m @ m[i]
        want = [j for j in np.lexsort((ids, -s)) if j != i][:10]
        mine = np.flatnonzero(rows == i)
        assert sorted(zip(-scores[mine], found[mine], strict=True)) == [(-s[j], j) for j in want]
    assert scored < 0.5 * 40 * -(-6000 // topk.BLOCK)


def test_large_values_few_rows_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.search(spark.createDataFrame([], schema)).collect() == []
    assert topk.search(spark.createDataFrame([(20, [1.0])], schema)).collect() == []
    big = spark.createDataFrame([(20, [3e38, 1.0]), (1, [3e38, -1.0]), (2, [-3e38, 0.0])], schema)
    assert [(r.vec_id, r.score) for r in topk.search(big).orderBy("rank").collect()] == [(1, 2**63 - 1), (2, -(2**63))]
