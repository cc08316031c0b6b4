import random
import re
from collections import defaultdict

from quarrystone.llm import mixing


def plain_targets(size, weights=(5, 2, 1), most=3):
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    clamped = set()
    while True:
        left = sum(size.values()) - sum(most * size[s] for s in clamped)
        open_ = sum(weight[s] for s in size if s not in clamped)
        goal = {s: most * size[s] if s in clamped else weight[s] * left / open_ for s in size}
        over = {s for s in size if s not in clamped and goal[s] > most * size[s]}
        if not over:
            return goal
        clamped |= over
        if clamped == set(size):
            return {s: most * size[s] for s in size}


def check(spark, rows, bucket):
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, taken string, whole int")
    out = mixing.mix(docs, bucket=bucket).collect()
    assert len(out) == len(rows)
    words = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[2] or "")) for r in rows}
    source = {r[0]: r[1] for r in rows}
    size = defaultdict(int)
    for r in rows:
        size[r[1]] += words[r[0]]
    goal = plain_targets(size)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in out:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (words[r.doc_id], size[s])
        assert abs(r.target - goal[s]) < 1e-6 * max(1, goal[s])
        assert 0 <= r.repeats <= 3 and r.taken == r.repeats * r.size
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s in size:
        assert abs(taken[s] - goal[s]) <= largest[s] / 2 + 1e-6
    again = mixing.mix(docs, bucket=10**9).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in out)
    mix = mixing.mixed(docs, bucket=bucket)
    assert mix.columns == docs.columns
    times = defaultdict(int)
    for r in mix.collect():
        times[r.doc_id] += 1
    assert dict(times) == {r.doc_id: r.repeats for r in out if r.repeats}


def test_against_plain_water_filling(spark):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        source = rng.choice(["big"] * 5 + ["b", "é", "Z", None, "tiny", "empty"])
        n = 0 if source == "empty" else rng.randrange(1, 4) if source == "tiny" else rng.randrange(30)
        rows.append((i, source, rng.choice([" ", "\n", "\t "]).join(["w%d" % i] * n) or rng.choice([None, "", " \n"]), "x", 1))
    check(spark, rows, 7)


def test_one_source_ties_nulls_and_no_rows(spark):
    check(spark, [(i, "only", "a b c", "x", 1) for i in range(20)], 3)
    schema = "doc_id long, source string, text string"
    assert mixing.mix(spark.createDataFrame([], schema)).collect() == []
    assert mixing.mixed(spark.createDataFrame([], schema)).collect() == []
    blank = spark.createDataFrame([(1, None, None), (2, "a", " ")], schema)
    assert [(r.size, r.target, r.taken) for r in mixing.mix(blank).collect()] == [(0, 0.0, 0)] * 2
    same = spark.createDataFrame([(None, "a", "x y"), (None, "a", "x y"), (3, "a", "x y"), (3, "a", "x y")], schema)
    assert sum(r.taken for r in mixing.mix(same).collect()) == 8


def test_any_other_columns(spark):
    rows = [(i, "s" if i % 3 else "t", "a b c", 1, 2, 3, 4, 5, {"k": i}) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, _whole int, _cutoff int, _source int, _times int, _mix int, whole map<string,int>")
    taken = {r.doc_id: r.repeats for r in mixing.mix(docs, bucket=4).collect()}
    mix = mixing.mixed(docs, bucket=4)
    assert mix.columns == docs.columns
    assert sorted(map(str, mix.collect())) == sorted(str(r) for r in docs.collect() for _ in range(taken[r.doc_id]))
