import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrystone.llm import boosted_trees, queries


def walked(trees, row):
    """One row down all trees, node by node."""
    total = trees.base
    for feature, limit, leaf in zip(trees.feature, trees.limit, trees.leaf, strict=True):
        node = 0
        while node < len(feature):
            node = 2 * node + (2 if row[feature[node]] > limit[node] else 1)
        total += leaf[node - len(feature)]
    return 1 / (1 + np.exp(-total))


def points(n=600):
    r = np.random.default_rng(2)
    rows = r.normal(size=(n, 4))
    return rows, ((rows[:, 0] > 0.2) ^ (rows[:, 2] > 0)).astype(np.int64)


def test_trees_learn_and_walk_as_a_plain_walk_does():
    rows, labels = points()
    trees = boosted_trees.fit(rows, labels, np.ones(len(rows)))
    scores = trees.scores(rows)
    assert ((scores >= 0.5) == labels).mean() > 0.98
    assert np.allclose(scores, [walked(trees, x) for x in rows])


def test_a_split_is_the_best_of_all_limits():
    rows, labels = points(40)
    bins, edges = boosted_trees._binned(rows)
    slope, curve = labels - 0.5, np.full(len(labels), 0.25)
    feature, limit, leaf, place = boosted_trees._grown(bins, edges, slope, curve, 1)

    def gain(f, at):
        left = rows[:, f] <= at
        return sum(slope[x].sum() ** 2 / (curve[x].sum() + boosted_trees.DAMP) for x in (left, ~left)) if min(curve[left].sum(), curve[~left].sum()) >= boosted_trees.LEAF else -1

    best = max(gain(f, at) for f in range(4) for at in edges[f])
    assert gain(feature[0], limit[0]) == pytest.approx(best)
    assert np.allclose(leaf[place], [slope[place == k].sum() / (curve[place == k].sum() + boosted_trees.DAMP) for k in place])


@pytest.mark.parametrize("labels", ([], [1, 1, 1], [0]))
def test_one_label_or_none_gives_a_share(labels):
    trees = boosted_trees.fit(np.zeros((len(labels), 3)), np.array(labels, np.int64), np.ones(len(labels)))
    assert np.allclose(trees.scores(np.zeros((2, 3))), (sum(labels) + 1) / (len(labels) + 2))


def test_statistics_of_one_text_do_not_depend_on_others():
    values = [b"", b"one two\n\nTHREE!! | #four", " \té è\n".encode(), b"a b " * 5000, b"x" * 100_000]
    whole = boosted_trees.statistics(values)
    assert whole.shape == (5, boosted_trees.N_STATISTICS) and np.isfinite(whole).all()
    assert np.array_equal(whole, np.concatenate([boosted_trees.statistics([v]) for v in values]))
    assert not whole[0].any()


def corpus(spark):
    r = random.Random(1)
    words = lambda n: " ".join(r.choice(("river", "stone", "walks", "under", "light", "evening")) + r.choice(("", ".", ",")) for _ in range(n))
    good = [(i, words(r.randrange(30, 90)), 1) for i in range(0, 400, 2)]
    bad = [(i, " | ".join(words(40).upper().split()) + "!! $$$", 0) for i in range(1, 400, 2)]
    rows = [(i, t, "x") for i, t, _ in good + bad] + [(1000, None, "x"), (1001, "", "x"), (None, "a river.", None), (2, good[1][1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in good + bad] + [(None, 1, 0), (5000, 0, 1), (2, None, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_held_out_rows_are_told_apart_and_never_learned_from(spark, tmp_path):
    docs, labels = corpus(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    out = queries.op11_boosted_trees(spark, str(tmp_path)).collect()
    assert len(out) == docs.count()
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(400)}
    for r in out:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        if r["doc_id"] is not None and r["doc_id"] < 400:
            assert r["predicted"] == 1 - r["doc_id"] % 2
    turned = labels.withColumn("quality", F.when(F.col("doc_id").isin([i for i, h in held.items() if h]), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r["doc_id"]: r["score"] for r in boosted_trees.classify(docs, turned).collect()}
    assert again == {r["doc_id"]: r["score"] for r in out}


def test_no_labels_and_no_rows(spark):
    docs, labels = corpus(spark)
    assert {r["score"] for r in boosted_trees.classify(docs.limit(3), labels.limit(0)).collect()} == {0.5}
    assert boosted_trees.classify(docs.limit(0), labels).collect() == []
