"""Search keeps nothing that grows with queries times documents, and gives what plain versions give."""

import math
import random

from pyspark.sql import functions as F

from quarrystone.operators import search


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scores_are_added_up_where_documents_lie(spark):
    docs = spark.createDataFrame([(i, f"alpha word{i % 3}") for i in range(20)], "doc_id long, text string")
    queries = spark.createDataFrame([(q, "alpha word1") for q in range(5)], "qid long, query string")
    plan = _plan(search.bm25(docs, queries))
    assert not [line for line in plan.splitlines() if "hashpartitioning(qid" in line and " id#" in line]
    assert search.bm25(docs, queries).count() == 100


def test_hybrid_ranking_stores_no_score_of_every_pair(spark, monkeypatch):
    sizes, settled = [], search.settled

    def counted(df):
        out = settled(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(search, "settled", counted)
    chunks = spark.createDataFrame([(i, f"alpha word{i % 3}", "clause", 1) for i in range(200)], "doc_id long, text string, chunk_type string, page int")
    vectors = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(200)], "id long, v array<float>")
    queries = spark.createDataFrame([(q, "alpha word1" if q % 2 else "word2", [1.0, float(q)]) for q in range(40)], "qid long, query string, q array<float>")
    got = search.hybrid_topk(chunks, vectors, queries, 2).collect()
    assert len(got) == 80 and max(sizes) < 1000  # 40 queries and 200 chunks: 5334 scores


def test_nearest_vectors_by_brute_force(spark):
    r = random.Random(3)
    odd = [None, [], [1.0], [1.0, None, 2.0], [math.nan, 0.0, 1.0], [math.inf, 1.0, 1.0], [1e200, 1.0, 1.0]]
    rows = [(i, odd[i % 40] if i % 40 < len(odd) and i < 80 else [r.choice((0.5, -0.25, r.random())) for _ in range(3)]) for i in range(400)]
    rows += [(i, [0.1, 0.7, 0.3]) for i in range(400, 460)]
    vectors = spark.createDataFrame(rows, "id long, v array<double>")
    asked = spark.createDataFrame([(q, v) for q, v in rows if q % 9 == 0], "qid long, q array<double>")
    pairs = vectors.crossJoin(asked).select("qid", "id", F.round(search.dot(F.col("v"), F.col("q")), 6).alias("score"))
    for k, block, shard in ((3, 10, 50), (450, 100, 1000)):
        got, want = (sorted(map(str, df.select("qid", "id", "score", "rank").collect())) for df in (search.vector_topk(vectors, asked, k, block, shard), search.ranked(pairs, k)))
        assert got == want
    assert "NestedLoop" not in _plan(search.vector_topk(vectors, asked, 3))


def test_bm25_ranking_reads_each_text_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    docs = spark.createDataFrame([(i, f"alpha word{i % 3}") for i in range(60)], "doc_id long, text string").repartition(16).mapInArrow(counted, "doc_id long, text string")
    queries = spark.createDataFrame([(q, "alpha word1") for q in range(5)], "qid long, query string")
    assert len(search.bm25_topk(docs, queries, 4).collect()) == 20
    assert read.value == 60


def test_bm25_ranking_by_joins_and_by_brute_force(spark, monkeypatch):
    r = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "çelik", "x1", "rare"]
    texts = [None, "", "a b", "beta", *(" ".join(r.choices(words, [9, 5, 5, 3, 2, 2, 1], k=r.randrange(1, 12))) for _ in range(150))]
    rows = [(i - i % 7 if i % 20 == 0 else i, text) for i, text in enumerate(texts + ["gamma gamma rare"] * 40)]  # some ids twice, many copies
    asked = [(1, "alpha beta beta"), (2, "Rare gamma"), (3, "absent"), (4, None), (5, "çelik rare x1 delta"), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    queries = spark.createDataFrame(asked, "qid long, query string")
    told = [(i, t.split()) for i, t in rows if t]
    told = [(i, [w for w in ws if len(w) > 1]) for i, ws in told]
    avgdl = sum(len(ws) for _, ws in told) / sum(t is not None for _, t in rows)
    hits = {}
    for i, ws in told:
        for w in ws:
            hits[i, w, len(ws)] = hits.get((i, w, len(ws)), 0) + 1
    want = []
    for q, query in asked:
        scores = {}
        for w in (query or "").lower().split():
            df = sum(x == w for _, x, _ in hits)
            for (i, x, dl), tf in hits.items():
                if x == w:
                    scores[i] = scores.get(i, 0) + math.log((len(rows) - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))
        best = sorted((-round(s, 6), i) for i, s in scores.items())[:6]
        want += [(q, i, -s, rank) for rank, (s, i) in enumerate(best, 1)]
    for name, value in (("SCORES", 1 << 22), ("SCORES", 40), ("BROADCAST_TERMS", 0)):
        monkeypatch.setattr(search, name, value)
        got = sorted((x.qid, x.id, x.score, x["rank"]) for x in search.bm25_topk(docs, queries, 6).collect())
        assert [(q, i, n) for q, i, _, n in got] == [(q, i, n) for q, i, _, n in sorted(want, key=lambda x: (x[0], x[1]))]
        assert all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(got, sorted(want, key=lambda x: (x[0], x[1])), strict=True))
    nothing = spark.createDataFrame([(1, None)], "doc_id long, text string")
    monkeypatch.undo()
    assert search.bm25_topk(nothing, queries, 6).collect() == search.bm25_topk(docs, queries.limit(0), 6).collect() == []
