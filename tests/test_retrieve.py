import re

import pytest

from quarrystone.plans import queries
from quarrystone.operators import bundle, search
from quarrystone.operators.retrieve import retrieve, telemetry
from quarrystone.sources.store import with_defaults


def test_each_query_takes_one_way(spark):
    rows = [
        ("d", 0, 0, 1, "[Article 21] Life\nNo person shall be deprived of life.", "article", "21", "", "", ""),
        ("d", 1, 1, 1, "(2) Nothing here applies to courts.", "clause", "", "", "", ""),
        ("d", 2, 2, 9, "31. Posts and telegraphs.", "generic", "", "VII", "I", "31"),
        ("d", 3, 3, 20, "The rivers and the lakes of a land.", "generic", "", "", "", ""),
    ]
    names = "doc_id string, chunk_id int, chunk_pos long, page int, text string, chunk_type string, article_id string, schedule_id string, list_id string, entry_id string"
    chunks = with_defaults(spark.createDataFrame(rows, names))
    vectors = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(4)], "id long, v array<float>")
    queries = spark.createDataFrame([(1, "What does Article 21 say?", [1.0, 0.0]), (2, "entry 31 of the Union List", [1.0, 0.0]), (3, "entry 31", [1.0, 0.0]), (4, "rivers and lakes", [0.0, 1.0])], "qid long, query string, q array<float>")
    got = sorted((r.qid, r.rank, r.chunk_pos, r.method) for r in retrieve(chunks, vectors, queries, 2).collect())
    assert got[:4] == [(1, 1, 0, "identifier"), (1, 2, 1, "identifier"), (2, 1, 2, "identifier"), (3, 1, 2, "identifier")]
    assert got[4][:3] == (4, 1, 3) and {g[3] for g in got[4:]} == {"hybrid"} and len(got) == 6


def test_structure_fills_up_behind_articles_and_notes_stand_in(spark):
    rows = [
        ("d", 0, 0, 1, "[Article 21] Life\nNo person shall be deprived of life.", "article", "21", "", "", ""), ("d", 1, 1, 1, "[Article 22] Arrest\n(1) Grounds.", "article", "22", "", "", ""),
        ("d", 2, 2, 9, "31. Posts.", "generic", "", "VII", "I", "31"), ("d", 3, 3, 9, "31. Roads.", "generic", "", "VII", "II", "31"), ("d", 4, 4, 9, "Union List", "heading", "", "VII", "I", ""), ("d", 5, 5, 9, "31. Posts again.", "generic", "", "VII", "I", "31"),
    ]
    names = "doc_id string, chunk_id int, chunk_pos long, page int, text string, chunk_type string, article_id string, schedule_id string, list_id string, entry_id string"
    chunks = with_defaults(spark.createDataFrame(rows, names))
    vectors = spark.createDataFrame([(i, [1.0]) for i in range(6)], "id long, v array<float>")
    asked = ["Articles 22 and 21 with Entry 31 of List I and of List II", "What was substituted in Article 21", "Entry 31 of the Union List or the State List", "the Seventh Schedule", "Entry 31"]
    queries = spark.createDataFrame([(i, q, [1.0]) for i, q in enumerate(asked)], "qid long, query string, q array<float>")
    results = retrieve(chunks, vectors, queries, 3)
    got = {i: [(r.chunk_pos, r.synthetic) for r in results.orderBy("rank").collect() if r.qid == i] for i in range(5)}
    assert [c for c, _ in got[0]] == [1, 0, 2]
    assert got[1] == [(-1, True)]
    assert [c for c, _ in got[2]] == [2, 3, 5]
    assert [c for c, _ in got[3]] == [2, 3, 4] and [c for c, _ in got[4]] == [2, 3, 5]
    told = {r.qid: r for r in telemetry(results.withColumns({"page": results.chunk_pos, "page_start": results.chunk_pos}), queries).collect()}
    assert told[1].method == "identifier" and told[1].n == 1 and told[1].top == "p-1/amendment/art21/s1.0"


def test_every_orders_question_takes_its_way(spark):
    d = "/root/testdata/sf0.001"
    found = {}
    for r in queries.routed_questions(spark, d).collect():
        found.setdefault(r["qid"], []).append(r)
    last = spark.read.parquet(f"{d}/part.parquet").count() // 8
    seen = 0
    for r in spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey").collect():
        n = r["o_orderkey"]
        got, nth = sorted(found.get(2 * n, []), key=lambda x: x["rank"]), n % 390
        if n >= 390 or not 0 < nth < last - 8:
            continue
        seen += 1
        own = lambda k: list(range(8 * k, 8 * k + 6))  # noqa: E731  the heading, its clauses, and the one without an article
        if n % 3 == 1:
            assert [(x["chunk_pos"], x["chunk_type"], x["synthetic"]) for x in got] == [(8 * nth + 6, "amendment", False)]
        else:
            assert [x["chunk_pos"] for x in got] == (own(nth) if n % 3 == 0 else own(nth) + own(nth + 7)) and {x["method"] for x in got} == {"identifier"}
            assert got[0]["text"].startswith(f"{nth + 1}. Of ")
    assert seen > 8
    texts = [x for qid, own in found.items() if qid % 2 for x in own]
    assert texts and {x["method"] for x in texts} == {"hybrid"} and max(x["rank"] for x in texts) <= 8


def test_benchmark_texts_are_asked_whole(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    monkeypatch.setattr(queries.retrieve, "retrieve", lambda chunks, vectors, asked: asked)
    got = {r["qid"]: r["query"] for r in queries.routed_questions(spark, d).where("qid % 2 = 1").collect()}
    assert got == {2 * r["item_id"] + 1: r["text"] for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()}
    assert max(map(len, got.values())) > 200


def _broadcast_whole(plan):
    """Scans of chunks or of their words that a broadcast takes as they are: neither joined nor counted first."""
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = next((x for x in lines[i + 1 :] if re.search("Scan|Join|Aggregate|Union|Window", x)), "")
            if re.search(r"Scan.*\b(chunk_pos|tf)#", below):
                yield below


@pytest.mark.parametrize("named", (True, False))
def test_no_join_sends_the_store_to_the_driver(spark, monkeypatch, tmp_path, named):
    plans = []
    told = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    for module in (bundle, search, queries.retrieve):
        monkeypatch.setattr(module, "settled", lambda df, f=module.settled: told(df) or f(df))
    shape = ("'d' AS doc_id", "CAST(id AS INT) AS chunk_id", "id AS chunk_pos", "1 AS page", "concat(id % 9 + 1, '. Title.-(1) Text ', id) AS text", "'article' AS chunk_type", "CAST(id % 9 + 1 AS STRING) AS article_id", "'' AS schedule_id", "'' AS list_id", "'' AS entry_id")
    spark.range(50).selectExpr(*shape).write.parquet(str(tmp_path / "store"))
    chunks = with_defaults(spark.read.parquet(str(tmp_path / "store")))
    vectors = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(50)], "id long, v array<float>")
    asked = spark.createDataFrame([(q, f"Article {q + 1}" if named else f"title text {q}", [1.0, 0.5]) for q in range(3)], "qid long, query string, q array<float>")
    found = retrieve(chunks, vectors, asked, 2)
    told(found)
    assert found.count() >= 3 and len(plans) > 5
    assert [x for plan in plans for x in _broadcast_whole(plan)] == []


def test_queries_of_one_text_are_answered_once(spark, monkeypatch):
    seen, bundles = [], bundle.bundles
    monkeypatch.setattr(bundle, "bundles", lambda chunks, wanted: seen.append(wanted.count()) or bundles(chunks, wanted))
    names = "doc_id string, chunk_id int, chunk_pos long, page int, text string, chunk_type string, article_id string, schedule_id string, list_id string, entry_id string"
    chunks = with_defaults(spark.createDataFrame([("d", i, i, 1, f"{i + 1}. Title.-(1) Text {i}.", "article", str(i + 1), "", "", "") for i in range(3)], names))
    vectors = spark.createDataFrame([(i, [1.0]) for i in range(3)], "id long, v array<float>")
    asked = spark.createDataFrame([(q, f"Article {q % 3 + 1}" if q < 9 else "title text", [] if q < 9 else [1.0]) for q in range(11)], "qid long, query string, q array<float>")
    got = sorted((r.qid, r.rank, r.chunk_pos) for r in retrieve(chunks, vectors, asked, 2).collect())
    assert seen == [3] and got[:9] == [(q, 1, q % 3) for q in range(9)]
    assert [(q - 9, *x) for q, *x in got[9:] if q == 9] == [(q - 10, *x) for q, *x in got[9:] if q == 10] and len(got) == 13
