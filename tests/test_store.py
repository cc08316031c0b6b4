import json

import pytest
from pyspark.sql import functions as F

from quarrystone.operators import index
from quarrystone.sources import store
from quarrystone.streaming.ingest import ingest, ingest_into, store_batch


def test_snapshots_flip_and_refuse_a_wrong_count(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0, "x Article 5", 1), ("a", 1, "y", 1), ("b", 0, "z", 2)], "doc_id string, chunk_id int, text string, page int")
    chunks = store.numbered(rows)
    assert sorted(r.chunk_pos for r in chunks.collect()) == [0, 1, 2]
    full = store.with_defaults(chunks)
    manifest = spark.createDataFrame([("a", "f", "h", 1, 2, None), ("b", "g", "i", 1, 1, None)], store.MANIFEST)
    kept = store.Store(spark, str(tmp_path / "s"))
    assert kept.current() is None
    assert kept.save(full, index.build_postings(full), manifest) == "snapshot-0"
    assert kept.save(full, index.build_postings(full), manifest) == "snapshot-1"
    assert kept.read("chunks").count() == 3 and kept.read("chunks").where("chunk_type = 'generic' and article_id = ''").count() == 3
    with pytest.raises(ValueError):
        kept.save(full.limit(1), index.build_postings(full), manifest)
    assert kept.current() == "snapshot-1"
    assert [r.doc_id for r in store.without_document(kept.read("manifest"), "h").collect()] == ["b"]


def test_append_writes_only_what_is_new(spark, tmp_path):
    kept = store.Store(spark, str(tmp_path / "s"))
    schema = "doc_id string, chunk_id int, text string, page int"
    add = lambda doc, n: (store.with_defaults(store.numbered(spark.createDataFrame([(doc, i, f"{doc}{i} Article 5", 1) for i in range(n)], schema), kept.next_position())), spark.createDataFrame([(doc, "f", f"h{doc}", 1, n, None)], store.MANIFEST))
    for doc, n in (("a", 2), ("b", 3)):
        rows, manifest = add(doc, n)
        kept.append(rows, index.build_postings(rows), manifest)
    assert kept.current() == "snapshot-1" and kept.size() == 5
    assert sorted((r.doc_id, r.chunk_pos) for r in kept.read("chunks").collect()) == [("a", 0), ("a", 1), ("b", 2), ("b", 3), ("b", 4)]
    assert kept.read("postings").where("kind = 'tag'").count() == 5
    rows, _ = add("c", 2)
    with pytest.raises(ValueError):
        kept.append(rows, index.build_postings(rows), add("c", 1)[1])
    assert kept.delete("ha") == "snapshot-2" and [r.doc_id for r in kept.read("manifest").collect()] == ["b"] and kept.read("chunks").count() == 3
    (tmp_path / "s" / "snapshots" / "_left").write_text("{")  # a writer that was lost before its snapshot had a place
    assert store.Store(spark, str(tmp_path / "s")).current() == "snapshot-2"


def _added(spark, kept, doc, n):
    rows = spark.createDataFrame([(doc, i, f"{doc}{i} Article 5", 1) for i in range(n)], "doc_id string, chunk_id int, text string, page int")
    full = store.with_defaults(store.numbered(rows, kept.next_position()))
    return full, index.build_postings(full), spark.createDataFrame([(doc, "f", f"h{doc}", 1, n, None)], store.MANIFEST)


def test_positions_are_never_used_again(spark, tmp_path):
    kept = store.Store(spark, str(tmp_path / "s"))
    kept.save(*_added(spark, kept, "a", 3))
    kept.append(*_added(spark, kept, "b", 2))
    kept.delete("ha")
    kept.append(*_added(spark, kept, "c", 2))
    assert sorted((r.doc_id, r.chunk_pos) for r in kept.read("chunks").collect()) == [("b", 3), ("b", 4), ("c", 5), ("c", 6)]
    assert sorted(r.chunk_pos for r in kept.read("postings").where("kind = 'tag'").collect()) == [3, 4, 5, 6]
    kept.delete("hc")
    assert kept.next_position() == 7 and kept.size() == 2
    again = store.with_defaults(store.numbered(spark.createDataFrame([("d", 0, "t", 1)], "doc_id string, chunk_id int, text string, page int"), kept.size()))
    with pytest.raises(ValueError):  # counted from what is left
        kept.append(again, index.build_postings(again), spark.createDataFrame([("d", "f", "hd", 1, 1, None)], store.MANIFEST))
    kept.append(*_added(spark, kept, "a", 1))  # a document that comes again is not the deleted one
    before = sorted(map(str, kept.read("chunks").collect()))
    kept.compact()
    assert sorted(map(str, kept.read("chunks").collect())) == before and kept.next_position() == 8
    assert spark.read.parquet(*(f"{tmp_path}/s/{n}/chunks" for n in kept._state()["chunks"])).count() == 3


def test_of_two_writers_one_wins(spark, tmp_path):
    one, other = (store.Store(spark, str(tmp_path / "s")) for _ in range(2))
    one.save(*_added(spark, one, "a", 1))
    rows, late = _added(spark, other, "b", 1), other._state()
    one.append(*_added(spark, one, "c", 2))
    with pytest.raises(RuntimeError):
        other._point(late, chunks=[other._written(*rows)])
    assert sorted(r.doc_id for r in other.read("chunks").collect()) == ["a", "c", "c"]
    with pytest.raises(ValueError):  # its positions are taken by now
        other.append(*rows)
    other.append(*_added(spark, other, "b", 1))
    assert sorted(r.chunk_pos for r in one.read("chunks").collect()) == [0, 1, 2, 3]


def test_a_stream_fills_a_store_once(spark, tmp_path):
    source, mark = str(tmp_path / "in"), str(tmp_path / "mark")
    kept = store.Store(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([(1, "word " * 60, "a"), (2, "word " * 60, "b"), (3, "See Article 5. " * 100, "c"), (4, None, "d")], "doc_id long, text string, filename string")
    rows.write.parquet(source)
    run = lambda: ingest_into(spark.readStream.schema(rows.schema).parquet(source), kept, mark).awaitTermination()
    run()
    assert kept.batch("documents") == 0 and sorted(r.doc_id for r in kept.read("manifest").collect()) == ["1", "3"]
    first = sorted(map(str, kept.read("chunks").collect()))
    store_batch(kept, "documents")(rows, 0)  # the batch runs again after a crash
    assert sorted(map(str, kept.read("chunks").collect())) == first and kept.current() == "snapshot-0"
    more = rows.withColumn("doc_id", F.col("doc_id") + 10).union(spark.createDataFrame([(20, "another text " * 30, "e")], rows.schema))
    more.write.mode("append").parquet(source)
    run()
    assert sorted(r.doc_id for r in kept.read("manifest").collect()) == ["1", "20", "3"]
    assert kept.read("chunks").select("chunk_pos").distinct().count() == kept.read("chunks").count() == kept.size() == kept.next_position()


def test_evaluation_items_and_reports(spark, tmp_path):
    item = {"id": "e1", "category": "direct_article", "query": "Article 21?", "expected_article_ids": ["21"], "retrieval_pass_criteria": {"exact_article_set": ["21"]}, "expected_mode": {"amendment_expected": False}, "answer_pass_criteria": {"prompt_must_contain": ["CONTEXT"]}}
    (tmp_path / "items.json").write_text(json.dumps([item]), encoding="utf-8-sig")
    got = store.read_eval_items(spark, str(tmp_path / "items.json"))
    r = got.first()
    assert (r.id, r.required_article_ids, r.exact_article_set, r.amendment_expected, r.synthetic_only_expected, r.prompt_must_contain) == ("e1", ["21"], ["21"], False, None, ["CONTEXT"])
    store.write_report(got, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).first().id == "e1"


def test_json_with_a_byte_order_mark(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"doc_id": "a", "text": "t", "page": 3}]), encoding="utf-8-sig")
    (tmp_path / "i.json").write_text(json.dumps({"articles": {"21": [0, 4]}, "tags": {}}), encoding="utf-8-sig")
    (tmp_path / "e.json").write_text("[]", encoding="utf-8-sig")
    assert store.read_metadata(spark, str(tmp_path / "m.json")).select("doc_id", "page").collect() == [("a", 3)]
    assert store.read_metadata(spark, str(tmp_path / "e.json")).collect() == []
    assert sorted(map(tuple, store.read_index(spark, str(tmp_path / "i.json")).collect())) == [("articles", "21", 0), ("articles", "21", 4)]


def test_stream_takes_each_content_once(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    rows = spark.createDataFrame([(1, "word " * 60), (2, "word " * 60), (3, "other " * 300)], "doc_id long, text string")
    rows.write.parquet(source)
    run = lambda: ingest(spark.readStream.schema(rows.schema).parquet(source), out, mark).awaitTermination()
    run()
    rows.withColumn("doc_id", F.col("doc_id") + 10).write.mode("append").parquet(source)
    run()
    got = spark.read.parquet(out)
    assert got.select("file_hash").distinct().count() == 2 and got.where("doc_id > 10").count() == 0
    assert [r.chunk_id for r in got.where("doc_id = 3").orderBy("chunk_id").collect()][:2] == [0, 1]


def test_values_of_a_malformed_index(spark):
    raw = spark.createDataFrame([('\ufeff{"articles":{"21":[0,"x",1.5,{"a":1},null],"22":"no","23":7,"24":[]},"tags":{},"parts":[1],"lists":4}',), ("[1]",), ("not JSON",), (None,)], "value string")
    got = sorted(map(str, store.index_values(raw).select("kind", "key", "place", "chunk_pos").collect()))
    values = [("articles", "21", p, 0 if p == 0 else None) for p in range(5)] + [("articles", k, None, None) for k in ("22", "23")]
    assert got == sorted(str(spark.createDataFrame([v], "kind string, key string, place int, chunk_pos long").first()) for v in values)
