import io
import zipfile

from pyspark.sql import functions as F

from quarrystone.functions import legal as L
from quarrystone.functions import sql
from quarrystone.functions import text as T
from quarrystone.operators import chunks
from quarrystone.sources.archives import OcrResults

TEXTS = ("1. Subs. by the Act.\n2. Ins. by the Act.\nSee Section 12A", "Article 5 and art. 7b, Article 5", "", "Entry 5a of amended lists; constitution only\nplain", "x" * 400 + "\n1. Subs. by it")


def test_functions_equal_columns(spark):
    sql.register(spark)
    rows = spark.createDataFrame([(i, t, kind, label) for i, t in enumerate(TEXTS) for kind, label in (("text_block", "9th"), ("article", "first"), ("list_heading", "13"))] + [(9, None, None, None)], "i int, t string, kind string, label string")
    rows.createOrReplaceTempView("sql_texts")
    got = spark.sql("SELECT content_hash(t) a, tokens(t) b, chunk_type(t, kind) c, section_id(t) d, wants_amendments(t) e, constitution_only(t) f, article_refs(t) g, entry_refs(t) h, schedule_id(label) j, footnotes(t) k FROM sql_texts")
    t = F.col("t")
    want = rows.select(T.content_hash(t), T.tokens(t), T.chunk_type(t, F.col("kind")), T.section_id(t), T.wants_amendments(t), T.constitution_only(t), L.article_refs(t), L.entry_refs(t), L.schedule_id(F.col("label")), T.footnotes(t))
    assert list(map(tuple, got.collect())) == list(map(tuple, want.collect()))
    assert "Python" not in got._jdf.queryExecution().toString()


def test_table_functions_equal_columns(spark):
    sql.register(spark)
    rows = spark.createDataFrame([(i, "\n".join(f"line {k} " + "w" * (k * 7 % 23) for k in range(i * 3))) for i in range(8)], "i int, t string")
    rows.createOrReplaceTempView("sql_pages")
    got = spark.sql("SELECT i, c.pos, c.chunk FROM sql_pages, LATERAL packed_lines(t, 60, 10) c ORDER BY i, pos")
    want = rows.select("i", F.posexplode(chunks.pack(chunks.lines(F.col("t")), 60, 10))).orderBy("i", "pos")
    assert list(map(tuple, got.collect())) == list(map(tuple, want.collect())) and want.count() > 20
    assert spark.sql("SELECT token FROM tokens_of('Ab c DEF')").collect() == [("ab",), ("def",)]


def test_ocr_results_of_files_and_archives(spark, tmp_path):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").orderBy("conv_id", "turn").collect()
    want = []
    for r in turns:
        (tmp_path / f"job{r.conv_id}").mkdir(exist_ok=True)
    for conv in sorted({r.conv_id for r in turns}):
        own = [(f"page_{r.turn + 1}.md", r.text) for r in turns if r.conv_id == conv]
        want += [(f"job{conv}", *x) for x in own]
        if conv % 3 == 0:
            for name, text in own:
                (tmp_path / f"job{conv}" / name).write_text(text, encoding="utf-8", newline="")
            continue
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
            for name, text in [("__MACOSX/x", "no"), (".hidden", "no"), ("dir/", ""), *reversed(own)]:
                archive.writestr(name, text)
        (tmp_path / f"job{conv}" / "result.zip").write_bytes(held.getvalue())
    (tmp_path / "odd").mkdir()
    (tmp_path / "odd" / "bad.md").write_bytes(b"a\xffb")
    with zipfile.ZipFile(tmp_path / "odd" / "none.zip", "w"):
        pass
    spark.dataSource.register(OcrResults)
    read = lambda size: spark.read.format("ocr_results").option("part_bytes", size).load(f"file://{tmp_path}")
    small, whole = read(200), read(1 << 20)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, whole.collect())) == sorted([*want, ("odd", "bad.md", "a�b")])
    assert small.rdd.getNumPartitions() > whole.rdd.getNumPartitions()
