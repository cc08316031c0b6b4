import random
import re

import pytest
from pyspark.sql import functions as F

from quarrystone.functions import legal as L
from quarrystone.functions import text as T
from quarrystone.operators import answer, chunks, evaluate, pages, search


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first().x


def joined(pieces, size, least, glue, cut):
    """Pieces joined while they fit; too short a chunk goes, too long a piece is cut."""
    out, held = [], ""
    for p in pieces:
        if len(f"{held}{glue}{p}" if held else p) <= size:
            held = f"{held}{glue}{p}" if held else p
            continue
        out += [held] * (len(held) >= max(least, 1))
        out, held = (out + cut(p), "") if len(p) > size and cut else (out, p)
    return out + [held] * (len(held) >= max(least, 1))


def plain_chunks(text, size, overlap, least):
    """The generic chunker with overlap, and without it."""
    parts = [p.strip() for p in re.split(r"\n{2,}", text) if p.strip()]
    windows = lambda p, step: [p[i : i + size] for i in range(0, len(p), step)]
    sentences = lambda p: [w for c in joined(re.split(r"(?<=[.!?])\s+", p), size, 1, " ", None) for w in ([c] if len(c) <= size else windows(c, size - overlap))]
    out = joined(parts, size, least, "\n\n", sentences)
    bare = joined(parts, size, least, "\n\n", lambda p: windows(p, size)) or [text[:size]] * bool(text.strip())
    return [f"{out[i - 1][-overlap:]} {c}".strip() if i else c for i, c in enumerate(out)], bare


def test_chunkers_agree_with_plain_python(spark):
    rng = random.Random(2)
    texts = ["", "short"]
    for _ in range(40):
        parts = [" ".join("w" * rng.randrange(1, 9) + rng.choice(["", ".", "!"]) for _ in range(rng.randrange(1, 60))) for _ in range(rng.randrange(1, 9))]
        texts.append("\n\n".join(parts))
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r.id: r for r in rows.select("id", chunks.chunk_text(F.col("t"), 120, 30, 20).alias("a"), chunks.generic_split(F.col("t"), 120, 20).alias("b")).collect()}
    for i, t in enumerate(texts):
        assert (got[i].a, got[i].b) == plain_chunks(t, 120, 30, 20)


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("Articles 20-22", ["20", "21", "22"]), ("Article 22 to 20", ["22", "21", "20"]), ("Articles 20A–22", ["20A", "22", "20"][:2]), ("Articles 14, 19 and 21A", ["14", "19", "21A"]),
        ("compare 14 and 15", ["14", "15"]), ("14 & 15", ["14", "15"]), ("Article 999", []), ("nothing", []),
    ],
)
def test_article_ids(spark, query, want):
    got = one(spark, L.article_ids(F.col("q")), q=query)
    assert got[: len(want)] == want and len(got) >= len(want)


def test_expansion_rules(spark):
    q = "Articles 352, 19 and 21 on arrest and habeas corpus"
    assert one(spark, L.expanded_articles(F.col("q"), L.article_ids(F.col("q"))), q=q) == ["352", "19", "21", "358", "359", "22", "32"]


def test_page_text(spark):
    raw = "THE CONSTITUTION OF INDIA\n 12 \n**5.  Title.** - (1) body $^{2}[x y\n\n\n\nâ€œend  \n  z"
    assert one(spark, T.page_text(F.col("t")), t=raw) == "5. Title.\n(1) body x y\n\n\"end\nz"


CONTEXT = "Article 20 No person shall be convicted. Article 22 Grounds for arrest under the CrPC.\nhealth"


@pytest.mark.parametrize(
    ("raw", "query", "note", "want"),
    [
        ("<think>a\nb</think>Yes <citation src='synthetic'>gone</citation><citation>kept\n it</citation>\nPrivacy counts.\nHealth does.", "", None, "Yes kept it\nHealth does."),
        ("Under the CrPC, it is so.\nUnder the IPC, it is so.\nCase law says more.", "Constitution only: why?", None, "Not found in retrieved constitutional context."),
        ("The Penal Code says so.", "Constitution only: why?", None, "The Penal Code says so."),
        ("The ruling says so.", "Constitution only: why?", None, "Not found in retrieved constitutional context."),
        ("The ruling says so.", "why?", None, "The ruling says so."), ("Dignity.", "why?", None, "Not found in provided context."), ("Not found in provided context.", "why?", None, "Not found in provided context."),
        ("Not found in provided context.\nYes.", "Constitution only: why?", None, "Not found in retrieved constitutional context.\nYes."),
        ("All of it <citation type='synthetic'>x</citation>", "why?", "No footnote for Article 21 was found.", "No footnote for Article 21 was found."),
        ("A [doc\n the law.pdf | doc_id:4e | article:20 | p:41 | type:article ]. [see above] [type:amendment|p:4]", "", None, "A [the law.pdf | article:20 | p:41]. [see above] [p:4 | amendment]"),
    ],
)
def test_answers_are_cleaned(spark, raw, query, note, want):
    context = CONTEXT if "CrPC" not in raw else "nothing of it"
    rows = spark.createDataFrame([(raw, context, query, note)], "answer string, context string, query string, note string")
    assert answer.clean(rows).first().cleaned == want


def test_messages_and_grounding_of_synthetic_notes(spark):
    schema = "qid long, rank int, text string, filename string, page int, page_start int, page_end int, article_id string, schedule_id string, list_id string, entry_id string, chunk_type string, synthetic boolean, synthetic_reason string, display_citation boolean"
    rows = [(1, 2, "Body", "a.pdf", 4, 4, 5, "22", "", "", "", "amendment", False, None, True), (1, 1, " \n", "a.pdf", 4, 4, 4, "", "", "", "", "generic", True, "none", False), (2, 1, " No  note\nfound. ", "", None, None, None, "21A", "", "", "", "amendment", True, "none", False)]
    chunks = spark.createDataFrame(rows, schema)
    found = {r.qid: r for r in answer.grounding(chunks).collect()}
    assert (found[1].context, found[1].note, found[2].note) == (" \n\nBody", None, "No note found.")
    queries = spark.createDataFrame([(1, "based only on the constitution, why?"), (2, "why?"), (3, "what?")], "qid long, query string")
    told = {(r.qid, r.role): r.content for r in answer.messages(queries, chunks).collect()}
    assert "[a.pdf | article:22 | p:4-5 | amendment]" in told[1, "user"] and told[1, "user"].index("CONSTITUTION-ONLY MODE:") > told[1, "user"].index("QUESTION:")
    assert "Constitution-only mode is active." in told[1, "system"] and "repeat that fallback" not in told[1, "system"] and "Synthetic retrieval notes" in told[1, "system"]
    assert "(synthetic retrieval note for Article 21A; reason: none)" in told[2, "user"] and "repeat that fallback" in told[2, "system"] and "Constitution-only" not in told[2, "system"]
    assert told[3, "user"].startswith("CONTEXT:\n\n\nQUESTION: what?") and "Synthetic" not in told[3, "system"]


def test_evaluation_of_items(spark):
    schema = "qid long, rank int, chunk_id long, article_id string, schedule_id string, list_id string, entry_id string, chunk_type string, text string, synthetic boolean"
    rows = [(1, 1, 7, "22", "", "", "", "article", "Grounds of arrest", False), (1, 2, 8, "22", "VII", "", "", "footnote", "note", None), (1, 3, 9, "21", "", "I", "5", "clause", "x", False)]
    prompts = spark.createDataFrame([(1, "user", "Question"), (1, "system", "Rules")], "qid long, role string, content string")
    items = [(1, "repaired_boundary", "amendment history", ["22", "32"], ["22"], ["21"], ["article"], ["GROUNDS", "zz"], False, ["Rules\nQuestion", "synthetic"]), (2, "structural_routing", "x", None, None, None, None, ["a"], None, None)]
    names = "id long, category string, query string, required_article_ids array<string>, exact_article_set array<string>, forbidden_article_ids array<string>, allowed_chunk_types_only array<string>, required_text_substrings array<string>, amendment_expected boolean, prompt_must_contain array<string>"
    got = {r.id: r for r in evaluate.evaluated(spark.createDataFrame(items, names), spark.createDataFrame(rows, schema), prompts).collect()}
    assert [(i.phase, i.tag, i.message) for i in got[1].issues] == [
        ("retrieval", "indexing", "missing required articles: ['32']"), ("retrieval", "indexing", "article set mismatch: expected ['22'], got ['22', '21']"), ("retrieval", "indexing", "forbidden neighboring article retrieved: 21"),
        ("retrieval", "indexing", "unexpected chunk types present: ['clause', 'footnote']"), ("retrieval", "indexing", "missing expected text snippet: zz"), ("mode", "amendment_mode", "amendment mode mismatch: expected False, got True"),
        ("answer", "synthetic_fallback", "prompt missing required snippet: synthetic"),
    ]
    assert (got[1].chunk_ids, got[1].schedules, got[1].entries, got[1].passed) == ([7, 8, 9], ["VII"], ["5"], False)
    assert [i.tag for i in got[2].issues] == ["structural_routing"] and got[2].mode_pass and got[2].answer_pass and not got[2].synthetic_only
    results = evaluate.evaluated(spark.createDataFrame(items, names), spark.createDataFrame(rows, schema), prompts)
    assert sorted(map(tuple, evaluate.failure_tags(results).collect())) == [("amendment_mode", 1), ("indexing", 5), ("structural_routing", 1), ("synthetic_fallback", 1)]


def test_ocr_files_and_images(spark):
    files = [(1, "p1.md", "one"), (1, "x_1.txt", "later"), (1, "p3.md", "three"), (2, "all.md", "pre\n--- page 4 ---\na\n--- page 6 ---\nb"), (3, "7.md", "plain"), (4, "a.md", "--- page 1 ---"), (4, "b_2.md", "--- page 5 ---\nq")]
    got = sorted(map(tuple, pages.ocr_pages(spark.createDataFrame(files, "doc_id long, name string, content string")).collect()))
    assert got == [(1, 1, "later"), (1, 3, "three"), (2, 4, "a"), (2, 6, "b"), (3, 7, "plain"), (4, 1, "--- page 1 ---"), (4, 2, "--- page 5 ---\nq")]
    rows = spark.createDataFrame([(1, 1), (1, 2)], "doc_id long, page int")
    images = spark.createDataFrame([(1, 2, "b.png")], "doc_id long, image_no int, image_path string")
    assert sorted(map(tuple, pages.with_images(rows, images).collect())) == [(1, 1, ""), (1, 2, "b.png")]


def test_pages_fall_back_by_batch(spark):
    a = spark.createDataFrame([(1, 1, "x"), (1, 2, ""), (1, 11, " "), (1, 12, None)], "doc_id int, page int, text string")
    b = spark.createDataFrame([(1, n, "b%d" % n) for n in (1, 2, 11, 12)], "doc_id int, page int, text string")
    got = sorted((r.page, r.text, r.source) for r in pages.with_fallback(a, b).collect())
    assert got == [(1, "x", "primary"), (2, "", "primary"), (11, "b11", "secondary"), (12, "b12", "secondary")]


def test_bm25_prefers_rare_terms_and_is_empty_without_them(spark):
    docs = spark.createDataFrame([(1, "common rare"), (2, "common common"), (3, None)], "doc_id long, text string")
    ask = lambda q: search.bm25_topk(docs, spark.createDataFrame([(0, q)], "qid long, query string"), 5).orderBy("rank").collect()
    assert [r.id for r in ask("common rare")] == [1, 2]
    assert ask("absent") == []
