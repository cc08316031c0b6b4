import random
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from quarrystone.functions import structure as S
from quarrystone.operators import segment as G
from quarrystone.operators.scan import exclusive_scan
from quarrystone.plans import queries

LONG = "which shall apply to every person in the territory and in all of the land around it, "


def articles(spark, *texts):
    rows = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).select(G.article_segments(F.col("text")).alias("s")).collect()
    return [r["s"] for r in rows]


def structures(spark, *pages):
    """Segments of (text, schedule, list, entry) pages as schedules, lists and entries."""
    rows = spark.createDataFrame(pages, "text string, s string, l string, e string").coalesce(1)
    carry = F.struct(F.lit("").alias("article"), F.lit("").alias("heading"), F.col("s").alias("schedule"), F.col("l").alias("list"), F.col("e").alias("entry"))
    return [r["x"] for r in rows.select(G.schedule_segments(S.marked_lines(F.col("text")), carry).alias("x")).collect()]


def test_article_headings(spark):
    found = articles(
        spark,
        "21. Protection of life.—No person shall be deprived of life except by procedure established by law.\n"
        "2[21A. Right to education.—The State shall provide free education to all children of that age.]\n"
        "22. Protection against arrest.—(1) No person who is arrested shall be detained without being informed.\n"
        "1. Subs. by the Constitution (Fourth Amendment) Act, 1955, for the earlier words.\n",
        "3359A. [Special provision.]\nOmitted by the Act.\n360. Provisions as to emergency.—(1) If the President is satisfied, he may so declare.\n",
        "34. Restriction on rights while martial law\nis in force in any area.—Notwithstanding anything in the foregoing provisions, Parliament may by law do so.\n",
        "Article 14. Equality before law\nThe State shall not deny to any person equality before the law.\n",
        "1. Ins. by the Act.\n2. Rep. by the Act.\n",
        "368.\nPower of Parliament to amend.—(1) Notwithstanding anything in this Constitution, Parliament may.\n",
        "PART III of rights\n132A. [Remedies.]\nOmitted.\n401. Too high a number for an article.-(1) The list goes on.\n",
    )
    assert [[s["article"] for s in page if s["article"]] for page in found] == [["21", "21A", "22"], ["359A", "360"], ["34"], ["14"], [], ["368"], ["32A"]]
    assert "education" not in found[0][0]["text"] and found[2][0]["heading"] == "Restriction on rights while martial law is in force in any area"
    assert (found[6][0]["type"], found[6][0]["heading"]) == ("part_heading", "of rights") and "401." in found[6][1]["text"]


def test_schedules_lists_entries_and_notes(spark):
    found = structures(
        spark,
        ("(SEVENTH SCHEDULE)\n15. Capitation taxes on the persons of all the land.\n16. Another matter of this kind, in full.\n", "VII", "I", "14"),
        ("1[FIRST SCHEDULE\nThe States\n", "", "", ""),
        ("1. The words were omitted by the Act w.e.f. 1-11-1956.\n31. Posts and telegraphs; telephones and so on.\n", "VII", "I", "30"),
        ("as listed in the Fourth Schedule, for the States.\n", "", "", ""),
        ("First Schedule and includes any other territory.", "", "", ""),
        ("UNION LIST Items follow", "", "", ""),
        ("SEVENTH SCHEDULE Of the States", "", "", ""),
        ("FIRST SCHEDULE;\nThe rest", "", "", ""),
        ("STATE LIST (see above)\n4. Prisons and borstals\nthereto. 5. Local government", "", "", ""),
        ("See the Schedule below\nwhich is here", "IX", "", ""),
    )
    short = [[(s["type"], s["schedule"], s["list"], s["entry"]) for s in page] for page in found]
    assert short[0] == [("entry", "VII", "I", "15"), ("entry", "VII", "I", "16")]
    assert short[1] == [("schedule_heading", "I", "", "")] and found[1][0]["text"] == "1[FIRST SCHEDULE\nThe States"
    assert short[2] == [("text_block", "VII", "I", ""), ("entry", "VII", "I", "31")]
    assert short[3] == short[4] == short[5] == short[6] == []
    assert short[7] == [("schedule_heading", "I", "", "")]
    assert short[8] == [("list_heading", "VII", "II", ""), ("entry", "VII", "II", "4"), ("entry", "VII", "II", "5")]
    assert short[9] == [("text_block", "IX", "", "")]


def test_contents_pages_head_three_schedules_or_lists(spark):
    lists, parts = "CONTENTS\nLIST I\nLIST II\nLIST III\n", "CONTENTS\nPART I\nPART II\nPART III\nFIRST SCHEDULE\n"
    found = structures(spark, (lists, "", "", ""), (parts, "", "", ""))
    assert found[0] == [] and [s["type"] for s in found[1]] == ["text_block", "schedule_heading"]


def test_pages_carry_articles_and_are_numbered(spark):
    pages = [
        (1, 1, "21. Protection of life.—No person shall be deprived of his life or personal liberty, " + LONG),
        (1, 2, None), (1, 3, "(2) The same goes for " + LONG * 2), (1, 4, "x"), (1, 5, "The last page says that " + LONG), (2, 1, "Plain. " + LONG), (2, 1, "And more. " + LONG),
        (None, None, "Nobody's page. " + LONG),
    ]
    got = sorted(map(tuple, G.chunk_pages(spark.createDataFrame(pages, "doc_id long, page int, text string"), width=2).collect()), key=str)
    assert [(r[0], r[1], r[2], r[4], r[5]) for r in got] == [(1, 0, 1, "article", "21"), (1, 1, 3, "article", "21"), (1, 2, 5, "generic", ""), (2, 0, 1, "generic", ""), (None, 0, None, "generic", "")]
    assert got[1][3].startswith("[Article 21] Protection of life\n(2)")
    assert got[3][3].startswith("And more.") and "\nPlain." in got[3][3]


def test_no_pages(spark):
    assert G.chunk_pages(spark.createDataFrame([(1, 1, " ")], "doc_id long, page int, text string")).collect() == []


def pages_of(seed):
    r = random.Random(seed)
    lines = [
        "SEVENTH SCHEDULE", "(SEVENTH SCHEDULE)", "LIST I-UNION LIST", "STATE LIST", "CONTENTS", "5. Taxes on lands " + LONG, "6. Short entry.", "1. Subs. by the Act of 1955.", "FIRST SCHEDULE;",
        "21. Protection of life.—No person shall be deprived of it, " + LONG, "(1) " + LONG * 2, "", "Article 14. Equality before law\nThe State shall not " + LONG, "as in the Fourth Schedule", LONG * 9, "x",
    ]
    return [(doc, page, "\n".join(r.choice(lines) for _ in range(r.randrange(7)))) for doc in range(12) for page in range(doc * 2)]


def test_states_equal_a_walk_page_by_page(spark):
    pages = G.filled_pages(spark.createDataFrame(pages_of(7), "doc_id long, page int, text string")).cache()
    steps = pages.select("doc_id", "page", G.let(S.marked_lines(F.col("text")), lambda ms: G.let(G.article_segments(F.col("text")), lambda a: G._next_states(ms, a, 80))).alias("f"))
    want, state, values, before = {}, 0, {}, None
    for r in sorted(steps.collect(), key=lambda r: (r["doc_id"], r["page"])):
        if r["doc_id"] != before:
            state, values, before = 0, dict.fromkeys(G._VALUES, ""), r["doc_id"]
        want[r["doc_id"], r["page"]] = tuple(values.values())
        step = r["f"][state]
        state, values = step["state"], {v: values[v] if step[v] is None else step[v] for v in G._VALUES}
    for width in (2, 5, 64):
        got = {(r["doc_id"], r["page"]): tuple(r["carry"]) for r in G.page_states(pages, width=width).collect()}
        assert got == want
    assert len({bool(w[0]) + 2 * bool(w[2]) + 4 * bool(w[3]) + 8 * bool(w[4]) for w in want.values()}) == 5


@pytest.mark.parametrize("width", (2, 3, 64))
def test_scan_combines_in_order(spark, width):
    r = random.Random(1)
    rows = [(g, at - 40, chr(97 + r.randrange(26))) for g in (1, 2, None) for at in sorted(r.sample(range(300), 60))]
    shuffled = r.sample(rows, len(rows))
    got = exclusive_scan(spark.createDataFrame(shuffled, "g int, at int, v string"), "g", "at", "v", F.concat, F.lit(""), width).collect()
    want = {}
    for g in (1, 2, None):
        own = [x for x in rows if x[0] == g]
        want |= {(g, x[1]): before for x, before in zip(own, ["", *accumulate(x[2] for x in own)], strict=False)}
    assert {(x["g"], x["at"]): x["before"] for x in got} == want


def test_registered_chunks_come_from_the_pages_states(spark):
    """Chunks of the registered query follow its structure: the same articles, schedules, lists and entries on every page."""
    d = "/root/testdata/sf0.001"
    chunks = queries.page_chunks(spark, d).where("chunk_type <> 'generic' OR schedule_id <> ''").select("doc_id", "page", "article_id", "schedule_id", "list_id", "entry_id").distinct()
    pieces = queries.page_structure(spark, d).select("doc_id", "page", "article", "schedule", "list", "entry").distinct()
    assert chunks.exceptAll(pieces).count() == 0 and chunks.count() > 40


def test_pages_are_read_by_all_cores_and_once_in_each_state(spark):
    d = "/root/testdata/sf0.001"
    assert queries.page_structure(spark, d).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    pages = queries._pages(spark, d)
    step = G.let(S.marked_lines(F.col("text")), lambda ms: G.let(G.article_segments(F.col("text")), lambda a: G._next_states(ms, a, 80)))
    assert pages.select(step.alias("f"))._jdf.queryExecution().analyzed().toString().count("= CONTENTS") == 1
