"""Citations, prompts and the cleaning of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import strip
from ..tables import let

# What makes a bracket a citation, and the order of its parts.
_BRACKET = r"\[[^\[\]]{1,400}\]"
_SIGNAL = r"(?i)\bdoc\b|\.pdf\b|\barticle\b|\bschedule\b|\blist\b|\bentry\b|\bp:|\btype\b"
_PARTS = ("article", "schedule", "list", "entry", "p")

PROMPT_TEXT, PREVIEW, SNIPPET = 1500, 500, 140

# The texts of a prompt.
RULES = (
    "You answer questions ONLY from the provided CONTEXT.\n"
    "Rules:\n"
    "- If the answer is not in the context, say: \"Not found in provided context.\"\n"
    "- Use only facts explicitly stated in the context. Do not use outside legal knowledge.\n"
    "- Do NOT add case law, judicial expansion, doctrine, or constitutional interpretation unless that exact material appears in the context.\n"
    "- Do NOT mention privacy, dignity, health, pollution-free environment, Maneka Gandhi, or similar expansions unless those exact topics appear in the context.\n"
    "- Every material factual claim must be supported by one or more citations.\n"
    "- Copy citations exactly from the chunk header tags; do not invent, rewrite, abbreviate, or leave empty fields.\n"
    "- Do not output <think>, <thinking>, or any hidden-reasoning tags.\n"
    "- Be precise. Quote exact text when relevant.\n"
    "- Do NOT make up information.\n"
    "- If a chunk is tagged type:footnote or type:amendment, note it as editorial annotation.\n"
)
ONLY_RULES = (
    "- Constitution-only mode is active.\n"
    "- Answer only from the retrieved constitutional context.\n"
    "- Do NOT use IPC, CrPC, Evidence Act, other statutes, case law, or external legal knowledge unless that exact material appears in the context.\n"
    "- Prefer direct constitutional text or close paraphrase before brief explanation.\n"
    "- Remain grounded and concise.\n"
    "- If the retrieved constitutional context is insufficient, say: \"Not found in retrieved constitutional context.\"\n"
)
NOTE_RULE = "- Synthetic retrieval notes are fallback context only. Do not cite them as extracted constitutional text.\n"
ALL_NOTES_RULE = "- If the only context is a synthetic retrieval note, repeat that fallback plainly and do not add citations.\n"
ONLY_NOTE = "CONSTITUTION-ONLY MODE: Answer only from the retrieved constitutional text. If the context is insufficient, say: Not found in retrieved constitutional context.\n\n"
CLOSING = "Answer only from the context. If a requested detail is missing, say so.\nEnd each factual paragraph or bullet with exact copied citations:"


def _one_line(c: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def _named(name: str, c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(name + ":"), c))


def citation_header() -> Column:
    """[file | article:.. | schedule:.. | list:.. | entry:.. | p:a-b | type] of a chunk row, empty if it should not be cited."""
    start = F.coalesce("page_start", "page")
    end = F.coalesce(F.col("page_end"), start)
    pages = F.when(start.isNotNull(), F.when(start == end, F.concat(F.lit("p:"), start)).otherwise(F.concat(F.lit("p:"), start, F.lit("-"), end)))
    name = F.nullif(T.strip(F.regexp_replace(F.coalesce("filename", F.lit("")), r"\s+", " ")), F.lit(""))
    kind = F.when(~F.coalesce("chunk_type", F.lit("")).isin("", "generic", "article"), F.col("chunk_type"))
    parts = F.concat_ws(" | ", name, _named("article", F.col("article_id")), _named("schedule", F.col("schedule_id")), _named("list", F.col("list_id")), _named("entry", F.col("entry_id")), pages, kind)
    return F.when(~F.coalesce("display_citation", F.lit(True)) | (parts == ""), "").otherwise(F.concat(F.lit("["), parts, F.lit("]")))


def context_header(rank: Column) -> Column:
    article = F.when(F.coalesce("article_id", F.lit("")) != "", F.concat(F.lit(" for Article "), F.col("article_id"))).otherwise("")
    note = F.concat(F.lit("--- Chunk "), rank, F.lit(" (synthetic retrieval note"), article, F.lit("; reason: "), F.coalesce("synthetic_reason", F.lit("synthetic")), F.lit(") ---"))
    cited = F.concat_ws(" ", F.concat(F.lit("--- Chunk "), rank), F.nullif(citation_header(), F.lit("")), F.lit("---"))
    return F.when(F.coalesce("synthetic", F.lit(False)), note).otherwise(cited)


def context(chunks: DataFrame) -> DataFrame:
    """(qid, context): each query's ranked chunks under their headers, texts cut to PROMPT_TEXT characters."""
    block = F.concat(context_header(F.col("rank").cast("string")), F.lit("\n"), F.substring("text", 1, PROMPT_TEXT))
    ordered = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))  # a query's few chunks
    return chunks.groupBy("qid").agg(ordered.alias("b")).select("qid", F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("context"))


def preview(c: Column) -> Column:
    return F.when(F.char_length(c) > PREVIEW, F.concat(F.substring(c, 1, PREVIEW), F.lit("..."))).otherwise(c)


def snippet(c: Column) -> Column:
    return F.substring(_one_line(c), 1, SNIPPET)


def shown_sources(chunks: DataFrame, images: DataFrame) -> DataFrame:
    """(qid, rank, note, text, image_path): what a reader sees of each query's chunks (filename, page, synthetic).

    Texts are cut to PREVIEW characters; `note` tells synthetic notes from sources; an image, joined by (filename,
    page) of images (filename, page, image_path), stands at the first chunk of its page only.
    """
    of_page = images.select("filename", "page", "image_path").dropDuplicates(["filename", "page"])
    rows = chunks.join(of_page, ["filename", "page"], "left")
    first = F.row_number().over(Window.partitionBy("qid", "filename", "page").orderBy("rank")) == 1
    note = F.coalesce("synthetic", F.lit(False))
    return rows.select("qid", "rank", note.alias("note"), preview(F.col("text")).alias("text"), F.when(first & ~note & (F.col("image_path") != ""), F.col("image_path")).alias("image_path"))


def grounding(chunks: DataFrame) -> DataFrame:
    """(qid, context, note): each query's texts by rank, one below the other, and, if all are synthetic, the first that says something."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", F.coalesce("text", F.lit("")).alias("text"))))  # a query's few chunks
    per = chunks.groupBy("qid").agg(ordered.alias("b"), F.every(F.coalesce("synthetic", F.lit(False))).alias("synthetic"))
    texts = F.transform("b", lambda x: x["text"])
    said = F.filter(F.transform(texts, _one_line), lambda x: x != "")
    return per.select("qid", F.array_join(texts, "\n").alias("context"), F.when(F.col("synthetic") & (F.size(said) > 0), F.element_at(said, 1)).alias("note"))


def normalised_citation(bracket: Column) -> Column:
    """A bracket in the fixed order of parts, empty if it names none of them; as it is if it is no citation."""
    body = _one_line(F.substr(bracket, F.lit(2), F.char_length(bracket) - 2))

    def told(part: Column) -> Column:
        colon = F.instr(part, ":")
        word, rest = F.lower(F.substring_index(part, " ", 1)), strip(F.substr(part, F.instr(part, " ") + 1, F.char_length(part)))
        lone = F.when((word == "doc") & F.contains(part, F.lit(" ")), F.struct(F.lit("doc").alias("k"), rest.alias("v"))).when(F.contains(F.lower(part), F.lit(".pdf")), F.struct(F.lit("doc").alias("k"), part.alias("v")))
        lone = lone.when((word == "type") & F.contains(part, F.lit(" ")), F.struct(F.lit("type").alias("k"), rest.alias("v"))).otherwise(F.struct(F.lit("").alias("k"), F.lit("").alias("v")))
        return F.when(colon > 0, F.struct(F.lower(strip(F.substring_index(part, ":", 1))).alias("k"), strip(F.substr(part, colon + 1, F.char_length(part))).alias("v"))).otherwise(lone)

    def in_order(fields: Column) -> Column:
        last = lambda key: F.try_element_at(F.filter(fields, lambda f: f["k"] == key), F.lit(-1))["v"]
        kind = let(last("type"), lambda x: F.when(~F.lower(x).isin("generic", "article"), x))
        return F.concat_ws(" | ", last("doc"), *[F.concat(F.lit(k + ":"), last(k)) for k in _PARTS], kind)

    def shown(text: Column) -> Column:
        fields = F.filter(F.transform(F.split(text, r"\|"), lambda p: let(strip(p), told)), lambda f: f["v"] != "")
        named = let(let(fields, in_order), lambda parts: F.when(parts == "", "").otherwise(F.concat(F.lit("["), parts, F.lit("]"))))
        return F.when(~text.rlike(_SIGNAL), bracket).otherwise(named)

    return let(body, shown)


def normalised_citations(answer: Column) -> Column:
    """Answers with their citation brackets in one form; brackets without a known part go, others stay."""
    between, brackets = F.split(answer, _BRACKET), F.regexp_extract_all(answer, F.lit(_BRACKET), F.lit(0))
    pairs = F.zip_with(between, F.transform(brackets, normalised_citation), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.array_join(pairs, "")


def clean(answers: DataFrame) -> DataFrame:
    """answers (answer, context, query, note) with `cleaned`.

    A note, which stands for chunks that are all synthetic, is the answer. Else reasoning, citation tags and
    unsupported lines go, blanks are tidied, and an answer of which nothing is left says so.
    """
    text = normalised_citations(T.without_citation_tags(T.without_reasoning(F.col("answer"))))
    only = T.constitution_only(F.col("query"))
    rows = answers.withColumn("_only", only).withColumn("_text", T.without_unsupported_lines(text, F.col("context")))
    text = F.when(F.col("_only"), T.without_external_lines(F.col("_text"), F.col("context"))).otherwise(F.col("_text"))
    rows = rows.withColumn("_text", strip(F.regexp_replace(F.regexp_replace(text, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")))
    missing = F.when(F.col("_only"), T.NOT_FOUND_HERE).otherwise(T.NOT_FOUND)
    note = F.col("note") if "note" in answers.columns else F.lit("")
    cleaned = F.when(F.coalesce(note, F.lit("")) != "", note).when(F.col("_text") != "", F.col("_text")).otherwise(missing)
    return rows.withColumn("cleaned", cleaned).drop("_only", "_text")


def messages(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, role, content): a system and a user message for each query (qid, query) over its ranked chunks.

    The rules for synthetic notes and for answers from the constitution alone come in where they apply;
    a query without chunks has an empty context.
    """
    told = chunks.groupBy("qid").agg(F.some(F.coalesce("synthetic", F.lit(False))).alias("some"), F.every(F.coalesce("synthetic", F.lit(False))).alias("all"))
    rows = queries.select("qid", "query").join(context(chunks), "qid", "left").join(told, "qid", "left")
    only = T.constitution_only(F.col("query"))
    block = lambda cond, text: F.when(cond, text).otherwise("")
    system = F.concat(F.lit(RULES), block(only, ONLY_RULES), block(F.col("some"), NOTE_RULE), block(F.col("all"), ALL_NOTES_RULE))
    user = F.concat(F.lit("CONTEXT:\n"), F.coalesce("context", F.lit("")), F.lit("\n\nQUESTION: "), F.col("query"), F.lit("\n\n"), block(only, ONLY_NOTE), F.lit(CLOSING))
    both = F.array(F.struct(F.lit("system").alias("role"), system.alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))
    return rows.select("qid", F.explode(both).alias("m")).select("qid", "m.role", "m.content")
