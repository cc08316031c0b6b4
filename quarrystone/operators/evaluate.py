"""Evaluation of retrieval, query modes and prompts against the criteria of a set of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

_STRINGS = "array<string>"
#: Criteria of an item beside id, category and query; an absent or null one is not checked.
CRITERIA = {
    **dict.fromkeys(("required_article_ids", "required_schedule_ids", "required_list_ids", "required_entry_ids", "exact_article_set", "article_prefix", "forbidden_article_ids"), _STRINGS),
    **dict.fromkeys(("allowed_chunk_types_only", "forbidden_chunk_types", "required_text_substrings", "forbidden_text_substrings", "prompt_must_contain", "prompt_must_not_contain"), _STRINGS),
    **dict.fromkeys(("amendment_expected", "constitution_only_expected", "synthetic_only_expected"), "boolean"),
}
_ISSUE = "array<struct<phase:string,tag:string,message:string>>"
PHASES = ("retrieval", "mode", "answer")


def _listed(c: Column) -> Column:
    return F.when(F.size(c) == 0, "[]").otherwise(F.concat(F.lit("['"), F.array_join(c, "', '"), F.lit("']")))


def _issue(phase: str, tag: Column | str, message: Column) -> Column:
    return F.struct(F.lit(phase).alias("phase"), (F.lit(tag) if isinstance(tag, str) else tag).alias("tag"), message.alias("message"))


def _if(cond: Column, phase: str, tag: Column | str, message: Column) -> Column:
    return F.when(F.coalesce(cond, F.lit(False)), F.array(_issue(phase, tag, message))).otherwise(F.array()).cast(_ISSUE)


def _each(values: Column, phase: str, tag: Column | str, label: str, retag: Column | None = None) -> Column:
    """An issue for each of some values."""
    tagged = (lambda x: retag(x)) if callable(retag) else (lambda x: tag)
    return F.coalesce(F.transform(values, lambda x: _issue(phase, tagged(x), F.concat(F.lit(label), x))), F.array()).cast(_ISSUE)


def retrieved(chunks: DataFrame) -> DataFrame:
    """(qid, chunk_ids, articles, schedules, lists, entries, chunk_types, synthetic_only, text) of ranked chunks; identifiers each once, in order."""
    row = F.struct("rank", "chunk_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("article_id", "schedule_id", "list_id", "entry_id", "chunk_type", "text")])
    per = chunks.groupBy("qid").agg(F.array_sort(F.collect_list(row)).alias("r"), F.every(F.coalesce("synthetic", F.lit(False))).alias("synthetic_only"))  # a query's few chunks
    field = lambda name: F.transform("r", lambda x: x[name])
    once = lambda name: F.array_distinct(F.filter(field(name), lambda x: x != ""))
    names = {"articles": "article_id", "schedules": "schedule_id", "lists": "list_id", "entries": "entry_id"}
    return per.select("qid", field("chunk_id").alias("chunk_ids"), *[once(c).alias(n) for n, c in names.items()], field("chunk_type").alias("chunk_types"), "synthetic_only", F.array_join(field("text"), "\n").alias("text"))


def evaluated(items: DataFrame, chunks: DataFrame, prompts: DataFrame) -> DataFrame:
    """items (id, category, query, CRITERIA) with what was found, `issues` (phase, tag, message) and whether each phase passed.

    chunks: what retrieval gave (qid = id, rank, ...); prompts: messages (qid, role, content). An item without
    chunks has found nothing and is not synthetic.
    """
    have = set(items.columns)
    rows = items.select("*", *[F.lit(None).cast(t).alias(c) for c, t in CRITERIA.items() if c not in have])
    said = prompts.groupBy(F.col("qid").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((F.col("role") != "system").alias("later"), "content"))), lambda m: m["content"]), "\n").alias("prompt"))
    rows = rows.join(retrieved(chunks).withColumnRenamed("qid", "id"), "id", "left").join(said, "id", "left")
    none = F.array().cast(_STRINGS)
    rows = rows.withColumns({c: F.coalesce(c, none) for c in ("articles", "schedules", "lists", "entries", "chunk_types")} | {"chunk_ids": F.coalesce("chunk_ids", F.array().cast("array<long>"))})
    rows = rows.withColumns({"synthetic_only": F.coalesce("synthetic_only", F.lit(False)), "text": F.coalesce("text", F.lit("")), "prompt": F.coalesce("prompt", F.lit(""))})
    rows = rows.withColumns({"amendment_mode": T.wants_amendments(F.col("query")), "constitution_only_mode": T.constitution_only(F.col("query"))})
    category, col = F.col("category"), F.col
    own = F.when(category == "repaired_boundary", "indexing").when(category == "amendment_history", "amendment_evidence_handling").otherwise("retrieval")
    typed = F.when(category == "amendment_history", "amendment_evidence_handling").otherwise(own)
    routed = F.when(category == "structural_routing", "structural_routing").otherwise(own)
    low = F.lower("text")
    missing = lambda c, actual: F.filter(col(c), lambda x: ~F.array_contains(col(actual), x))

    def required(c: str, actual: str, tag: Column | str) -> Column:
        return _if(F.size(missing(c, actual)) > 0, "retrieval", tag, F.concat(F.lit(f"missing required {actual}: "), _listed(missing(c, actual))))

    def unlike(c: str, actual: Column, label: str) -> Column:
        return _if(actual != col(c), "retrieval", own, F.concat(F.lit(f"article {label} mismatch: expected "), _listed(col(c)), F.lit(", got "), _listed(col("articles"))))

    def mode(c: str, actual: str, phase: str, tag: str, label: str) -> Column:
        text = lambda x: F.initcap(x.cast("string"))
        return _if(col(c) != col(actual), phase, tag, F.concat(F.lit(f"{label} mismatch: expected "), text(col(c)), F.lit(", got "), text(col(actual))))

    def prompt_tag(x: Column) -> Column:
        said = F.lower(x)
        of_mode = F.contains(said, F.lit("constitution-only")) | F.contains(said, F.lit("retrieved constitutional context"))
        return F.when(F.contains(said, F.lit("synthetic")), "synthetic_fallback").when(of_mode, "constitution_only_enforcement").otherwise("answer_grounding")

    other = F.array_sort(F.array_distinct(F.filter("chunk_types", lambda x: (x != "") & ~F.array_contains(col("allowed_chunk_types_only"), x))))
    banned = F.array_sort(F.array_distinct(F.filter("chunk_types", lambda x: F.array_contains(col("forbidden_chunk_types"), x))))
    issues = F.concat(
        required("required_article_ids", "articles", own), required("required_schedule_ids", "schedules", "structural_routing"),
        required("required_list_ids", "lists", "structural_routing"), required("required_entry_ids", "entries", "structural_routing"),
        unlike("exact_article_set", col("articles"), "set"), unlike("article_prefix", F.slice("articles", F.lit(1), F.greatest(F.size("article_prefix"), F.lit(0))), "prefix"),
        _each(F.filter("forbidden_article_ids", lambda x: F.array_contains("articles", x)), "retrieval", own, "forbidden neighboring article retrieved: "),
        _if(col("allowed_chunk_types_only").isNotNull() & (F.size(other) > 0), "retrieval", typed, F.concat(F.lit("unexpected chunk types present: "), _listed(other))),
        _if(F.size(banned) > 0, "retrieval", typed, F.concat(F.lit("forbidden chunk types present: "), _listed(banned))),
        _each(F.filter("required_text_substrings", lambda x: ~F.contains(low, F.lower(x))), "retrieval", routed, "missing expected text snippet: "),
        _each(F.filter("forbidden_text_substrings", lambda x: F.contains(low, F.lower(x))), "retrieval", own, "forbidden text snippet present: "),
        mode("amendment_expected", "amendment_mode", "mode", "amendment_mode", "amendment mode"),
        mode("constitution_only_expected", "constitution_only_mode", "mode", "constitution_only_enforcement", "constitution-only mode"),
        mode("synthetic_only_expected", "synthetic_only", "answer", "synthetic_fallback", "synthetic-only"),
        _each(F.filter("prompt_must_contain", lambda x: ~F.contains(col("prompt"), x)), "answer", "", "prompt missing required snippet: ", prompt_tag),
        _each(F.filter("prompt_must_not_contain", lambda x: F.contains(col("prompt"), x)), "answer", "answer_grounding", "prompt contains forbidden snippet: "),
    )
    rows = rows.withColumn("issues", issues)
    passed = {f"{p}_pass": ~F.array_contains(F.transform("issues", lambda x: x["phase"]), p) for p in PHASES}
    return rows.withColumns(passed).withColumn("passed", F.size("issues") == 0).drop("text", "prompt")


def summary(results: DataFrame) -> DataFrame:
    """(category, passed, total) of results (category, passed), and all of them under `(all)`."""
    sums = results.rollup("category").agg(F.sum(F.col("passed").cast("long")).alias("passed"), F.count("*").alias("total"))
    return sums.select(F.coalesce("category", F.lit("(all)")).alias("category"), "passed", "total")


def failure_tags(results: DataFrame) -> DataFrame:
    """(tag, n): how often each tag occurs in the issues of results."""
    return results.select(F.explode("issues").alias("i")).groupBy(F.col("i.tag").alias("tag")).agg(F.count("*").alias("n"))
