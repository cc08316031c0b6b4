"""URL filtering by rules, and where none fits by the ratio of two character language models.

The urls that a rule accepts or rejects train one smoothed variable-order Markov model each
(interpolated Witten-Bell estimates up to ORDER characters of context; every context counts, however
rare, and interpolation gives a rare one little weight). A url without a rule is
judged by the difference of its two log-likelihoods a character against a threshold that is calibrated on
rule-decided urls held out of training. All of it is DataFrame operations; log ratios are whole
numbers of millionths, so sums don't depend on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
ORDER = 4
#: Symbols that the text of a url is made of: letters, 0 for any digit, ./_%- and ~ for all others, ^ before and $ after.
SYMBOLS = 40
#: One url in so many is kept for calibration.
FOLD = 5
#: Width of a calibration bin in millionths, and bins on either side of 0.
BIN, BINS = 10_000, 1000
#: Distinct grams whose scores may be broadcast: some 40 bytes each.
BROADCAST_GRAMS = 250_000
SALTS = 16

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def _rule(rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the columns host and path, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = text.partition("/")
        own = F.col("host")
        fits = ((own == name) | own.endswith("." + name)) & F.col("path").startswith("/" + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def _symbols() -> Column:
    text = F.translate(F.concat("host", "path"), _UPPER, _LOWER)
    return F.regexp_replace(F.regexp_replace(text, "[0-9]", "0"), "[^a-z0./_%-]", "~")


def _grams(urls: DataFrame, order: int) -> DataFrame:
    """urls with a row for each symbol and the end: gram, the symbol after its context."""
    text = F.concat(F.lit("^" * order), _symbols(), F.lit("$"))
    at = F.explode(F.sequence(F.lit(1), F.char_length("text") - order))
    return urls.withColumn("text", text).withColumn("at", at).withColumn("gram", F.expr(f"substring(text, at, {order + 1})")).drop("text", "at")


def train(judged: DataFrame, distinct: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, score) for every gram of `distinct`: its log ratio under models trained on judged (host, path, verdict)."""
    kinds = [F.sum((F.col("verdict") == k).cast("long")).alias(k) for k in ("allow", "block")]
    counts = written(_grams(judged, order).groupBy("gram").agg(*kinds), "grams")
    scored = distinct.withColumns({"p_allow": F.lit(1.0 / SYMBOLS), "p_block": F.lit(1.0 / SYMBOLS)})
    for k in range(order + 1):
        grams = counts.groupBy(F.expr(f"right(gram, {k + 1})").alias("g")).agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
        sums = [f(c).alias(n + c) for c in ("allow", "block") for n, f in (("n_", F.sum), ("t_", lambda c: F.sum((F.col(c) > 0).cast("long"))))]
        contexts = grams.groupBy(F.expr(f"left(g, {k})").alias("h")).agg(*sums)
        scored = scored.join(contexts, F.expr(f"substring(gram, {order + 1 - k}, {k})") == F.col("h"), "left").join(grams, F.expr(f"right(gram, {k + 1})") == F.col("g"), "left")
        for c in ("allow", "block"):
            n, t, p = (F.col(x + c) for x in ("n_", "t_", "p_"))
            scored = scored.withColumn("p_" + c, F.when(n > 0, (F.coalesce(c, F.lit(0)) + t * p) / (n + t)).otherwise(p))
        scored = scored.select("gram", "p_allow", "p_block")
    ratio = F.round((F.ln("p_allow") - F.ln("p_block")) * 1e6).cast("long")
    return scored.select("gram", ratio.alias("score"))


def _with_scores(grams: DataFrame, scores: DataFrame, n: int, limit: int) -> DataFrame:
    """grams joined to their scores: by broadcast within the limit, else with the frequent grams dealt over SALTS."""
    if n <= limit:
        return grams.join(F.broadcast(scores), "gram")
    spread = scores.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return grams.withColumn("salt", F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(SALTS)).cast("int")).join(spread, ["gram", "salt"])


def _threshold(held: DataFrame) -> DataFrame:
    """One row: the bin edge `edge` that best parts held-out accepted from rejected urls (mean of both rates); 0 without either."""
    place = F.greatest(F.lit(-BINS), F.least(F.lit(BINS), F.floor(F.col("total") / (F.col("n") * float(BIN)))))
    bins = held.groupBy(place.alias("bin")).agg(*[F.sum((F.col("verdict") == k).cast("long")).alias(k) for k in ("allow", "block")])
    both = bins.agg(F.sum("allow").alias("all_allow"), F.sum("block").alias("all_block"))
    pairs = F.collect_list(F.struct("bin", "allow", "block"))  # at most 2 * BINS + 1 of them
    listed = bins.agg(pairs.alias("bins")).join(F.broadcast(both))
    tried = listed.select("*", F.explode(F.concat(F.transform("bins", lambda b: b["bin"]), F.array(F.lit(0).cast("long")))).alias("edge"))
    above = F.aggregate(F.filter("bins", lambda b: b["bin"] >= F.col("edge")), F.lit(0).cast("long"), lambda s, b: s + b["allow"])
    below = F.aggregate(F.filter("bins", lambda b: b["bin"] < F.col("edge")), F.lit(0).cast("long"), lambda s, b: s + b["block"])
    rated = tried.select("edge", (above * F.col("all_block") + below * F.col("all_allow")).alias("right"), (F.col("all_allow") * F.col("all_block")).alias("known"))
    best = rated.agg(F.max_by("edge", F.struct("right", -F.abs("edge"), "edge")).alias("edge"), F.max("known").alias("known"))
    return best.select(F.when(F.col("known") > 0, F.col("edge")).otherwise(0).alias("edge"))


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, order: int = ORDER, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """(page_id, host, path, rule, verdict, total, n) for every row of pages; total / n / 1e6 is the mean log ratio.

    A null url, or one without "://", has an empty host and path and is judged like any other text
    (the end symbol alone). Repeated rows are judged each. Without both accepted and rejected
    urls in training and calibration the threshold is 0, and a ratio of 0 allows. No rows give none.
    """
    rule, verdict = _rule(rules)
    rows = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rows = rows.withColumn("rule", rule).withColumn("ruled", verdict)
    fold = F.pmod(F.conv(F.substring(F.md5(F.concat("host", "path").cast("binary")), 1, 4), 16, 10).cast("long"), F.lit(FOLD)) == 0
    same = rows.groupBy("host", "path", "rule", "ruled").agg(F.count("*").alias("rows")).withColumn("held", fold)
    urls = written(same, "urls")
    distinct = written(_grams(urls.select("host", "path"), order).select("gram").distinct(), "distinct")
    judged = urls.where("ruled is not null and not held").select("host", "path", F.col("ruled").alias("verdict"))
    scores = written(train(judged, distinct, order), "scores")
    summed = _with_scores(_grams(urls.withColumn("page_id", F.lit(0)), order), scores, scores.count(), broadcast_grams)
    summed = summed.groupBy("host", "path", "rule", "ruled", "held").agg(F.sum("score").alias("total"), F.count("*").alias("n"))
    summed = written(summed, "sums")
    edge = _threshold(summed.where("ruled is not null and held").withColumnRenamed("ruled", "verdict"))
    found = summed.join(F.broadcast(edge)).withColumn("verdict", F.coalesce("ruled", F.when(F.col("total") / (F.col("n") * float(BIN)) >= F.col("edge"), "allow").otherwise("block")))
    found = found.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "verdict", "total", "n")
    joined = rows.join(found, (rows.host == found["_host"]) & (rows.path == found["_path"]))
    return joined.select("page_id", "host", "path", "rule", "verdict", "total", "n")


def oracle(rules: tuple[tuple[str, str], ...] = RULES, order: int = ORDER) -> str:
    """The same in DuckDB's SQL, over the view pages."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    cases: dict[str, list[str]] = {"rule": [], "ruled": []}
    for kind, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, _, rest = text.partition("/")
        fits = f"(host = {quoted(name)} OR ends_with(host, {quoted('.' + name)})) AND starts_with(path, {quoted('/' + rest)})"
        cases["rule"].append(f"WHEN {fits} THEN {quoted(text)}")
        cases["ruled"].append(f"WHEN {fits} THEN {quoted(kind)}")
    parts = [
        f"parts AS (SELECT page_id, translate(coalesce(regexp_extract(url, '{_PARTS}', 1), ''), '{_UPPER}', '{_LOWER}') AS host, coalesce(regexp_extract(url, '{_PARTS}', 2), '') AS path FROM pages)",
        f"ruled AS (SELECT *, CASE {' '.join(cases['rule'])} END AS rule, CASE {' '.join(cases['ruled'])} END AS ruled FROM parts)",
        f"urls AS (SELECT DISTINCT host, path, rule, ruled, CAST('0x' || substr(md5(host || path), 1, 4) AS BIGINT) % {FOLD} = 0 AS held FROM ruled)",
        f"texts AS (SELECT *, '{'^' * order}' || regexp_replace(regexp_replace(translate(host || path, '{_UPPER}', '{_LOWER}'), '[0-9]', '0', 'g'), '[^a-z0./_%-]', '~', 'g') || '$' AS text FROM urls)",
        f"grams AS (SELECT host, path, ruled, held, substr(text, CAST(unnest(range(1, length(text) - {order - 1})) AS BIGINT), {order + 1}) AS gram FROM texts)",
        "counts AS (SELECT gram, CAST(count(*) FILTER (ruled = 'allow') AS BIGINT) AS allow, CAST(count(*) FILTER (ruled = 'block') AS BIGINT) AS block FROM grams WHERE ruled IS NOT NULL AND NOT held GROUP BY gram)",
        f"p_0 AS (SELECT DISTINCT gram, CAST(1.0 AS DOUBLE) / {SYMBOLS} AS allow, CAST(1.0 AS DOUBLE) / {SYMBOLS} AS block FROM grams)",
    ]
    for k in range(order + 1):
        step = ", ".join(f"CASE WHEN c.n_{x} > 0 THEN (coalesce(g.{x}, 0) + c.t_{x} * p.{x}) / (c.n_{x} + c.t_{x}) ELSE p.{x} END AS {x}" for x in ("allow", "block"))
        parts += [
            f"g_{k} AS (SELECT right(gram, {k + 1}) AS g, CAST(sum(allow) AS BIGINT) AS allow, CAST(sum(block) AS BIGINT) AS block FROM counts GROUP BY 1)",
            f"c_{k} AS (SELECT left(g, {k}) AS h, CAST(sum(allow) AS BIGINT) AS n_allow, count(*) FILTER (allow > 0) AS t_allow, CAST(sum(block) AS BIGINT) AS n_block, count(*) FILTER (block > 0) AS t_block FROM g_{k} GROUP BY 1)",
            f"p_{k + 1} AS (SELECT p.gram, {step} FROM p_{k} p LEFT JOIN c_{k} c ON substr(p.gram, {order + 1 - k}, {k}) = c.h LEFT JOIN g_{k} g ON right(p.gram, {k + 1}) = g.g)",
        ]
    place = f"greatest(-{BINS}, least({BINS}, CAST(floor(total / (n * {float(BIN)})) AS BIGINT)))"
    parts += [
        f"scores AS (SELECT gram, CAST(round((ln(allow) - ln(block)) * 1e6) AS BIGINT) AS score FROM p_{order + 1})",
        "sums AS (SELECT host, path, ruled, held, CAST(sum(score) AS BIGINT) AS total, count(*) AS n FROM grams JOIN scores USING (gram) GROUP BY ALL)",
        f"bins AS (SELECT {place} AS bin, count(*) FILTER (ruled = 'allow') AS allow, count(*) FILTER (ruled = 'block') AS block FROM sums WHERE ruled IS NOT NULL AND held GROUP BY 1)",
        "edges AS (SELECT DISTINCT bin AS edge FROM bins UNION SELECT 0)",
        "rated AS (SELECT edge, coalesce((SELECT sum(allow) FROM bins WHERE bin >= edge), 0) * (SELECT sum(block) FROM bins) + coalesce((SELECT sum(block) FROM bins WHERE bin < edge), 0) * (SELECT sum(allow) FROM bins) AS good FROM edges)",
        "best AS (SELECT edge FROM rated ORDER BY good DESC NULLS LAST, abs(edge), edge DESC LIMIT 1)",
        "chosen AS (SELECT CASE WHEN (SELECT sum(allow) * sum(block) FROM bins) > 0 THEN edge ELSE 0 END AS edge FROM best)",
    ]
    verdict = f"coalesce(r.ruled, CASE WHEN s.total / (s.n * {float(BIN)}) >= (SELECT edge FROM chosen) THEN 'allow' ELSE 'block' END)"
    return f"WITH {', '.join(parts)} SELECT r.page_id, r.host, r.path, r.rule, {verdict} AS verdict, s.total, s.n FROM ruled r JOIN sums s USING (host, path)"
