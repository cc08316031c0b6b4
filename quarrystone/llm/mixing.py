"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checked_broadcast, partitions, unused, written

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
#: Documents that one window sorts, about.
BUCKET = 20_000
#: Sources whose table may be broadcast: some 100 bytes each.
BROADCAST_SOURCES = 50_000


def sizes(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _weighted(sources: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """sources with their weight: the weights in turn, in code-point order, null last. Numbered in parts, so no task gets all."""
    n = partitions(sources.sparkSession)
    dealt = written(sources.repartitionByRange(n, F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    counts = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.pmod(F.col("before") + F.col("nth"), F.lit(len(weights)))
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int"))
    return dealt.withColumn("nth", nth).join(before, "part").select("source", "source_size", "n_docs", weight.cast("long").alias("weight"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, n_docs, target): shares of all sizes by weight, clamped at max_epochs times the source.

    Each round shares what the clamped sources left by weight among the others and clamps those
    that come above their limit, until none is. A round takes three numbers to the driver.
    """
    known = written(_weighted(sources, weights), "weighted")
    limit = F.col("source_size") * max_epochs
    total = known.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level = float("-inf")
    while True:
        clamped = F.col("weight") * F.lit(level) > limit
        left, weight = known.agg(F.sum(F.when(clamped, limit).otherwise(0)), F.sum(F.when(clamped, 0).otherwise(F.col("weight")))).first()
        after = (total - (left or 0)) / weight if weight else level
        if after <= level or not weight:
            break
        level = after
    target = F.least(F.col("weight") * F.lit(level if level > 0 else 0.0), limit.cast("double"))
    return known.select("source", "source_size", "n_docs", target.alias("target"))


def _place(doc_id: Column, seed: str) -> Column:
    """A document's place in the seeded order: 60 bits."""
    digest = F.md5(F.concat(F.lit(seed + "/"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _cutoffs(slim: DataFrame, known: DataFrame, bucket: int) -> DataFrame:
    """known with `whole`, the repetitions that all of a source get, and `cutoff`: places up to there get one more.

    Only the bucket of places in which a source's cutoff falls is sorted, so no task gets a whole source.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goals = known.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    goals = goals.select(F.col("source").alias("_source"), "source_size", "target", "whole", "rest", F.ceil(F.col("n_docs") / bucket).alias("cuts"))
    placed = slim.join(goals, slim.source.eqNullSafe(goals["_source"])).where("rest > 0").select("source", "h", "size", "rest", F.shiftright(F.shiftright("h", 30) * F.col("cuts"), 30).alias("bucket"))
    sums = placed.groupBy("source", "bucket").agg(F.sum("size").alias("n"), F.first("rest").alias("rest"), F.max("h").alias("last"))
    upto = F.sum("n").over(Window.partitionBy("source").orderBy("bucket"))
    sums = written(sums.withColumn("before", upto - F.col("n")), "buckets")
    full = F.max(F.when(F.col("before") + F.col("n") <= F.col("rest"), F.col("last")))
    crossed = sums.where("before <= rest and before + n > rest").select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), "before")
    inside = placed.join(crossed, placed.source.eqNullSafe(crossed["_source"]) & (placed.bucket == crossed["_bucket"]))
    inside = inside.groupBy("source", "bucket", "h").agg(F.sum("size").alias("n"), F.first("rest").alias("rest"), F.first("before").alias("before"))
    earlier = F.col("before") + F.sum("n").over(Window.partitionBy("source", "bucket").orderBy("h")) - F.col("n")
    part = inside.withColumn("earlier", earlier).where(2 * F.col("earlier") + F.col("n") <= 2 * F.col("rest"))
    ends = sums.groupBy("source").agg(full.alias("cutoff")).unionByName(part.groupBy("source").agg(F.max("h").alias("cutoff")))
    ends = ends.groupBy("source").agg(F.max("cutoff").alias("cutoff"))
    found = goals.join(ends, goals["_source"].eqNullSafe(ends.source), "left")
    return found.select("_source", "source_size", "target", "whole", F.coalesce("cutoff", F.lit(-1)).alias("cutoff"))


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size, h) for every row, and a row for each source: (_source, source_size, target, whole, cutoff)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", sizes(docs["text"]).alias("size"), _place(docs["doc_id"], seed).alias("h"))
    slim = written(rows, "sizes")
    sources = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    known = written(targets(sources, weights, max_epochs), "targets")
    n = known.count()
    found = written(_cutoffs(slim, checked_broadcast(known, n, BROADCAST_SOURCES), bucket), "cutoffs")
    return slim, checked_broadcast(found, n, BROADCAST_SOURCES)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, size, source_size, target, taken, repeats) for every row of docs.

    Each document is taken floor(target / source_size) times, and once more if it stands early enough
    in a seeded order of ids: the order is followed until what it adds would overshoot the target by
    more than it fell short. So a source misses its target by at most half of one document's size.
    Null and empty texts have size 0; null is a source of its own, ordered last; rows with equal ids
    (null ids too) are decided together; an empty table gives no rows. Reruns agree.
    """
    slim, known = plan(docs, weights, max_epochs, seed, bucket)
    repeats = F.col("whole") + (F.col("h") <= F.col("cutoff")).cast("long")
    found = slim.join(known, slim.source.eqNullSafe(known["_source"])).withColumn("repeats", repeats)
    return found.select("doc_id", "size", "source_size", "target", (F.col("repeats") * F.col("size")).alias("taken"), "repeats")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, bucket: int = BUCKET) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken, with their own columns, of any names and types.

    Null and empty texts, which have no words, are never taken; null sources, equal ids and no rows are as in mix().
    """
    _, known = plan(docs, weights, max_epochs, seed, bucket)
    name = unused("_mix", docs)
    goals = known.select(F.struct("_source", "whole", "cutoff").alias(name))
    repeats = F.col(f"{name}.whole") + (_place(docs["doc_id"], seed) <= F.col(f"{name}.cutoff")).cast("long")
    found = docs.join(goals, docs["source"].eqNullSafe(F.col(f"{name}._source"))).withColumn(name, F.explode(F.array_repeat(F.lit(1), repeats.cast("int"))))
    return found.select(*[docs[c] for c in docs.columns])
