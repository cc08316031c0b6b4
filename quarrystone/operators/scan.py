"""Prefix scans over ordered rows of groups, in blocks: no task ever holds a group.

A window over a group is one task, however long the group. Here rows meet in blocks of a fixed width, blocks in blocks
of blocks, and so on; the combined value of a block stands for its rows one level up, and what comes before a block
is handed down again. The number of levels is the logarithm of the longest span of places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import settled, shuffled

WIDTH = 64


def exclusive_scan(rows: DataFrame, group: str, at: str, value: str, combine: Callable[[Column, Column], Column], nothing: Column, width: int = WIDTH) -> DataFrame:
    """(group, at, before): the values of a group's rows at smaller places, combined in order.

    combine is associative and `nothing` its neutral value, both of the type of `value`. Places are whole numbers,
    each once in a group; gaps between them are fine, and groups may be null.
    """
    kind = rows.schema[value].dataType
    spans = rows.agg(F.min(at).alias("first"), F.max(at).alias("last")).first()
    if spans is None or spans["first"] is None:
        return rows.select(group, at, F.col(value).alias("before"))
    first, span = spans["first"], spans["last"] - spans["first"]
    level = rows.select(F.col(group).alias("_g"), (F.col(at) - F.lit(first)).cast("long").alias("_at"), F.col(value).alias("_v"))
    blocks = []
    while True:
        items = F.array_sort(F.collect_list(F.struct("_at", "_v")), lambda a, b: F.when(a["_at"] < b["_at"], -1).when(a["_at"] > b["_at"], 1).otherwise(0))
        block = level.groupBy("_g", F.floor(F.col("_at") / width).cast("long").alias("_block")).agg(items.alias("_items"))
        span //= width
        if not span:
            blocks.append(block.withColumn("_before", nothing.cast(kind)))
            break
        blocks.append(block := shuffled(settled(block)))
        total = F.aggregate("_items", nothing.cast(kind), lambda a, x: combine(a, x["_v"]).cast(kind))
        level = block.select("_g", F.col("_block").alias("_at"), total.alias("_v"))

    def handed(block: DataFrame) -> DataFrame:
        state = F.struct(F.col("_before").alias("now"), F.array().cast(f"array<struct<_at:long,_before:{kind.simpleString()}>>").alias("out"))
        step = lambda s, x: F.struct(combine(s["now"], x["_v"]).cast(kind).alias("now"), F.concat(s["out"], F.array(F.struct(x["_at"].alias("_at"), s["now"].alias("_before")))).alias("out"))
        return block.select("_g", F.explode(F.aggregate("_items", state, step, lambda s: s["out"])).alias("x")).select("_g", "x._at", "x._before")

    found = handed(blocks.pop())
    while blocks:
        above = found.select(F.col("_g").alias("_g2"), F.col("_at").alias("_block2"), "_before")
        low = blocks.pop()
        found = handed(low.join(above, low["_g"].eqNullSafe(above["_g2"]) & (low["_block"] == above["_block2"])))
    return found.select(F.col("_g").alias(group), (F.col("_at") + F.lit(first)).alias(at), F.col("_before").alias("before"))
