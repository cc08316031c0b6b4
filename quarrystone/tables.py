"""How tables are dealt out, and how a Column is computed once."""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SHUFFLED = ("Join", "Aggregate", "Exchange", "Window", "Sort", "CoGroup", "FlatMapGroups")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by a hash of its keys if it is a scan of fewer partitions than the cluster has cores, else as it is.

    For work that costs much more than moving the rows: a table of one file would else be one task. Tables
    of many files, which is what large ones are, and rows that a shuffle has dealt stay where they are.
    """
    plan = df._jdf.queryExecution().sparkPlan().toString()
    if any(name in plan for name in _SHUFFLED):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores, F.xxhash64(*keys)) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, *keys: str, least: int = 0) -> DataFrame:
    """df dealt by a hash of its keys to three tasks a core, or to `least` tasks if that is more.

    For slim rows whose work costs much more than moving them: a file of such rows is so small, or has so few row
    groups, that its partitions say nothing of the work. Nor do those of a join, which are put together by their bytes.
    """
    return df.repartition(max(least, 3 * df.sparkSession.sparkContext.defaultParallelism), F.xxhash64(*keys))


def shuffled(df: DataFrame) -> DataFrame:
    """df for joins that shuffle it and never broadcast it.

    For rows that grow with a table: Spark reckons their size by the table's file, and files of rows that compress well are
    many times smaller than what the driver would hold. The hint reaches the first join above df.
    """
    return df.hint("merge")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once: a Column inside a lambda is computed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def settled(df: DataFrame) -> DataFrame:
    """df computed once and cut from its lineage, by a checkpoint in the folder that spark.checkpoint.dir names.

    Plans that use a result several times stay small. Where no folder is set, one machine uses its own.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found and not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(found or f"file:///tmp/checkpoints/quarrystone-{os.getpid()}")
    return df.checkpoint()
