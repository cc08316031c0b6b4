"""The carry between pages on a stream: pages come in any order and any batches, each document's state is what the next page takes over.

How a page reads in each of the five states is worked out by Spark's expressions before the state is met, and its chunks after
it; the stateful step only follows, page by page, which of the five applies, and holds back pages that have come too early.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import structure as S
from ..functions import text as T
from ..operators import segment
from ..tables import let

VALUES = ("article", "heading", "schedule", "list", "entry")
STATE = "page int, state int, " + ", ".join(f"{v} string" for v in VALUES)
OUT = "doc_id long, page int, text string, " + ", ".join(f"{v} string" for v in VALUES)
#: Milliseconds for which a page that came too early waits for those before it.
LATE = 60_000


class CarryOver(StatefulProcessor):
    """Per document: the last page passed on with what it carries, and the pages that wait for those before them."""

    def __init__(self, first: int = 1, late: int = LATE):
        self.first, self.late = first, late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", STATE)
        self.waiting = handle.getMapState("waiting", "page int", "text string, step string")

    def _state(self) -> tuple[int, int, dict]:
        found = self.last.get() if self.last.exists() else None
        return (found[0], found[1], dict(zip(VALUES, found[2:], strict=True))) if found else (self.first - 1, 0, dict.fromkeys(VALUES, ""))

    def _passed(self, key: tuple, over_gaps: bool) -> pd.DataFrame:
        """Pages whose turn it is, with what they take over; over_gaps: all that wait."""
        page, state, values = self._state()
        held = {k[0]: v for k, v in self.waiting.iterator()}
        out = []
        for n in sorted(held):
            text, step = held[n]
            if n <= page:  # those after it are gone: it stands alone
                out.append((key[0], n, text, *[""] * len(VALUES)))
            elif n == page + 1 or over_gaps:
                out.append((key[0], n, text, *values.values()))
                if step:
                    taken = json.loads(step)[state]
                    values = {v: values[v] if taken.get(v) is None else taken[v] for v in VALUES}
                    state = taken["state"]
                page = n
            else:
                break
            self.waiting.removeKey((n,))
        if out:
            self.last.update((page, state, *values.values()))
        return pd.DataFrame(out, columns=[f.split()[0] for f in OUT.split(", ")])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for part in rows:
            for page, text, step in zip(part["page"].tolist(), part["text"].tolist(), part["step"].tolist(), strict=True):
                self.waiting.updateValue((int(page),), (text, step))
        yield self._passed(key, False)
        if next(iter(self.waiting.keys()), None) is not None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.late)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self._passed(key, True)

    def close(self) -> None:
        pass


def carried_pages(pages: DataFrame, first: int = 1, late: int = LATE, min_size: int = segment.MIN_SIZE) -> DataFrame:
    """(doc_id, page, text, carry) of a stream of pages (doc_id, page, text), each page once, when all before it have come.

    Pages count from `first`. One that waits for `late` milliseconds goes on without those that are missing; a page that
    comes after that carries nothing. Blank pages change nothing. A state is a few strings and the pages that wait. The
    session's state store has to be RocksDB's; with the trigger availableNow, which timers would keep from ending, set
    spark.sql.streaming.noDataMicroBatches.enabled to false, and timers are looked at when the next pages come.
    """
    text = F.translate(F.coalesce("text", F.lit("")), segment._CAME + segment._MARK, "")
    rows = pages.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("page").cast("int").alias("page"), text.alias("text")).where("page IS NOT NULL")
    step = let(S.marked_lines(F.col("text")), lambda ms: let(segment.article_segments(F.col("text")), lambda a: segment._next_states(ms, a, min_size)))
    read = rows.withColumn("step", F.when(T.strip(F.col("text")) != "", F.to_json(step)).otherwise(""))
    found = read.groupBy("doc_id").transformWithStateInPandas(CarryOver(first, late), OUT, "Append", "ProcessingTime")
    return found.select("doc_id", "page", "text", F.struct(*VALUES).alias("carry"))


def chunk_pages_stream(pages: DataFrame, first: int = 1, late: int = LATE, size: int = segment.CHUNK_SIZE, min_size: int = segment.MIN_SIZE) -> DataFrame:
    """(doc_id, page, pos, text, chunk_type, identifiers) of a stream of pages: what chunk_pages() makes, without numbers in the document."""
    filled = carried_pages(pages, first, late, min_size).where(T.strip(F.col("text")) != "")
    cut = filled.select("doc_id", "page", F.posexplode(segment.page_chunks(F.col("text"), F.col("carry"), size, min_size)).alias("pos", "c"))
    return cut.select("doc_id", "page", "pos", "c.text", "c.chunk_type", "c.article_id", "c.schedule_id", "c.list_id", "c.entry_id", "c.section_id")
