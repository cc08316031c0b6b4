import hashlib
import os
import zlib
from collections import Counter, defaultdict
from datetime import datetime

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quarrystone.llm import co_bucket

BUCKETS = 8


def number(key, known=None):
    if key is None:
        return BUCKETS + 1
    return BUCKETS if known is not None and key not in known else zlib.crc32(f"s{key}".encode()) % BUCKETS


def ordered(rows):
    return sorted(rows, key=lambda r: [(v is not None, v.encode() if isinstance(v, str) else v) for v in r])


def sha(values):
    return hashlib.sha256(",".join("" if v is None else str(v) for v in values).encode()).hexdigest()


def expected(sales, lines):
    """Both tables bucket by bucket, from plain lists."""
    known, out = {s[0] for s in sales if s[0] is not None}, {}
    n_sales, n_lines = Counter(s[0] for s in sales), Counter(x[0] for x in lines)
    for name, rows, start, ids in (
        ("sales", sales, lambda r: number(r[0]) - (number(r[0]) % 4 == 1), None),
        ("lines", lines, lambda r: zlib.crc32(str(r[2]).encode()) % BUCKETS if r[2] is not None else 0, known),
    ):
        started, finals = defaultdict(list), defaultdict(list)
        for r in rows:
            started[start(r)].append(r)
            finals[number(r[0], ids)].append(r)
        for b, own in finals.items():
            sources = Counter(start(r) for r in own)
            stays = any(ordered(started[s]) == ordered(own) for s in sources)
            joined = sum(n * n_lines[k] for k, n in n_sales.items() if k is not None and number(k) == b)
            out[name, b] = (ordered(own), sha(r[0] for r in ordered(own)), sha(f"{s}:{n}" for s, n in sorted(sources.items())), joined, not stays)
    return out


def held(found, tables):
    rows = {(r["table_name"], r["bucket"]): r for r in found.collect()}
    want = expected(*tables)
    assert rows.keys() == want.keys()
    for at, (own, ids, lineage, joined, changed) in want.items():
        r, path = rows[at], rows[at]["path"].removeprefix("file://")
        stored = pq.ParquetFile(path)
        assert ",".join(stored.schema_arrow.names) == r["columns"]
        assert [tuple(x.values()) for x in stored.read().to_pylist()] == own
        assert (r["n_rows"], r["ids_sha256"], r["lineage_sha256"], r["n_joined"], r["rewritten"]) == (len(own), ids, lineage, joined, changed), at
    return rows


def sides(spark, sales, lines):
    s = spark.createDataFrame(sales, "k long, status string, `_start` double, at timestamp_ntz")
    x = spark.createDataFrame(lines, "k long, line int, item long, `_known` string, `_place` int")
    own = co_bucket.bucket(F.col("k"), None, BUCKETS)
    item = F.crc32(F.col("item").cast("string").cast("binary")) % BUCKETS
    return co_bucket.Side("sales", s, F.when(own % 4 == 1, own - 1).otherwise(own)), co_bucket.Side("lines", x, F.coalesce(item, F.lit(0)))


def made(n):
    sales = [(i if i % 17 else None, ("é", None, "a" * 3000, "z")[i % 4], None if i % 5 == 0 else i / 3, datetime(2024, 1, 1 + i % 28)) for i in range(n)]
    lines = [((7 if i % 3 == 0 else i % (n + 9)) if i % 19 else None, i % 5, None if i % 11 == 0 else i % 40, None if i % 7 else "x", i % 2) for i in range(6 * n)]
    return sales + sales[:5], lines + lines[:40] * 3


@pytest.mark.parametrize("n", (0, 1, 12, 150))
def test_files_and_digests_equal_plain_lists(spark, tmp_path, n, monkeypatch):
    monkeypatch.setattr(co_bucket, "BATCH_ROWS", 7)
    tables = made(n)
    path = f"file://{tmp_path}/pair"
    rows = held(co_bucket.co_bucket(*sides(spark, *tables), "k", path, BUCKETS), tables)
    found = {os.path.join(d, f) for d, _, names in os.walk(tmp_path) for f in names if f.endswith(".parquet")}
    assert found == {r["path"].removeprefix("file://") for r in rows.values()}
    if n == 150:
        assert {r["rewritten"] for r in rows.values()} == {True, False}
        table = spark.read.parquet(f"{path}/lines")
        assert table.columns == ["k", "line", "item", "_known", "_place"] and table.count() == len(tables[1])


def test_one_table_empty(spark, tmp_path):
    tables = ([], made(12)[1])
    rows = held(co_bucket.co_bucket(*sides(spark, *tables), "k", f"file://{tmp_path}/pair", BUCKETS), tables)
    assert {b for _, b in rows} == {BUCKETS, BUCKETS + 1}


def test_a_file_of_equal_rows_is_cut_into_runs_and_joined(spark, tmp_path):
    tables = ([(7, "a", None, None)], [(7, 1, i % 9, "x", 0) for i in range(4000)])
    held(co_bucket.co_bucket(*sides(spark, *tables), "k", f"file://{tmp_path}/pair", BUCKETS), tables)


def test_only_listed_files_are_read(spark, tmp_path):
    first, second = sides(spark, *made(150))
    folder = co_bucket.Folder(spark, f"file://{tmp_path}/pair")
    own = co_bucket.lay_out(folder, first, "k")
    kept = [path.rpartition("/")[2] for path, *_ in own.values()][:2]
    rows = co_bucket._stored(folder, first).where(~F.col("_metadata.file_name").isin(kept))
    assert not {f.rpartition("/")[2] for f in (r[0] for r in rows.select("_metadata.file_name").distinct().collect())} & set(kept)
