"""Lexical, vector and hybrid ranking. Queries come as a table, so one plan answers one or many."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..tables import settled, shuffled, spread

K1, B = 1.5, 0.75
VECTOR_WEIGHT, BM25_WEIGHT, NOTE_WEIGHT = 0.7, 0.3, 0.4
#: Candidates of either side for each row of the result.
WIDEN = 3
#: Queries and vectors that meet in one task, and terms of queries that are broadcast.
QUERY_BLOCK, SHARD = 4096, 32_768
BROADCAST_TERMS = 500_000
#: Scores that are added up at once in a task.
SCORES = 1 << 22


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, term, tf, dl): term counts of every document; built once and kept as a table at scale."""
    rows = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text")
    words = rows.select("id", T.tokens(F.col("text")).alias("ws"))
    return words.select("id", F.size("ws").cast("long").alias("dl"), F.explode("ws").alias("term")).groupBy("id", "term", "dl").agg(F.count("*").alias("tf"))


def term_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, df, tf): documents with a term, and its occurrences."""
    return postings(docs, text_col=text_col).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(qid, term, qtf) of queries (qid, query); a repeated word counts repeatedly."""
    return queries.select("qid", F.explode(T.tokens(F.col("query"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))


def corpus_stats(stored: DataFrame) -> DataFrame:
    """(n, avgdl) of stored postings (id, term, tf, dl); documents without a word are not in them."""
    return stored.groupBy("id").agg(F.first("dl").alias("dl")).agg(F.count("*").alias("n"), F.avg(F.col("dl").cast("double")).alias("avgdl"))


def _weighted(hits: DataFrame, terms: DataFrame) -> DataFrame:
    """(qid, term, qtf, df) of queries' terms that some document has: broadcast where they are few."""
    known = terms.join(hits.groupBy("term").agg(F.count("*").alias("df")), "term")
    return F.broadcast(known) if terms.count() <= BROADCAST_TERMS else known


def _part(k1: float, b: float) -> Column:
    weight = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    return F.col("qtf") * weight * (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))


def bm25_stored(stored: DataFrame, corpus: DataFrame, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(qid, id, score) of every document with a query's term, from postings (id, term, tf, dl) and one row (n, avgdl).

    Postings meet the queries' terms by key: a table kept by term is read for these terms alone. They are dealt by document
    then, so scores are added up where they arise: what is shuffled grows with the postings, not with queries times documents.
    """
    terms = query_terms(queries)
    hits = stored.join(terms.select("term").distinct(), "term", "left_semi").repartition("id")
    return hits.join(_weighted(hits, terms), "term").crossJoin(F.broadcast(corpus)).groupBy("qid", "id").agg(F.sum(_part(k1, b)).alias("score"))  # corpus is one row


def _hits(docs: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((id, dl, term, tf) of the documents' words that are terms, one row (n, avgdl) of all documents)."""
    words = spread(docs.select(F.col("doc_id").alias("id"), "text"), "id", "text").select("id", T.tokens(F.col("text")).alias("ws"))
    found = words.select("id", F.size("ws").cast("long").alias("dl"), "ws")
    corpus = found.agg(F.count("*").alias("n"), F.avg(F.col("dl").cast("double")).alias("avgdl"))
    asked = terms.select("term").distinct()
    asked = F.broadcast(asked) if asked.count() <= BROADCAST_TERMS else asked  # else all words would be shuffled to meet them
    return found.select("id", "dl", F.explode("ws").alias("term")).join(asked, "term", "left_semi").groupBy("id", "term", "dl").agg(F.count("*").alias("tf")), corpus


def bm25(docs: DataFrame, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(qid, id, score) of every document with a query's term, for documents without stored postings.

    Words are counted inside each row, so texts stay where they are; only counts of words that some query has are
    exploded and shuffled.
    """
    hits, corpus = _hits(docs, query_terms(queries))
    return bm25_stored(hits, corpus, queries, k1, b)


def ranked(scores: DataFrame, k: int | Column, by: str = "score") -> DataFrame:
    """The k best of each query with their rank; ties go to the smaller id."""
    order = Window.partitionBy("qid").orderBy(F.desc(by), "id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _counting(asked: pa.Array) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (id, ws) to (id, dl, terms, tfs): numbers of the words that are asked for, with their counts, inside each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch["ws"].value_lengths()
            words = batch["ws"].flatten()
            numbers = pc.index_in(words, value_set=asked.cast(words.type)).fill_null(-1).to_numpy()
            rows = np.repeat(np.arange(len(batch)), sizes.fill_null(0).to_numpy())
            known = numbers >= 0
            found, tf = np.unique(rows[known] * len(asked) + numbers[known], return_counts=True)
            ends = pa.array(np.searchsorted(found, np.arange(len(batch) + 1) * len(asked)), pa.int32())
            terms, counts = (pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (found % max(1, len(asked)), tf))
            yield pa.RecordBatch.from_arrays([batch["id"], sizes.cast(pa.int64()), terms, counts], ["id", "dl", "terms", "tfs"])

    return run


def _merged(parts: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, dl, term, tf) of lists of (dl, terms, tfs), ordered by row; what several of a row's rows of one dl have of a term is one."""
    several = parts.value_lengths().to_numpy()
    dls, terms, tfs = parts.flatten().flatten()
    sizes = terms.value_lengths().to_numpy()
    row, dl = np.repeat(np.repeat(np.arange(len(parts)), several), sizes), np.repeat(dls.fill_null(0).to_numpy(), sizes)
    term, tf = terms.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy().astype(np.int64)
    if len(row) and several.max() > 1:
        order = np.lexsort((term, dl, row))
        row, dl, term, tf = (x[order] for x in (row, dl, term, tf))
        first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (dl[1:] != dl[:-1]) | (term[1:] != term[:-1])])
        row, dl, term, tf = row[first], dl[first], term[first], np.add.reduceat(tf, first)
    return row, dl, term, tf


def _found_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, df) of the rows of each batch."""
    for batch in batches:
        df = np.bincount(_merged(batch["parts"])[2])
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.int32()), pa.array(df[term], pa.int64())], ["term", "df"])


def _scoring(qids: pa.Array, ends: np.ndarray, of: np.ndarray, weight: np.ndarray, avgdl: float, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (id, parts) to (qid, id, score): all that may be among a query's k best by score rounded to six digits.

    Term t has weight[i] in query of[i], for i from ends[t] up to ends[t + 1].
    """
    n_q = len(qids)
    wide, step = (max(1, SCORES // max(1, n)) for n in (n_q, len(of)))  # documents whose scores, and whose products, are held: a document meets each query's term once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.zeros(n_q)  # k documents of this task have as much
        for batch in batches:
            row, dl, term, tf = _merged(batch["parts"])
            place = np.argsort(pc.sort_indices(batch["id"], null_placement="at_start").to_numpy())
            part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))
            for low in range(0, len(batch), wide):
                n = min(wide, len(batch) - low)
                scores = np.empty((n, n_q))
                for first in range(0, n, step):
                    held = scores[first : first + step]
                    at = slice(*np.searchsorted(row, (low + first, low + first + len(held))))
                    many = (ends[1:] - ends[:-1])[term[at]]
                    hit = np.repeat(np.arange(len(many)), many)
                    use = ends[term[at]][hit] + np.arange(len(hit)) - (np.cumsum(many) - many)[hit]
                    cell = (row[at] - low - first)[hit] * n_q + of[use]
                    held[:] = np.bincount(cell, weight[use] * part[at][hit], held.size).reshape(held.shape)
                if n > k:
                    least = np.maximum(least, np.partition(scores, n - k, axis=0)[n - k])
                docs, asks = np.nonzero((scores > 0) & (scores >= least - 2e-6))
                near = scores[docs, asks]
                kept = _best(place[low + docs], near, k, asks)
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(asks[kept])), batch["id"].take(pa.array(low + docs[kept])), pa.array(near[kept])], ["qid", "id", "score"])

    return run


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, id, score, rank) of the k best documents (doc_id, text) of each query (qid, query).

    Texts are read once, into one row of counts for each id. Those rows meet the queries' terms as arrays, some documents at a
    time, and only each query's best of them are shuffled. Beyond BROADCAST_TERMS the terms are met by joins.
    """
    terms = settled(query_terms(queries))
    if terms.count() > BROADCAST_TERMS:
        hits, corpus = _hits(docs, terms)
        scores = bm25_stored(settled(hits), settled(corpus), queries)
        return ranked(scores.select("qid", "id", F.round("score", 6).alias("score")), k)
    uses = terms.orderBy("term", "qid").toArrow().combine_chunks()
    asked, qids = (pc.unique(uses[name].combine_chunks()) for name in ("term", "qid"))
    name, number = docs.schema["doc_id"].dataType.simpleString(), queries.schema["qid"].dataType.simpleString()
    words = spread(docs.select(F.col("doc_id").alias("id"), "text"), "id", "text").select("id", T.tokens(F.col("text")).alias("ws"))
    counts = words.mapInArrow(_counting(asked), f"id {name}, dl long, terms array<int>, tfs array<int>")
    kept = settled(counts.groupBy("id").agg(F.collect_list(F.struct("dl", "terms", "tfs")).alias("parts")))
    n, avgdl = kept.select(F.explode("parts.dl").alias("dl")).agg(F.count("*"), F.avg(F.col("dl").cast("double"))).first()
    found = kept.select("parts").mapInArrow(_found_in, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(len(asked))
    df[found["term"].to_numpy()] = found["df"].to_numpy()
    of_term, of = (pc.index_in(uses[name], value_set=x).to_numpy() for name, x in (("term", asked), ("qid", qids)))
    weight = uses["qtf"].to_numpy() * np.log((n - df + 0.5) / (df + 0.5) + 1.0)[of_term]
    ends = np.searchsorted(of_term, np.arange(len(asked) + 1))
    best = kept.mapInArrow(_scoring(qids, ends, of, weight, avgdl or 1.0, k), f"qid {number}, id {name}, score double")
    return ranked(best.select("qid", "id", F.round("score", 6).alias("score")), k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _sizes(lists: pa.ListArray) -> np.ndarray:
    return lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def _plain(lists: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows are vectors of this length with moderate components, their matrix)."""
    sizes = _sizes(lists)
    ends = np.cumsum(np.maximum(sizes, 0))
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    rows = np.flatnonzero(sizes == width)
    m = flat[(ends[rows] - width)[:, None] + np.arange(width)]
    fine = (np.abs(m) < 1e100).all(axis=1)
    ok = np.zeros(len(sizes), bool)
    ok[rows[fine]] = True
    return ok, m[fine]


def _full(lists: pa.ListArray) -> np.ndarray:
    """Which rows are vectors without a null."""
    sizes, null = _sizes(lists), lists.flatten().is_null().to_numpy(zero_copy_only=False)
    ends = np.cumsum(np.maximum(sizes, 0))
    nulls = np.r_[0, np.cumsum(null)]
    return (sizes >= 0) & (nulls[ends] == nulls[ends - np.maximum(sizes, 0)])


def _sum_of_products(v: list, q: list) -> float:
    out = 0.0
    for x, y in zip(v, q, strict=True):
        out += x * y
    return out


def _in_order(m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products added up from the first component to the last, as dot() does."""
    out = np.zeros(len(m))
    for j in range(m.shape[1]):
        out += m[:, j] * q[j]
    return out


def _best(ids: np.ndarray, scores: np.ndarray, k: int, of: np.ndarray | int = 0) -> np.ndarray:
    """Places of all scores but those that k equal ones (of the same query) with smaller ids precede."""
    of = np.broadcast_to(of, len(scores))
    order = np.lexsort((ids, -scores, of))
    s, q = scores[order], of[order]
    first = np.r_[0, np.flatnonzero((s[1:] != s[:-1]) | (q[1:] != q[:-1])) + 1] if len(s) else np.empty(0, np.int64)
    nth = np.arange(len(s)) - np.repeat(first, np.diff(np.r_[first, len(s)]))
    return order[nth < k]


def near_in_shard(ids: np.ndarray, m: np.ndarray, q: np.ndarray, k: int, rows: int = 256) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each row of q (places in m, scores) of all vectors that may be among its k best by score rounded to six digits.

    Matrix products, which add up in any order, choose those within a rounding step of the k-th; their scores are then added up in order.
    """
    out, size = [], np.sqrt((m * m).sum(axis=1).max(initial=0.0))
    for at in range(0, len(q), rows):
        part = q[at : at + rows]
        raw = part @ m.T
        kth = np.partition(raw, len(m) - k, axis=1)[:, len(m) - k] if len(m) > k else np.full(len(part), -np.inf)
        least = kth - 2e-6 - 1e-12 * size * np.sqrt((part * part).sum(axis=1))
        for i in range(len(part)):
            near = np.flatnonzero(raw[i] >= least[i])
            scores = _in_order(m[near], part[i])
            kept = _best(ids[near], scores, k)
            out.append((near[kept], scores[kept]))
    return out


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int, block: int = QUERY_BLOCK, shard: int = SHARD) -> DataFrame:
    """(qid, id, score, rank): the k vectors (id, v) of largest inner product with each query (qid, q).

    Groups of at most some `block` queries meet shards of at most some `shard` vectors, so a task holds one of each. Both are
    counted and dealt; a group's or shard's k best are all that is shuffled then. Vectors that are null, of another
    length or not finite get the score that dot() gives.
    """
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    n_q, n_v = queries.count(), vectors.count()
    blocks = max(1, -(-n_q // block))
    shards = max(1, -(-n_v // shard), min(-(-2 * cores // blocks), n_v // 1024))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    name, number = vectors.schema["id"].dataType, queries.schema["qid"].dataType
    asked = queries.select("qid", F.col("q").cast("array<double>").alias("q"), F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int").alias("g"))
    known = vectors.select("id", F.col("v").cast("array<double>").alias("v"), F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("s"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        qids, ids, asked_for, held = (x.combine_chunks() for x in (a["qid"], b["id"], a["q"], b["v"]))
        width = int(np.bincount(np.maximum(_sizes(asked_for), 0)).argmax()) if len(qids) else 0
        ok_q, q = _plain(asked_for, width)
        ok_v, m = _plain(held, width)
        rows_q, rows_v = np.flatnonzero(ok_q), np.flatnonzero(ok_v)
        order = np.argsort(np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, bool))]
        if len(rows_q) and len(rows_v):
            out += [(np.full(len(at), rows_q[i]), rows_v[at], scores, np.zeros(len(at), bool)) for i, (at, scores) in enumerate(near_in_shard(order[rows_v], m, q, k))]
        if not (ok_q.all() and ok_v.all()):
            by_id = np.argsort(order, kind="stable")
            size_q, size_v, full_q, full_v = _sizes(asked_for), _sizes(held), _full(asked_for), _full(held)
            values = {}
            for i in range(len(qids)):
                met = np.flatnonzero(~ok_v) if ok_q[i] else np.arange(len(ids))
                told = full_v[met] & full_q[i] & (size_v[met] == size_q[i])
                null = np.zeros(len(ids), bool)
                null[met[~told]] = True
                first = by_id[null[by_id]][:k]
                out.append((np.full(len(first), i), first, np.zeros(len(first)), np.ones(len(first), bool)))
                value = asked_for[i].as_py() if told.any() else None
                at = met[told]
                numbers = np.array([_sum_of_products(values[j] if j in values else values.setdefault(j, held[j].as_py()), value) for j in at.tolist()], np.float64)
                for group in (np.isnan(numbers), ~np.isnan(numbers)):
                    kept = np.flatnonzero(group)[_best(order[at[group]], np.nan_to_num(numbers[group], nan=0.0, posinf=np.inf, neginf=-np.inf), k)]
                    out.append((np.full(len(kept), i), at[kept], numbers[kept], np.zeros(len(kept), bool)))
        at_q, at_v, scores, null = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"qid": qids.take(pa.array(at_q)), "id": ids.take(pa.array(at_v)), "score": pa.array(scores, pa.float64(), mask=null)})

    left, right = asked.withColumn("s", every(shards)), known.withColumn("g", every(blocks))
    found = left.groupBy("g", "s").cogroup(right.groupBy("g", "s")).applyInArrow(run, f"qid {number.simpleString()}, id {name.simpleString()}, score double")
    return ranked(found.select("qid", "id", F.round("score", 6).alias("score")), k)


def type_weight(chunk_type: Column, wants_amendments: Column) -> Column:
    return F.when(chunk_type.isin("footnote", "amendment") & ~wants_amendments, NOTE_WEIGHT).otherwise(1.0)


def rank_weight(text: Column, chunk_type: Column, page: Column) -> Column:
    early = (page > 0) & (page <= 10)
    place = F.when(early & T.strip(text).rlike(r"(?i)^\s*contents\b"), 0.35).when(early & (chunk_type == "generic"), 0.6).otherwise(1.0)
    return F.when(chunk_type == "heading", 0.7).otherwise(1.0) * place


def hybrid_topk(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, vector_weight: float = VECTOR_WEIGHT, bm25_weight: float = BM25_WEIGHT) -> DataFrame:
    """(qid, id, score, rank) of chunks (doc_id, text, chunk_type, page) for queries (qid, query, q).

    Candidates are the best WIDEN * k of either side; lexical scores are divided by their largest. Queries of one
    text share its lexical scores, which are added up again for each use, so that none are stored.
    """
    wide = WIDEN * k
    near = settled(vector_topk(vectors, queries.select("qid", "q"), wide).select("qid", "id", F.col("score").alias("vs")))  # few rows of each query, used three times
    shaped = queries.select("qid", T.lexical_query(F.col("query")).alias("query"))
    texts = settled(shaped.groupBy("query").agg(F.min("qid").alias("tid")))
    of_text = settled(shaped.join(texts, shaped["query"].eqNullSafe(texts["query"])).select("qid", "tid"))
    terms = settled(query_terms(texts.select(F.col("tid").alias("qid"), "query")))
    found, corpus = _hits(chunks, terms)
    hits = shuffled(settled(found))  # no more than the chunks' words
    weighted, one = _weighted(hits, terms), F.broadcast(settled(corpus))
    part = F.sum(_part(K1, B)).alias("score")
    scored = hits.repartition("id").join(weighted, "term").crossJoin(one).groupBy("qid", "id").agg(part)
    tops = settled(scored.groupBy("qid").agg(F.max("score").alias("top")))  # partial maxima, where a window would gather a text's scores
    relative = F.round(F.col("score") / F.col("top"), 9)
    leading = ranked(scored.join(tops, "qid").select("qid", "id", relative.alias("bs")), wide, "bs").select(F.col("qid").alias("tid"), "id", "bs")
    lexical = leading.join(of_text, "tid").select("qid", "id")
    ids = settled(near.select("qid", "id").union(lexical).distinct().join(of_text, "qid"))
    pairs = ids.select(F.col("tid").alias("qid"), "id").distinct()
    told = hits.join(pairs, "id").join(weighted, ["qid", "term"]).crossJoin(one).groupBy("qid", "id").agg(part).join(tops, "qid").select(F.col("qid").alias("tid"), "id", relative.alias("bs"))
    both = ids.join(near, ["qid", "id"], "left").join(told, ["tid", "id"], "left").drop("tid")
    rows = both.join(shuffled(chunks).select(F.col("doc_id").alias("id"), "text", "chunk_type", "page"), "id").join(queries.select("qid", T.wants_amendments(F.col("query")).alias("wants")), "qid")
    raw = vector_weight * F.coalesce("vs", F.lit(0.0)) + bm25_weight * F.coalesce("bs", F.lit(0.0))
    score = raw * type_weight(F.col("chunk_type"), F.col("wants")) * rank_weight(F.col("text"), F.col("chunk_type"), F.col("page"))
    best = ranked(rows.select("qid", "id", F.round(score, 6).alias("score")), k)
    return best.withColumn("score", F.round("score", 4))
