"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from . import url_filter

#: Weights 5, 2, 1 in turn; a source is clamped at three times its size if the level that its
#: fellows reach without the tighter ones lies above its limit.
OP9 = r"""
WITH slim AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix-1/' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM slim GROUP BY source
), ordered AS (
  SELECT *, row_number() OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST) AS k FROM sources
), levels AS (
  SELECT *, ((SELECT sum(source_size) FROM sources) - coalesce(CAST(sum(3 * source_size) OVER w AS BIGINT), 0))
            / CAST(sum(weight) OVER (ORDER BY k DESC) AS DOUBLE) AS level
  FROM ordered WINDOW w AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), water AS (
  SELECT coalesce(min(k), 9223372036854775807) AS k, coalesce(arg_min(level, k), 0) AS level FROM levels WHERE level * weight <= 3 * source_size
), goals AS (
  SELECT source, source_size, least(weight * (SELECT level FROM water), CAST(3 * source_size AS DOUBLE)) AS target FROM ordered
), wholes AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM goals
), placed AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, g.whole,
         CAST(sum(s.size) OVER a AS BIGINT) AS upto, CAST(sum(s.size) OVER (PARTITION BY s.source, s.h) AS BIGINT) AS own
  FROM slim s JOIN wholes g ON s.source IS NOT DISTINCT FROM g.source
  WINDOW a AS (PARTITION BY s.source ORDER BY s.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN target > whole * source_size AND 2 * (upto - own) + own <= 2 * (target - whole * source_size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM placed
"""

OP8 = """
WITH fine AS (
  SELECT row_number() OVER () AS own, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(64 * x) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.own, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM fine q JOIN fine c ON q.vec_id % 20 = 0 AND q.own <> c.own
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
"""

ORACLES: dict[str, str] = {"op2_url_filter": url_filter.oracle(), "op8_exact_top_k": OP8, "op9_source_mixing": OP9}
