"""Query op7: groups of documents linked by the similarity of their 4-word shingles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from burstline.llm.ngram_join import linked_documents


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT r, array_to_string(w[i:i + 3], ' ') AS shingle
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT r, count(*) AS n, coalesce(string_agg(shingle, chr(10) ORDER BY shingle), '') AS shingles FROM s GROUP BY r),
links AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.r AS a, y.r AS b, count(*) AS shared FROM s AS x JOIN s AS y USING (shingle) WHERE x.r <> y.r GROUP BY ALL)
  JOIN (SELECT r AS a, n AS na FROM n) USING (a) JOIN (SELECT r AS b, n AS nb FROM n) USING (b)
  WHERE 100 * shared >= 85 * (na + nb - shared)),
reached AS (SELECT r, r AS other FROM d UNION SELECT r, b FROM reached JOIN links ON a = other)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, CASE WHEN n IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY shingles) END AS class_id
FROM d LEFT JOIN n USING (r)
JOIN (SELECT reached.r, min(doc_id) AS component_id FROM reached JOIN d ON d.r = reached.other GROUP BY reached.r) USING (r)
"""
