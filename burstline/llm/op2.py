"""Query op2: repeated runs of lines of 50 words or more, deleted from all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burstline.llm.line_dedup import MIN_WORDS, delete_repeated_lines


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return delete_repeated_lines(docs).select("doc_id", "n_lines", "n_removed", "n_runs",
                                              F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = f"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
a AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS pos FROM t),
w AS (
  SELECT doc_id, line, pos, length(line) - length(replace(line, ' ', '')) + 1 AS words,
    row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS nth
  FROM a WHERE replace(line, ' ', '') <> ''),
s AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) - words AS start,
    sum(words) OVER (PARTITION BY doc_id) AS total FROM w),
e AS (SELECT *, list(line) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {MIN_WORDS - 1} FOLLOWING) AS ahead
  FROM s),
-- runs of {MIN_WORDS} words or more that have fewer without their first or without their last line
v AS (
  SELECT x.doc_id, x.nth, y.nth - x.nth + 1 AS size, ahead[1:y.nth - x.nth + 1] AS win
  FROM e AS x JOIN s AS y ON y.doc_id = x.doc_id AND y.nth BETWEEN x.nth AND x.nth + {MIN_WORDS - 1}
  WHERE y.start + y.words - x.start >= {MIN_WORDS}
    AND (y.start - x.start < {MIN_WORDS} OR y.start + y.words - x.start - x.words < {MIN_WORDS})),
r AS (
  SELECT doc_id, nth, size,
    first_value(doc_id) OVER (PARTITION BY win ORDER BY doc_id, nth) AS first_doc,
    first_value(nth) OVER (PARTITION BY win ORDER BY doc_id, nth) AS first_nth
  FROM v),
g AS (SELECT DISTINCT doc_id, unnest(range(nth, nth + size)) AS nth FROM r
  WHERE doc_id > first_doc OR doc_id = first_doc AND nth > first_nth),
n AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (before IS NULL OR before < nth - 1) AS n_runs
  FROM (SELECT *, lag(nth) OVER (PARTITION BY doc_id ORDER BY nth) AS before FROM g) GROUP BY doc_id),
k AS (SELECT a.doc_id, count(*) AS n_lines,
    coalesce(string_agg(a.line, chr(10) ORDER BY a.pos) FILTER (g.nth IS NULL), '') AS kept
  FROM a LEFT JOIN w ON w.doc_id = a.doc_id AND w.pos = a.pos LEFT JOIN g ON g.doc_id = w.doc_id AND g.nth = w.nth
  GROUP BY a.doc_id)
SELECT doc_id, n_lines::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
  coalesce(n_runs, 0)::BIGINT AS n_runs, sha256(kept) AS kept_sha256
FROM k LEFT JOIN n USING (doc_id)
"""
