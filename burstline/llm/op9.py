"""Query op9: all documents mixed to target weights; the number of a source, modulo 4, makes its domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from burstline.llm.mixing import MixParams, mix

PARAMS = MixParams(share_percent=60, max_epochs=2, seed=7, weights={
    "domain": {"d0": 4, "d1": 3, "d2": 2}, "language": {"en": 5, "de": 2, "fr": 2}, "source": {"src0": 2}})


def domain_of(source: Column) -> Column:
    number = F.right(F.concat(F.lit("0"), F.regexp_extract(source, "([0-9]+)", 1)), F.lit(9))
    return F.concat(F.lit("d"), number.cast("long") % 4)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs, domain=domain_of(F.col("source")), language=F.col("lang"), source=F.col("source"), params=PARAMS)


def _level(depth: int) -> str:
    """The shares of the nodes of one level, from those of the level above (`b<depth>`)."""
    names = ["domain", "language", "source"][:depth + 1]
    parent, cols, level = ", ".join(names[:-1]) or "root", ", ".join(names), names[-1]
    listed = " ".join(f"WHEN '{k}' THEN {w}" for k, w in PARAMS.weights[level].items())
    root = "" if depth else "0 AS root, "
    return f"""
n{depth} AS (SELECT {root}{cols}, sum(room)::HUGEINT AS room, (CASE {level} {listed} ELSE 1 END)::HUGEINT AS w
  FROM rooms GROUP BY {cols}),
o{depth} AS (SELECT n.*, budget - coalesce(sum(room) OVER p, 0) AS lft,
    sum(w) OVER (PARTITION BY {parent}) - coalesce(sum(w) OVER p, 0) AS heavy
  FROM n{depth} n JOIN b{depth} USING ({parent})
  WINDOW p AS (PARTITION BY {parent} ORDER BY room / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f{depth} AS (SELECT *, room * heavy <= w * lft AS filled FROM o{depth}),
b{depth + 1} AS (SELECT {cols}, CASE WHEN filled THEN room::HUGEINT ELSE
    (w * max(lft) FILTER (NOT filled) OVER q)::HUGEINT // (max(heavy) FILTER (NOT filled) OVER q)::HUGEINT END AS budget
  FROM f{depth} WINDOW q AS (PARTITION BY {parent}))"""


ORACLE = f"""
WITH rows AS (
  SELECT doc_id, 'd' || (CAST(right('0' || regexp_extract(source, '([0-9]+)', 1), 9) AS BIGINT) % 4) AS domain,
    coalesce(lang, '') AS language, coalesce(source, '') AS source,
    CASE WHEN coalesce(text, '') = '' THEN 0
      ELSE length(text) - length(replace(replace(text, ' ', ''), chr(10), '')) + 1 END AS n_tokens
  FROM documents),
leaves AS (SELECT domain, language, source, sum(n_tokens)::HUGEINT AS tokens FROM rows GROUP BY ALL),
rooms AS (SELECT *, tokens * {PARAMS.max_epochs} AS room FROM leaves WHERE tokens > 0),
b0 AS (SELECT 0 AS root, least((SELECT sum(tokens) FROM leaves) * {PARAMS.share_percent} // 100,
                               (SELECT sum(room) FROM rooms))::HUGEINT AS budget),
{",".join(_level(d) for d in range(3))},
plan AS (SELECT domain, language, source, (budget // tokens)::BIGINT AS whole, (budget % tokens)::BIGINT AS rest
  FROM b3 JOIN leaves USING (domain, language, source)),
seen AS (SELECT rows.*, whole, rest, sum(n_tokens) OVER (PARTITION BY domain, language, source
      ORDER BY md5('{PARAMS.seed}|' || whole || '|' || doc_id)) - n_tokens AS before
  FROM rows JOIN plan USING (domain, language, source)),
taken AS (
  SELECT doc_id, domain, language, source, unnest(range(whole)) AS epoch, n_tokens, n_tokens AS tokens_taken FROM seen
  UNION ALL
  SELECT doc_id, domain, language, source, whole, n_tokens, least(n_tokens, rest - before) FROM seen WHERE before < rest)
SELECT doc_id, domain, language, source, epoch::BIGINT AS epoch, n_tokens::BIGINT AS n_tokens,
  tokens_taken::BIGINT AS tokens_taken FROM taken
"""
