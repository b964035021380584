"""The pipeline's stages, one after the other, against brute force; the registered queries against their SQL."""

from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as cp
from burstline.llm import queries
from burstline.llm.quality import classify
from tests.llm.cases import LOWER, shingles
from tests.llm.test_ngram_join import brute
from tests.llm.test_packing import whole


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Rows before the first stage and after each."""
    out = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.unionByName(docs.limit(5)).unionByName(docs.limit(3).withColumn("text", F.lit(None).cast("string")))
    rows.write.parquet(f"{out}/0")
    for k, (_, stage) in enumerate(cp.STAGES, 1):
        stage(spark, spark.read.parquet(f"{out}/{k - 1}"), sf_dir).write.parquet(f"{out}/{k}")
    return [spark.read.parquet(f"{out}/{k}") for k in range(len(cp.STAGES) + 1)]


def test_each_stage(spark, sf_dir, stages):
    names = [name for name, _ in cp.STAGES]
    assert names == ["quality", "exact", "near", "mixing", "packing"]
    assert all(df.columns == stages[0].columns for df in stages[:-1])
    rows = [[(r.doc_id, r.text) for r in df.collect()] for df in stages[:-1]]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = classify(stages[0], labels, host=F.col("source"), path=F.concat_ws("/", "source", "lang")).where("kept").count()
    assert len(rows[1]) == kept < len(rows[0])
    groups = defaultdict(list)
    for i, t in rows[1]:
        groups[(t or "").translate(LOWER)].append(i)
    assert sorted((t or "").translate(LOWER) for _, t in rows[2]) == sorted(groups)
    assert all(max(groups[(t or "").translate(LOWER)]) == i for i, t in rows[2])
    want = {w[2] for w in brute(rows[2], 5, 80) if w[1]}
    assert {i for i, t in rows[3] if shingles(t, 5)} == want
    assert set(rows[4]) <= set(rows[3])
    tokens = lambda part: sum(len(t or "") for _, t in part)
    assert 0.8 * tokens(rows[3]) < tokens(rows[4]) <= tokens(rows[3])
    pieces = stages[-1].groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    ids = defaultdict(int)
    for i, t in whole(rows[4]):
        ids[i] += len(t)
    assert {r.doc_id: r.n for r in pieces} == dict(ids)


def test_run_gives_the_last_stage(spark, sf_dir):
    got = cp.run(spark, sf_dir)
    assert got.agg(F.sum("length")).first()[0] > 0 and cp.ORACLE_SQL is None
    assert "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf_dir).toPandas(), con.sql(queries.ORACLE[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    one, two = (f[cols].astype(str).sort_values(cols).values.tolist() for f in (got, want))
    assert one == two


def test_every_operator_has_one_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14))
