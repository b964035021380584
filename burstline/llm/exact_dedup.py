"""Exact duplicates by a tree merge of sorted digest runs.

Each input partition makes one run: its digests in order, one row a digest, with the identifier that
stays so far and the number of rows. Rounds then merge `fan_in` neighbouring runs into one, digest by
digest, until one run is left (a binomial tree for `fan_in=2`). Runs are spread over all tasks by
digest, so no task ever holds a run, and a digest that a third of all rows share is one row a run. On
the way back, the result goes from the last run to the first runs and from there to the rows, so that
the rows of a hot digest stay spread over the runs they came from.

Digests are SHA-256 of the normalised text, and its length in bytes goes along as a second key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from burstline.lineage import cut
from burstline.llm.text import ascii_lower, text_or_empty

FAN_IN = 8
_KEY = ["digest", "n_bytes"]


def _digest(text_col: str) -> list:
    text = ascii_lower(text_or_empty(text_col))
    return [F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).alias("n_bytes")]


def _merged(runs: DataFrame, best) -> DataFrame:
    return (runs.groupBy("run", *_KEY).agg(best("best").alias("best"), F.sum("size").alias("size"))
            .sortWithinPartitions("run", *_KEY))


def _same(a: DataFrame, b: DataFrame, keys: list[str]):
    on = a[keys[0]].eqNullSafe(b[keys[0]])
    for k in keys[1:]:
        on = on & a[k].eqNullSafe(b[k])
    return on


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                     keep: str = "largest", fan_in: int = FAN_IN) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, digest (binary), n_bytes.

    Texts are equal when they agree after lower-casing A-Z. Of each group the row with the largest
    (`keep="smallest"`: smallest) id stays. Defined cases: a null text is the empty text; a null id loses
    to any other; of rows repeated with one id, exactly one stays; an empty table gives no rows; other
    columns are ignored, whatever their names.
    """
    if fan_in < 2:
        raise ValueError("fan_in must be 2 or more")
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), text_col)
               .select("doc_id", F.spark_partition_id().alias("run"),
                       F.monotonically_increasing_id().alias("row"), *_digest(text_col)))
    # nulls sort first in both directions, so "smallest" puts them last by a flag
    if keep == "largest":
        best, order = F.max, F.struct("doc_id", (-F.col("row")).alias("row"))
    else:
        best, order = F.min, F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    first = cut(_merged(rows.select("run", *_KEY, order.alias("best"), F.lit(1).cast("long").alias("size")), best))
    runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    level = first
    while runs > 1:
        level = cut(_merged(level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int")), best))
        runs = -(-runs // fan_in)
    root = level.select(*_KEY, F.col("best.doc_id").alias("keep_id"),
                        F.abs(F.col("best.row")).alias("keep_row"), "size")
    leaves = first.select("run", *_KEY).join(root, _KEY)
    return rows.join(leaves, ["run", *_KEY]).select(
        "doc_id", "keep_id", F.col("size").alias("group_size"),
        (F.col("row") == F.col("keep_row")).alias("kept"), *_KEY)


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                          keep: str = "largest", fan_in: int = FAN_IN) -> DataFrame:
    """`docs` with one row of each group of equal texts, all columns as they were."""
    kept = (exact_duplicates(docs, id_col, text_col, keep=keep, fan_in=fan_in)
            .where("kept").select("doc_id", *_KEY))
    rows = docs.select(F.struct("*").alias("rec"), F.col(id_col).alias("doc_id"), *_digest(text_col))
    # a row repeated with its id comes through more than once: the last step keeps one
    once = Window.partitionBy(*(rows[c] for c in ("doc_id", *_KEY))).orderBy(F.lit(0))
    return (rows.join(kept, _same(rows, kept, ["doc_id", *_KEY]), "left_semi")
            .withColumn("nth", F.row_number().over(once)).where("nth = 1").select("rec.*"))
