"""Deleting repeated runs of lines by winnowing.

A window is a run of whole lines of `min_words` words or more that has fewer without its first or without its last line;
lines without words are passed over. Each window selects the smallest hash among its lines, the last one if
there are several: its fingerprint. Two equal windows select the same line, so every repeat of a window's length shares a
fingerprint for certain. Occurrences of a fingerprint meet by its hash; each brings the windows that selected
it, which reach from it to the left and to the right as far as a match must. A window that an earlier
occurrence has as well is a match, and matches that overlap make one run. Every line of a repeated run of
`min_words` words or more lies in a window inside the run, so runs are maximal; their lines go.

Windows are counted before they are joined, so only those that occur again reach the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burstline.lineage import cut
from burstline.llm.text import text_or_empty

MIN_WORDS = 50
# repeated windows go to every task below this many, else they are joined
SMALL_TABLE = 100_000
_NO_ID = (1 << 63) - 1


def _has_words(line: Column) -> Column:
    return F.replace(line, F.lit(" "), F.lit("")) != ""


def _windows(rows: DataFrame, min_words: int) -> DataFrame:
    """(id, key, nth, size, print, one, two): the windows of each text, `nth` counting lines with words."""
    lines = (rows.select("id", "key", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
             .where(_has_words(F.col("line")))
             .select("id", "key", "pos", F.xxhash64("line").alias("one"), F.xxhash64(F.lit(1), "line").alias("two"),
                     (F.length("line") - F.length(F.replace(F.col("line"), F.lit(" "), F.lit(""))) + 1).alias("words"))
             .repartition("id", "key").dropDuplicates(["id", "key", "pos"]))
    text = Window.partitionBy("id", "key")
    before = text.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.select(
        "*", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"), F.sum("words").over(text).alias("total"),
        (F.row_number().over(text.orderBy("pos")) - 1).alias("nth"))
    # a line has a word at least: the window ends within min_words lines
    reach = text.orderBy("start").rangeBetween(Window.unboundedPreceding, min_words - 1)
    ahead = text.orderBy("start").rowsBetween(0, min_words - 1)
    placed = placed.select(
        "id", "key", "nth", "start", "total", (F.count("*").over(text) - F.col("nth")).cast("int").alias("left"), (F.count("*").over(reach) - F.col("nth")).cast("int").alias("size"),
        F.collect_list(F.struct("one", (-F.col("nth")).alias("last"), "two")).over(ahead).alias("lines"))
    # the shortest window from this line on, and those that end before the shortest one from the next line on does
    in_order = text.orderBy("start")
    placed = placed.withColumns({"after": F.lead("size").over(in_order), "next": F.lead("start").over(in_order)})
    longest = F.when(F.col("next") + min_words <= F.col("total"), F.greatest("size", "after")).otherwise(F.col("left"))
    inside = F.slice("lines", 1, F.col("size"))
    return (placed.where(F.col("start") + min_words <= F.col("total"))
            .withColumn("size", F.explode(F.sequence("size", longest))).withColumn("inside", inside)
            .select("id", "key", "nth", "size", F.array_min("inside")["one"].alias("print"),
                    F.xxhash64(F.transform("inside", lambda x: x["one"])).alias("one"),
                    F.xxhash64(F.transform("inside", lambda x: x["two"])).alias("two")))


def repeated_lines(rows: DataFrame, min_words: int) -> DataFrame:
    """(id, key, gone): the numbers of the lines with words that repeat an earlier run, of texts that have such."""
    windows = cut(_windows(rows, min_words))
    name = ["print", "one", "two"]
    first = (windows.groupBy(*name).agg(F.min(F.struct("id", "key", "nth")).alias("first"), F.count("*").alias("n"))
             .where("n > 1").select(*name, "first"))
    first = cut(first)
    if first.count() <= SMALL_TABLE:
        first = F.broadcast(first)
    return (windows.join(first, name).where(F.struct("id", "key", "nth") > F.col("first"))
            .groupBy("id", "key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(
                F.sequence("nth", F.col("nth") + F.col("size") - 1))))).alias("gone")))


def delete_repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                          min_words: int = MIN_WORDS) -> DataFrame:
    """One row per row: doc_id, n_lines, n_removed, n_runs (of removed lines), kept (the other lines).

    Texts come in the order of id (texts with one id in the order of a hash). Words are parted by single
    blanks. Defined cases: null texts are empty and have one line; texts shorter than a window keep all;
    null ids come last; a row repeated with its id is the same text, and repeats nothing of itself; other
    columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).select(
        "doc_id", "text", F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), F.xxhash64("doc_id", "text").alias("key"))
    gone = cut(repeated_lines(rows, min_words))
    lines = F.split("text", "\n", -1)
    # numbers of lines with words become numbers of lines
    at = F.filter(F.transform("lines", lambda x, i: F.when(_has_words(x), i)), lambda i: i.isNotNull())
    jumps = F.size(F.filter(F.zip_with(F.slice("gone", 2, F.size("gone")), F.slice("gone", 1, F.size("gone") - 1),
                                       lambda a, b: a - b > 1), lambda far: far))
    touched = F.col("gone").isNotNull()
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1),
                          F.transform("gone", lambda i: F.get(F.col("at"), i)))
    # the same join at every size, so that what small tables cost tells what large ones will
    return (rows.join(gone.hint("merge"), ["id", "key"], "left").withColumn("lines", lines)
            .withColumn("at", F.when(touched, at))
            .select("doc_id", F.size("lines").cast("long").alias("n_lines"),
                    F.when(touched, F.size("gone")).otherwise(0).cast("long").alias("n_removed"),
                    F.when(touched, jumps + 1).otherwise(0).cast("long").alias("n_runs"),
                    F.when(touched, F.array_join(F.transform(left, lambda i: F.get(F.col("lines"), i)), "\n"))
                    .otherwise(F.col("text")).alias("kept")))
