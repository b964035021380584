"""From token bags to the vocabulary and the pruned posts of each window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burstline.functions import text as tx
from burstline.lineage import cut

# bits of a block of the filter that rare terms are held back by, and the most blocks it has: 32 MB
_BLOCK_BITS = 1 << 15
_MOST_BLOCKS = 8192
# bits of the filter per term that passes it
_BITS_PER_TERM = 16
# hashes of terms that a task counts: fewer of them in up to so many tasks, more beyond that
_FEW_KEYS, _MANY_PARTS, _TASK_KEYS = 1_000_000, 200, 4_000_000


def post_terms(eligible: DataFrame) -> DataFrame:
    """One row per post and distinct 2- or 3-gram of its tokens."""
    tokens = tx.with_columns_once(eligible, tokens=tx.feature_tokens(F.col("bag")))
    return tokens.select("window_id", "post_id", "ts", F.explode(tx.ngrams(F.col("tokens"))).alias("term"))


def _bits(key: Column) -> list[Column]:
    """The three bits of a key of 48 bits inside its block."""
    return [F.shiftrightunsigned(key, k).bitwiseAND(F.lit(_BLOCK_BITS - 1)) for k in (0, 15, 30)]


def _word(bit: Column) -> Column:
    return F.shiftright(bit, 6).cast("int")


def _mask(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))


def frequent_terms(eligible: DataFrame, floor: int) -> DataFrame:
    """`post_terms` without nearly all of those that fewer than `floor` posts of their window hold.

    Most terms of a window occur once. So hashes are counted, not terms, and those that come `floor` times are kept
    as bits of a filter, which goes to every task: at most 32 MB, however many there are. No term that
    occurs often enough is lost; a rare one that passes by chance is left to `vocabulary`, which counts the terms.

    Nothing is gained by counting before the shuffle, where the counts of a whole split would outgrow memory: hashes
    are dealt out as they come, to as many tasks as hold their counts.
    """
    terms = post_terms(eligible)
    if floor < 2:
        return terms
    expected = 2 * (eligible.agg(F.sum(F.size("bag"))).first()[0] or 0)
    parts = max(min(_MANY_PARTS, expected // _FEW_KEYS + 1), expected // _TASK_KEYS)
    keyed = terms.withColumn("_key", F.shiftrightunsigned(F.xxhash64("window_id", "term"), 16))
    often = cut(keyed.select("_key").repartition(parts, "_key").groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
                .filter(F.col("_n") >= floor).select("_key"))
    blocks = min(_MOST_BLOCKS, often.count() * _BITS_PER_TERM // _BLOCK_BITS + 1)
    block = F.pmod(F.xxhash64("_key"), F.lit(blocks))

    words = _BLOCK_BITS // 64
    number = F.col("id")
    empty = terms.sparkSession.range(blocks * words).select(
        F.floor(number / words).alias("block"), F.pmod(number, F.lit(words)).cast("int").alias("word"),
        F.lit(0).cast("long").alias("mask"))
    bits = often.select(block.alias("block"), F.explode(F.array(*_bits(F.col("_key")))).alias("bit")).select(
        "block", _word(F.col("bit")).alias("word"), _mask(F.col("bit")).alias("mask"))
    filled = (bits.unionByName(empty).groupBy("block", "word").agg(F.bit_or("mask").alias("mask"))
              .groupBy("block").agg(F.array_sort(F.collect_list(F.struct("word", "mask"))).alias("words"))
              .select("block", F.transform("words", lambda w: w["mask"]).alias("words")))
    found = keyed.withColumn("block", block).join(F.broadcast(cut(filled)), "block")
    for bit in _bits(F.col("_key")):
        found = found.filter(F.get("words", _word(bit)).bitwiseAND(_mask(bit)) != 0)
    return found.select(*terms.columns)


def share_or_floor(count: Column, share: float, floor: int) -> Column:
    return F.greatest(F.floor(count * F.lit(share)), F.lit(floor).cast("bigint"))


def vocabulary(terms: DataFrame, eligible: DataFrame, min_df_floor: int = 10,
               min_df_share: float = 0.0025) -> DataFrame:
    """Terms of a window held by enough of its eligible posts, with that number.

    Since df >= share * posts, a window has at most (terms per post / share) vocabulary terms,
    however many posts fall into it.
    """
    sizes = eligible.groupBy("window_id").agg(F.count(F.lit(1)).alias("n_eligible"))
    df = terms.groupBy("window_id", "term").agg(F.count(F.lit(1)).alias("df"))
    needed = share_or_floor(F.col("n_eligible"), min_df_share, min_df_floor)
    return (df.filter(F.col("df") >= min_df_floor).join(sizes, "window_id")
            .filter(F.col("df") >= needed).select("window_id", "term", "df"))


def pruned_posts(terms: DataFrame, vocab: DataFrame, min_post_terms: int = 4) -> DataFrame:
    """Posts with more than `min_post_terms` vocabulary terms, with those terms sorted."""
    kept = terms.join(vocab.select("window_id", "term"), ["window_id", "term"], "left_semi")
    return (kept.groupBy("window_id", "post_id", "ts")
            .agg(F.sort_array(F.collect_list("term")).alias("terms"))
            .filter(F.size("terms") > min_post_terms))


def patterns(pruned: DataFrame) -> DataFrame:
    """Posts of a window with equal terms as one row, named after the earliest of them.

    Copies are equal vectors, so distances and clusters are worked out per pattern and weighted by
    `n_posts`: a window full of copies costs no more than one with a single copy.
    """
    return (pruned.groupBy("window_id", "terms")
            .agg(F.count(F.lit(1)).alias("n_posts"), F.min(F.struct("ts", "post_id")).alias("_first"))
            .select("window_id", F.col("_first.post_id").alias("pattern_id"),
                    F.col("_first.ts").alias("ts"), "n_posts", "terms"))


def pattern_of_post(pruned: DataFrame, pats: DataFrame) -> DataFrame:
    """The pattern each pruned post belongs to."""
    return pruned.join(pats.select("window_id", "terms", "pattern_id"), ["window_id", "terms"]).select(
        "window_id", "post_id", "ts", "pattern_id")


def term_df(pats: DataFrame, vocab: DataFrame) -> DataFrame:
    """Posts per term after pruning; vocabulary terms that no pruned post holds count 0."""
    held = (pats.select("window_id", "n_posts", F.explode("terms").alias("term"))
            .groupBy("window_id", "term").agg(F.sum("n_posts").alias("df")))
    return (vocab.select("window_id", "term").join(held, ["window_id", "term"], "left")
            .select("window_id", "term", F.coalesce("df", F.lit(0).cast("bigint")).alias("df")))


def window_stats(sequence: DataFrame, windowed: DataFrame, eligible: DataFrame, vocab: DataFrame,
                 pruned: DataFrame) -> DataFrame:
    """Per window of the sequence, also one that lost its only post: posts, eligible posts, vocabulary terms,
    posts left after pruning."""

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("window_id").agg(F.count(F.lit(1)).alias(name))

    out = sequence.select("window_id").distinct()
    for part, name in ((windowed, "n_posts"), (eligible, "n_eligible"), (vocab, "n_terms"), (pruned, "n_pruned_posts")):
        out = out.join(count(part, name), "window_id", "left")
    return out.na.fill(0).withColumn("window_start", F.timestamp_seconds("window_id"))
