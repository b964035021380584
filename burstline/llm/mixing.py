"""Mixing sources to target weights by hierarchical budgets.

Documents hang in a tree (domain, language, source). A budget of tokens flows from the root down: each
node shares what it has among its children by weight, no child gets more than it can give, and what a
child cannot take goes to its siblings by weight. A node is never given more than its children can take
together, so a shortage reaches the parent's siblings only when all children are full.

What a leaf can give is `max_epochs` times its tokens. A leaf that got b of its t tokens contributes
b // t whole epochs and a prefix of b % t tokens of the next; every epoch has an order of its own, set by
a seeded digest of the document.

Amounts are whole numbers, so shares do not depend on the order of summing. Running sums inside a leaf go
in two steps, over slices of the digest and then inside a slice, so that no task holds a leaf.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burstline.lineage import cut
from burstline.llm.text import text_or_empty

LEVELS = ["domain", "language", "source"]
SLICE_ROWS = 1 << 13  # about so many rows of a leaf are summed in one task
# tables of nodes and slices go to every task below this many rows, else they are joined
SMALL_TABLE = 50_000


@dataclass(frozen=True)
class MixParams:
    """Weights are whole numbers by the node's name at each level; names that are not listed have weight 1."""

    share_percent: int = 50  # of all tokens, the budget of the root
    max_epochs: int = 2
    seed: int = 7
    weights: dict[str, dict[str, int]] = field(default_factory=dict)
    whole_documents: bool = False  # take the document at the end of a prefix whole, not its first tokens


def n_tokens(text: Column) -> Column:
    """Words between single blanks and line ends; 0 for the empty text."""
    return F.when(text == "", 0).otherwise(
        F.length(text) - F.length(F.translate(text, " \n", "")) + 1).cast("long")


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    out = F.lit(1)
    for name, w in sorted(weights.get(level, {}).items()):
        out = F.when(F.col(level) == name, F.lit(w)).otherwise(out)
    return out.cast("decimal(18,0)")


def _shared(children: DataFrame, parent: list[str]) -> DataFrame:
    """`children` (parent, name, w, room, budget of the parent) with the budget of each child.

    Children fill up in the order of room by weight; the first that does not fill leaves all later ones
    unfilled, and those share the rest by weight.
    """
    wide = "decimal(38,0)"
    before = (Window.partitionBy(*parent).orderBy(F.col("room") / F.col("w"), "name")
              .rowsBetween(Window.unboundedPreceding, -1))
    everything = Window.partitionBy(*parent)
    zero = F.lit(0).cast("decimal(28,0)")
    left = F.col("budget") - F.coalesce(F.sum("room").over(before), zero)
    heavy = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), zero)
    rows = (children.withColumn("left", left.cast(wide)).withColumn("heavy", heavy.cast(wide))
            .withColumn("full", F.expr("cast(room as decimal(19,0)) * cast(heavy as decimal(19,0)) <= "
                                       "cast(w as decimal(19,0)) * cast(left as decimal(19,0))")))
    # at the first child that does not fill, `left` and `heavy` are those of all unfilled ones
    open_left = F.max(F.when(~F.col("full"), F.col("left"))).over(everything)
    open_heavy = F.max(F.when(~F.col("full"), F.col("heavy"))).over(everything)
    return (rows.withColumn("open_left", open_left).withColumn("open_heavy", open_heavy)
            .withColumn("given", F.when(F.col("full"), F.col("room").cast("long")).otherwise(
                F.expr("(cast(w as decimal(19,0)) * cast(open_left as decimal(19,0))) div open_heavy"))))


def leaf_budgets(leaves: DataFrame, params: MixParams) -> DataFrame:
    """`leaves` (domain, language, source, tokens) with the tokens each is to give, `budget`.

    Leaves without tokens, or under a node of weight 0, get no budget and no row.
    """
    rooms = leaves.where("tokens > 0")
    for level in LEVELS:
        rooms = rooms.where(_weight(level, params.weights) > 0)
    rooms = rooms.select(*LEVELS, (F.col("tokens") * params.max_epochs).alias("room"))
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    able = rooms.agg(F.sum("room")).first()[0] or 0
    given = rooms.sparkSession.range(1).select(
        F.lit(min(total * params.share_percent // 100, able)).cast("decimal(18,0)").alias("budget"))
    for depth, level in enumerate(LEVELS):
        nodes = (rooms.groupBy(*LEVELS[:depth + 1]).agg(F.sum("room").cast("decimal(18,0)").alias("room"))
                 .withColumn("w", _weight(level, params.weights)).withColumn("name", F.col(level)))
        parents = LEVELS[:depth] or ["root"]
        if depth == 0:
            given, nodes = given.withColumn("root", F.lit(0)), nodes.withColumn("root", F.lit(0))
        given = cut(_shared(nodes.join(given, parents), parents)
                    .select(*LEVELS[:depth + 1], F.col("given").cast("decimal(18,0)").alias("budget")))
    return given.select(*LEVELS, F.col("budget").cast("long").alias("budget"))


def _digest(id_col: Column, epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id_col.cast("string"), F.lit("null"))))


def _leaf(docs: DataFrame, domain: Column, language: Column, source: Column) -> list[Column]:
    return [F.coalesce(c, F.lit("")).alias(n) for c, n in zip((domain, language, source), LEVELS)]


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SMALL_TABLE else df


def mix(docs: DataFrame, *, domain: Column, language: Column, source: Column, id_col: str = "doc_id",
        text_col: str = "text", params: MixParams = MixParams()) -> DataFrame:
    """One row per document and epoch that it is taken in: doc_id, domain, language, source, epoch, n_tokens,
    tokens_taken. Only the last document of a leaf's last epoch gives less than all its tokens.

    Defined cases: a null text has no tokens; a null name of a level is ''; documents without tokens are
    taken where an epoch is taken whole, or before the end of a prefix; rows repeated with one id stand
    next to each other; an empty table gives no rows; other columns are ignored.
    """
    return _taken(*_measured(docs, domain, language, source, id_col, text_col, params), params)


def _measured(docs, domain, language, source, id_col, text_col, params) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, levels, n_tokens, row), and the leaves with whole epochs and the rest of the budget."""
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), *_leaf(docs, domain, language, source),
                           n_tokens(text_or_empty(text_col)).alias("n_tokens"),
                           F.monotonically_increasing_id().alias("row")))
    leaves = cut(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")))
    plan = leaves.join(leaf_budgets(leaves.select(*LEVELS, "tokens"), params), LEVELS)
    # a slice holds about SLICE_ROWS rows of a leaf
    digits = F.greatest(F.lit(1), F.ceil(F.log(16.0, F.col("rows") / SLICE_ROWS))).cast("int")
    return rows, cut(plan.select(*LEVELS, F.expr("budget div tokens").alias("whole"),
                                 (F.col("budget") % F.col("tokens")).alias("rest"), digits.alias("digits")))


def _prefix(rows: DataFrame, plan: DataFrame, params: MixParams) -> DataFrame:
    """The rows of each leaf's last epoch that its prefix takes, with digest and the tokens before them."""
    last = (rows.join(_small(plan.where("rest > 0")), LEVELS)
            .withColumn("digest", _digest(F.col("doc_id"), F.col("whole"), params.seed))
            .withColumn("slice", F.expr("left(digest, digits)")))
    starts = (last.groupBy(*LEVELS, "slice").agg(F.sum("n_tokens").alias("n"))
              .withColumn("start", F.coalesce(F.sum("n").over(
                  Window.partitionBy(*LEVELS).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    starts = cut(starts.select(*LEVELS, "slice", "start"))
    # slices that begin past the end of the prefix are not looked at any further
    inside = (Window.partitionBy(*LEVELS, "slice").orderBy("digest", "doc_id", "n_tokens", "row")
              .rowsBetween(Window.unboundedPreceding, -1))
    return (last.join(_small(starts), [*LEVELS, "slice"]).where("start < rest")
            .withColumn("before", F.col("start") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
            .where("before < rest"))


def _taken(rows: DataFrame, plan: DataFrame, params: MixParams) -> DataFrame:
    whole = (rows.join(_small(plan.where("whole > 0")), LEVELS)
             .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)))
             .withColumn("tokens_taken", F.col("n_tokens")))
    some = _prefix(rows, plan, params).withColumn("epoch", F.col("whole")).withColumn(
        "tokens_taken", F.col("n_tokens") if params.whole_documents
        else F.least(F.col("n_tokens"), F.col("rest") - F.col("before")))
    out = ["doc_id", *LEVELS, "epoch", "n_tokens", "tokens_taken"]
    return whole.select(out).unionByName(some.select(out))


def keep_mixed(docs: DataFrame, *, domain: Column, language: Column, source: Column, id_col: str = "doc_id",
               text_col: str = "text", params: MixParams = MixParams(max_epochs=1)) -> DataFrame:
    """The rows of `docs` that one epoch of the mixture takes, whole, all columns as they were.

    A leaf's prefix ends at a digest, so the rows are chosen where they are read.
    """
    if params.max_epochs != 1:
        raise ValueError("rows can only be kept for one epoch")
    rows, plan = _measured(docs, domain, language, source, id_col, text_col, params)
    ends = _prefix(rows, plan, params).groupBy(*LEVELS).agg(F.max("digest").alias("end"))
    ends = cut(plan.where("whole > 0").select(*LEVELS, "whole", F.lit("g").alias("end"))
               .unionByName(ends.withColumn("whole", F.lit(0).cast("long"))))
    return (docs.select(F.struct("*").alias("rec"), F.col(id_col).alias("doc_id"), *_leaf(docs, domain, language, source))
            .join(_small(ends), LEVELS)
            .where(_digest(F.col("doc_id"), F.lit(0), params.seed) <= F.col("end")).select("rec.*"))
