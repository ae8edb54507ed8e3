"""Mixing sources to target weights (operator 6): hierarchical budgets over a tree.

Tokens of each leaf (domain, language, source) are added up over all documents.  The
budget then goes down the tree: at each node the children share it by weight, no
child gets more than its subtree holds (``epochs`` times over), and what one child
cannot take is dealt among its siblings.  Only when all of them are full does a
shortage reach the level above, because a node is never given more than its subtree
holds.  Each leaf takes the prefix of a seeded order of its documents, one shuffled
epoch after another, that its budget covers.

Everything is DataFrame operations.  The prefix of a leaf that holds a third of all
rows is found without bringing them together: documents fall into ranges of the seeded
hash, the ranges' sums are added up first, and a running sum is needed within a range
only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.llm.common import materialise

LEVELS = ("domain", "lang", "source")
#: Hex digits of the seeded hash that name a range: 16**3 ranges a leaf and epoch.
RANGE_DIGITS = 3


def word_count(text: Column) -> Column:
    """Words: runs of anything but ``[\\x20\\x09-\\x0D]``."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def weight_of(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    """The whole-number weight of a node by its name; 1 where none is given."""
    known = weights.get(level, {})
    if not known:
        return F.lit(1).cast("long")
    pairs = F.create_map(*(F.lit(x) for kv in known.items() for x in kv))
    return F.coalesce(pairs[F.col(level)], F.lit(1)).cast("long")


def share(nodes: DataFrame, parent: Sequence[str], name: str) -> DataFrame:
    """Adds ``granted`` to rows (parent..., name, weight, capacity, budget): each parent's budget among its children.

    Children are filled in the order of capacity a unit of weight.  Those that the
    common rate would overfill get their capacity; the others get what is left by
    weight, rounded down.
    """
    group = Window.partitionBy(*parent)
    # capacity / weight orders them exactly enough: equal ratios are filled alike.
    order = group.orderBy(F.col("capacity") / F.col("weight"), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    rated = nodes.withColumn("left", F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0))).withColumn("sharing", F.sum("weight").over(after))
    full = F.col("capacity") * F.col("sharing") <= F.col("left") * F.col("weight")
    rated = rated.withColumn("full", full)
    open_left = F.max(F.when(~F.col("full"), F.col("left"))).over(group)
    open_sharing = F.max(F.when(~F.col("full"), F.col("sharing"))).over(group)
    rated = rated.withColumn("open_left", open_left).withColumn("open_sharing", open_sharing)
    rest = F.expr("(weight * open_left) div open_sharing")
    return rated.withColumn("granted", F.when(F.col("full"), F.col("capacity")).otherwise(F.least("capacity", rest)).cast("long")).drop("left", "sharing", "full", "open_left", "open_sharing")


def budgets(leaves: DataFrame, total: Column, weights: Mapping[str, Mapping[str, int]], levels: Sequence[str] = LEVELS, epochs: int = 1) -> DataFrame:
    """(levels..., tokens, granted) from (levels..., tokens): a row for each leaf."""
    held = leaves.withColumn("capacity", (F.col("tokens") * epochs).cast("long"))
    above = held.agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("all_tokens")).select(F.least("capacity", total.cast("long")).alias("budget"))
    for depth, level in enumerate(levels):
        parent, path = list(levels[:depth]), list(levels[: depth + 1])
        nodes = held.groupBy(*path).agg(F.sum("capacity").alias("capacity"))
        nodes = nodes.join(above, parent) if parent else nodes.join(F.broadcast(above))  # one row
        above = share(nodes.withColumn("weight", weight_of(level, weights)), parent, level).select(*path, F.col("granted").alias("budget"))
    return leaves.join(above.withColumnRenamed("budget", "granted"), list(levels))


def seeded(seed: str, epoch: Column, doc_id: Column) -> Column:
    """The place of a document in an epoch: 32 hex digits."""
    return F.md5(F.concat(F.lit(seed + ":"), epoch.cast("string"), F.lit(":"), doc_id.cast("string")))


def mix_sources(
    docs: DataFrame, weights: Mapping[str, Mapping[str, int]], domain: Column, percent: int = 50, epochs: int = 1, seed: str = "mix", tokens: Column | None = None, id_col: str = "doc_id", lang: str = "lang", source: str = "source", text: str = "text"
) -> DataFrame:
    """doc_id, domain, lang, source, epoch, tokens, upto (the leaf's tokens to here) of each document chosen in each epoch.

    The budget is ``percent`` of all tokens.  A leaf takes documents as long as their
    running sum stays within its grant, so documents are whole; ``epochs`` bounds how
    often a document can come up.  Null names are the name ''.  A document without
    tokens costs nothing and is chosen with the place it falls in.  Null ids are left
    out; repeated rows are documents of their own, with ties in the order of tokens.  Other
    columns are left behind, whatever their names; an empty table gives no rows.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(domain, F.lit("")).alias("domain"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
        (word_count(F.col(text)) if tokens is None else tokens.cast("long")).alias("tokens"),
    )
    rows = materialise(rows, "mix-rows")
    leaves = materialise(rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")), "mix-leaves")
    whole = leaves.agg(F.sum("tokens")).first()[0] or 0
    grants = materialise(budgets(leaves, F.lit(whole * percent // 100), weights, LEVELS, epochs), "mix-grants")
    placed = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn("place", seeded(seed, F.col("epoch"), F.col("doc_id")))
    placed = placed.withColumn("range", F.substring("place", 1, RANGE_DIGITS))
    # Running sums in two steps: 16 parts of an epoch, then the ranges of a part.
    ranges = materialise(placed.groupBy(*LEVELS, "epoch", "range").agg(F.sum("tokens").alias("in_range")), "mix-ranges").withColumn("part", F.substring("range", 1, 1))
    before = lambda of, *by: Window.partitionBy(*of).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    parts = ranges.groupBy(*LEVELS, "epoch", "part").agg(F.sum("in_range").alias("in_part"))
    parts = parts.select(*LEVELS, "epoch", "part", F.coalesce(F.sum("in_part").over(before(LEVELS, "epoch", "part")), F.lit(0)).alias("by_part"))
    inside = F.coalesce(F.sum("in_range").over(before([*LEVELS, "epoch", "part"], "range")), F.lit(0))
    ranges = ranges.withColumn("inside", inside).join(parts, [*LEVELS, "epoch", "part"]).select(*LEVELS, "epoch", "range", (F.col("by_part") + F.col("inside")).alias("ahead"))
    ranges = ranges.join(grants.select(*LEVELS, "granted"), list(LEVELS)).where("ahead <= granted")
    within = Window.partitionBy(*LEVELS, "epoch", "range").orderBy("place", "tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = placed.join(ranges, [*LEVELS, "epoch", "range"]).withColumn("upto", F.col("ahead") + F.sum("tokens").over(within))
    return summed.where("upto <= granted").select("doc_id", *LEVELS, F.col("epoch").cast("int").alias("epoch"), "tokens", "upto")
