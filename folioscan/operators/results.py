"""What happens to hits: distinct ids, cross-source dedup, reading order, limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions import geometry, text
from folioscan.model import TEXT_LAYER, SearchOptions
from folioscan.sources.derive import held


def sequence(hits: DataFrame) -> DataFrame:
    """Adds ``seq``, a document's order of production: page, text layer first, ordinal."""
    order = Window.partitionBy("doc_id").orderBy("page", F.when(F.col("source") == TEXT_LAYER, 0).otherwise(1), "ordinal")
    return hits.withColumn("seq", F.row_number().over(order))


def distinct_ids(hits: DataFrame) -> DataFrame:
    """The first hit of each result id of a document; blank ids all stay."""
    first = F.row_number().over(Window.partitionBy("doc_id", "result_id").orderBy("seq"))
    return hits.withColumn("__n", first).where("__n = 1 or trim(result_id) = ''").drop("__n")


def dedup(hits: DataFrame, threshold: float = 0.65) -> DataFrame:
    """Greedy in order of ``seq``, as one fold over each group of equal text on a page.

    A hit that overlaps a survivor replaces it in its place if it is preferred (text
    layer over recognised, else the higher confidence) and goes otherwise.  Groups
    are the hits of one text on one page, so a fold stays small.  Hits go through the
    fold whole: nothing is looked up again afterwards.
    """
    row = F.struct("seq", F.struct(*(F.col(c) for c in hits.columns)).alias("hit"))
    keyed = hits.withColumn("__key", text.dedup_key(F.col("matched")))
    groups = keyed.groupBy("doc_id", "page", "__key").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    # Small items go through the fold; of those that stay, the number finds the row.
    items = F.transform("rows", lambda x, i: F.struct(i.alias("i"), x["hit"]["source"].alias("source"), x["hit"]["conf"].alias("conf"), geometry.union_of(x["hit"]["rects"]).alias("box")))

    def step(kept: Column, c: Column) -> Column:
        at = F.array_position(F.transform(kept, lambda e: geometry.iou(e["box"], c["box"]) >= threshold), True)

        def choose(e: Column) -> Column:
            rank = lambda x: F.when(x["source"] == TEXT_LAYER, 1).otherwise(0)
            return F.when((rank(c) > rank(e)) | ((rank(c) == rank(e)) & (c["conf"] > e["conf"])), c).otherwise(e)

        replaced = F.transform(kept, lambda e, i: F.when(i + 1 == at, choose(e)).otherwise(e))
        return F.when(at == 0, F.concat(kept, F.array(c))).otherwise(replaced)

    folded = groups.withColumn("items", items).select("rows", F.explode(F.aggregate("items", F.slice("items", 1, 0), step)["i"]).alias("i"))
    return folded.select(F.col("rows")[F.col("i")]["hit"].alias("hit")).select("hit.*")


def first_ratio_rect(hits: DataFrame) -> DataFrame:
    """Adds ``top`` and ``left`` of the first rectangle (smallest top, then left) in page ratio; null without one."""
    ratio = F.transform("rects", lambda r: geometry.page_ratio(r, F.col("page_w"), F.col("page_h")))
    first = F.array_min(F.transform(F.filter(ratio, lambda r: r.isNotNull()), lambda r: F.struct(r["t"].alias("top"), r["l"].alias("left"), r["r"].alias("right"))))
    return hits.withColumn("__first", first).withColumns({"top": F.col("__first.top"), "left": F.col("__first.left"), "right": F.col("__first.right")}).drop("__first")


def with_split(rows: DataFrame, boxes: str, width: Column, ratio: float = 0.16) -> DataFrame:
    """Adds ``split``: where two columns part among the boxes (l, r) of an array in the row, or null.

    Of boxes narrower than 48 % of the page, at least four, the largest gap between
    centres counts if two stand on either side, it reaches ``ratio`` of the page (0.08
    to 0.40), and the gutter is clear by 35 % of that.
    """
    least = max(0.08, min(0.40, ratio)) * width
    narrow = F.filter(boxes, lambda x: (x["r"] - x["l"] < 0.48 * width) & (x["r"] > x["l"]))
    rows = held(rows, "__by_centre", F.array_sort(F.transform(narrow, lambda x: F.struct(((x["l"] + x["r"]) / 2).alias("c"), x["l"].alias("l"), x["r"].alias("r")))))
    n, at = F.size("__by_centre"), F.col("__by_centre")
    between = lambda i: F.struct((at[i + 1]["c"] - at[i]["c"]).alias("gap"), (-i).alias("i"), ((at[i + 1]["c"] + at[i]["c"]) / 2).alias("split"))
    rows = held(rows, "__best", F.when(n >= 4, F.array_max(F.transform(F.sequence(F.lit(1), n - 3), between))))
    cut = F.col("__best")["split"]
    end = F.array_max(F.transform(F.filter(at, lambda x: x["c"] < cut), lambda x: x["r"]))
    begin = F.array_min(F.transform(F.filter(at, lambda x: x["c"] >= cut), lambda x: x["l"]))
    return rows.withColumn("split", F.when((F.col("__best")["gap"] >= least) & (begin - end >= 0.35 * least), cut)).drop("__by_centre", "__best")


def column_split(boxes: DataFrame, keys: list[str], left: str, right: str, width: Column, ratio: float = 0.16) -> DataFrame:
    """(keys, split) of the groups of boxes that stand in two columns, by ``with_split``."""
    groups = boxes.groupBy(*keys).agg(F.collect_list(F.struct(F.col(left).alias("l"), F.col(right).alias("r"))).alias("__boxes"), F.max(width).alias("__width"))
    return with_split(groups, "__boxes", F.col("__width"), ratio).where("split is not null").select(*keys, "split")


def reading_order(hits: DataFrame, options: SearchOptions = SearchOptions()) -> DataFrame:
    """Adds ``rank`` within each document: page, column where a page's hits stand in two, top, left, source name, id."""
    placed = first_ratio_rect(hits)
    column = F.lit(0)
    if options.detect_columns:
        split = column_split(placed.where("left is not null"), ["doc_id", "page"], "left", "right", F.lit(1.0), options.column_gap)
        placed = placed.join(split, ["doc_id", "page"], "left")
        column = F.when(F.col("split").isNotNull() & ((F.col("left") + F.col("right")) / 2 >= F.col("split")), 1).otherwise(0)
    order = Window.partitionBy("doc_id").orderBy("page", "column", F.col("top").asc_nulls_last(), "left", "source", "result_id", "ordinal")
    return placed.withColumn("column", column).withColumn("rank", F.row_number().over(order))


def finalize(hits: DataFrame, options: SearchOptions = SearchOptions()) -> DataFrame:
    """Distinct ids, dedup, reading order, limit; ``hits`` has ``seq``."""
    out = distinct_ids(hits)
    if options.dedup:
        out = dedup(out, options.dedup_iou)
    out = reading_order(out, options)
    return out.where(F.col("rank") <= options.max_results) if options.max_results > 0 else out


def limit_in_scan(hits: DataFrame, plan: DataFrame, most: int) -> DataFrame:
    """The first ``most`` hits of each document in the order in which the plan (doc_id, page, rank) reaches its pages; 0 keeps all."""
    ranked = hits.join(plan.select("doc_id", "page", F.col("rank").alias("page_rank")), ["doc_id", "page"])
    if most <= 0:
        return ranked
    order = Window.partitionBy("doc_id").orderBy("page_rank", "ordinal")
    return ranked.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most).drop("__n")


def stop_after_first(hits: DataFrame, plan: DataFrame) -> DataFrame:
    """Hits of the first page of the plan (doc_id, page, rank) that has any."""
    ranked = hits.join(plan.select("doc_id", "page", F.col("rank").alias("page_rank")), ["doc_id", "page"])
    return ranked.withColumn("first", F.min("page_rank").over(Window.partitionBy("doc_id"))).where("page_rank = first").drop("first")


def highlights(hits: DataFrame) -> DataFrame:
    """A row for each rectangle in page ratio, in order of page, top, left, with the next and previous in a circle."""
    box = F.explode(F.transform("rects", lambda r: geometry.page_ratio(r, F.col("page_w"), F.col("page_h"))))
    rows = hits.select("doc_id", "page", "source", "result_id", "matched", box.alias("box")).where("box is not null")
    order = Window.partitionBy("doc_id").orderBy("page", "box.t", "box.l", "result_id", "source")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("n", F.row_number().over(order))
    return rows.withColumns({"next": F.coalesce(F.lead("n").over(order), F.first("n").over(whole)), "previous": F.coalesce(F.lag("n").over(order), F.last("n").over(whole))})
