"""Post-processing of recognition output; the networks themselves are a pluggable function."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.operators import imaging
from folioscan.sources.derive import held


def with_ctc(rows: DataFrame, steps: str) -> DataFrame:
    """Adds ``tokens``, ``begins``, ``ends`` (last step) and ``conf`` of greedy decoding of an array of (step, idx, prob) in their order.

    Runs of one index are a token, index 0 parts runs; ``conf`` is the mean of the
    tokens' mean probabilities.  All within the row.
    """
    at, n = F.col(steps), F.size(steps)
    first = F.transform(at, lambda x, i: F.when((i == 0) | (x["idx"] != F.get(at, i - 1)["idx"]), i))
    rows = held(rows, "__starts", F.array_compact(first))
    end = lambda j: F.coalesce(F.get("__starts", j + 1), n) - 1
    mean = lambda s, e: F.aggregate(F.slice(at, s + 1, e - s + 1), F.lit(0.0), lambda a, x: a + x["prob"]) / (e - s + 1)
    runs = F.transform("__starts", lambda s, j: F.struct(at[s]["step"].alias("begin"), at[end(j)]["step"].alias("end"), at[s]["idx"].alias("idx"), F.when(at[s]["idx"] != 0, mean(s, end(j))).alias("p")))
    rows = held(rows, "__runs", F.filter(runs, lambda x: x["idx"] != 0))
    conf = F.when(F.size("__runs") > 0, F.aggregate("__runs", F.lit(0.0), lambda a, x: a + x["p"]) / F.size("__runs"))
    parts = {"tokens": F.col("__runs.idx"), "begins": F.col("__runs.begin"), "ends": F.col("__runs.end"), "conf": conf}
    return rows.withColumns(parts).drop("__starts", "__runs")


def ctc_decode(steps: DataFrame, keys: list[str]) -> DataFrame:
    """keys, tokens, begins, ends and conf of ``with_ctc`` for rows of (step, idx, prob); what has blanks alone has no row."""
    lines = steps.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("step", "idx", "prob"))).alias("__steps"))
    return with_ctc(lines.where(F.exists("__steps", lambda x: x["idx"] != 0)), "__steps").select(*keys, "tokens", "begins", "ends", "conf")


def cell_bounds(tokens: DataFrame, keys: list[str], n_steps: Column) -> DataFrame:
    """Adds ``left_step`` and ``right_step``: halfway through the blank steps between runs; the outer ones reach the ends."""
    order = Window.partitionBy(*keys).orderBy("begin")
    left, right = (F.lag("end").over(order) + F.col("begin") + 1) / 2, (F.col("end") + F.lead("begin").over(order) + 1) / 2
    return tokens.withColumns({"left_step": F.coalesce(left, F.lit(0.0)), "right_step": F.coalesce(right, n_steps.cast("double"))})


def clamp_neighbours(tokens: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Overlapping neighbours meet halfway between their centres; a box of which nothing would be left stays as it is."""
    run = Window.partitionBy(*keys).orderBy(order)
    centre = (F.col("l") + F.col("r")) / 2
    tokens = tokens.withColumn("__c", centre)
    before, after = (F.lag("__c").over(run) + F.col("__c")) / 2, (F.lead("__c").over(run) + F.col("__c")) / 2
    left = F.when(F.lag("r").over(run) > F.col("l"), F.greatest(F.col("l"), before)).otherwise(F.col("l"))
    right = F.when(F.lead("l").over(run) < F.col("r"), F.least(F.col("r"), after)).otherwise(F.col("r"))
    tokens = tokens.withColumns({"new_l": left, "new_r": right}).withColumn("sound", F.col("new_r") > F.col("new_l"))
    kept = {c: F.when(F.col("sound"), F.col(f"new_{c}")).otherwise(F.col(c)) for c in ("l", "r")}
    return tokens.withColumns(kept).drop("__c", "new_l", "new_r", "sound")


def detection_boxes(boxes: DataFrame) -> DataFrame:
    """The usable boxes of (side, score, expanded_side, width, height)."""
    return boxes.where("side >= 3 and score >= 0.5 and expanded_side >= 5 and width > 10 and height > 10")


def expand_distance(quad: Column, ratio: float = 2.0) -> Column:
    """How far a box of four points grows: area * ratio / perimeter."""
    corner = lambda k: (quad[2 * (k % 4)], quad[2 * (k % 4) + 1])
    area, perimeter = F.lit(0.0), F.lit(0.0)
    for k in range(4):
        (x, y), (u, v) = corner(k), corner(k + 1)
        area = area + (x * v - u * y)
        perimeter = perimeter + F.sqrt((x - u) * (x - u) + (y - v) * (y - v))
    return F.abs(area) / 2 * ratio / perimeter


def orientation(scores: Column, least: float = 0.9) -> Column:
    """struct(label, score, turned) of an orientation network's scores: the first of the highest; odd labels above ``least`` are a half turn."""
    best = F.coalesce(F.array_max(F.filter(scores, lambda x: x > 0)), F.lit(0.0).cast("double"))
    label = F.greatest(F.array_position(scores, best) - 1, F.lit(0)).cast("int")
    label = F.when(best > 0, label).otherwise(0)
    return F.struct(label.alias("label"), best.alias("score"), ((label % 2 == 1) & (best > least)).alias("turned"))


def detect_and_recognise(pages: DataFrame, keys: Sequence[str], recogniser: Callable[[pd.DataFrame], pd.Series], schema: str) -> DataFrame:
    """keys, n, quad and what the recogniser says of each text box of a page, in the order of the boxes.

    ``pages`` has the image (pixels, width, height, channels) and the detector's map
    (scores, map_w, map_h).  ``recogniser`` takes a batch of crops (pixels, width, height,
    channels) and returns a value of ``schema`` for each; it is loaded where it runs, one
    call a batch, so it may be any network.
    """
    boxes = imaging.detect(pages.select(*keys, "scores", "map_w", "map_h", F.col("width").alias("source_w"), F.col("height").alias("source_h")), keys)
    quads = boxes.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("n", "quad")))["quad"].alias("quads"))
    cut = imaging.crops(pages.select(*keys, "pixels", "width", "height", "channels").join(quads, list(keys)), keys)

    @F.pandas_udf(schema)
    def read(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            yield recogniser(pd.DataFrame(dict(zip(("pixels", "width", "height", "channels"), columns, strict=True))))

    return cut.select(*keys, "n", read("pixels", "width", "height", "channels").alias("read")).join(boxes, [*keys, "n"])
