"""Search in recognised blocks one by one, without a page index: a match's rectangle comes from its tokens' boxes or from the look of its text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions import geometry, stats
from folioscan.functions.text import SPACES
from folioscan.model import check_keyword
from folioscan.operators import layout
from folioscan.sources.derive import held

#: About how wide a character is, by the first class that has it; all others beyond Latin-1 count 1, within it 0.52.
WIDTHS = (
    ("[\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsHangul}]", 1.0),
    ("\\p{Lu}", 0.62),
    ("[ilftr]", 0.34),
    ("[mw]", 0.72),
    ("\\p{Ll}", 0.52),
    ("\\p{Nd}", 0.58),
    ("[" + "".join(f"\\x{{{ord(c):x}}}" for c in SPACES + "\n\r\u2028\u2029") + "]", 0.28),
    ("[\\p{Pc}\\p{Pd}\\p{Ps}\\p{Pe}\\p{Po}&&[\\x00-\\x{ff}]]", 0.30),
    ("[^\\x00-\\x{ff}]", 1.0),
    (".", 0.52),
)
#: How far a box may be widened, in pixels and as a share of its width, for one token and for several.
PADDING = ((0.25, 0.08), (0.60, 0.04))
#: What is taken off a block without token boxes, of its height and width at either end, and of its height above and below.
INSET_HEIGHT, INSET_WIDTH, INSET_MOST, INSET_ROWS = 0.10, 0.015, 0.08, 0.08


def visual_width(text: Column) -> Column:
    """The sum of the characters' widths: each class is counted and taken out before the next."""
    total, left = F.lit(0.0), text
    for pattern, width in WIDTHS:
        pattern = f"(?s){pattern}"
        total = total + F.regexp_count(left, F.lit(pattern)) * width
        left = F.regexp_replace(left, pattern, "")
    return total


def _unit(x: Column) -> Column:
    return (x["l"] >= 0) & (x["t"] >= 0) & (x["r"] <= 1) & (x["b"] <= 1) & (x["r"] > x["l"]) & (x["b"] > x["t"])


def _by_tokens(rows: DataFrame) -> DataFrame:
    """Adds ``by_tokens``, (l, t, r, b) in ratios of the line: the union of the match's tokens, up to halfway to their neighbours' centres, a little wider."""
    touched = F.filter("tokens", lambda x: (x["end"] > F.col("start")) & (x["begin"] < F.col("stop")) & _unit(x))
    rows = held(rows, "__mine", touched)
    side = lambda k, f: f(F.transform("__mine", lambda x: x[k]))
    first, last = (F.try_element_at("__mine", F.lit(k))["i"] for k in (1, -1))
    centre = lambda i: F.when(i >= 0, F.get("tokens", i)).otherwise(None)
    middle = lambda x: F.when(_unit(x), (x["l"] + x["r"]) / 2)
    between = lambda i, j: (middle(centre(i)) + middle(centre(j))) / 2
    rows = rows.withColumns({"__low": geometry.clamp01(F.coalesce(between(first - 1, first), F.lit(0.0))), "__high": geometry.clamp01(F.coalesce(between(last, last + 1), F.lit(1.0)))})
    rows = rows.withColumns({"__l": F.greatest(side("l", F.array_min), F.col("__low")), "__r": F.least(side("r", F.array_max), F.col("__high"))})
    one = F.size("__mine") == 1
    width = F.col("r") - F.col("l")
    pad = [F.least(pixels / width, (F.col("__r") - F.col("__l")) * share) for pixels, share in PADDING]
    pad = F.when(one, pad[0]).otherwise(pad[1])
    box = F.struct(F.greatest(F.col("__low"), F.col("__l") - pad).alias("l"), side("t", F.array_min).alias("t"), F.least(F.col("__high"), F.col("__r") + pad).alias("r"), side("b", F.array_max).alias("b"))
    sound = (F.size("__mine") > 0) & (F.col("__r") > F.col("__l")) & (width > 0) & (F.col("b") > F.col("t"))
    return rows.withColumn("by_tokens", F.when(sound, box)).drop("__mine", "__low", "__high", "__l", "__r")


def _by_look(rows: DataFrame) -> DataFrame:
    """Adds ``by_look``, (l, t, r, b) in ratios of the block: the share of its width that the match's characters take up."""
    part = lambda a, b: F.substring("text", (a + 1).cast("int"), (b - a).cast("int"))
    rows = rows.withColumns({"__all": visual_width(F.col("text")), "__before": visual_width(part(F.lit(0), F.col("start"))), "__own": visual_width(part(F.col("start"), F.col("stop")))})
    total = F.when(F.col("__all") <= 0.01, F.char_length("text").cast("double")).otherwise(F.col("__all"))
    rows = rows.withColumns({"__a": geometry.clamp01(F.col("__before") / total), "__z": geometry.clamp01((F.col("__before") + F.col("__own")) / total)})
    width, height = F.col("r") - F.col("l"), F.col("b") - F.col("t")
    inset = F.least(F.lit(INSET_MOST), F.least(INSET_HEIGHT * height, INSET_WIDTH * width) / width)
    at = lambda c: inset + F.col(c) * (1 - 2 * inset)
    box = F.struct(at("__a").alias("l"), F.lit(INSET_ROWS).alias("t"), at("__z").alias("r"), F.lit(1 - INSET_ROWS).alias("b"))
    return rows.withColumn("by_look", F.when((width > 0) & (height > 0) & (F.col("__z") > F.col("__a")), box)).drop("__all", "__before", "__own", "__a", "__z")


def block_hits(pages: DataFrame, keyword: str, ignore_case: bool = True) -> DataFrame:
    """(doc_id, page, ordinal, block, start, length, l, b, r, t): the keyword as it stands in the blocks, in page points.

    ``pages`` are those of ``assembly.index_of_blocks``.  Matches are leftmost and do not
    overlap; nothing is normalised but, character by character, their case.  Matches
    without a rectangle go and have no ordinal.
    """
    sizes = ["bitmap_w", "bitmap_h", "page_w", "page_h"]
    sound = pages.where("bitmap_w > 0 and bitmap_h > 0 and page_w > 0 and page_h > 0")
    rows = sound.select("doc_id", "page", *sizes, F.posexplode("blocks").alias("block", "x")).select("doc_id", "page", *sizes, "block", "x.*").where("text is not null and l is not null")
    literal = ("(?iu)" if ignore_case else "") + "\\Q" + check_keyword(keyword).replace("\\E", "\\E\\\\E\\Q") + "\\E"
    rows = held(rows.where(F.rlike("text", F.lit(literal))), "__parts", F.split("text", literal, -1))
    rows = held(rows, "__sizes", F.transform("__parts", F.char_length))
    rows = held(rows, "__upto", stats.running_sums(F.col("__sizes")))
    n = len(keyword)
    starts = F.transform(F.slice("__upto", 1, F.size("__upto") - 1), lambda s, i: s + i * n)
    same = F.coalesce((F.size("token_boxes") == F.size("begins")) & (F.size("begins") == F.size("ends")), F.lit(False))
    token = lambda x, i: F.struct(i.alias("i"), x["begins"].alias("begin"), x["ends"].alias("end"), *(x["token_boxes"][k].alias(k) for k in "ltrb"))
    rows = rows.withColumn("tokens", F.when(same, F.transform(F.arrays_zip("token_boxes", "begins", "ends"), token)))
    rows = rows.select("doc_id", "page", *sizes, "block", "text", *"ltrb", "quad", "tokens", F.explode(starts).alias("start")).withColumn("stop", F.col("start") + n)
    rows = _by_look(_by_tokens(rows))
    rows = held(rows, "box", F.coalesce("by_tokens", "by_look"))
    rows = held(rows, "sides", F.struct(*(c.alias(k) for c, k in zip(layout.token_sides(F.col("box")), "ltrb", strict=True))))
    rect = geometry.bitmap_to_pdf(*(F.col("sides")[k] for k in "ltrb"), *(F.col(c) for c in sizes))
    found = rows.withColumn("rect", rect).where("box is not null and rect is not null")
    ordinal = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("block", "start")) - 1
    return found.select("doc_id", "page", ordinal.alias("ordinal"), "block", "start", F.lit(n).alias("length"), *(F.col("rect")[k].alias(k) for k in "lbrt"))

