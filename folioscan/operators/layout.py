"""Layout reconstruction: line breaks from geometry, separators between blocks, lost spaces, reading order of blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions import geometry, stats
from folioscan.functions.text import UNSEEN, visible_count
from folioscan.operators.results import column_split
from folioscan.sources.derive import held

#: Punctuation that takes no space after it, before it, on either side.
OPENING = "([{<（［｛《〈「『【〔〖〘〚“‘"
CLOSING = ")]}>）］｝》〉」』】〕〗〙〛，。！？；：、,.!?;:%％"
TIGHT = "-‐‑‒–—_/\\'’·•"
LATIN, CJK = "[\\p{IsLatin}\\p{Nd}]", "[\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsHangul}]"
#: Share of a glyph's width that a gap must reach, by script on either side.
MIXED, WESTERN, EASTERN, OTHER = 0.30, 0.42, 0.52, 0.45


def first_visible(text: Column) -> Column:
    return F.substring(F.regexp_replace(text, UNSEEN, ""), 1, 1)


def last_visible(text: Column) -> Column:
    return F.substring(F.regexp_replace(text, UNSEEN, ""), -1, 1)


def spacing_factor(before: Column, after: Column) -> Column:
    latin, cjk = (lambda c: F.rlike(c, F.lit(LATIN))), (lambda c: F.rlike(c, F.lit(CJK)))
    mixed = (latin(before) & cjk(after)) | (cjk(before) & latin(after))
    return F.when(mixed, MIXED).when(latin(before) & latin(after), WESTERN).when(cjk(before) & cjk(after), EASTERN).otherwise(OTHER)


def takes_no_space(before: Column, after: Column) -> Column:
    inside = lambda chars, c: F.contains(F.lit(chars), c)
    return (before == "") | (after == "") | inside(OPENING, before) | inside(CLOSING, after) | inside(TIGHT, before) | inside(TIGHT, after)


def separators(blocks: DataFrame, keys: list[str], order: str, page_w: Column) -> DataFrame:
    """Adds ``separator`` to blocks (text, l, t, r, b, glyph; y down): NONE, SPACE or LINE_BREAK before each, null before the first."""
    run = Window.partitionBy(*keys).orderBy(order)
    prev = {c: F.lag(c).over(run) for c in ("text", "l", "t", "r", "b", "glyph")}
    h0, h1 = F.greatest(F.lit(0.0), prev["b"] - prev["t"]), F.greatest(F.lit(0.0), F.col("b") - F.col("t"))
    low, high = F.least(h0, h1), F.greatest(h0, h1)
    overlap = F.greatest(F.lit(0.0), F.least(prev["b"], F.col("b")) - F.greatest(prev["t"], F.col("t")))
    level = (overlap >= 0.45 * low) | (F.abs((prev["t"] + prev["b"]) / 2 - (F.col("t") + F.col("b")) / 2) <= 0.35 * low)
    gap = F.col("l") - prev["r"]
    widest = F.least(F.greatest(3.5 * high, 0.03 * page_w), F.greatest(1.5 * high, 0.12 * page_w))
    apart = (low <= 0) | ~level | (F.col("r") < prev["l"] - 0.2 * low) | (gap > widest)
    before, after = last_visible(prev["text"]), first_visible(F.col("text"))
    glyphs = F.filter(F.array(prev["glyph"], F.col("glyph")), lambda x: x > 0)
    glyph = F.when(F.size(glyphs) > 0, stats.median(glyphs)).otherwise(0.55 * low)
    least = F.greatest(F.lit(1.5), glyph * spacing_factor(before, after), 0.1 * low)
    none = (gap <= 0) | F.rlike(prev["text"], F.lit("\\s$")) | F.rlike("text", F.lit("^\\s")) | takes_no_space(before, after)
    kind = F.when(apart, "LINE_BREAK").when(none, "NONE").when(gap >= least, "SPACE").otherwise("NONE")
    return blocks.withColumn("separator", F.when(prev["l"].isNotNull(), kind))


def with_lost_spaces(rows: DataFrame, tokens: str) -> DataFrame:
    """Adds ``spaced``: the seq of the tokens (seq, token, l, r; ratios of the line) of an array in the row before which a lost space stood.

    Ordinary gaps are those between visible neighbours; the baseline is their lower
    35 % quantile where there are three at least.
    """
    rows = held(rows, "__blank", F.transform(tokens, lambda x: F.rlike(x["token"], F.lit("\\s")).cast("int")))
    rows = held(rows, "__blanks", stats.running_sums(F.col("__blank")))
    counted = F.zip_with(F.col(tokens), "__blanks", lambda x, n: F.struct(x["seq"].alias("seq"), x["token"].alias("token"), x["l"].alias("l"), x["r"].alias("r"), n.alias("blanks"), first_visible(x["token"]).alias("first"), last_visible(x["token"]).alias("last")))
    rows = held(rows, "__counted", counted)
    rows = held(rows, "__seen", F.filter("__counted", lambda x: ~F.rlike(x["token"], F.lit("^\\s*$")) & (x["r"] > x["l"])))
    seen = F.col("__seen")
    centre = lambda x: (x["l"] + x["r"]) / 2
    onward = centre(F.try_element_at("__seen", F.lit(-1))) + 0.0001 >= centre(F.try_element_at("__seen", F.lit(1)))

    def gap(x: Column, i: Column) -> Column:
        before = F.get(seen, i - 1)
        return F.when((i > 0) & (before["blanks"] == x["blanks"]), F.when(onward, x["l"] - before["r"]).otherwise(before["l"] - x["r"]))

    rows = held(rows, "__gaps", F.transform("__seen", gap))
    rows = held(rows, "__wide", F.filter("__gaps", lambda g: g > 0))
    rows = held(rows, "__base", F.when(F.size("__wide") >= 3, stats.lower_quantile(F.col("__wide"), 0.35)).otherwise(0.0))
    rows = held(rows, "__width", stats.median(F.transform("__seen", lambda x: x["r"] - x["l"])))

    def spaced(x: Column, i: Column) -> Column:
        g, before, after = F.get("__gaps", i), F.get(seen, i - 1)["last"], x["first"]
        least = F.greatest(F.lit(0.004), F.col("__width") * spacing_factor(before, after), 2.6 * F.col("__base"))
        return F.when((g > 0) & (g >= least) & ~takes_no_space(before, after), x["seq"])

    found = rows.withColumn("spaced", F.array_compact(F.transform("__seen", spaced)))
    return found.drop("__blank", "__blanks", "__counted", "__seen", "__gaps", "__wide", "__base", "__width")


def recovered_spaces(toks: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``space`` to tokens (seq, token, l, r in ratios of the line): whether a lost space stood before it."""
    row = F.struct(*(F.col(c) for c in toks.columns))
    lines = toks.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("seq", "token", "l", "r", row.alias("row")))).alias("__tokens"))
    marked = with_lost_spaces(lines, "__tokens").select("spaced", F.explode("__tokens").alias("x"))
    return marked.select("x.row.*", F.array_contains("spaced", F.col("x.seq")).alias("space"))


def line_numbers(chars: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``new_line`` and ``line`` to chars (idx, char, cy, h): a break where the centre moves by more than 0.85 heights from the last boxed character.

    An explicit break starts a line as well and forgets the reference.
    """
    run = Window.partitionBy(*keys).orderBy("idx")
    before = run.rowsBetween(Window.unboundedPreceding, -1)
    explicit = F.col("char").isin("\n", "\r")
    chars = chars.withColumn("stretch", F.coalesce(F.sum(explicit.cast("int")).over(before), F.lit(0)))
    within = Window.partitionBy(*keys, "stretch").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    boxed = F.when(F.col("cy").isNotNull() & ~explicit, F.struct("cy", F.greatest(F.col("h"), F.lit(0.1)).alias("h")))
    last = F.last(boxed, ignorenulls=True).over(within)
    moved = F.col("cy").isNotNull() & ~explicit & last.isNotNull() & (F.abs(F.col("cy") - last["cy"]) > 0.85 * F.greatest(last["h"], F.col("h"), F.lit(0.1)))
    chars = chars.withColumn("new_line", F.coalesce(moved, F.lit(False)))
    return chars.withColumn("line", (F.col("stretch") + F.sum(F.col("new_line").cast("int")).over(run)).cast("int")).drop("stretch")


def block_order(blocks: DataFrame, keys: list[str], page_w: Column, ratio: float = 0.16, spans: float = 0.48) -> DataFrame:
    """Adds ``rank`` to blocks (id, l, r, t; y down): by bands between blocks across both columns, in a band by column, top, left.

    A block that reaches over the split parts two bands if it has ``spans`` of the page's width.
    """
    split = column_split(blocks, keys, "l", "r", page_w, ratio)
    return ranked_blocks(blocks.join(split, keys, "left"), keys, page_w, spans).drop("split")


def ranked_blocks(rows: DataFrame, keys: list[str], page_w: Column, spans: float) -> DataFrame:
    """Adds ``rank`` to blocks that know their page's ``split`` (null: one column)."""
    spanning = F.col("split").isNotNull() & (F.col("l") < F.col("split")) & (F.col("r") > F.col("split")) & (F.col("r") - F.col("l") >= spans * page_w)
    rows = rows.withColumn("spanning", spanning)
    top = Window.partitionBy(*keys).orderBy("t", "l", "id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("band", F.coalesce(F.sum(F.col("spanning").cast("int")).over(top), F.lit(0)))
    column = F.when(F.col("split").isNotNull() & ~F.col("spanning") & ((F.col("l") + F.col("r")) / 2 >= F.col("split")), 1).otherwise(0)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("band", "spanning", column, "t", "l", "id"))
    return rows.withColumn("rank", rank.cast("int")).drop("band", "spanning")


def even_tokens(text: Column, left: Column, right: Column) -> Column:
    """A block without token boxes: its width shared evenly by its characters, array of (token, l, r)."""
    n = F.char_length(text)
    step = (right - left) / n
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.substring(text, i, F.lit(1)).alias("token"), (left + (i - 1) * step).alias("l"), (left + i * step).alias("r")))


def token_sides(x: Column) -> list[Column]:
    """Left, top, right and bottom in the bitmap of a box ``x`` of the line, through the block's quad where it has one (columns l, t, r, b, quad)."""
    corners = [geometry.quad_point(F.col("quad"), x[a], x[b]) for a, b in (("l", "t"), ("r", "t"), ("r", "b"), ("l", "b"))]
    xs, ys = ([c[k] for c in corners] for k in (0, 1))
    flat = [F.col(lo) + (F.col(hi) - F.col(lo)) * x[side] for lo, hi, side in (("l", "r", "l"), ("t", "b", "t"), ("l", "r", "r"), ("t", "b", "b"))]
    skew = [F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)]
    has_quad = F.col("quad").isNotNull() & (F.size("quad") == 8)
    return [F.when(has_quad, a).otherwise(b) for a, b in zip(skew, flat, strict=True)]


def glyph_width(text: Column, tokens: Column, width: Column) -> Column:
    """About how wide a character of a block is: the median of its tokens' widths in the line, else an even share of its visible characters.

    ``tokens`` has (token, l, r, b, t) in ratios of the line, or is null.
    """
    seen = F.filter(tokens, lambda x: ~F.rlike(x["token"], F.lit(f"^{UNSEEN}*$")) & (x["r"] > x["l"]) & (x["b"] > x["t"]))
    middle = stats.median(F.transform(seen, lambda x: x["r"] - x["l"]))
    visible = visible_count(text)
    return F.when(width <= 0, 0.0).when(middle > 0, middle * width).when(visible > 0, width / visible).otherwise(0.0)


def debug_geometry(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, seq, n, kind, box, label: a DETECTION_BLOCK (n = 0) and its TOKEN_BOXes (from 1) as ratios of the page.

    Blocks have seq, text, l, t, r, b (bitmap, y down), quad (8 numbers or null), token_boxes
    (array of l, t, r, b in the line, or null), begins and ends in the text, bitmap_w and
    bitmap_h.  Boxes that are no part of the unit square or have no area go; a token whose
    arrays differ in length has no box.
    """
    blocks = blocks.where("bitmap_w > 0 and bitmap_h > 0 and l is not null")
    same = (F.size("token_boxes") == F.size("begins")) & (F.size("begins") == F.size("ends"))
    tokens = blocks.where(same).select("*", F.posexplode("token_boxes").alias("k", "x"))
    x = F.col("x")
    tokens = tokens.where((x["l"] >= 0) & (x["t"] >= 0) & (x["r"] <= 1) & (x["b"] <= 1) & (x["r"] > x["l"]) & (x["b"] > x["t"]))
    sides = token_sides(x)
    size = (F.col("bitmap_w"), F.col("bitmap_h"))
    begin = F.greatest(F.lit(0), F.element_at("begins", F.col("k") + 1))
    label = F.substring(F.col("text"), begin + 1, F.greatest(F.lit(0), F.element_at("ends", F.col("k") + 1) - begin))
    of_tokens = tokens.select(*keys, "seq", (F.col("k") + 1).alias("n"), F.lit("TOKEN_BOX").alias("kind"), geometry.bitmap_ratio(*sides, *size).alias("box"), label.alias("label"))
    own = geometry.bitmap_ratio(*(F.col(c) for c in "ltrb"), *size)
    of_blocks = blocks.select(*keys, "seq", F.lit(0).alias("n"), F.lit("DETECTION_BLOCK").alias("kind"), own.alias("box"), F.col("text").alias("label"))
    return of_blocks.unionByName(of_tokens).where("box is not null")
