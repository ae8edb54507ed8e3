"""Rectangles: PDF points have their origin at the bottom left (l, b, r, t); page ratios and bitmaps at the top left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rect(l: Column, b: Column, r: Column, t: Column) -> Column:  # noqa: E741
    """Edges in order; null if the area is empty."""
    lo_x, hi_x, lo_y, hi_y = F.least(l, r), F.greatest(l, r), F.least(b, t), F.greatest(b, t)
    return F.when((hi_x > lo_x) & (hi_y > lo_y), F.struct(lo_x.alias("l"), lo_y.alias("b"), hi_x.alias("r"), hi_y.alias("t")))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def page_ratio(box: Column, page_w: Column, page_h: Column) -> Column:
    """PDF points to ratios of the page, top left first: struct(l, t, r, b)."""
    out = F.struct(clamp01(box["l"] / page_w).alias("l"), clamp01(1 - box["t"] / page_h).alias("t"), clamp01(box["r"] / page_w).alias("r"), clamp01(1 - box["b"] / page_h).alias("b"))
    return F.when((page_w > 0) & (page_h > 0) & (out["r"] > out["l"]) & (out["b"] > out["t"]), out)


def bitmap_to_pdf(left: Column, top: Column, right: Column, bottom: Column, bitmap_w: Column, bitmap_h: Column, page_w: Column, page_h: Column) -> Column:
    return rect(left / bitmap_w * page_w, page_h - bottom / bitmap_h * page_h, right / bitmap_w * page_w, page_h - top / bitmap_h * page_h)


def quad_point(quad: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """A point of the unit square in a quad (top left, top right, bottom right, bottom left; 8 numbers)."""

    def axis(k: int) -> Column:
        upper = quad[k] + (quad[2 + k] - quad[k]) * x
        lower = quad[6 + k] + (quad[4 + k] - quad[6 + k]) * x
        return upper + (lower - upper) * y

    return axis(0), axis(1)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two structs (l, b, r, t); 0 where they do not meet."""
    w = F.greatest(F.lit(0.0), F.least(a["r"], b["r"]) - F.greatest(a["l"], b["l"]))
    h = F.greatest(F.lit(0.0), F.least(a["t"], b["t"]) - F.greatest(a["b"], b["b"]))
    union = (a["r"] - a["l"]) * (a["t"] - a["b"]) + (b["r"] - b["l"]) * (b["t"] - b["b"]) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def union_of(rects: Column) -> Column:
    """The bounding box of an array of rectangles."""
    side = lambda name, f: f(F.transform(rects, lambda x: x[name]))
    return F.struct(side("l", F.array_min).alias("l"), side("b", F.array_min).alias("b"), side("r", F.array_max).alias("r"), side("t", F.array_max).alias("t"))


def turned(box: Column) -> Column:
    """A ratio box after a half turn of its line."""
    return F.struct((1 - box["r"]).alias("l"), (1 - box["b"]).alias("t"), (1 - box["l"]).alias("r"), (1 - box["t"]).alias("b"))


def padded(box: Column, x: Column, y: Column, page_w: Column, page_h: Column) -> Column:
    return F.struct(F.greatest(F.lit(0.0), box["l"] - x).alias("l"), F.greatest(F.lit(0.0), box["b"] - y).alias("b"), F.least(page_w, box["r"] + x).alias("r"), F.least(page_h, box["t"] + y).alias("t"))


def page_rect(ratio: Column, width: Column, height: Column, start_y: Column | None = None) -> Column:
    """A ratio box on a page of a viewer; with ``start_y``, in the scrolled document."""
    dy = F.lit(0.0) if start_y is None else start_y
    out = F.struct((ratio["l"] * width).alias("l"), (ratio["t"] * height + dy).alias("t"), (ratio["r"] * width).alias("r"), (ratio["b"] * height + dy).alias("b"))
    return F.when(ratio.isNotNull() & (width > 0) & (height > 0), out)


def bitmap_ratio(left: Column, top: Column, right: Column, bottom: Column, bitmap_w: Column, bitmap_h: Column) -> Column:
    """Bitmap pixels to ratios of the page; null if nothing is left of the box."""
    out = F.struct(clamp01(left / bitmap_w).alias("l"), clamp01(top / bitmap_h).alias("t"), clamp01(right / bitmap_w).alias("r"), clamp01(bottom / bitmap_h).alias("b"))
    return F.when((bitmap_w > 0) & (bitmap_h > 0) & (out["r"] > out["l"]) & (out["b"] > out["t"]), out)


def centre_offset(base: Column, widest: Column, shown: Column) -> Column:
    """How far a viewer moves a page across the scrolling axis to centre it below the widest one."""
    return F.when((base > 0) & (widest > 0), F.greatest(F.lit(0.0), (widest - base) * (shown / base) / 2)).otherwise(0.0)


def detection_size(width: Column, height: Column, most: int) -> Column:
    """struct(w, h): an image for the detector, its long side ``most`` at most, either side the nearest multiple of 32."""
    longest = F.greatest(width, height)
    ratio = F.when(longest > most, most / longest).otherwise(1.0) if most > 0 else F.lit(1.0)

    def side(x: Column) -> Column:
        near = F.greatest(F.lit(1.0), F.round(F.round(x * ratio) / 32)) * 32
        return (F.least(near, F.lit(float(max(32, most // 32 * 32)))) if most > 0 else near).cast("int")

    return F.struct(side(width).alias("w"), side(height).alias("h"))


def detection_side(width: Column, height: Column) -> Column:
    """Long side of a detector's input: the next multiple of 32, from 960 to 2048."""
    return (F.ceil(F.greatest(F.lit(960), F.least(F.lit(2048), F.greatest(width, height))) / 32) * 32).cast("int")


def render_height(page_w: Column, page_h: Column, width: int) -> Column:
    """Height in pixels of a page that is drawn ``width`` pixels wide; null for pages and widths without extent."""
    height = F.greatest(F.lit(1), F.floor(page_h * (width / page_w) + 0.5).cast("int"))
    return F.when((page_w > 0) & (page_h > 0) & F.lit(width > 0), height)


def recognition_width(width: Column, height: Column, widest: Column, line: int = 32) -> Column:
    """Width of a line image that is made ``line`` pixels high, ``line`` times the ratio ``widest`` at most."""
    return F.least(F.ceil(line * (width / height)), F.floor(line * widest)).cast("int")
