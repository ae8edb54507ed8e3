"""Matches in recognised blocks: widths of characters, rectangles from tokens and from the look of the text."""

import random

import pytest
from pyspark.sql import functions as F

from folioscan.functions.text import visible_count
from folioscan.operators import blocks
from tests.test_assembly import PAGES, block

#: What a character of each kind counts.
ONE = {"漢": 1.0, "か": 1.0, "한": 1.0, "A": 0.62, "É": 0.62, "i": 0.34, "r": 0.34, "m": 0.72, "a": 0.52, "é": 0.52, "5": 0.58, " ": 0.28, "　": 0.28, "-": 0.30, "(": 0.30, ".": 0.30, "。": 1.0, "—": 1.0, "+": 0.52, "€": 1.0, "😀": 1.0, "\xa0": 0.52}


def test_widths_of_characters(spark):
    rng = random.Random(3)
    texts = ["", *ONE, *("".join(rng.choice(list(ONE)) for _ in range(12)) for _ in range(60))]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(blocks.visual_width(F.col("t"))).collect()
    assert [r[0] for r in got] == pytest.approx([sum(ONE[c] for c in t) for t in texts])


def hits(spark, keyword, *rows, **options):
    pages = spark.createDataFrame([(1, 0, 1000.0, 1000.0, 1000.0, 1000.0, list(rows))], PAGES)
    return sorted(blocks.block_hits(pages, keyword, **options).collect(), key=lambda r: r.ordinal)


def test_rectangles_from_the_look_of_the_text(spark):
    (hit,) = hits(spark, "b", block("aab", 0, 0, 300, 20))
    inset = min(0.08, min(2.0, 4.5) / 300)
    assert (hit.l, hit.r) == pytest.approx((300 * (inset + 2 / 3 * (1 - 2 * inset)), 300 * (1 - inset)))
    assert (hit.t, hit.b) == pytest.approx((1000 - 1.6, 1000 - 18.4))
    slanted = hits(spark, "aab", (*block("aab", 0, 0, 300, 40)[:6], [0.0, 0.0, 300.0, 20.0, 300.0, 40.0, 0.0, 20.0], None, None, None))[0]
    edge = min(4.0, 4.5) / 300  # in a quad 20 high that falls by 20
    assert (slanted.l, slanted.t, slanted.b) == pytest.approx((300 * edge, 1000 - (20 * edge + 1.6), 1000 - (20 * (1 - edge) + 18.4)))


def test_rectangles_from_tokens_stay_between_their_neighbours(spark):
    boxes = [(0.0, 0.3), (0.25, 0.6), (0.62, 0.8), (0.9, 1.0)]
    one, = hits(spark, "b", block("abcd", 0, 0, 100, 20, boxes=boxes))
    low, high = (0.15 + 0.425) / 2, (0.425 + 0.71) / 2
    assert (one.l, one.r) == pytest.approx((100 * low, 100 * high))  # clamped on both sides
    two, = hits(spark, "cd", block("abcd", 0, 0, 100, 20, boxes=boxes))
    assert (two.l, two.r) == pytest.approx((100 * (0.62 - 0.006), 100.0))
    ab, = hits(spark, "ab", block("abcd", 0, 0, 100, 20, boxes=boxes))
    assert (ab.l, ab.r) == pytest.approx((0.0, 100 * high))
    assert (one.t, one.b) == pytest.approx((1000 - 2, 1000 - 18))


def test_case_order_and_what_has_no_rectangle(spark):
    rows = [block("ab AB ab", 0, 0, 100, 20), block("nothing", 0, 30, 100, 50), block("xab", 0, 60, 0, 80), (None,) * 10, block("ABab", 0, 90, 100, 110)]
    assert [(r.ordinal, r.block, r.start) for r in hits(spark, "ab", *rows)] == [(0, 0, 0), (1, 0, 3), (2, 0, 6), (3, 4, 0), (4, 4, 2)]
    assert [(r.block, r.start) for r in hits(spark, "ab", *rows, ignore_case=False)] == [(0, 0), (0, 6), (4, 2)]
    assert hits(spark, "\\E.", *rows) == [] and hits(spark, "a.", *rows) == []
    with pytest.raises(ValueError, match="blank"):
        hits(spark, " ", *rows)


def test_two_rules_of_what_can_be_seen(spark):
    cases = {"a b\n": (2, 2), "\u3000": (0, 1), "\xa0": (1, 1), "\x85\x9f\x7f": (0, 0), "\x1c\u2028": (0, 1), "": (0, 0)}
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    assert [tuple(r) for r in df.select(visible_count(F.col("t")), visible_count(F.col("t"), True)).collect()] == list(cases.values())
