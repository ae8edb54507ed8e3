"""Search: the exact fold against a character-by-character one, plans without a shuffle, running sums, keyword tables."""

import dataclasses
import itertools
import random
import tracemalloc
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscan import queries
from folioscan.functions import stats, text
from folioscan.model import OCR, TEXT_LAYER, QueryOptions
from folioscan.operators import search

SF = "/root/testdata/sf0.001"
ALPHABET = ["a", "B", "-", "-", "\n", "\n", " ", " ", "\t", "\r", "\x85", " ", "\xa0", "　", "o", "O", "0", "ﬁ", "Ａ", "－", "½", "é", "Σ", "İ", "̈", "¨", "中", "\x0b", "\x1f", "…", "."]
OPTIONS = [dataclasses.replace(QueryOptions(), cross_line=a, join_hyphens=b, collapse_whitespace=c, ignore_whitespace=d, case_sensitive=e) for a, b, c, d, e in itertools.product([True, False], repeat=5)]


def spacelike(c):
    return (c in "\t\n\x0b\f\r\x1c\x1d\x1e\x1f" or unicodedata.category(c) in ("Zs", "Zl", "Zp")) and c not in "\xa0  "


def slow_fold(tokens, source, o):
    """Token after token and character after character: what was put can be taken back."""
    out, skip = [], False

    def trim():
        while out and spacelike(out[-1][0]):
            out.pop()

    def blank(k):
        if not o.ignore_whitespace and not (o.collapse_whitespace and out and spacelike(out[-1][0])):
            out.append((" ", k))

    for k, token in enumerate(tokens):
        if token and all(c in text.BREAKS for c in token):
            hyphen = False
            if o.join_hyphens:
                trim()
                if out and out[-1][0] == "-":
                    out.pop()
                    hyphen = True
            if hyphen or o.cross_line:
                trim()
                skip = True
            else:
                out.append(("\0", k))
                skip = False
        elif token and all(map(spacelike, token)):
            if not skip:
                blank(k)
        elif token:
            skip = False
            form = unicodedata.normalize("NFKC", token) if o.normalize_unicode else token
            for c in form if o.case_sensitive else form.lower():
                if c in text.BREAKS:
                    trim() if o.cross_line else out.append(("\0", k))
                elif spacelike(c):
                    blank(k)
                else:
                    out.append(("0" if source == OCR and o.tolerate_o_zero and c in "oO" else c, k))
    return "".join(c for c, _ in out), [k for _, k in out]


def test_fold_against_characters():
    rng = random.Random(1)
    for o in OPTIONS:
        for _ in range(150):
            source = rng.choice([TEXT_LAYER, OCR])
            tokens = ["".join(rng.choice(ALPHABET) for _ in range(rng.choice([1, 1, 1, 2, 3]))) for _ in range(rng.randrange(14))]
            assert text.normalize_tokens(tokens, source, o) == slow_fold(tokens, source, o), (tokens, o)
            page = "".join(tokens)
            assert text.fold_text(page, source, o) == slow_fold(list(page), source, o)[0], (page, o)


@pytest.mark.parametrize("o", OPTIONS[::3])
def test_expression_is_exact_where_it_is_used(spark, o):
    rng = random.Random(2)
    easy = ["a", "B", "-", "\n", " ", "\t", "O", "é", "É", "中", "."]
    pages = ["".join(rng.choice(easy if i % 2 else ALPHABET) for _ in range(rng.randrange(16))) for i in range(400)]
    rows = [(i, p, OCR if i % 3 == 0 else TEXT_LAYER) for i, p in enumerate(pages)] + [(-1, None, OCR), (-2, "x", None)]
    df = spark.createDataFrame(rows, "i long, text string, source string")
    got = df.select("i", text.needs_fold(F.col("text")).alias("hard"), text.normalize_page(F.col("text"), F.col("source"), o).alias("n")).collect()
    assert {r.i: r.n for r in got} == {i: p if p is None else slow_fold(list(p), s, o)[0] for i, p, s in rows}
    assert 50 < sum(not r.hard for r in got if r.i >= 0) < 350


def test_probes_that_the_expression_alone_misses(spark):
    for page, keyword in queries.CASES[:6]:
        df = spark.createDataFrame([(1, 0, TEXT_LAYER, page)], "doc_id long, page int, source string, text string")
        assert search.matches(df, keyword).count() == 1


@pytest.mark.parametrize("n", [0, 1, 2, 48, 49, 50, 1000, 1023])
def test_running_sums(spark, n):
    rng = random.Random(n)
    values = [rng.randrange(100) for _ in range(n)]
    df = spark.createDataFrame([(values,)], "x array<int>")
    assert df.select(stats.running_sums(F.col("x"))).first()[0] == list(itertools.accumulate(values))


@pytest.mark.parametrize("name", ["search_literal", "search_wholeword", "search_context", "search_native", "search_forms", "multi_keyword"])
def test_searches_shuffle_nothing(spark, name):
    plan = queries.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "NestedLoop" not in plan and plan.count("FileScan") == 1


def test_dedup_searches_once(spark):
    plan = queries.queries()["cross_source_dedup"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_hits_of_tokens_that_fold_together(spark):
    kinds = "doc_id long, page int, source string, text string, page_w double, page_h double, tokens array<struct<text:string,start:bigint,line:int,conf:double,l:double,b:double,r:double,t:double>>"
    words = ["ﬁ", "le", "-", "\n", "name", " ", "x"]
    starts = list(itertools.accumulate([0, *map(len, words)]))
    tokens = [(w, s, int(i > 3), 0.5 if i else -1.0, *((10.0 * i, 0.0, 10.0 * i + 9, 12.0) if w.strip() else (None,) * 4)) for i, (w, s) in enumerate(zip(words, starts, strict=False))]
    index = spark.createDataFrame([(1, 0, OCR, "".join(words), 100.0, 100.0, tokens), (2, 0, OCR, None, 1.0, 1.0, None), (3, 0, OCR, "", 1.0, 1.0, [])], kinds)
    (row,) = search.hits(index, "filename").collect()
    assert (row.ordinal, row.start, row.length, row.matched, row.conf) == (0, 0, 9, "ﬁle-\nname", 0.5)
    assert [tuple(r) for r in row.rects] == [(0.0, 0.0, 19.0, 12.0), (40.0, 0.0, 49.0, 12.0)]
    assert search.hits(index, "nothing").count() == 0


def test_keywords_in_blocks_and_of_any_length(spark):
    pages = spark.createDataFrame([(1, 0, "a b  A\nb aa"), (2, 0, None), (3, 1, "nothing")], "doc_id long, page int, text string")
    keys = spark.createDataFrame([(1, "a"), (2, "a B"), (3, "A b"), (4, " "), (5, None), (6, "b a b aa")], "item_id long, text string")
    want = {(1, 1, 4), (2, 1, 2), (3, 1, 2), (6, 1, 1)}
    for size in (1, 3, 1 << 20):
        assert {(r.item_id, r.doc_id, r.n) for r in search.multi_keyword(pages, keys, size).collect()} == want
    assert search.multi_keyword(pages, keys.limit(0)).count() == 0


def test_tokens_are_opened_a_few_pages_at_a_time(spark):
    n = 300
    page = [{"text": "the" if i % 100 == 7 else "ab", "start": 3 * i, "line": i // 50, "conf": 0.5 + i / 1000, "l": 1.5 * i, "b": 0.1, "r": 1.5 * i + 1, "t": 1.1} for i in range(n)]
    kind = pa.struct([("text", pa.string()), ("start", pa.int64()), ("line", pa.int32()), *((k, pa.float64()) for k in ("conf", *"lbrt"))])
    one = pa.array([page], pa.list_(kind))
    tokens, sources = pa.concat_arrays([one] * 600), pa.array([OCR] * 600)
    place = search._place("the", QueryOptions()).func
    assert len(place(tokens[:0], sources[:0])) == 0
    tracemalloc.start()
    got = place(tokens, sources)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12_000_000
    assert len(got) == 600 and [[h["start"] for h in got[k].as_py()] for k in (0, 63, 64, 599)] == [[21, 321, 621]] * 4
