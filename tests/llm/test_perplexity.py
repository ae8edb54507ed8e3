"""The Spark-built model against one of a single process, other scripts, and empty languages."""

import random

import numpy as np
import pyarrow as pa
import pytest

from folioscan.llm import perplexity, vec
from tests.llm.test_operators import SMALL

CYRILLIC = "а б в г д е ж з и к л м н о п р с т у ф х ц ч ш щ ы э ю я".split()
CHINESE = [chr(0x4E00 + 37 * k) for k in range(300)]


def local(texts):
    codes, _ = perplexity.grams(vec.Texts(pa.array(texts, pa.string())))
    return perplexity.KneserNey.fit(*np.unique(codes, return_counts=True)), codes


def script(letters, seed, n, grammar=True):
    rng, words = random.Random(seed), random.Random(1)
    known = ["".join(words.choice(letters) for _ in range(words.randrange(1, 6))) for _ in range(60)]
    return " ".join(rng.choice(known) if grammar else "".join(rng.choice(letters) for _ in range(4)) for _ in range(n))


def test_model_of_spark_equals_one_of_a_process(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("lang", "text")
    folder = perplexity.train(docs.unionByName(docs.limit(5)).fillna(""))
    rows = docs.unionByName(docs.limit(5)).fillna("").collect()
    rng = np.random.default_rng(4)
    for lang in {r.lang for r in rows}:
        want, codes = local([r.text for r in rows if r.lang == lang])
        got = perplexity.load_model(folder, lang)
        asked = np.concatenate([np.unique(codes), rng.integers(0, 1 << 24, 5000).astype(np.uint32)])
        assert got.log_p(asked) == pytest.approx(want.log_p(asked), abs=1e-4)
        for table in (*got.logs, *got.backoffs):
            assert (np.diff(table.keys.astype(object)) > 0).all()


def test_a_language_that_is_not_there_has_an_empty_model(spark):
    folder = perplexity.train(spark.createDataFrame([("en", "some words")], "lang string, text string"))
    model = perplexity.load_model(folder, "xx")
    assert model.log_p(np.array([1, 2], np.uint32)) == pytest.approx([-np.log(64)] * 2)
    rows = spark.createDataFrame([(1, "xx", None), (2, "yy", ""), (3, None, None)], "doc_id long, lang string, text string")
    assert [(r.kept, r.log_ppl) for r in perplexity.judge(rows).collect()] == [(False, None)] * 3


def test_other_scripts_are_spelled():
    texts = ["ab", "é", "жи", "漢", "“x”", "😀"]
    codes, whose = perplexity.grams(vec.Texts(pa.array(texts)))
    # One symbol for a character of Latin script or general punctuation, one a byte for others, and the end.
    assert np.bincount(whose).tolist() == [3, 2, 5, 4, 4, 5]
    assert len(np.unique(codes[whose == 2])) == 5


@pytest.mark.parametrize(("letters", "others"), [(CYRILLIC, CYRILLIC), (CHINESE, [chr(c) for c in range(0x4E00, 0x9FA0, 7)])])
def test_documents_of_other_scripts_have_a_band(spark, letters, others):
    good = [(i, script(letters, i, 120), "xx") for i in range(80)]
    # Four symbols see the order of Cyrillic letters, but little beyond one Chinese character.
    noise = [(1000 + i, script(others, i, 120, False), "xx") for i in range(3)]
    got = {r.doc_id: r for r in perplexity.judge(spark.createDataFrame(good + noise, "doc_id long, text string, lang string")).collect()}
    assert sum(got[i].typical for i, *_ in good) >= 78
    assert not any(got[i].typical for i, *_ in noise)
