"""Recall over all pairs of a table by a similarity of its own, hot buckets, and rows that share an id or have none."""

import collections
import math
import random
import re

import pytest

from folioscan.llm import near_dup
from tests.llm.test_operators import prose

SF = "/root/testdata/sf0.01"


def shingle_counts(text):
    words = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", text.lower())
    return collections.Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else collections.Counter()


def alike(texts, least):
    """(i, j, similarity) of all pairs of texts, by exact document frequencies and a dictionary for each text."""
    sets = [shingle_counts(t) for t in texts]
    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    n = len(texts)
    idf = {g: 1 + near_dup.IDF_SPREAD * math.log((1 + n) / len(h)) / math.log(2 + n) for g, h in holders.items()}
    weigh = lambda s: {g: (1 + math.log(tf)) * idf[g] for g, tf in s.items()}
    weights = [weigh(s) for s in sets]
    total = [sum(w.values()) for w in weights]
    shared = collections.Counter()
    for g, h in holders.items():
        for a, i in enumerate(h):
            for j in h[a + 1 :]:
                shared[i, j] += min(weights[i][g], weights[j][g])
    for (i, j), both in shared.items():
        if (s := both / (total[i] + total[j] - both)) >= least:
            yield i, j, s


def test_recall_over_all_pairs_of_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(docs).collect()}
    names = sorted({r.text or "" for r in rows})
    of = collections.defaultdict(list)
    for r in rows:
        of[r.text or ""].append(r.doc_id)
    assert all(len({got[i] for i in ids}) == 1 for ids in of.values())  # exact copies
    pairs = list(alike(names, 0.5))
    same = lambda i, j: got[of[names[i]][0]] == got[of[names[j]][0]]
    clear = [(i, j) for i, j, s in pairs if s >= 0.81]
    assert len(clear) >= 4 and all(same(i, j) for i, j in clear)
    near = [same(i, j) for i, j, s in pairs if s >= 0.8]
    assert sum(near) >= 0.9 * len(near)
    # What is together is so by links of at least the threshold.
    root = {i: i for i in range(len(names))}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j, s in pairs:
        if s >= 0.79:
            root[top(i)] = top(j)
    assert all(top(i) == top(j) for i, j, _ in pairs if same(i, j))


@pytest.mark.parametrize("hot", [2, 256])
def test_hot_buckets_meet_like_others(spark, monkeypatch, hot):
    monkeypatch.setattr(near_dup, "HOT_ROWS", hot)
    rows = [(1, 5, 10), (1, 5, 11), (1, 5, 12), (1, 6, 10), (2, 5, 11), (2, 5, 13), (2, -1, 14)]
    dealt = spark.createDataFrame(rows, "band int, key long, rep long")
    assert sorted(tuple(r) for r in near_dup.met(dealt).collect()) == [(1, 5, 10, 10), (1, 5, 10, 11), (1, 5, 10, 12), (2, 5, 11, 11), (2, 5, 11, 13)]
    assert near_dup.met(dealt.limit(0)).count() == 0


@pytest.mark.parametrize(("hot", "block"), [(2, 3), (256, 512)])
def test_large_groups_stay_whole(spark, monkeypatch, hot, block):
    monkeypatch.setattr(near_dup, "HOT_ROWS", hot)
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", block)
    rng, rows = random.Random(2), []
    for group in range(2):
        words = prose(900 + group, 150).split()
        for k in range(40):
            mine = list(words)
            mine[rng.randrange(150)] = f"x{group}{k}"
            rows.append((100 * group + k, " ".join(mine)))
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i // 100 * 100 for i, _ in rows}


def test_rows_of_one_id(spark):
    rows = [(1, "same words here and there", "a"), (1, "quite another text of words", "b"), (None, "same words here and there", "c"), (None, None, "d"), (2, None, "e"), (3, "same words here and there", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id string")
    for part in (docs, docs.repartition(5)):
        kept = near_dup.keep_representatives(part, near_dup.near_duplicates(docs))
        assert kept.columns == docs.columns
        got = sorted((r.doc_id, r.class_id) for r in kept.collect())
        assert [x[0] for x in got] == [1, 2]
        first = got if part is docs else first
        assert got == first
