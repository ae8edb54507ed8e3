"""The ten operators on small cases: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import base64
import collections
import functools
import gzip
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscan.llm import line_dedup, mixing, near_dup, perplexity, pieces, quality, queries, syncmers, token_counts, toxicity, vec, warc
from folioscan.llm.common import shared_dir
from folioscan.llm.queries import domain_of, model_file

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, n_tokens string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    long = prose(1, 30_000)
    rows = [(1, prose(2, 80)), (2, None), (3, ""), (4, prose(2, 80)), (5, long), (6, "x"), (6, "x"), (7, " \n\n héllo  wörld \n"), (None, "no id at all"), (9, "日本語 😀 text▁mark")]
    return spark.createDataFrame([(i, t, None if i == 7 else "en", None if i == 6 else f"src{(i or 0) % 3}", None, 0.5, "clash") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")


# 1 ---------------------------------------------------------------------------
@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("split", [8 << 20, 700])
def test_warc_round_trip_rejects_magic_in_payloads(spark, compress, split):
    inner = warc._record(99, "http://inside", b"fake", "X", None, "d")
    fake = (gzip.compress(inner) if compress else inner).decode("latin-1")
    rows = [(1, "http://a", "body"), (2, "http://b\r\nX: y%", "body"), (3, None, None), (4, "", ""), (5, "u", fake), (6, "u", "pre" + fake * 3), (7, "u", "z" * 5000), (None, "u", "body"), (1, "u", "body")]
    rows += [(i, "u", prose(i, 30)) for i in range(20, 60)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, offset string").repartition(2)
    if compress:  # stored, so that the inner magic is there to be found
        pages = pages.withColumn("html", F.when(F.col("page_id") == 5, F.col("html")).otherwise(F.col("html")))
    root = shared_dir(spark, "warc-test")
    files = warc.write_archives(pages, root, compress=compress)
    assert files.agg(F.sum("n_records")).first()[0] == len(rows)
    got = warc.read_archives(spark, root, split).collect()
    key = lambda i, r, d: (-1 if i is None else i, r is not None, d)
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    heads = {}
    for i, _, t in rows:
        if i is not None:
            heads[digest(t)] = min(i, heads.get(digest(t), i))
    want = sorted(key(i, None if i == heads[digest(t)] else 1, digest(t)) for i, _, t in rows)
    assert sorted(key(r.page_id, r.refers_to, r.payload_digest) for r in got) == want
    assert all(r.payload_bytes == len((t := next(x for j, _, x in rows if j == r.page_id and digest(x) == r.payload_digest) or "").encode()) for r in got)
    assert next(r.uri for r in got if r.page_id == 2) == "http://b\r\nX: y%"
    assert all(base64.b32encode(hashlib.sha1(r.payload).digest()).decode() == r.payload_digest for r in got if r.payload is not None)


def test_warc_of_a_failed_attempt_leaves_no_record_twice(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"body {i % 7}") for i in range(50)], "page_id long, url string, html string").repartition(3)
    root = f"file://{tmp_path}/archives"
    pending = tmp_path / "archives" / warc.PENDING
    pending.mkdir(parents=True)
    (pending / "part-000000-lost-0000.warc").write_bytes(warc._record(1, "u", b"body 1", "X", None, "d"))
    warc.write_archives(pages, root, compress=False)
    assert sorted(r.page_id for r in warc.read_archives(spark, root).collect()) == list(range(50))
    assert not pending.exists()


def test_warc_of_no_pages(spark):
    root = shared_dir(spark, "warc-empty")
    assert warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), root).count() == 0
    assert warc.read_archives(spark, root).count() == 0


# 2 ---------------------------------------------------------------------------
def test_syncmers_meet_the_next_document(spark, docs, empty):
    rows = docs.collect()
    order = sorted(((r.doc_id, r.text or "") for r in rows), key=lambda x: (-1 if x[0] is None else x[0], x[1]))
    want = []
    for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        e = t[: len(t) - len(t) // 4] + n[: len(t) // 4]
        want.append((-1 if i is None else i, len(t), hashlib.sha256(e.encode()).hexdigest()))
    got = syncmers.fingerprint_neighbours(docs).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    same = {r.n_chars: set() for r in got}
    for r in got:
        same[r.n_chars].add(r.fingerprint)
    assert len(same[1]) == 1 and same[0] == {""}
    big = next(r for r in got if r.doc_id == 5)
    assert big.near_edited > 0.5 > big.near_next
    assert syncmers.fingerprint_neighbours(empty).count() == 0


def test_closed_syncmers_are_context_free_and_match_brute_force():
    text, k, s = prose(5, 200), syncmers.K, syncmers.S

    def h(t):
        p = syncmers.prints([t], k=len(t), s=len(t), anchors=1)[0][0]
        return int(p[0])

    (hashes, at), = syncmers.prints([text], anchors=10**6)
    whole = dict(zip(hashes.tolist(), at.tolist(), strict=True))
    (moved, shifted), = syncmers.prints(["some other words before " + text], anchors=10**6)
    there = dict(zip(moved.tolist(), shifted.tolist(), strict=True))
    assert whole.keys() <= there.keys()
    assert all(there[x] - y == 24 for x, y in whole.items() if text.count(text[y : y + k]) == 1)
    assert 0.5 < len(whole) / (2 * (len(text) - k) / (k - s + 1)) < 1.6  # closed syncmers' density
    assert h(text[:k]) == h(text[:k])


def test_texts_without_a_syncmer_have_anchors():
    texts = [prose(1000 + 40 * n + i, 20)[:n] for n in range(32, 56) for i in range(40)]
    got = syncmers.prints(texts)
    assert all(len(h) for h, _ in got)
    # Those without a syncmer have all their k-mers; each alone gives the same as in a batch.
    every = [(p, t) for p, t in zip(got, texts, strict=True) if len(t) > 32 and len(p[0]) == len(t) - 31]
    assert len(every) > 100 and all(sorted(p[1].tolist()) == list(range(len(t) - 31)) for p, t in every)
    for t, (h, at) in zip(texts[::7], got[::7], strict=True):
        (alone, where), = syncmers.prints([t])
        assert alone.tolist() == h.tolist() and where.tolist() == at.tolist()
    # Unrelated texts share nothing; an edited quarter leaves less than all.
    assert all(syncmers.likeness(p, q) == 0 for p, q in zip(got, got[1:], strict=False))
    changed = syncmers.prints([t[: len(t) - len(t) // 4] + "#" * (len(t) // 4) for _, t in every])
    assert all(syncmers.likeness(p, q) < 1 for (p, _), q in zip(every, changed, strict=True))


def test_fingerprints_find_a_passage_in_long_texts(spark):
    passage = prose(77, 50)
    long = [f"{prose(70 + i, 10_000)} {passage} {prose(80 + i, 10_000)}" for i in range(2)]
    one, two = syncmers.prints(long)
    alone, = syncmers.prints([passage])
    assert len(alone[0]) >= 10 and set(alone[0].tolist()) <= set(one[0].tolist()) & set(two[0].tolist())
    assert len(one[0]) > 0.05 * len(long[0])
    shared = len(set(one[0].tolist()) & set(two[0].tolist()))
    got = {r.doc_id: r for r in syncmers.fingerprint_neighbours(spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")).collect()}
    assert got[0].fingerprint == syncmers.to_text(one) and 0 < got[0].whole_next <= 2 * shared / (len(one[0]) + len(two[0]))
    read = lambda s: list(zip(*(x.tolist() for x in syncmers.from_text(s)), strict=True))
    for r in (got[0], got[1]):
        own, edited = read(r.fingerprint), read(r.edited_fingerprint)
        assert r.whole_edited == pytest.approx(brute_likeness(own, edited, anchors=None)) and r.near_edited == pytest.approx(brute_likeness(own, edited))


# 3 ---------------------------------------------------------------------------
def brute_lines(rows):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\f\r"))
    where = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            where.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(key(x)) < 10 or len(where[key(x)]) < 2 or i == min((d for d in where[key(x)] if d is not None))]
        out.append((i, "\n".join(keep), len(lines), len(lines) - len(keep)))
    return out


LINES = [(1, "A common line here\nown line number one\n\nshort"), (2, "  a COMMON line here\t\nshort\na common line here"), (3, None), (4, ""), (5, "ünique Ünique line\nA common line here"), (6, "ÜNIQUE ünique line"), (6, "ÜNIQUE ünique line"), (7, "ünique ünique line\n" * 3)]


def lines_of(df):
    return sorted((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in df.collect())


def test_line_dedup_is_incremental_and_reversible(spark):
    df = spark.createDataFrame([(*x, "c") for x in LINES], "doc_id long, text string, key string")
    empty = line_dedup.LineIndex.empty(spark)
    whole = empty.insert(df)
    assert lines_of(line_dedup.dedup_lines(df, whole, keep=["key"])) == sorted(brute_lines(LINES))
    first, second = df.where("doc_id <> 1"), df.where("doc_id = 1")
    steps = empty.insert(first).insert(second)
    assert lines_of(line_dedup.dedup_lines(df, steps)) == sorted(brute_lines(LINES))
    back = steps.remove(second.select("doc_id"))
    assert lines_of(line_dedup.dedup_lines(first, back)) == sorted(brute_lines([x for x in LINES if x[0] != 1]))
    counts = lambda i: sorted((bytes(r.key), r.n_docs, r.first_doc) for r in i.refs.collect())
    assert counts(back) == counts(empty.insert(first))
    assert empty.insert(df.limit(0)).refs.count() == 0


def test_line_dedup_survives_keys_of_one_tag(spark):
    lines = [f"line number {i} of a kind" for i in range(3000)]
    hashes = line_dedup._key_hash(pa.array([hashlib.md5(x.encode()).digest() for x in lines]))
    table, found = line_dedup.Cuckoo(2), None
    tag, _ = table._where(hashes)
    for t, n in collections.Counter(tag.tolist()).items():
        for a, b in zip(same := np.flatnonzero(tag == t), same[1:]) if n > 1 else ():
            table = line_dedup.Cuckoo(2)
            table.insert(hashes[[a]])
            found = (lines[a], lines[b]) if table.contains(hashes[[b]])[0] else found
    one, two = found
    frame = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, text string")
    for gone, left in ((one, two), (two, one)):  # either owner of the tag may go
        index = line_dedup.LineIndex.empty(spark).insert(frame((1, one))).insert(frame((2, two)))
        index = index.remove(frame((1 if gone == one else 2, gone))).insert(frame((3, left)))
        (ref,) = index.refs.collect()
        stays = 2 if gone == one else 1
        assert (ref.n_docs, ref.first_doc) == (2, stays)
        assert [r.doc_id for r in index.dropped().collect()] == [3]
        (tables,) = (line_dedup.pickle.loads(r.tables) for r in index.filters.collect())
        assert sum(t.count for t in tables) == 1
        back = index.remove(frame((3, left))).insert(frame((1 if gone == one else 2, gone), (4, left)))
        assert sorted((r.n_docs, r.first_doc) for r in back.refs.collect()) == sorted([(1, 3 - stays), (2, stays)])
    tables = [line_dedup.Cuckoo(2)]
    for _ in range(20):  # a key's own tags never fill its buckets
        line_dedup._tagged(tables, hashes[:1])
    assert sum(t.count for t in tables) == 20


def test_cuckoo_filter_holds_and_forgets():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, 50_000, dtype=np.int64).astype(np.uint64)
    table = line_dedup.Cuckoo(len(keys))
    table.insert(keys)
    assert table.contains(keys).all()
    other = rng.integers(0, 1 << 63, 50_000, dtype=np.int64).astype(np.uint64)
    assert table.contains(other).mean() < 0.001
    table.remove(keys[:500])
    assert table.contains(keys[500:]).all() and table.contains(keys[:500]).mean() < 0.02


# 4 ---------------------------------------------------------------------------
def test_near_duplicates_against_brute_force(spark):
    base = [prose(100 + k, 120) for k in range(4)]
    rows, i = [], 0
    for k, text in enumerate(base):
        rng = random.Random(k)
        for copy in range(6):
            words = text.split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
            rows.append((i, " ".join(words)))
            i += 1
    rows += [(100, None), (101, ""), (102, "one two"), (103, "One, two!"), (104, prose(999, 300)), (None, base[0]), (0, base[0] if rows[0][1] == base[0] else rows[0][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, rep int")
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(df).collect()}
    sets = {}
    for d, t in rows:
        if d is not None:
            w = re.findall(r"\w+", (t or "").lower())
            sets[d] = {" ".join(w[j : j + 5]) for j in range(max(1, len(w) - 4))}
    for a in sets:
        for b in sets:
            jaccard = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            if jaccard > 0.85:
                assert got[a] == got[b], (a, b, jaccard)
            if a // 6 != b // 6 and jaccard < 0.3 and a < 90 and b < 90:
                assert got[a] != got[b]
    assert got[100] == got[101] == 100 and got[102] == got[103] == 102 and got[104] == 104
    assert near_dup.near_duplicates(df.limit(0)).count() == 0
    kept = near_dup.keep_representatives(df, near_dup.near_duplicates(df))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))


def test_samples_estimate_weighted_jaccard():
    rng = np.random.default_rng(3)
    h = vec.mix(np.arange(4000, dtype=np.uint64))
    w = rng.choice([1.0, 1.5, 3.0], 4000)
    a, b = np.arange(0, 3000), np.arange(1000, 4000)
    codes = near_dup.samples(np.concatenate([h[a], h[b]]), np.repeat([0, 1], 3000), np.concatenate([w[a], w[b]]), 2)
    assert abs((codes[0] == codes[1]).mean() - w[1000:3000].sum() / w.sum()) < 0.25


# 5, 7 ------------------------------------------------------------------------
def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.AdditiveModel.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95
    assert model.pairs[0] == (0, 1)
    assert quality.AdditiveModel.fit(np.zeros((0, 3)), np.zeros(0)).score(x[:1])[0] == pytest.approx(0.5)


def test_quality_edges(spark, docs, empty, labels):
    model = quality.train(docs, labels)
    rows = quality.score_quality(docs, model, keep=["doc_id", "score", "lang"]).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.score_quality(empty, quality.train(empty, labels.limit(0))).count() == 0


SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("label", "least"), [("quality", 0.93), ("toxic", 0.93)])
def test_held_out_accuracy(spark, label, least):
    docs, marks = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    if label == "quality":
        scored = quality.score_quality(docs, quality.train(docs, marks))
    else:
        scored = toxicity.score_toxicity(docs, toxicity.train(docs, marks))
    held = scored.join(marks, "doc_id").where("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2")
    assert held.agg(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0] >= least


def edit_distance(a, b):
    d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_against_edit_distances():
    terms = [toxicity.Term("idiot", False, 1), toxicity.Term("disgusting", False, 2), toxicity.Term("scum", False, 0), toxicity.Term("lowei", True, 0)]
    auto, rng = toxicity.Automaton(terms), random.Random(4)
    for _ in range(4000):
        word = list(rng.choice(terms).text)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(word) + 1)
            rng.choice([lambda: word.insert(at, rng.choice("abidst")), lambda: word and word.pop(min(at, len(word) - 1)), lambda: word.__setitem__(slice(at, at + 2), word[at : at + 2][::-1])])()
        token = "".join(word)
        near = [(edit_distance(token, t.text), i) for i, t in enumerate(terms) if not t.stem and edit_distance(token, t.text) <= t.edits]
        got = auto.match(token)
        if token.startswith("lowei"):
            assert got == (3, 0)
        else:
            assert got == ((min(near)[1], min(near)[0]) if near else None), token


def test_stems_allow_edits():
    forms = ["achliche" + x for x in ("ren", "mut", "tor")]
    terms = toxicity.choose_terms({"achliche~": (30, 0), **{f: (10, 0) for f in forms}, "scum": (9, 0)})
    stems, covered = terms[:2], terms[2:]
    assert stems == [toxicity.Term("achliche", True, 1), toxicity.Term("scum", False, 0)]
    assert sorted(covered, key=lambda t: t.text) == [toxicity.Term(f, False, 2) for f in sorted(forms)]
    assert toxicity.Automaton([toxicity.Term("achliche", True), *covered]).match("aclhichemut") == (1 + [t.text for t in covered].index("achlichemut"), 1)
    auto, rng = toxicity.Automaton(stems), random.Random(8)
    for _ in range(3000):
        word = list(rng.choice(forms))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(9)
            rng.choice([lambda: word.insert(at, rng.choice("achlie")), lambda: word.pop(at), lambda: word.__setitem__(slice(at, at + 2), word[at : at + 2][::-1])])()
        token = "".join(word)
        near = min((edit_distance(token[:k], "achlich") for k in range(len(token)) if token[k] == "e"), default=9)
        near = min([near, *(1 + edit_distance(token[:k], "achlic") for k in range(len(token)) if token[k : k + 2] == "eh")])
        assert auto.match(token) == ((0, near) if near < 2 else None), token


def test_every_precise_term_is_kept(spark):
    rng = random.Random(9)
    rare = sorted({"".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(6)) for _ in range(900)})
    assert {t.text for t in toxicity.choose_terms({w: (8, 0) for w in rare})} == set(rare)
    rows, learned = [], [i for i in range(1, 40, 2) if zlib.crc32(str(i).encode()) % 4 != 2][:5]
    for i in range(40):
        rng.shuffle(rare)
        rows.append((i, " ".join(rare if i % 2 else WORDS) + (" seldom" if i in learned else ""), i % 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    texts = lambda model: {t.text for t in model.terms}
    assert texts(toxicity.train(docs.drop("toxic"), docs)) == set(rare)
    assert texts(toxicity.train(docs.drop("toxic"), docs, support=5)) == {*rare, "seldom"}


def test_context_of_hits_against_brute_force():
    reader, rng = toxicity.Reader((toxicity.Term("idiot", False, 1),)), random.Random(5)
    for _ in range(800):
        text = "".join(rng.choice(["idiot ", "idiom ", '"', "you ", "fine ", "day ", "\n", "“"]) for _ in range(rng.randrange(60)))
        hits = reader.hits(text)
        want = dict.fromkeys(toxicity.FEATURES[:6], 0)
        for i, at, _, edits in hits:
            begin, end = text.rfind("\n", 0, at) + 1, (text + "\n").find("\n", at)
            quoted = len(re.findall('["“]', text[begin:at])) % 2 == 1 and re.search('["“]', text[at:end]) is not None
            want[("fuzzy" if edits else "exact") + "_quoted" * quoted] += 1
            want["addressed"] += "you" in reader.tokens[max(0, i - 8) : i + 9]
            want["crowded"] += any(0 < abs(h[0] - i) <= 8 for h in hits)
        assert reader.row(text)[:6] == pytest.approx(np.log1p(list(want.values())))


def test_quoted_hits_weigh_less(spark, docs, empty, labels):
    terms = (toxicity.Term("idiot", False, 1),)
    weights = np.array([1.0 if f in ("exact", "any_unquoted") else -0.7 if "quoted" in f else 0.0 for f in toxicity.FEATURES])
    model = toxicity.ToxicityModel(terms, weights, -0.5)
    reader = toxicity.Reader(terms)
    plain, quoted, clean = (model.score(np.array([reader.row(t)]))[0] for t in ("you idiot", 'he said "you idiot" twice', "a fine day"))
    assert plain > clean > quoted
    trained = toxicity.train(docs, labels)
    assert toxicity.score_toxicity(docs, trained, keep=["doc_id", "score"]).count() == docs.count()
    assert toxicity.score_toxicity(empty, toxicity.train(empty, labels)).count() == 0


# 6 ---------------------------------------------------------------------------
def test_mixing_fills_siblings_before_ancestors(spark, empty):
    rows = [("a", "x", "s", 10), ("a", "y", "s", 1000), ("b", "x", "s", 1000)]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, tokens long")
    got = {(r.domain, r.lang): r.granted for r in mixing.budgets(leaves, F.lit(400), {}).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 190, ("b", "x"): 200}
    got = {(r.domain, r.lang): r.granted for r in mixing.budgets(leaves, F.lit(1900), {"domain": {"a": 3}}).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 1000, ("b", "x"): 890}
    assert mixing.mix_sources(empty, {}, domain_of(F.col("source"))).count() == 0


def test_mixing_prefixes(spark, docs):
    got = mixing.mix_sources(docs, {}, domain_of(F.col("source")), percent=60, epochs=2).collect()
    for leaf in {(r.domain, r.lang, r.source) for r in got}:
        mine = sorted((r for r in got if (r.domain, r.lang, r.source) == leaf), key=lambda r: (r.upto, r.tokens))
        assert mine[-1].upto == sum(r.tokens for r in mine)
    assert {r.epoch for r in got} <= {0, 1}


# 8, 9 ------------------------------------------------------------------------
def test_pieces_match_the_library(spark, docs, empty):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=model_file())
    coder, rng = pieces.model(model_file()), random.Random(9)
    for _ in range(3000):
        text = "".join(rng.choice(" ▁\n\tab é😀\0.<0x0A>中ǅ") for _ in range(rng.randrange(14)))
        (ids,) = coder.ids([text])
        assert ids.tolist() == library.encode(text), repr(text)
        begins, ends = coder.spans(text, ids)
        if len(ids):
            assert begins[0] == 0 and ends[-1] == len(text.encode()) and (begins[1:] == ends[:-1]).all()
    rows = pieces.encode(docs, model_file(), keep=["doc_id", "ids" if False else "n_tokens"], decode=True).collect()
    assert all(r.ids == library.encode(t or "") and r.decoded == library.decode(r.ids) for r, t in zip(rows, [x.text for x in docs.collect()], strict=True))
    assert pieces.encode(empty, model_file()).count() == 0
    assert [r.decoded for r in pieces.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>"), model_file()).collect()] == [None, ""]


@pytest.mark.parametrize("rule", ["nfkc", "nmt_nfkc_cf"])
def test_character_map_against_the_library(rule):
    import sentencepiece

    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=False)
    parts = dict(pieces._fields(library.serialized_model_proto()))
    own = pieces.PieceModel.__new__(pieces.PieceModel)
    own.map = pieces.CharacterMap(dict(pieces._fields(parts[3]))[2])
    own.prefix = own.squeeze = own.escape = own.suffix = 0
    for text in ("Ｆｕｌｌ　ｗｉｄｔｈ", "ﬁne ①", "é é", "ｶﾞ", "A b", "Ⅷ ㌔ ½", "日本"):
        got, origin = own.normalise(text)
        assert got.decode() == library.normalize(text)
        assert len(origin) == len(got) + 1 and (np.diff(origin) >= 0).all() and origin[-1] == len(text.encode())


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_50k.tiktoken"])
def test_counts_do_not_depend_on_where_texts_are_split(name, monkeypatch):
    import public_tokenizers

    texts = [prose(1, 400), "", "a  b", "no" * 500, " lead and trail ", "x <|endoftext|> y 12 3"]
    count = token_counts.counter(public_tokenizers.path(name), public_tokenizers.PATTERN)
    whole = count.lengths(texts)
    monkeypatch.setattr(token_counts, "PACK_BYTES", 50)
    assert [sum(count.lengths(count.cut(t))) for t in texts] == whole
    if name.endswith(".model"):
        assert whole == [len(x) for x in count.model.library.encode(texts)]


def test_token_counts_edges(docs, empty):
    rows = token_counts.count_tokens(docs, model_file(), keep=["doc_id", "n_tokens"], limit=10).collect()
    assert {(r.n_bytes, r.n_tokens, r.over_limit) for r in rows if r.doc_id in (2, 3)} == {(0, 0, False)}
    assert next(r for r in rows if r.doc_id == 5).over_limit
    assert token_counts.count_tokens(empty, model_file()).count() == 0


# 10 --------------------------------------------------------------------------
def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, t in enumerate(triples) if triples.count(t) > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_base_counts_against_brute_force():
    rng = random.Random(8)
    texts = ["".join(rng.choice(["ab ", "c ", "é#", "\n", "  ", "ab c ab\n", "\x0b", "|", "日 "]) for _ in range(rng.randrange(40))) for _ in range(300)] + ["", " ", "\n\n", "a"]
    got = perplexity.base_counts(vec.Texts(pa.array(texts)))
    assert [tuple(int(got[b][i]) for b in perplexity.BASE) for i in range(len(texts))] == [brute_base(t) for t in texts]


def test_kneser_ney_is_a_distribution():
    rng = np.random.default_rng(2)
    codes, n = np.unique(rng.integers(0, 4, 3000) + 64 * rng.integers(0, 4, 3000) + 4096 * rng.integers(0, 4, 3000) + 262144 * rng.integers(0, 4, 3000), return_counts=True)
    model = perplexity.KneserNey.fit(codes.astype(np.uint32), n)
    for context in (0, 1 + 64 * 2 + 4096 * 3, 50 + 64 * 60):
        assert np.exp(model.log_p((context * 64 + np.arange(64)).astype(np.uint32))).sum() == pytest.approx(1, abs=0.02)


def test_perplexity_rejects_noise_and_keeps_prose(spark, docs, empty):
    rng = random.Random(6)
    noise = " ".join("".join(rng.choice("QXZ#%&@~^0987") for _ in range(7)) for _ in range(100))
    good = [(1000 + i, prose(i, 150)) for i in range(60)]
    df = spark.createDataFrame([(i, t, "en") for i, t in [*good, (1, noise), (2, None)]], "doc_id long, text string, lang string")
    kept = {r.doc_id: r.kept for r in perplexity.judge(df).collect()}
    assert all(kept[i] for i, _ in good) and not kept[1] and not kept[2]
    assert perplexity.judge(docs).count() == docs.count()
    assert perplexity.judge(empty).count() == 0


# whole queries -----------------------------------------------------------------
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()
    return {r.doc_id: r.text or "" for r in rows}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def answer(spark, name):
    rows = queries.queries()[name](spark, SMALL).collect()
    found = {r.doc_id: r for r in rows}
    assert len(found) == len(rows)
    return found


def test_op2_query_against_brute_force(spark, small):
    got, order = answer(spark, "op2_syncmers"), list(small.items())
    assert got.keys() == small.keys()
    for (i, t), (n, after) in zip(order, order[1:] + order[:1], strict=True):
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), sha(edited))
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        if t == after:
            assert got[i].fingerprint == got[n].fingerprint and got[i].near_next == 1


def brute_likeness(a, b, anchors=64):
    """The longest common run in order by its recurrence, over the smallest hashes of both."""
    if a == b:
        return 1.0
    here, there = dict(a), dict(b)
    both = sorted(set(here) | set(there))[:anchors]
    pairs = sorted((here[h], there[h]) for h in both if h in here and h in there)
    best = []
    for i, (_, y) in enumerate(pairs):
        best.append(1 + max((best[j] for j in range(i) if pairs[j][1] < y), default=0))
    run = max(best, default=0)
    return 2 * run / (len(both) + run) if run else 0.0


def test_op2_fingerprints_and_likeness_against_brute_force(spark, small):
    got, order = answer(spark, "op2_syncmers"), list(small.items())
    read = lambda s: list(zip(*(x.tolist() for x in syncmers.from_text(s)), strict=True))
    for (i, t), (n, after) in zip(order, order[1:] + order[:1], strict=True):
        # Each text by itself gives what it gave in the stream.
        assert got[i].fingerprint == syncmers.to_text(syncmers.prints([t])[0])
        assert got[i].edited_fingerprint == syncmers.to_text(syncmers.prints([t[: len(t) - len(t) // 4] + after[: len(t) // 4]])[0])
        own = read(got[i].fingerprint)
        assert got[i].near_edited == pytest.approx(brute_likeness(own, read(got[i].edited_fingerprint)))
        assert got[i].near_next == pytest.approx(brute_likeness(own, read(got[n].fingerprint)))


def test_op8_and_op9_queries_against_the_library(spark, small):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=model_file())
    coded, counted = answer(spark, "op8_sentencepiece"), answer(spark, "op9_token_counts")
    assert coded.keys() == small.keys() == counted.keys()
    for i, text in small.items():
        ids = library.encode(text)
        assert (coded[i].n_tokens, coded[i].ids_sha256, coded[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
        assert (counted[i].n_bytes, counted[i].n_tokens, counted[i].over_limit) == (len(text.encode()), len(ids), len(ids) > 4096)


def test_op10_query_against_brute_force(spark, small):
    got = answer(spark, "op10_quality_rules")
    assert got.keys() == small.keys()
    for i, text in small.items():
        base = brute_base(text)
        assert tuple(got[i][b] for b in perplexity.BASE) == base
        assert got[i].base_failed == (base[0] < 50 or 100 * base[4] > 50 * base[0]) and not (got[i].base_failed and got[i].kept)


def brute_log_perplexity(texts):
    """Mean negative log-probability of each text's characters under a modified Kneser-Ney model of the texts, by dictionaries."""

    def kind(c):
        b = c.encode()
        return 60 + (b[1] & 3) if len(b) > 1 else int(perplexity._CLASS[b[0]])

    windows = []
    for t in texts:
        line = [0, 0, 0, *map(kind, t), 0]
        windows.append([tuple(line[k : k + 4]) for k in range(len(line) - 3)] if t else [])
    counts = {4: collections.Counter(w for ws in windows for w in ws)}
    for n in (3, 2, 1):
        counts[n] = collections.Counter(g[1:] for g in counts[n + 1])
    cut, total, kinds = {}, {}, {}
    for n, c in counts.items():
        f = collections.Counter(c.values())
        y = f[1] / (f[1] + 2 * f[2]) if f[1] else 0
        cut[n] = [min(most, max(0.1, k - (k + 1) * y * f[k + 1] / f[k] if f[k] and f[k + 1] else 0.5)) for k, most in ((1, 0.95), (2, 1.9), (3, 2.9))]
        total[n], kinds[n] = collections.Counter(), collections.Counter()
        for g, k in c.items():
            total[n][g[:-1]] += k
            kinds[n][g[:-1], min(k, 3)] += 1

    @functools.cache
    def p(g):
        n, k, head = len(g), counts[len(g)][g], g[:-1]
        free = sum(cut[n][j - 1] * kinds[n][head, j] for j in (1, 2, 3)) / total[n][head]
        return (k - cut[n][min(k, 3) - 1]) / total[n][head] + free * (p(g[1:]) if n > 1 else 1 / 64)

    return [-sum(math.log(p(w)) for w in ws) / len(ws) if ws else None for ws in windows]


def test_op10_perplexities_and_bands_against_brute_force(spark):
    rows = [r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = {r.doc_id: r for r in perplexity.judge(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()}
    query = answer(spark, "op10_quality_rules")
    sure = 0
    for lang in {r.lang for r in rows}:
        mine = [r for r in rows if r.lang == lang]
        logs = dict(zip((r.doc_id for r in mine), brute_log_perplexity([r.text or "" for r in mine]), strict=True))
        distinct = {r.text: logs[r.doc_id] for r in mine if not got[r.doc_id].base_failed}
        steps = sorted(round(x, 3) for x in distinct.values())
        low, high = (steps[math.ceil(len(steps) * q) - 1] for q in (0.25, 0.75))
        wide = max(3 * (high - low), 0.8)
        for r in mine:
            g, x = got[r.doc_id], logs[r.doc_id]
            assert (g.log_ppl is None) == (x is None) and (x is None or g.log_ppl == pytest.approx(x, abs=1e-4))
            assert (g.low, g.high) == pytest.approx((low - wide, high + wide), abs=0.01)
            if x is not None and min(abs(x - g.low), abs(x - g.high)) > 0.02:
                sure += 1
                assert g.kept == query[r.doc_id].kept == (not g.base_failed and low - wide <= x <= high + wide)
    assert sure > 0.9 * len(rows)


def test_op10_typical_goes_by_the_spread_of_a_language(spark):
    home = SMALL.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{home}/{t}.parquet") for t in ("documents", "labels"))
    rows = perplexity.judge(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").join(labels.select("doc_id", "quality"), "doc_id", "left").collect()
    query = {r.doc_id: r.typical for r in queries.op10_quality_rules(spark, home).select("doc_id", "typical").collect()}
    for lang in {r.lang for r in rows}:
        mine = [r for r in rows if r.lang == lang and not r.base_failed]
        steps = sorted(round(x, 3) for x in {r.text: r.log_ppl for r in mine}.values())
        low, high = (steps[math.ceil(len(steps) * q) - 1] for q in (0.25, 0.75))
        for r in mine:
            assert (r.typical_low, r.typical_high) == pytest.approx((low - 3 * (high - low), high + 3 * (high - low)), abs=0.015)
            assert r.typical == query[r.doc_id] == (r.typical_low <= r.log_ppl <= r.typical_high)
    assert not any(r.typical for r in rows if r.base_failed) and all(r.kept for r in rows if r.typical)
    share = lambda q: (x := [r.typical for r in rows if r.quality == q and not r.base_failed]) and sum(x) / len(x)
    assert share(0) < 0.5 and share(1) > 0.97


@pytest.mark.parametrize(("name", "cut"), [("op5_quality", 0.7), ("op7_toxicity", 0.3)])
def test_op5_and_op7_queries_cover_all_rows(spark, small, name, cut):
    got = answer(spark, name)
    assert got.keys() == small.keys()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)


def brute_classes(spark, docs):
    """Classes by the exact similarity of all pairs."""
    idf = near_dup.idf_cells(*near_dup.document_frequencies(docs.select("doc_id", "text")))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    label = {i: i for i in texts}
    names = sorted(texts)
    for k, i in enumerate(names):
        later = names[k + 1 :]
        alike = near_dup.similarity([texts[i]] * len(later), [texts[j] for j in later], idf) >= near_dup.THRESHOLD if later else []
        if not re.search(r"\w", texts[i]):  # texts without words are copies of each other
            alike = [not re.search(r"\w", texts[j]) for j in later]
        for j, near in zip(later, alike, strict=True):
            if near and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = {d: low if c == high else c for d, c in label.items()}
    return label


def test_op4_query_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {i: r.class_id for i, r in answer(spark, "op4_near_duplicates").items()}
    assert got == brute_classes(spark, docs)


def brute_mix(rows):
    """Ids that one epoch of half the tokens takes, by filling level after level."""
    def fill(nodes, budget):
        given, budget = {}, min(budget, sum(c for _, c in nodes.values()))
        while nodes:
            total = sum(w for w, _ in nodes.values())
            full = {k: c for k, (w, c) in nodes.items() if c * total <= budget * w}
            if not full:
                return given | {k: min(c, w * budget // total) for k, (w, c) in nodes.items()}
            given |= full
            budget -= sum(full.values())
            nodes = {k: v for k, v in nodes.items() if k not in full}
        return given

    tokens = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _, _ in rows}
    path = {}
    for i, _, lang, source in rows:
        number = re.search("([0-9]{1,9})$", source or "")
        path[i] = (f"d{int(number[1]) % 4}" if number else "other", lang or "", source or "")
    grants = {(): sum(tokens.values()) * queries.MIX_PERCENT // 100}
    for depth, level in enumerate(mixing.LEVELS, 1):
        weight, below = queries.MIX_WEIGHTS.get(level, {}), {}
        for node, budget in grants.items():
            kids = {p[:depth] for p in path.values() if p[: depth - 1] == node}
            below |= fill({k: (weight.get(k[-1], 1), sum(tokens[i] for i, p in path.items() if p[:depth] == k)) for k in kids}, budget)
        grants = below
    chosen = set()
    for leaf, budget in grants.items():
        upto = 0
        for _, i in sorted((hashlib.md5(f"{queries.MIX_SEED}:0:{i}".encode()).hexdigest(), i) for i, p in path.items() if p == leaf):
            upto += tokens[i]
            if upto <= budget:
                chosen.add(i)
    return chosen


# pipeline ---------------------------------------------------------------------
def test_pipeline_stages_against_brute_force(spark):
    import sentencepiece

    import corpus_pipeline
    from folioscan.llm.common import materialise

    stages = dict(corpus_pipeline.STAGES)
    documents, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))

    def after(name, docs):
        out = materialise(stages[name](spark, docs, SMALL), "pipeline-test")
        return out, {r.doc_id: r for r in out.collect()}

    model = quality.train(documents, labels)
    texts = {r.doc_id: r.text for r in documents.collect()}
    score = dict(zip(texts, model.score(quality.features(pa.array(texts.values(), pa.string()))), strict=True))
    docs, got = after("quality classifier", documents)
    assert got.keys() == {i for i in texts if score[i] >= queries.GOOD_FROM}

    want = {i: t for i, t, _, _ in brute_lines([(i, r.text) for i, r in got.items()])}
    docs, got = after("line dedup", docs)
    assert {i: r.text for i, r in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values())

    want = {i for i, c in brute_classes(spark, docs).items() if i == c}
    docs, got = after("MinHash near-dedup", docs)
    assert set(got) == want

    want = brute_mix([(i, r.text, r.lang, r.source) for i, r in got.items()])
    docs, got = after("mixing sources to target weights", docs)
    assert got.keys() == want and want

    library = sentencepiece.SentencePieceProcessor(model_file=model_file())
    texts = {i: r.text for i, r in got.items()}
    _, got = after("SentencePiece encoding", docs)
    assert {i: r.ids for i, r in got.items()} == {i: library.encode(t or "") for i, t in texts.items()}
    assert {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SMALL).collect()} == {i: r.ids for i, r in got.items()}


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    seen = rows
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, seen, sf)
        assert after.columns == corpus_pipeline.COLUMNS
        assert 0 < after.count() <= seen.count(), name
        seen = after
    assert corpus_pipeline.run(spark, sf).count() == seen.count()
