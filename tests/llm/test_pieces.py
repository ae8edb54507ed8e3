"""Offsets of pieces against an alignment by single characters, against the library's own offsets, and through a compiled map."""

import random

import numpy as np
import pytest
import sentencepiece

from folioscan.llm import pieces
from folioscan.llm.queries import model_file
from tests.llm.test_operators import SMALL, answer, sha

RULES = [None, "nfkc", "nmt_nfkc", "nmt_nfkc_cf"]
STRANGE = [" ", " ", "▁", "\n", "\t", "a", "b", "the", "é", "é", "Ａ", "ﬁ", "①", "½", "㌔", "ｶﾞ", "😀", "中", "　", "\xa0", "​", "-", "E"]


def source_of(rule):
    return model_file() if rule is None else pieces.with_rule(model_file(), rule)


def slow_alignment(coder, text):
    """Normalised bytes and their source bytes, prefix after prefix."""
    source, at, out = text.encode(), 0, []
    while at < len(source):
        found = coder.map.match(source, at) if coder.map.units else None
        piece, n = found or (source[at : at + 1], 1)
        out += [(bytes([b]), at) for b in piece]
        at += n
    out = ([(b" ", 0)] if source else []) + out
    whole = [(m, at) for b, at in out for m in ("▁".encode() if b == b" " else b,)]
    return b"".join(m for m, _ in whole), [at for m, at in whole for _ in m] + [len(source)]


def slow_spans(coder, text, ids):
    normal, origin = slow_alignment(coder, text)
    ends, upto = [], 0
    for i in ids:
        upto += 1 if coder.is_byte[i] else len(coder.pieces[i].encode())
        ends.append(origin[upto])
    assert not ids or upto == len(normal)
    return [0, *ends[:-1]] if ids else [], ends


@pytest.mark.parametrize("rule", RULES)
def test_spans_of_strange_texts(rule):
    coder, rng = pieces.model(source_of(rule)), random.Random(4)
    library = sentencepiece.SentencePieceProcessor(model_proto=coder.library.serialized_model_proto())
    for _ in range(400):
        text = "".join(rng.choice(STRANGE) for _ in range(rng.randrange(12)))
        (ids,) = coder.ids([text])
        assert ids.tolist() == library.encode(text)
        begins, ends = coder.spans(text, ids)
        assert (begins.tolist(), ends.tolist()) == slow_spans(coder, text, ids.tolist()), repr(text)
        for i, b, e, p in zip(ids, begins, ends, library.encode(text, return_type="proto").pieces, strict=True):
            if not coder.is_byte[i]:
                assert (b, e) == (p.begin, p.end), (repr(text), p)


def test_squeezed_blanks_keep_their_alignment():
    library = sentencepiece.SentencePieceNormalizer(rule_name="nfkc", add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
    parts = dict(pieces._fields(library.serialized_model_proto()))
    own, rng = pieces.PieceModel.__new__(pieces.PieceModel), random.Random(5)
    own.map = pieces.CharacterMap(dict(pieces._fields(parts[3]))[2])
    own.prefix = own.squeeze = own.escape = 1
    for suffix in (0, 1):
        own.suffix = suffix
        for _ in range(300):
            text = "".join(rng.choice([" ", " ", "　", "a", "é", "ﬁ", "\xa0"]) for _ in range(rng.randrange(9)))
            got, origin = own.normalise(text)
            assert suffix or got.decode() == library.normalize(text), repr(text)
            assert len(origin) == len(got) + 1 and (np.diff(origin) >= 0).all()


def test_every_span_on_a_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    coder = pieces.model(model_file())
    for r in pieces.encode(docs, model_file()).collect():
        assert (r.begins, r.ends) == slow_spans(coder, texts[r.doc_id], r.ids)


def test_mapped_query_against_the_library(spark):
    got = answer(spark, "sentencepiece_mapped")
    coder = pieces.model(source_of("nmt_nfkc"))
    wide = str.maketrans("abcdefghijklm", "".join(chr(ord(c) + 0xFEE0) for c in "abcdefghijklm"))
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        text = (r.text or "").replace("fi", "ﬁ").translate(wide)
        ids = coder.library.encode(text)
        begins, ends = slow_spans(coder, text, ids)
        join = lambda x: ",".join(map(str, x))
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].spans_sha256, got[r.doc_id].covered_bytes) == (len(ids), sha(join(ids)), sha(join(begins + ends)), len(text.encode()))
        assert ids == coder.library.encode(r.text or "")  # the map undoes the other forms


def test_edges(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, ""), (3, "ﬁ " * 40_000)], "doc_id long, text string")
    rows = pieces.encode(df, source_of("nfkc"), decode=True).orderBy("doc_id").collect()
    assert [len(r.ids) for r in rows[:3]] == [0, 0, 0] and [r.decoded for r in rows[:3]] == ["", "", ""]
    assert rows[3].ends[-1] == 160_000 and rows[3].decoded == "fi " * 40_000
    assert pieces.encode(df.limit(0), source_of("nfkc")).count() == 0
