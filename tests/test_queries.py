"""Every query of the library against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from folioscan import queries

SF = "/root/testdata/sf0.001"
TABLES = "documents benchmark conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(plain(x) for x in v) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert ours == theirs


def test_every_query_runs_or_has_sql(spark):
    extra = set(queries.queries()) - set(queries.oracle_sql())
    assert extra == {"normalize_page_nfkc"}
    assert queries.queries()["normalize_page_nfkc"](spark, SF).where("length(norm) <> map_length").count() == 0


def test_recognition_reads_every_line(spark):
    pages = queries.table(spark, SF, "conversations").selectExpr("conv_id", "turn", "coalesce(text, '') text").collect()
    lines = {(r.conv_id, r.turn, i): line for r in pages for i, line in enumerate(r.text.split("\n")) if line}
    read = lambda name: queries.queries()[name](spark, SF).collect()
    assert {(r.doc_id, r.page, r.at_line): r.codes for r in read("ctc_decode_lines")} == {k: ",".join(str(ord(c)) for c in line) for k, line in lines.items()}
    assert len(read("ctc_cells_lines")) == sum(map(len, lines.values()))
    assert len(read("token_ink_boxes_lines")) == sum(not c.isspace() for line in lines.values() for c in line)
