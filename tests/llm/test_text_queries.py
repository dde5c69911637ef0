"""The text queries run over the smallest tables and give rows of the stated form."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from parchment.llm import plans

COLUMNS = {
    "p1_found": ["table_name", "row_key"], "p2_found": ["evidence_id", "line_no"], "p7_found": ["table_name", "row_key", "noise_kind"],
    "p8_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "subject_key"],
}


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, name):
    df = plans.queries()[name](spark, "/root/testdata/sf0.001")
    rows = df.collect()
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
        assert len(rows) == len({str(r) for r in rows})


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_against_sql(spark, name):
    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for f in Path(d).iterdir():
        c.sql(f"create view {f.stem} as select * from '{f}'")
    df = plans.queries()[name](spark, d)
    cols = sorted(df.columns)
    want = c.sql(plans.oracle_sql()[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(x) for x in cols]
    assert Counter(tuple(r[x] for x in cols) for r in df.collect()) == Counter(tuple(r[i] for i in at) for r in want.fetchall())
