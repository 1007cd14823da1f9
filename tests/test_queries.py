"""Every registered query against its SQL, over the whole smallest tables."""

import pytest
from compare import both, connect

from lexforge import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_rows_are_those_of_sql(spark, duck, name):
    mine, theirs = both(spark, duck, FOLDER, queries.QUERIES[name], queries.ORACLES[name])
    assert mine == theirs


def test_leaves_are_filled_in_order(spark):
    rows = sorted(queries.fts_leaf_packing(spark, FOLDER).collect(), key=lambda r: (r.part, r.word, r.ctx))
    size, last = {}, None
    for r in rows:
        key = (r.part, r.leaf)
        if key != last:
            assert r.prefix == 0
            last = key
        entry = 2 + len(r.word) - r.prefix + 1 + max(1, -(-r.docs.bit_length() // 7)) + 6 + max(1, -(-r.data_bytes.bit_length() // 7))
        size[key] = size.get(key, 8) + entry
    assert max(size.values()) <= 4096
    assert len(rows) == len({(r.word, r.ctx) for r in rows})


def test_entry_and_registration(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
