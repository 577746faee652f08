"""Columns found by position."""

import pytest
from test_tables import rows_of

from tablespark.sources.ingest import import_text
from tablespark.sources.layout import columns_of

TEXT = """First list

ID    Physical name   State
---   -------------   -----
1     disk one        ok
2     a very long name of it  bad
3     短い名前        ok

Second

ID       Size   Host
1      10     alpha
2             beta
3      30     gamma
"""


def test_widths():
    assert [columns_of(c) for c in "aé短́\t가"] == [1, 1, 2, 0, 0, 2]


@pytest.fixture(scope="module")
def got(spark):
    return import_text(spark, TEXT, "aligned-table")


def test_titles_wide_letters_and_overflow(got):
    one = got.tables[0]
    assert (one.name, one.headers) == ("First list", ("ID", "Physical name", "State"))
    assert rows_of(one) == [("1", "disk one", "ok"), ("2", "a very long name of it", "bad"), ("3", "短い名前", "ok")]
    assert [d[0] for d in got.diagnostics] == ["ALIGNED_POSITION_MISMATCH"]


def test_lines_outvote_the_header(got):
    two = got.tables[1]
    assert (two.name, two.headers) == ("Second", ("ID", "Size", "Host")) and rows_of(two) == [("1", "10", "alpha"), ("2", "", "beta"), ("3", "30", "gamma")]
