"""Every registered query with SQL equals it, the others return rows; all of them on the smallest tables."""

import pytest

import __spark_entry__ as entry_module
from tools.check_oracles import compare, connect

pytest.importorskip("inkwell.llm.queries")
from inkwell.llm.queries import QUERIES  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    ok, note = compare(spark, db, name, SF_DIR)
    assert ok and " 0 rows" not in note, note
