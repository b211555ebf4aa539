"""Every registered query beside its SQL, on the smallest tables."""

import contextlib
import io

import pytest
from oracle import compare, connect

import __spark_entry__ as entry
from tidemark.plans import catalogue

SF = "/root/testdata/sf0.001"
SQLS = entry.oracle_sql()
# The training-data operators have tests of their own; theirs is the one removable subpackage.
QUERIES = {name: fn for name, fn in entry.queries().items() if name in catalogue.QUERIES}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, con, name):
    assert name in SQLS
    frame = QUERIES[name](spark, SF)
    assert compare(spark, con, SF, lambda *_: frame, SQLS[name]) is None
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        frame.explain("formatted")
    assert "CartesianProduct" not in plan.getvalue() and "NestedLoopJoin" not in plan.getvalue()


def test_entry_has_rows(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["status", "entity_runs", "entities"] and frame.count() > 0


def test_only_known_names_have_sql():
    assert set(SQLS) <= set(entry.queries())
