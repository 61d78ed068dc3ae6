"""Every registered query beside its SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

from tests import oracle

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_queries_match_their_sql(spark):
    import __spark_entry__ as entry

    con, sqls, wrong = oracle.connection(SF), entry.oracle_sql(), {}
    for name, f in entry.queries().items():
        if name in sqls:
            if said := oracle.difference(f(spark, SF), con, sqls[name]):
                wrong[name] = said
        else:
            f(spark, SF).count()
    assert not wrong


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
