"""Every query of the core against its SQL on the smallest tables; those without SQL must give rows."""

import pytest
from oracle import SF, same

from stackloom.plans import file_queries, format_queries, locus_queries, mapped_queries, problem_queries, read_queries, site_queries, snp_queries, stack_queries

MODULES = (problem_queries, snp_queries, stack_queries, locus_queries, read_queries, format_queries, mapped_queries, file_queries, site_queries)
ALL = [(m, n) for m in MODULES for n in m.QUERIES]


@pytest.mark.parametrize("module,name", ALL, ids=[n for _, n in ALL])
def test_query(spark, module, name):
    if name in module.ORACLE_SQL:
        same(spark, module.QUERIES[name], module.ORACLE_SQL[name])
    else:
        assert module.QUERIES[name](spark, SF).count() > 0


def test_names_are_unique():
    names = [n for _, n in ALL]
    assert len(names) == len(set(names))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
