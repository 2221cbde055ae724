"""Every registered query of the library against its SQL on the smallest tables."""

import pytest

from lattica.plans import catalog
from tests.duck import same_as_duckdb


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["v", "heap"]


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, sf, name):
    same_as_duckdb(catalog.QUERIES[name](spark, sf), catalog.ORACLE_SQL[name], sf)


#: Held against interpreters in test_programs and test_strings, and read back in test_graph_text.
PROGRAMS = {"nn13_program", "iv12_program", "str06_values", "snk01_program_json"}


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL) - PROGRAMS))
def test_query_without_sql(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).columns
