"""The encodings leave results far below the product of their factors, so that a solver that says 'everything' would fail."""

from pathlib import Path

import duckdb
import pytest

from lattica.plans import catalog


@pytest.fixture(scope="module")
def rows(sf):
    con = duckdb.connect()
    for p in Path(sf).iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return lambda name: con.execute(catalog.ORACLE_SQL[name]).fetchall()


@pytest.mark.parametrize("name", ["pt05_field_load", "pt07_array_contents", "pt13_static_calls", "acc03_closure", "set02_subsets"])
def test_results_are_sparse(rows, name):
    found = rows(name)
    assert 1000 < len(found) < len({r[0] for r in found}) * len({r[1] for r in found}) / 10


def test_fields_decide(rows):
    loads, stores, arrays = rows("pt05_field_load"), rows("pt06_field_store"), rows("pt07_array_contents")
    assert set(loads) < set(arrays)
    by_field = {}
    for heap, f, other in stores:
        by_field.setdefault(heap, {}).setdefault(f, set()).add(other)
    assert any(len(x) > 1 and len({frozenset(v) for v in x.values()}) > 1 for x in by_field.values())


def test_discovery_goes_on(rows):
    found = rows("reg21_discovery")
    assert sum(rel == "m" and a % 2 == 1 for rel, a in found) > 100 and sum(rel == "t" for rel, a in found) == 5
