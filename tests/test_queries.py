"""Every query of the engine against its SQL on small tables; those without SQL give rows."""

from __future__ import annotations

import pytest
from compare import duck, rows

from tokenloom.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, name):
    made = registry.QUERIES[name](spark, sf)
    own = made.toPandas()
    assert list(own.columns) == made.columns
    if name in registry.ORACLE_SQL:
        want = duck(sf, registry.ORACLE_SQL[name])
        assert sorted(own.columns) == sorted(want.columns)
        assert rows(own) == rows(want)
    else:
        assert len(own) > 0


def test_entry_points_import():
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
