"""Every registered query of the engine against its SQL."""

import pytest
from conftest import same_rows

from countloom.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_matches_sql(spark, sf_dir, duck, name):
    assert same_rows(catalogue.QUERIES[name](spark, sf_dir), duck.execute(catalogue.ORACLE[name]).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
