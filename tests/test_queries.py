"""Every registered query of the library itself against its SQL."""

import pytest

from tests.compare import assert_same, connect
from vectrail.plans import registry

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf_dir, con, name):
    assert_same(registry.queries()[name](spark, sf_dir), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    assert registry.queries()[name](spark, sf_dir).count() > 0


def test_entry_is_the_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["item_id", "place", "doc_id", "chunk_ix", "start", "cosine", "score"]
