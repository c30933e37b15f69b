import pytest

from lodeseam.plans import queries, sql
from tests.compare import same
from tests.conftest import SF

ROWS_ONLY = {"html_sections", "html_text"}


def test_every_query_has_sql():
    assert set(queries.queries()) - set(sql.oracle_sql()) == ROWS_ONLY


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_against_sql(spark, name):
    ok, said = same(spark, SF, queries.queries()[name], sql.oracle_sql()[name])
    assert ok, said


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_rows(spark, name):
    assert queries.queries()[name](spark, SF).count() >= 50


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "search_endtoend" in e.queries()
