import pytest
from oracle import same

from lakeloom.plans import analyses, catalog, details, general, rankings, works

MODULES = (general, catalog, rankings, analyses, details, works)
QUERIES = {k: q for m in MODULES for k, q in m.QUERIES.items()}
SQL = {k: q for m in MODULES for k, q in m.SQL.items()}
#: Tested by themselves, with results of their own.
ELSEWHERE = {"p1_found", "p1_linked", "p3_found", "p3_unified", "p4_found", "p4_values", "q_components", "q_depths", "q_selection_v2"}
#: At the smallest scale no row meets all conditions.
EMPTY = {"q_same_observation"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_is_its_sql(spark, data, duck, name):
    same(QUERIES[name](spark, data), duck, SQL[name], empty=name in EMPTY)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - ELSEWHERE))
def test_query_has_rows(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark, data):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["source_field", "record_id", "node_path", "parent_path"]
