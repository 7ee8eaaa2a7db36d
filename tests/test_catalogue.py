"""Every query against its SQL in DuckDB, on the smallest tables."""

from pathlib import Path

import pytest

from foliant.plans import reading_catalog, registry, shelf_catalog, text_catalog, upkeep_catalog  # noqa: F401  the catalogues register their queries
from tests.conftest import SF, same_rows


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n in registry.SQL])
def test_query_equals_sql(spark, duck, name):
    got, want = same_rows(registry.QUERIES[name](spark, SF), duck.sql(registry.SQL[name]))
    assert got == want


#: Queries that SQL can't express, and the tests that hold them against plain Python.
PLAIN = {"audit_repeat": "test_plain_versions.py", "pagemap_ranges": "test_plain_versions.py", "align_agreement": "test_plain_versions.py", "divergence_clusters": "test_plain_versions.py", "llm_batches": "test_plain_versions.py", "segmented_documents": "test_words.py"}


def test_queries_without_sql_have_a_plain_version():
    assert {n for n in registry.QUERIES if n not in registry.SQL} == set(PLAIN)
    for name, where in PLAIN.items():
        assert f'QUERIES["{name}"]' in (Path(__file__).parent / where).read_text()
