"""Registered queries against their SQL at the smallest scale; tests/compare.py runs them all."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
RUN = (
    "scan_language extract_functions extract_positions extract_documents extract_errors extract_nested extract_conditional extract_directives extract_declarators params_json_unicode signature_norm "
    "tokenise_documents tokenise_pages query_grammar edit_distance_parts edit_distance_documents candidates_both "
    "search_top search_batch search_exact change_detection live_functions stream_progress params_json format_hits"
).split()


def test_every_query_has_its_sql():
    assert set(entry.QUERIES) == set(entry.ORACLE)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", RUN)
def test_query_equals_sql(spark, name):
    assert compare(entry.queries()[name](spark, SF), connect(SF), entry.oracle_sql()[name]) == []


def test_entry(spark):
    assert 0 < entry.entry(spark).count() <= 20
