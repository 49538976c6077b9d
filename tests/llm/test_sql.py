"""Queries of the corpus operators against their DuckDB twins."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import actual, expected  # noqa: E402

from tracelake.llm import queries  # noqa: E402

SF = "/root/testdata/sf0.001"
#: test_operators holds these against plain versions on the same tables.
COVERED = {"op1_decontamination", "op4_embedding_dedup", "op6_minhash_dedup"}


@pytest.mark.parametrize("name", sorted(set(queries.oracle_sql()) - COVERED))
def test_query(spark, name):
    assert actual(queries.queries()[name](spark, SF)) == expected(queries.oracle_sql()[name], SF)
