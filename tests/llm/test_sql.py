"""Corpus queries against their SQL in another engine."""

import pytest

from hazardlens.llm import catalog
from tools import compare


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, name):
    frame = catalog.QUERIES[name](spark, sf_dir)
    problems = compare.differences(frame, compare.connect(sf_dir), catalog.ORACLE_SQL[name])
    assert not problems, "\n".join(problems)


def test_one_query_per_operator():
    numbers = [int(name[2:].split("_")[0]) for name in catalog.QUERIES]
    assert sorted(numbers) == list(range(1, 14))
