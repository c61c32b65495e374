"""The operators that SQL can express, against their twins over the whole given tables."""

from __future__ import annotations

import pytest

from adperf.llm import queries as llm
from tests.comparing import differences, duck


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_twin(spark, sf_dir, name):
    assert differences(llm.queries()[name](spark, sf_dir), duck(sf_dir), llm.oracle_sql()[name]) is None
