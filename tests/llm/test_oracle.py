"""Every query of the subpackage that has SQL gives DuckDB's rows."""

import pytest

from meshlark.llm import oracle
from tests.test_oracle import db, same  # noqa: F401


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_same_rows(spark, db, sf_dir, name):  # noqa: F811
    same(spark, db, sf_dir, name, oracle.SQL[name])
