"""Every query of the core against its SQL; those without SQL have to run and give rows."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from helpers import check  # noqa: E402

from chatterloom.plans import registry  # noqa: E402


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, data, oracle, name):
    df = registry.queries()[name](spark, data)
    if name in registry.oracle_sql():
        check(df, oracle, registry.oracle_sql()[name])
    else:
        assert df.limit(1).count() == 1
