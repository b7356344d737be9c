"""Every registered query at the smallest scale, against its check SQL where there is one."""

import pytest
from check import compare, connect

from phrasebench.queries import ORACLES, QUERIES

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(ROOT)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, ROOT)
    if name in ORACLES:
        diff, _ = compare(df, con, ORACLES[name])
        assert not diff, diff
    else:
        assert df.count() > 0


def test_every_check_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
