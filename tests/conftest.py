import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from ebbtide.session import get_spark
    s = get_spark("local[4]", app="ebbtide-tests", shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SMOKE


@pytest.fixture(scope="session")
def customers(spark, sf_dir):
    from ebbtide.operators.enrich import enriched_customers
    return enriched_customers(spark, sf_dir)
