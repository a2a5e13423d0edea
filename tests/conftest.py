import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from larkspan.session import build_session

    return build_session("tests", int(os.environ.get("TEST_CPUS", "4")), {"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "3g"})


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
