import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from promptscreen.session import get_spark
    s = get_spark(app="promptscreen-tests", master="local[4]", shuffle_partitions=8,
                  driver_memory="6g")
    yield s
