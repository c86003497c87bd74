import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from glosa.session import get_spark

    s = get_spark(cores="*", shuffle_partitions=8, app="glosa-tests")
    yield s
    s.stop()
