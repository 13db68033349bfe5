import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    import precis.plans.fixtures  # noqa: F401 - sets the default registry
    from precis.session import local_session
    s = local_session(4, shuffle_partitions=4, app_name="precis-tests")
    yield s
    s.stop()
