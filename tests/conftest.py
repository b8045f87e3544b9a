import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from claimsift.session import local_session

    return local_session(8, "8g")


@pytest.fixture(scope="session")
def views(spark):
    from claimsift.plans.views import Views

    return Views(spark, SMALL)
