import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from tessera.session import get_session
    s = get_session("local[4]", shuffle_partitions=8, app_name="tessera-tests")
    # tests run without a cluster: a scratch checkpoint folder is set only because none is named
    assert s.sparkContext.getCheckpointDir()
    yield s
    SparkSession.getActiveSession()


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="tessera-test-")
