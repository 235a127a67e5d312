import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cohortscope.session import build_session, checkpoint_dir  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", app_name="cohortscope-tests", shuffle_partitions=8)
    # Tests only: a scratch checkpoint folder where the session has none.
    checkpoint_dir(session, fallback=tempfile.mkdtemp(prefix="cohortscope-ckpt-", dir="/tmp"))
    yield session
    session.stop()


def rows(df):
    return [tuple(r) for r in df.collect()]
