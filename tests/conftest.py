import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tablekit.session import get_session, set_shared_root, shared_root
    s = get_session("local[4]", 4, extra_conf={"spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    if not shared_root(s, required=False):   # tests only: a shared folder of their own
        set_shared_root(s, str(tmp_path_factory.mktemp("shared")))
    yield s


@pytest.fixture(scope="session")
def spark_session_holder(spark):
    return spark
