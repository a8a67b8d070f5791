import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from hirelake.session import build_session

    session = build_session("tests", master="local[8]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2",
        # Tiny inputs: re-planning between stages costs more than it saves.
        "spark.sql.adaptive.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="hirelake-test-"),
    })
    session.sparkContext.setLogLevel("OFF")
    return session


@pytest.fixture(scope="session")
def sf():
    return SF
