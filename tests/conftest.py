import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from stringloom.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_session("tests", 8)
    session.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))) if session.conf.get("spark.checkpoint.dir", None) is None else None
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
