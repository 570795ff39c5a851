import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from roadfuse.session import local_session, use_checkpoint_dir  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, "roadfuse-tests", spark__sql__shuffle__partitions="4")
    s.sparkContext.setLogLevel("ERROR")
    use_checkpoint_dir(s)
    yield s
    s.stop()
