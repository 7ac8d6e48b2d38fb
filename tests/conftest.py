import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from spoglio.session import get_session

    s = get_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="2g", spark__sql__autoBroadcastJoinThreshold="1m")
    s.sparkContext.setLogLevel("ERROR")
    return s
