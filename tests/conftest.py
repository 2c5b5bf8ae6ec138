import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")

DATA = Path(os.environ.get("TESTDATA_DIR", "/root/testdata"))


@pytest.fixture(scope="session")
def spark():
    from skeinflow.session import local_session

    session = local_session(cpus=4, app="tests", memory="4g", partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    """The smallest tables."""
    folder = DATA / "sf0.001"
    if not folder.exists():
        pytest.skip("no test tables")
    return str(folder)


def rows(df):
    """Sorted rows as tuples; nulls first."""
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, str(type(x)), x) if not isinstance(x, (list, dict)) else (True, "", str(x)) for x in r))
