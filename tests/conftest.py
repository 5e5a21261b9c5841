import sys
from pathlib import Path

import pytest

for folder in (Path(__file__).resolve().parents[1], Path(__file__).resolve().parent):
    sys.path.insert(0, str(folder))

from driftline.session import local_session  # noqa: E402
from fleet_tables import synthetic_lines, write_lines  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def export_path(tmp_path_factory):
    return write_lines(tmp_path_factory.mktemp("export"), synthetic_lines())
