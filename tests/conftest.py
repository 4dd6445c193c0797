import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from corpusloom.session import local_session, ship

    s = local_session(cpus=8, shuffle_partitions=4, memory="6g")
    ship(s)
    return s
