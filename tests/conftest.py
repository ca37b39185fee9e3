import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import clear_scratch, local_session
    session = local_session(8, 4, "6g", "tidemark-tests")
    yield session
    clear_scratch(session)
    session.stop()
