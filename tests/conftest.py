import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from vulnlake.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(
        app="vulnlake-tests",
        spark__sql__shuffle__partitions="4",
        spark__sql__streaming__stateStore__providerClass=(
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
        ),
    )
    yield session
    session.stop()
