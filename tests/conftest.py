import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from corpus_audit.session import build_session

    session = build_session(
        "tests", master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "6g"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def files(spark):
    """Build a files table from {path: content} or (repo, path, content) rows."""

    def build(rows):
        if isinstance(rows, dict):
            rows = [("r", path, content) for path, content in rows.items()]
        return spark.createDataFrame(rows, "repo string, path string, content string")

    return build
