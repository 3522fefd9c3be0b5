import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from risklens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(8, shuffle_partitions=4, app="tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def corpus(spark):
    """Builds a corpus table from {path: content}."""

    def build(files: dict[str, str], project: str = "p"):
        rows = [(project, path, content) for path, content in files.items()]
        return spark.createDataFrame(rows, "project_name string, file_path string, content string")

    return build
