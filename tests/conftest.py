from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from haulmark.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    base = tmp_path_factory.mktemp("spark")
    session = build_session(
        "haulmark-tests", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="8g",
        spark__sql__warehouse__dir=str(base / "warehouse"), spark__checkpoint__dir=str(base / "checkpoints"),
        spark__driver__extraJavaOptions=f"-Dderby.system.home={base / 'derby'}")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def files(tmp_path):
    """Write text files by name and return their folder."""
    def write(**named: str) -> str:
        for name, text in named.items():
            (tmp_path / name).write_text(text)
        return str(tmp_path)

    return write


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
