import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

from lumenscan.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        app="lumenscan-tests",
        master="local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="4g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("stages")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def units_of(spark):
    """Source units from ``{name: text}``."""

    def make(texts):
        rows = [(name, name, text, None, True) for name, text in texts.items()]
        return spark.createDataFrame(
            rows, "unit_id string, location string, content string, content_sha2 string, valid_utf8 boolean"
        )

    return make
