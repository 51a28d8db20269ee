import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from webstrata import settings  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = settings.session(
        "tests",
        spark__master="local[8]",
        spark__ui__enabled="false",
        spark__sql__shuffle__partitions="4",
        spark__default__parallelism="4",
        spark__driver__memory="6g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoints")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


@pytest.fixture
def rows(spark):
    """Build a frame in one partition: ``rows(schema, *tuples)``."""

    def build(schema, *values):
        return spark.createDataFrame(list(values), schema).coalesce(1)

    return build
