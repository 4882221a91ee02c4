import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from deskloom.session import discard, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("checkpoints")
    session = local_session("4", spark__checkpoint__dir=str(folder), spark__driver__memory="4g")
    yield session
    discard(session)
    assert not list(folder.glob("deskloom-*")), "staged tables were left behind"
    session.stop()


def one(spark, column, **values):
    """The value of one expression over one row of text values."""
    schema = ", ".join(f"{name} string" for name in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]
