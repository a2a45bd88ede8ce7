import datetime
import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from millrace.session import build  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build("tests", "local[4]", **{
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def at(seconds: float, base: str = "2021-05-01 00:00:00") -> datetime.datetime:
    """A time `seconds` after the start of the test day."""
    return datetime.datetime.fromisoformat(base) + datetime.timedelta(seconds=seconds)


def rows(df, *order):
    return sorted(tuple(r) for r in df.select(*(order or df.columns)).collect())
