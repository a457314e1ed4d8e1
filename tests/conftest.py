import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from seclake.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "seclake-tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}",
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
            "spark.python.sql.dataFrameDebugging.enabled": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def lines(spark):
    """Make a lines table from texts."""

    def make(*texts, file="f"):
        rows = [(file, i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "file STRING, seq BIGINT, line STRING")

    return make


@pytest.fixture
def events(spark):
    """Make an events table from dicts; fields not given are NULL."""
    from seclake.schema import EVENT_FIELDS

    def make(rows):
        schema = "seq BIGINT, format STRING, event_ts STRING, " + ", ".join(f"{f} STRING" for f in EVENT_FIELDS)
        names = ["seq", "format", "event_ts", *EVENT_FIELDS]
        data = [tuple({"seq": i, **r}.get(n) for n in names) for i, r in enumerate(rows)]
        df = spark.createDataFrame(data, schema)
        return df.selectExpr(
            "seq", "format", "cast(event_ts as timestamp) as event_ts", *EVENT_FIELDS
        )

    return make
