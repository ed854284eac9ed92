import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from veritrail.session import SETTINGS, build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    SETTINGS.update({"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                     "spark.driver.memory": "6g"})
    session = build_session("tests", "local[8]", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def value(spark):
    """Evaluate one column expression."""
    def run(*columns):
        row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
        return row[0] if len(columns) == 1 else tuple(row)
    return run
