import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from prumo.session import make_session, ship

    s = make_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.sql.autoBroadcastJoinThreshold": "1m"})
    ship(s)
    yield s
    s.stop()


def rows(df):
    """The rows of a small result as a sorted list of tuples."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
