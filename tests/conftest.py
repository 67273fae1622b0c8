import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shelltrail.schema import EVENT_COLUMNS, EVENT_SCHEMA  # noqa: E402
from shelltrail.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, app="tests")


@pytest.fixture(scope="session")
def make_events(spark):
    """Events from dicts; times are texts, missing fields are null."""
    from pyspark.sql import functions as F

    def make(rows):
        names = [name for name, _ in EVENT_COLUMNS]
        ordered = []
        for i, row in enumerate(rows):
            full = {"event_id": i, "return_code": 0, "hostname": "h", **row}
            full.setdefault("end_timestamp", full.get("start_timestamp"))
            ordered.append(tuple(full.get(name) for name in names))
        loose = ", ".join(
            f"{field.name} {'string' if 'timestamp' in field.name else field.dataType.simpleString()}"
            for field in EVENT_SCHEMA
        )
        frame = spark.createDataFrame(ordered, loose)
        return frame.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in EVENT_SCHEMA])

    return make
