import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shelfwise.session import local_session  # noqa: E402
from shelfwise.sources.schemas import RAW_COLUMNS, text_schema  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def raw(spark):
    """Raw tables from short dicts; columns left out are NULL."""

    def make(table, rows):
        full = [tuple(r.get(c) for c in RAW_COLUMNS[table]) for r in rows]
        return spark.createDataFrame(full, text_schema(table))

    return make
