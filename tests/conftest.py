import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from bookmark_lake.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("8")


@pytest.fixture(scope="session")
def one(spark):
    """Value of a column expression over one row of named values."""

    def value(column, **values):
        schema = ", ".join(f"{n} string" for n in values) or "x string"
        row = tuple(values.values()) or (None,)
        return spark.createDataFrame([row], schema).select(column.alias("v")).first()["v"]

    return value


@pytest.fixture(scope="session")
def each(spark):
    """Values of a column expression over rows of one string column ``a``."""

    def values(column, raw):
        rows = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, a string")
        return [r["v"] for r in rows.select("i", column.alias("v")).orderBy("i").collect()]

    return values
