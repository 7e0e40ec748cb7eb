from __future__ import annotations

import pytest

from graphloom.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", "tests", spark__sql__shuffle__partitions="4", spark__driver__memory="6g", spark__default__parallelism="4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows():
    """Sorted plain tuples of a DataFrame, nulls first."""

    def collect(df, *columns):
        df = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, str(x)) for x in r))

    return collect
