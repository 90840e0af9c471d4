from __future__ import annotations

import pytest

from tests.session import session


@pytest.fixture(scope="session")
def spark():
    return session()


def rows(df, *order):
    """All rows as tuples, in the order of the named columns."""
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
