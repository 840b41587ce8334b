from __future__ import annotations

import pytest

from tallyferry.llm.store import importable


@pytest.fixture(scope="session", autouse=True)
def workers(spark):
    """Python workers find the package in whatever folder the tests are started."""
    importable(spark)
