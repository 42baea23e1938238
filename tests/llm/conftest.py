from __future__ import annotations

import pytest

from moodwire.llm.common import prepare


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    prepare(spark)
