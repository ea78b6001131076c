import pytest

from ruleloom.llm.common import release


@pytest.fixture(autouse=True)
def _released(spark):
    yield
    release(spark)
