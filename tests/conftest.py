import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from usetrail.session import build

    session = build("local[4]", partitions=4, memory="6g", shared=str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture(params=["whole", "cut"])
def cutting(request, spark):
    """Run a test with small ranges put together, and with every range a chunk of its own."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, str(request.param == "whole").lower())
    yield request.param
    spark.conf.unset(name)
