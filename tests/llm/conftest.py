import os

import pytest


@pytest.fixture(scope="session", autouse=True)
def own_modules(spark):
    """Python workers find this folder's modules, too."""
    env = spark.sparkContext.environment
    env["PYTHONPATH"] = os.path.dirname(__file__) + ":" + env.get("PYTHONPATH", "")
