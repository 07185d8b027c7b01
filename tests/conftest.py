import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from chainlens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "6g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session


@pytest.fixture(scope="session")
def ar1(spark):
    """AR(1) chain with known autocorrelation, without gaps."""
    import numpy as np
    rng = np.random.default_rng(5)
    n, phi = 6001, 0.8
    x = np.zeros(n)
    for i in range(1, n):
        x[i] = phi * x[i - 1] + rng.standard_normal()
    y = rng.normal(3.0, 2.0, n)
    rows = [(0, i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    chain = spark.createDataFrame(rows, "chain_id int, step long, x double, y double").repartition(7).cache()
    return chain, x, y
