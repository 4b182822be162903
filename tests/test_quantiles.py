"""Exact quantiles from bounded slices."""

import random

import pytest
from pyspark.sql import functions as F

from rulefact.operators.aggregates import latency, quantiles

R = random.Random(7)
TABLES = {
    "spread": [R.gauss(0, 1e3) for _ in range(3000)],
    "ties": [float(R.randrange(4)) for _ in range(3000)],
    "one value": [2.5] * 900,
    "single": [7.0],
    "two": [1.0, 2.0],
    "heavy end": [0.0] * 1500 + [R.random() * 1e-9 for _ in range(900)] + [1e300],
    "nulls": [None, 3.0, None, 1.0, 2.0],
}


@pytest.mark.parametrize("name", TABLES)
@pytest.mark.parametrize("most", [40, 50_000])
def test_equal_percentile(spark, name, most):
    df = spark.createDataFrame([(x,) for x in TABLES[name]], "v double")
    shares = [0.0, 0.5, 0.95, 1.0]
    want = df.agg(F.percentile("v", F.array(*map(F.lit, shares)))).first()[0]
    assert quantiles(df, "v", shares, most) == pytest.approx(want, rel=1e-12)


def test_no_values(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert quantiles(df, "v", [0.5]) == [None]
    assert tuple(latency(df, "v").first()) == (None, None, None)
