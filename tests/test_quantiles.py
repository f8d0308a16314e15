"""Radix selection against sorted lists."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from vellumspark.operators import quantiles


@pytest.mark.parametrize("buckets, few", [(1024, 4096), (16, 3), (2, 1)])
def test_ranks_equal_sorted_lists(spark, monkeypatch, buckets, few):
    monkeypatch.setattr(quantiles, "BUCKETS", buckets)
    monkeypatch.setattr(quantiles, "FEW", few)
    rng = random.Random(buckets)
    groups = {
        "uniform": [rng.random() * 1000 for _ in range(300)], "heavy": [10 ** rng.uniform(-3, 12) for _ in range(200)], "same": [7.0] * 50, "one": [3.5], "nine": [float(k) for k in range(9)],
        "ten": [float(k * k) for k in range(10)], "signs": [rng.choice([-1e9, -1.0, 0.0, 2.0, 5e-7]) for _ in range(111)], None: [1.0, 2.0, 4.0],
    }
    rows = [(g, v) for g, values in groups.items() for v in values] + [("uniform", None), ("none", None)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in quantiles.spreads(frame, ["g"], "v").collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        p90 = statistics.quantiles(values, n=10)[8] if len(values) >= 10 else max(values)
        assert got[g].median == pytest.approx(statistics.median(values), rel=1e-12) and got[g].p90 == pytest.approx(p90, rel=1e-12), g
    ranks = quantiles.at_ranks(quantiles.counted(frame, ["g"], "v"), ["g"], {"first": F.lit(1), "third": F.least(F.lit(3), F.col("n")), "last": F.col("n")})
    for r in ranks.collect():
        values = sorted(groups[r.g])
        assert (r.n, r.first, r.third, r["last"]) == (len(values), values[0], values[min(3, len(values)) - 1], values[-1])
    late = {r.g: (r.a, r.b) for r in quantiles.latencies(frame, ["g"], "v", {"a": 50, "b": 95}).collect()}
    at = lambda g, p: sorted(groups[g])[max(1, int(len(groups[g]) * p / 100)) - 1]
    assert late == {g: (pytest.approx(at(g, 50), abs=0.06), pytest.approx(at(g, 95), abs=0.06)) for g in groups}


def test_many_distinct_values_of_one_group(spark):
    """No step holds a group's values: 300,000 distinct ones narrow to the wanted ranks by histograms."""
    n = 300_000
    rows = spark.range(n).select(F.lit("all").alias("g"), ((F.col("id") * 7919) % n + 1).cast("double").alias("v"))
    r = quantiles.spreads(rows, ["g"], "v").head()
    assert (r.median, r.p90) == ((n + 1) / 2, 0.9 * (n + 1))
