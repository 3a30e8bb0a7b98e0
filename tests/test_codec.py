import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import codec
from tidemark.sources import generators


def same(a, b):
    return np.array_equal(np.asarray(a, dtype=np.float64).view(np.int64), np.asarray(b, dtype=np.float64).view(np.int64))


def round_trip(t, v):
    data = codec.encode(np.array(t, dtype=np.int64), np.array(v, dtype=np.float64))
    back_t, back_v = codec.decode(data, len(t))
    assert back_t.tolist() == list(t) and same(back_v, v)
    return data


def test_round_trips():
    odd = [0.0, -0.0, 1e300, -1e-300, 1.7976931348623157e308, 5e-324, math.nan, math.inf, -math.inf]
    round_trip(range(len(odd)), odd)
    round_trip([2**40], [1.5])
    round_trip([0, 2**40, 2**33, -5, -(2**62)], [1, 2, 2, 3, 3])
    rng = random.Random(1)
    for _ in range(30):
        n, t = rng.randint(1, 80), 0
        ts = [t := t + rng.choice([1, 1, 1, 60, -3, 10**6, 2**35]) for _ in range(n)]
        round_trip(ts, [rng.choice([1.0, 2.5, rng.random(), rng.uniform(-1e9, 1e9)]) for _ in range(n)])
    data = round_trip([0, 10, 20], [1, 2, 3])
    with pytest.raises(EOFError):
        codec.decode(data[:-4], 3)


@pytest.mark.parametrize(("dod", "extra"), [(100, 10), (-100, 10), (150, 14), (2000, 14), (3000, 35), (2 * 10**9, 35), (3 * 10**9, 67), (2**40, 67)])
def test_timestamp_costs(spark, dod, extra):
    base = spark.createDataFrame([(1, t, i) for i, t in enumerate([0, 10, 20, 30 + dod])], "k long, t long, seq long")
    assert codec.timestamp_bits(base, ["k"]).first().ts_bits == 64 + 11 + 1 + 1 + extra
    bits = 8 * len(codec.encode(np.array([0, 10, 20, 30 + dod]), np.ones(4)))
    assert 0 <= bits - (64 + 64 + 11 + 1 + 1 + extra + 3) < 8


def test_constant_series():
    data = codec.encode(np.arange(101) * 10, np.ones(101))
    assert 0 <= 8 * len(data) - (128 + 12 + 198) < 8


@pytest.mark.parametrize(("kind", "most"), [("steps", 3.0), ("drift", 12.0), ("noise", 11.0)])
def test_blocks(spark, kind, most):
    rows = generators.shape(spark, kind, 20_000).withColumn("series", F.lit("s")).withColumn("block_base", F.lit(0).cast("long"))
    encoded = codec.blocks(rows).cache()
    assert sorted(r["count"] for r in encoded.collect()) == [3616, 8192, 8192]
    assert codec.report(encoded).first().bytes_per_sample <= most
    back = codec.samples_of(encoded).select("t", "v")
    assert back.exceptAll(rows.select("t", "v")).count() == 0 and back.count() == 20_000
    encoded.unpersist()
