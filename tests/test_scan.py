"""Smoothings by a scan over blocks against the fold, and over many tasks for one series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.operators import recurrences, scan
from tidewheel.operators.layout import arrange


def plain(values, alpha):
    return recurrences.Smoother(alpha)(np.asarray(values, "float64"))


@pytest.mark.parametrize("alpha", [0.5, 2 / 51, 1e-5])
@pytest.mark.parametrize("rows", [1, 3, 7, 100])
def test_blocks_compose(alpha, rows):
    rng = np.random.default_rng(rows)
    values = rng.normal(100, 10, 230)
    values[rng.random(230) < 0.3] = np.nan
    values[:5] = values[60:95] = np.nan
    parts = [values[i: i + rows] for i in range(0, len(values), rows)]
    states, gaps = scan.composed(np.array([scan.summary(p, alpha) for p in parts]), alpha)
    got = np.concatenate([scan.seeded(p, alpha, s, g) for p, s, g in zip(parts, states, gaps, strict=True)])
    assert np.allclose(got, plain(values, alpha), rtol=1e-12, atol=0, equal_nan=True)
    assert np.isnan(scan.seeded(np.full(4, np.nan), alpha, float("nan"), 0.0)).all()


def _series(spark, rows, symbols):
    noise = (F.xxhash64("id", "symbol") % 1000) / 100
    frame = spark.range(rows).crossJoin(spark.createDataFrame([(s,) for s in symbols], "symbol string")).select(
        "symbol", F.timestamp_seconds(F.col("id") * 3600).alias("dt"), (100 + noise).alias("close"), (101 + noise).alias("high"), (99 + noise / 2).alias("low"),
        (50 + F.abs(F.xxhash64("id") % 77) / 7).alias("bench_close"))
    return frame.withColumn("close", F.when(F.hour("dt") != 5, F.col("close"))).repartition(3)


def test_scan_equals_the_fold(spark):
    frame = _series(spark, 1200, ["A", "B"]).union(_series(spark, 1, ["one"])).union(_series(spark, 130, ["C"]))
    blocks = scan.blocks(frame, rows=100, chunk_seconds=86_400)
    assert blocks.select("symbol", "block").distinct().count() == 27
    own = {(r.symbol, r.pos): r for r in recurrences.with_trend(arrange(frame)).collect()}
    turned = {(r.symbol, r.pos): r for r in recurrences.with_rotation(arrange(frame)).collect()}
    for got, want, names in ((scan.strength_index(blocks), own, ["rsi"]), (scan.true_range(blocks), own, ["atr", "ema55"]),
                             (scan.rotation(blocks), turned, ["ratio", "mom", "ema50"])):
        rows = got.collect()
        assert len(rows) == len(want)
        for r in rows:
            for name in names:
                a, b = r[name], want[r.symbol, r.pos][name]
                assert (a is None and (b is None or b != b)) or abs(a - b) <= 1e-9 * max(1.0, abs(b)), (r, name, b)


def test_one_long_series_is_many_tasks(spark):
    rows = 300_000
    frame = spark.range(rows).select(F.lit("A").alias("symbol"), F.timestamp_seconds(F.col("id") * 60).alias("dt"), (F.xxhash64("id") % 97).cast("double").alias("close"))
    blocks = scan.blocks(frame, rows=10_000, chunk_seconds=86_400)
    out = scan.smoothed(blocks, {"ema": ("close", 0.01)})
    held = out.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"))
    assert max(r.n for r in held.collect()) < rows  # no task has the whole series
    last = out.agg(F.max_by("ema", "pos")).first()[0]
    values = np.array([r.close for r in frame.orderBy("dt").collect()])
    assert abs(last - plain(values, 0.01)[-1]) < 1e-9


def test_nothing(spark):
    empty = _series(spark, 1, ["A"]).filter("false")
    assert scan.rotation(scan.blocks(empty)).count() == 0
