import math

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from binweave.functions.quantize import Scale, bin_of, bin_value, bits_for, fraction_bin, half_up, least_value, number, quantize, text, value_of


@pytest.mark.parametrize(("bins", "bits"), [(None, 12), (0, 12), (1, 1), (2, 1), (3, 2), (300, 9), (4096, 12), (10**6, 16)])
def test_bits(bins, bits):
    assert bits_for(bins) == bits


def test_golden_bins():
    assert [bin_of(v, Scale(1, 4, 4)) for v in (1, 2, 3, 4)] == [0, 5, 10, 15]
    assert [bin_of(v, Scale(0, 4, 4)) for v in range(5)] == [0, 4, 8, 11, 15]
    assert [bin_of(v, Scale(1, 7, 4)) for v in (5, 1, 3, 7, 2)] == [10, 0, 5, 15, 3]
    assert [bin_of(v, Scale(10, 120, 3)) for v in (10, 20, 50, 90, 120)] == [0, 1, 3, 5, 7]
    assert [bin_of(v, Scale(1200, 18000, 3)) for v in (1200, 1800, 5400, 9600, 18000)] == [0, 0, 2, 4, 7]
    assert [bin_of(v, Scale(10, 50, 8)) for v in (10, 20, 30, 40, 50)] == [0, 64, 128, 191, 255]
    assert [bin_of(h, Scale(0, 23, 10)) for h in range(10)] == [0, 44, 89, 133, 178, 222, 267, 311, 356, 400]
    assert bin_of(1000, Scale(0, 1024, 10)) == 999
    assert (bin_of(5, Scale(0, 4096, 12)), bin_of(9000, Scale(0, 4096, 12)), bin_of(-3, Scale(0, 4096, 12))) == (5, 4095, 0)


def test_spark_agrees_with_python(spark):
    scale = Scale(-2.5, 17.3, 9)
    values = [None, math.nan, math.inf, -math.inf, -9.0, -2.5, 0.0, 0.49999999999999994, 3.3, 17.3, 99.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r[0] for r in df.orderBy("i").select(quantize(F.col("v"), scale)).collect()]
    assert got == [bin_of(v, scale) for v in values]
    assert got[:4] == [0, 0, 0, 0]


def test_half_up(spark):
    values = [0.0, 0.49999999999999994, 0.5, 1.5, 2.5, 3.4999]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(half_up(F.col("v"))).collect()] == [0, 0, 1, 2, 3, 3]


@given(st.floats(-1e6, 1e6), st.floats(1e-3, 1e6), st.integers(1, 16), st.floats(0, 1))
def test_bin_value_stays_in_its_bin(low, width, bits, at):
    scale = Scale(low, low + width, bits)
    b = bin_of(low + at * width, scale)
    assert 0 <= b < scale.bins
    if width > 1e-6 * abs(low):
        assert bin_of(value_of(b, scale), scale) == b


def test_bin_value_column(spark):
    scale = Scale(10, 20, 4)
    got = [r[0] for r in spark.range(16).select(bin_value(F.col("id"), scale)).collect()]
    assert got == [value_of(b, scale) for b in range(16)]


def test_fraction_and_coercion():
    assert [fraction_bin(f, 12) for f in (-1, 0, 0.5, 1, 2)] == [0, 0, 2048, 4095, 4095]
    assert [number(x) for x in (None, "", " 12 ", True, "0x10", "1e3", "-Infinity")] == [0, 0, 12, 1, 16, 1000, -math.inf]
    assert all(math.isnan(number(x)) for x in ("abc", "nan", "inf", "1_0", [], {}))
    assert [text(x) for x in (None, True, 3.0, 2.5, "x")] == ["null", "true", "3", "2.5", "x"]


@given(st.floats(-1e6, 1e6), st.floats(1e-3, 1e6), st.integers(1, 16), st.floats(0, 1))
def test_least_value(low, width, bits, at):
    scale = Scale(low, low + width, bits)
    b = 1 + int(at * (scale.top - 1))
    v = least_value(b, scale)
    assert bin_of(v, scale) >= b
    assert v <= scale.low or bin_of(math.nextafter(v, -math.inf), scale) < b
