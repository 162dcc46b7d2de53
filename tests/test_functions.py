import math

import pytest
from pyspark.sql import functions as F

from stayline.functions import bands
from stayline.functions.hashing import hash_number, hash_uniform
from stayline.functions.numbers import edge_index, finite_or_null, two_sided_p, with_step
from stayline.functions.text import blank_to_null, normalised


def values(df, column):
    return [r[0] for r in df.select(column).collect()]


def test_tenure_bands_both_forms(rows):
    df = rows([(None,), (6.0,), (6.5,), (7.0,), (49.0,), (-3.0,)], "t double")
    loose = ["0-6 months", "7-12 months", "7-12 months", "49+ months", "0-6 months"]
    assert values(df, bands.tenure_band(F.col("t"))) == [None, *loose]
    assert values(df, bands.tenure_band(F.col("t"), null_band=True)) == ["49+ months", *loose]


def test_export_group_limits(rows):
    df = rows([(-1,), (0,), (12,), (13,), (48,), (49,), (999,), (1000,), (None,)], "t int")
    assert values(df, bands.export_tenure_group(F.col("t"))) == [
        None, "0-12", "0-12", "13-24", "25-48", "49+", "49+", None, None,
    ]


def test_risk_score_counts_unknown_as_zero(rows):
    df = rows(
        [
            ("Month-to-month", 5, "No", 90.0, "Electronic check"),
            (None, None, None, None, None),
            ("Two year", 11, "Yes", 85.0, "Mailed check"),
        ],
        "c string, t int, s string, m double, p string",
    )
    score = bands.risk_score(*[F.col(c) for c in "ctsmp"])
    assert values(df, score) == [8, 0, 3]
    assert values(df, bands.risk_segment(score)) == ["High", "Low", "Medium"]


def test_trim_strips_spaces_only(rows):
    df = rows([("   ",), ("\t a ",), (" x ",), (None,), ("",)], "c string")
    assert values(df, blank_to_null(F.col("c"))) == [None, "\t a", "x", None, None]
    assert values(df, normalised(F.col("c")))[:3] == ["", "a", "x"]


def test_undefined_numbers_become_null(rows):
    df = rows([(math.inf,), (-math.inf,), (math.nan,), (None,), (1.5,)], "x double")
    assert values(df, finite_or_null(F.col("x"))) == [None, None, None, None, 1.5]


def test_steps_count_edges_not_above(rows):
    df = rows([(0.0,), (1.0,), (1.5,), (2.0,), (9.0,)], "x double")
    assert values(df, edge_index(F.col("x"), [1.0, 2.0])) == [0, 1, 1, 2, 2]
    assert values(with_step(df, "x", [1.0, 2.0], "s"), F.col("s")) == [0, 1, 1, 2, 2]


def test_two_sided_tail(rows):
    df = rows([(0.0,), (1.959963984540054,), (-1.959963984540054,), (None,)], "z double")
    p = values(df, two_sided_p(F.col("z")))
    assert p[0] == 1.0 and p[3] is None
    assert p[1] == pytest.approx(0.05, abs=1e-12) and p[1] == p[2]


def test_hash_is_uniform_and_layout_free(spark):
    df = spark.range(20000).select(
        "id", hash_number(7, F.col("id")).alias("h"), hash_uniform(7, F.col("id")).alias("u")
    )
    again = spark.range(20000).repartition(13).select("id", hash_number(7, F.col("id")).alias("h2"))
    assert df.join(again, "id").where("h <> h2").count() == 0
    low, high, mean = df.agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 <= low < 0.01 and 0.99 < high < 1 and abs(mean - 0.5) < 0.01


def test_undefined_numbers_are_missing(rows):
    df = rows([(float("nan"), "Two year", "Yes")], "x double, c string, s string")
    row = df.select(
        bands.tenure_band(F.col("x")).alias("band"),
        bands.customer_segment(F.lit(20), F.col("x"), F.col("c"), F.col("s"), 50.0).alias("segment"),
    ).first()
    assert row["band"] is None and row["segment"] == "core_customers"
