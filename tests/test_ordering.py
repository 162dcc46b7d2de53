import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from stayline.operators.ordering import global_rank, running_totals
from stayline.operators.quantiles import exact_median, exact_quantiles, sortable_score, top_cuts
from stayline.session import stage


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one score; a third of the rows one group."""
    df = spark.range(6000).select(
        "id",
        F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.round(F.rand(1), 3)).alias("s"),
        F.when(F.col("id") % 3 == 1, 0).otherwise(F.col("id") % 5).alias("g"),
    )
    return stage(df, "skewed")


def test_rank_equals_one_window(skewed):
    order = [F.desc("s"), F.asc("id")]
    expected = skewed.select("id", (F.row_number().over(Window.orderBy(*order)) - 1).alias("e"))
    ranked = global_rank(skewed.repartition(7), order)
    assert ranked.join(expected, "id").where("e <> rank").count() == 0
    assert ranked.count() == 6000


def test_running_totals_per_group(skewed):
    order = [F.desc("s"), F.asc("id")]
    w = Window.partitionBy("g").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    expected = skewed.select(
        "id", (F.row_number().over(w) - 1).alias("e"), F.sum("id").over(w).alias("total_e")
    )
    ranked = running_totals(skewed.repartition(5), order, {"total": F.col("id")}, by=["g"])
    joined = ranked.join(expected, "id")
    assert joined.count() == 6000
    assert joined.where("e <> rank or total_e <> total").count() == 0


def test_one_shuffle_of_rows(skewed):
    """Only per-partition offsets meet in one task; rows are range-partitioned."""
    plan = global_rank(skewed, [F.desc("s"), F.asc("id")])._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert text.count("SinglePartition") == 1
    below = text.split("SinglePartition")[1]
    assert "HashAggregate" in below.split("FileScan")[0]
    assert "SortMergeJoin" not in text and "CartesianProduct" not in text


@pytest.mark.parametrize("few", [200_000, 40])
def test_quantiles_equal_numpy(skewed, few):
    probs = [0, 0.01, 0.25, 0.5, 0.6, 0.9, 1]
    found = exact_quantiles(skewed, {"s": probs, "id": [0.5]}, few=few)
    data = skewed.toPandas()
    assert found["s"] == [float(v) for v in np.quantile(data.s, probs)]
    assert found["id"] == [float(np.median(data.id))]


def test_median_by_midpoint_and_empty(rows):
    assert exact_median(rows([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "x double"), "x") == 2.5
    assert exact_median(rows([(None,)], "x double"), "x") is None


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-3, 3).map(lambda v: v / 4), min_size=1, max_size=40))
def test_cuts_take_exactly_the_best_rows(spark, scores):
    data = list(enumerate(scores))
    df = spark.createDataFrame(data, "id int, s double")
    wanted = [0, 1, len(data) // 2, len(data)]
    score = sortable_score(F.col("s"))
    _, cuts = top_cuts(df, {"s": score}, "id", {"s": lambda n: wanted}, few=3)
    best = [i for i, _ in sorted(data, key=lambda r: (-r[1], r[0]))]
    for size, cut in zip(wanted, cuts["s"]):
        inside = {r["id"] for r in df.where(cut.contains(score, F.col("id"))).collect()}
        assert inside == set(best[:size])


def test_cuts_on_hot_ties_and_text_keys(spark):
    df = spark.range(5000).select(
        F.concat(F.lit("k"), F.lpad("id", 5, "0")).alias("key"),
        F.when(F.col("id") % 2 == 0, 1.0).otherwise(F.col("id") / 5000).alias("s"),
    )
    score = sortable_score(F.col("s"))
    _, cuts = top_cuts(df, {"s": score}, "key", {"s": lambda n: [700, 3000]}, few=50)
    assert cuts["s"][0].last_key == "k01398"
    assert [df.where(c.contains(score, F.col("key"))).count() for c in cuts["s"]] == [700, 3000]


def test_many_small_blocks(skewed, monkeypatch):
    from stayline.operators import ordering

    monkeypatch.setattr(ordering, "_BLOCK_BITS", 6)
    order = [F.desc("s"), F.asc("id")]
    w = Window.partitionBy("g").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    expected = skewed.select("id", F.sum("id").over(w).alias("total_e"))
    totals = running_totals(skewed, order, {"total": F.col("id")}, by=["g"])
    assert totals.join(expected, "id").where("total_e <> total").count() == 0


def test_many_quantiles_share_a_sketch(skewed):
    probs = [i / 100 for i in range(101)]
    found = exact_quantiles(skewed, {"s": probs}, few=30)["s"]
    assert found == [float(v) for v in np.quantile(skewed.toPandas().s, probs)]


def test_staged_tables_can_be_removed(spark):
    from pathlib import Path

    from stayline import session

    known = session._written.get(spark.sparkContext.applicationId, [])
    session._written[spark.sparkContext.applicationId] = []
    path = session.new_path(spark, "gone")
    spark.range(3).write.parquet(path)
    session.remove_staged(spark)
    assert not Path(path).exists()
    session._written[spark.sparkContext.applicationId] = known


def test_staged_columns_are_not_copied(skewed, monkeypatch):
    from stayline.operators import quantiles

    def refused(df, label):
        raise AssertionError("a copy of stored columns")

    monkeypatch.setattr(quantiles, "stage", refused)
    found = exact_quantiles(skewed, {"s": [0.5], "id": [0.5]}, few=30, staged=True)
    data = skewed.toPandas()
    assert found == {"s": [float(np.median(data.s))], "id": [float(np.median(data.id))]}


def test_thinned_sketches_and_many_edges(spark, monkeypatch):
    """Sketches thinned again and again, values without a finite one, signed zeros."""
    from stayline.operators import quantiles

    monkeypatch.setattr(quantiles, "CHUNK", 64)
    monkeypatch.setattr(quantiles, "SKETCH_POINTS", 16)
    draw = F.pmod(F.col("id") * 7919, F.lit(6007))
    odd = F.when(draw % 5 == 0, F.lit("NaN")).when(draw % 5 == 1, "-Infinity").when(draw % 5 == 2, "-0.0")
    df = spark.range(6000).repartition(3).select(
        draw.cast("double").alias("x"), odd.otherwise(draw.cast("string")).cast("double").alias("y"),
        F.lit(None).cast("double").alias("z"),
    )
    probs = [i / 40 for i in range(41)]
    found = exact_quantiles(df, {"x": probs, "y": probs, "z": probs}, few=5)
    data = df.toPandas()
    known = data.y[np.isfinite(data.y)]
    assert found["x"] == pytest.approx(np.quantile(data.x, probs))
    assert found["y"] == pytest.approx(np.quantile(known, probs))
    assert found["z"] == [None] * 41
