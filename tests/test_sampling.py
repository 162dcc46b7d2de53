import math

import pytest
from pyspark.sql import functions as F

from stayline.operators.sampling import assign_folds, hash_sample, stratified_split


def frame(spark, partitions):
    return spark.range(0, 3001, 1, partitions).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"))


def test_split_is_exact_disjoint_and_layout_free(spark):
    one = stratified_split(frame(spark, 2), "id", F.col("y"), 0.25, 42)
    two = stratified_split(frame(spark, 9).repartition(5), "id", F.col("y"), 0.25, 42)
    train, test = ({r["id"] for r in df.collect()} for df in one)
    assert test == {r["id"] for r in two[1].collect()}
    assert not train & test and len(train | test) == 3001
    sizes = {r["y"]: r["count"] for r in one[1].groupBy("y").count().collect()}
    assert sizes == {1: math.ceil(301 * 0.25), 0: math.ceil(2700 * 0.25)}
    other_seed = stratified_split(frame(spark, 2), "id", F.col("y"), 0.25, 43)[1]
    assert {r["id"] for r in other_seed.collect()} != test


def test_split_moves_no_rows(spark):
    train, test = stratified_split(frame(spark, 2), "id", F.col("y"), 0.25, 42)
    for part in (train, test):
        assert "Exchange" not in part._jdf.queryExecution().executedPlan().toString()


def test_folds_are_even_in_each_stratum(spark):
    folded = assign_folds(frame(spark, 4), "id", F.col("y"), 5, 42)
    sizes = folded.groupBy("y", "fold").count().collect()
    assert {r["fold"] for r in sizes} == {0, 1, 2, 3, 4}
    assert {r["count"] for r in sizes if r["y"] == 1} == {60, 61}
    assert {r["count"] for r in sizes if r["y"] == 0} == {540}


def test_rows_without_stratum_are_left_out(rows):
    df = rows([(i, None if i % 4 == 0 else i % 2) for i in range(40)], "id int, y int")
    train, test = stratified_split(df, "id", F.col("y"), 0.5)
    assert train.count() + test.count() == 30


def test_sample_is_the_same_under_any_layout(spark):
    a = hash_sample(frame(spark, 3), "id", 50)
    b = hash_sample(frame(spark, 8), "id", 50)
    assert {r["id"] for r in a.collect()} == {r["id"] for r in b.collect()} and a.count() == 50


def test_sample_larger_than_the_table_is_the_table(spark):
    assert hash_sample(frame(spark, 5), "id", 5000).count() == 3001


def test_rows_without_key_are_refused(rows):
    df = rows([(1, 0), (None, 1)], "id long, y int")
    for place in (
        lambda: hash_sample(df, "id", 1),
        lambda: stratified_split(df, "id", F.col("y"), 0.5),
        lambda: assign_folds(df, "id", F.col("y"), 2),
    ):
        with pytest.raises(ValueError, match="must not be NULL"):
            place()
