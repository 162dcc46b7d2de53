import pytest
from pyspark.sql import functions as F

from stayline.operators import cleaning
from stayline.session import new_path
from stayline.sources import files, tables
from stayline.sources.schemas import CAMPAIGN_COLUMNS, CUSTOMER_COLUMNS, text_schema


def test_last_row_per_key_wins(rows):
    df = rows(
        [("a", "old", 1), ("a", "new", 5), ("b", "only", 2), (None, "lost", 3)],
        "k string, v string, n long",
    )
    kept = cleaning.keep_last(df, "k", "n")
    assert {(r["k"], r["v"]) for r in kept.collect()} == {("a", "new"), ("b", "only")}
    assert "WindowGroupLimit" in kept._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "value, kind", [("12.5", "int"), ("12345678901234.5", "decimal(12,2)"), ("x", "double")]
)
def test_strict_cast_fails_on_malformed(rows, value, kind):
    with pytest.raises(Exception, match="malformed"):
        cleaning.strict_cast(rows([(value,)], "c string"), {"c": kind}).collect()


def test_strict_cast_ignores_session_mode(spark, rows):
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        with pytest.raises(Exception, match="malformed"):
            cleaning.strict_cast(rows([("12.5",)], "c string"), {"c": "int"}).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")


def test_decimals_round_half_away_from_zero(rows):
    typed = cleaning.strict_cast(
        rows([("1.005",), ("-1.005",), (None,)], "c string"), {"c": "decimal(12,2)"}
    )
    assert [None if r[0] is None else str(r[0]) for r in typed.collect()] == ["1.01", "-1.01", None]


def test_quarantine_keeps_every_row(rows):
    df = rows([("1", "2.5"), ("x", "2"), ("y", "z"), (None, "3")], "a string, b string")
    good, bad = cleaning.cast_or_quarantine(df, {"a": "int", "b": "double"})
    assert sorted(map(tuple, good.collect()), key=str) == [(1, 2.5), (None, 3.0)]
    assert sorted(r["malformed_columns"] for r in bad.collect()) == [["a"], ["a", "b"]]


def test_labels(rows):
    df = cleaning.add_churn_value(rows([("Yes",), ("no",), ("maybe",), (None,)], "churn_label string"))
    assert [r["churn_value"] for r in df.collect()] == [1, 0, None, None]
    assert df.schema["churn_value"].dataType.typeName() == "short"


def test_constraints(rows):
    good = rows([(1, 0), (2, 1), (3, None)], "k int, y int")
    checked = cleaning.enforce_constraints(good, "k", binary=["y"])
    assert sorted(checked.collect()) == sorted(good.collect())
    assert "LocalTableScan" not in checked._jdf.queryExecution().executedPlan().toString()  # it reads what was checked
    bad = rows([(1, 0), (1, 2), (None, 1)], "k int, y int")
    report = {r["rule"]: r["violations"] for r in cleaning.constraint_report(bad, "k", binary=["y"]).collect()}
    assert report == {"k not null": 1, "y in (0, 1)": 1, "k unique": 1}
    with pytest.raises(ValueError, match="Constraint violations"):
        cleaning.enforce_constraints(bad, "k", binary=["y"])


def customer_line(**known):
    return ",".join(known.get(c, "") for c in CUSTOMER_COLUMNS)


def test_customer_file_to_typed_table(spark, tmp_path):
    lines = [
        ",".join(CUSTOMER_COLUMNS),
        customer_line(customer_id=" c1 ", monthly_charge=" 10.005 ", churn_label="No"),
        customer_line(customer_id="c2", age="41", churn_label="YES", churn_reason='"a ""q"" b"'),
        customer_line(customer_id="c1", monthly_charge="20", churn_label="yes", city='"x, y"'),
        customer_line(customer_id="  ", churn_label="yes"),
    ]
    path = tmp_path / "customers.csv"
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    raw = files.read_customers_csv(spark, str(path))
    assert [r["load_order"] for r in raw.orderBy("load_order").collect()] == [1, 2, 3, 4]
    clean = {r["customer_id"]: r for r in cleaning.clean_customers(raw).collect()}
    assert set(clean) == {"c1", "c2"}
    assert str(clean["c1"]["monthly_charge"]) == "20.00" and clean["c1"]["city"] == "x, y"
    assert clean["c2"]["churn_reason"] == 'a "q" b' and clean["c2"]["churn_value"] == 1
    assert clean["c2"]["age"] == 41 and clean["c2"]["cltv"] is None


def test_numbers_follow_file_order(spark):
    path = new_path(spark, "numbered")
    spark.range(0, 1000, 1, 6).select(F.col("id").cast("string").alias("a")).write.option(
        "header", True
    ).csv(path)
    df = files._numbered(files.read_csv(spark, path, text_schema(["a"])), "n")
    found = df.select("n", F.col("a").cast("int").alias("a")).orderBy("n").collect()
    assert [r["n"] for r in found] == list(range(1, 1001))
    assert [r["a"] for r in found] == list(range(1000))


def test_campaign_file_keeps_gaps(spark, tmp_path):
    def line(y, t):
        return ",".join({"pc1": "1.5", "factor2": " b ", "y": y, "t": t}.get(c, "") for c in CAMPAIGN_COLUMNS)

    path = tmp_path / "campaign.csv"
    text = [",".join(CAMPAIGN_COLUMNS), line("1", "0"), line("2", "0"), line(" 0 ", "1"), line("", "1")]
    path.write_text("\n".join(text) + "\n")
    clean = cleaning.clean_campaign(files.read_campaign_csv(spark, str(path)))
    found = clean.select("campaign_row_id", "pc1", "factor2", "y", "t").orderBy("campaign_row_id").collect()
    assert [tuple(r) for r in found] == [(1, 1.5, "b", 1, 0), (3, 1.5, "b", 0, 1)]
    assert len(clean.columns) == 181


def test_results_are_replaced(spark, rows):
    path = new_path(spark, "sink")
    files.write_results({"kpi": rows([("a", 1)], "k string, v int")}, path)
    files.write_results({"kpi": rows([("b", 2)], "k string, v int")}, path)
    assert [tuple(r) for r in spark.read.option("header", True).csv(f"{path}/kpi").collect()] == [("b", "2")]


def test_loaders_check_schema(spark, rows):
    path = new_path(spark, "table")
    rows([("a", 1, 2.0)], "customer_id string, churn_value int, x double").write.parquet(path)
    assert tables.load_customers(spark, path).count() == 1
    assert tables.load_table(spark, path, columns=["x"]).columns == ["x"]
    with pytest.raises(ValueError, match=r"lacks the columns \['campaign_row_id', 't', 'y'\]"):
        tables.load_campaign(spark, path)
    empty = rows([], "customer_id string, churn_value int")
    with pytest.raises(ValueError, match="is empty"):
        tables.require_columns(empty, {"customer_id"}, "customers")


def test_jdbc_options_partition_the_read():
    plain = tables.JdbcSource("jdbc:postgresql://db/x").options("t")
    assert plain["dbtable"] == "public.t" and "numPartitions" not in plain
    split = tables.JdbcSource("u", partition_column="id", lower=0, upper=10, partitions=4).options("t")
    assert (split["partitionColumn"], split["numPartitions"]) == ("id", "4")


def test_row_numbers_survive_another_cut_of_the_files(spark, tmp_path):
    path = tmp_path / "long.csv"
    path.write_text("a\n" + "".join(f"{i}\n" for i in range(20_000)))
    size = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(size)
    try:
        spark.conf.set(size, "8k")
        numbered = files._numbered(files.read_csv(spark, str(path), text_schema(["a"])), "n")
        spark.conf.set(size, "64m")
        assert all(int(r["a"]) + 1 == r["n"] for r in numbered.collect())
        assert numbered.count() == 20_000
    finally:
        spark.conf.set(size, before)


def test_csv_keeps_spaces(spark, rows, tmp_path):
    values = [" a ", "\tb", "c,d", 'said "x"']
    files.write_result(rows([(v,) for v in values], "a string"), str(tmp_path / "out"), format="csv")
    back = files.read_csv(spark, str(tmp_path / "out"), text_schema(["a"])).collect()
    assert sorted(r["a"] for r in back) == sorted(values)
