"""CSV readers, file-order row numbers and result sinks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayline.session import stage
from stayline.sources.schemas import CAMPAIGN_COLUMNS, CUSTOMER_COLUMNS, text_schema

BROADCAST_SPLITS = 500_000


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    *,
    multi_line: bool = False,
) -> DataFrame:
    """Positional CSV with a header line; quotes are escaped by doubling.

    A row that does not fit the schema fails the job. ``multi_line`` allows line
    breaks inside quotes, at the price of one task per file. Without a schema names
    come from the header and types from one extra pass over the file.
    """
    reader = spark.read.option("inferSchema", True) if schema is None else spark.read.schema(schema)
    return (
        reader.option("header", True)
        .option("escape", '"')
        .option("encoding", "UTF-8")
        .option("mode", "FAILFAST")
        .option("multiLine", multi_line)
        .csv(path)
    )


def _numbered(df: DataFrame, name: str) -> DataFrame:
    """Add 1..N in file order (path, offset in the file, line).

    A file split lies in one task, so a row's place in its split is local; the
    splits' row counts give the offsets. Rows are not shuffled, but written once with
    their places: a later scan may cut the files at other points.
    """
    split = ["_path", "_start"]
    placed = stage(
        df.select(
            "*",
            F.col("_metadata.file_path").alias("_path"),
            F.col("_metadata.file_block_start").alias("_start"),
        ).withColumn("_place", F.monotonically_increasing_id()),
        "placed",
    )
    in_file_order = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    splits = (
        placed.groupBy(*split)
        .agg(F.count(F.lit(1)).alias("_rows"), F.min("_place").alias("_first"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(in_file_order), F.lit(0)))
        .drop("_rows")
    )
    splits = stage(splits, "splits")
    if splits.count() <= BROADCAST_SPLITS:
        splits = F.broadcast(splits)
    return (
        placed.join(splits, split)
        .withColumn(name, F.col("_place") - F.col("_first") + F.col("_before") + 1)
        .select(name, *df.columns)
    )


def read_customers_csv(spark: SparkSession, path: str, *, multi_line: bool = False) -> DataFrame:
    """Raw customer text plus ``load_order`` (later rows win in ``keep_last``)."""
    raw = read_csv(spark, path, text_schema(CUSTOMER_COLUMNS), multi_line=multi_line)
    return _numbered(raw, "load_order")


def read_campaign_csv(spark: SparkSession, path: str, *, multi_line: bool = False) -> DataFrame:
    """Raw campaign text plus ``campaign_row_id`` 1..N, given before any row is removed."""
    raw = read_csv(spark, path, text_schema(CAMPAIGN_COLUMNS), multi_line=multi_line)
    return _numbered(raw, "campaign_row_id")


def write_result(df: DataFrame, path: str, *, format: str = "parquet") -> None:
    """Replace the folder ``path``; ``format`` is parquet or csv (with header)."""
    writer = df.write.mode("overwrite")
    if format == "csv":
        writer = (
            writer.option("header", True)
            .option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
        )
    writer.format(format).save(path)


def write_results(results: Mapping[str, DataFrame], folder: str, *, format: str = "csv") -> None:
    """One sub-folder per named result."""
    for name, df in results.items():
        write_result(df, f"{folder}/{name}", format=format)


def publish_table(df: DataFrame, table: str, *, format: str = "parquet") -> None:
    """Re-runnable load: replace the catalog table by ``df``."""
    df.write.mode("overwrite").format(format).saveAsTable(table)
