"""Writers: tables for exchange with other programs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of the exchange table, in order.
WORKSHEET = ("document_type", "tariff_code", "category", "description", "quantity", "unit_cost", "total_cost", "computed_total", "variance", "invoice_total", "freight", "insurance", "tax", "discount", "packages", "supplier", "group_key")


def worksheet(groups: DataFrame) -> DataFrame:
    """``groups`` in the exchange table's columns; missing ones are null, variance is total minus quantity times cost."""
    out = groups
    if "computed_total" not in out.columns:
        out = out.withColumn("computed_total", (F.col("quantity") * F.col("unit_cost")).cast("decimal(18,2)"))
    if "variance" not in out.columns:
        out = out.withColumn("variance", (F.col("total_cost") - F.col("computed_total")).cast("decimal(18,2)"))
    return out.select(*[F.col(c) if c in out.columns else F.lit(None).cast("string").alias(c) for c in WORKSHEET])


def write_table(df: DataFrame, path: str, by: list[str] | None = None, rows_per_file: int = 1_000_000, mode: str = "error") -> None:
    """Parquet, in a folder for each value of ``by``; a frequent value is spread over several files of bounded size."""
    writer = df.write.option("maxRecordsPerFile", rows_per_file).mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.option("header", True).option("escape", '"').mode(mode).csv(path)


#: Folders that text files are dealt to, and a committer whose tasks move their own files: the driver would move one after another.
TEXT_FOLDERS, COMMITTER = 256, ("mapreduce.fileoutputcommitter.algorithm.version", "2")


def write_texts(df: DataFrame, path: str, text: str = "text", spread: bool = True, compression: str = "none") -> None:
    """A text file for each row, compressed by ``compression``. With ``spread`` in folders of about equally many, made by all tasks however few partitions ``df`` has, as opening files is
    most of the work; without it (for long texts, which have partitions enough) in one folder, by the tasks that have the rows."""
    rows = df.select(text)
    if not spread:
        return rows.write.option("maxRecordsPerFile", 1).option(*COMMITTER).text(path, compression=compression)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts).withColumn("folder", F.spark_partition_id() % TEXT_FOLDERS)
    dealt.write.option("maxRecordsPerFile", 1).option(*COMMITTER).partitionBy("folder").text(path, compression=compression)


def write_journal(df: DataFrame, path: str) -> None:
    """Appends rows as line-delimited JSON."""
    df.write.mode("append").json(path)


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Overwrites only the partitions that ``df`` has rows of: an upsert of whole shipments."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
