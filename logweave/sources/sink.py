"""All-or-nothing ordered single-file sink and its guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from logweave.plans.materialize import fresh_folder, remove
from logweave.sources.files import canonical, concatenate


def write_lines(df: DataFrame, output: str) -> int:
    """Writes the first column, in the frame's order, as one file; returns the number of lines.

    Executors write their ranges to the shared folder; the driver joins the parts as bytes, beside the output, and renames the
    whole over it. On any failure the output stays as it was.
    """
    spark, folder, seen = df.sparkSession, fresh_folder(df.sparkSession, "lines"), Observation()
    try:
        df.select(F.col(df.columns[0]).alias("value")).observe(seen, F.count("*").alias("n")).write.option("lineSep", "\n").text(folder)
        concatenate(spark, folder, output)
    finally:
        remove(folder)
    return seen.get["n"]


def output_collides(spark: SparkSession, inputs: list[str], output: str) -> str | None:
    return next((p for p in inputs if p == output or canonical(spark, p) == canonical(spark, output)), None)
