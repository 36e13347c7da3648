"""Beyond parity: follow a folder of logs with the same stateless filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions.query import compile_predicate, parse
from logweave.sources.lines import classify, strip_cr


def tail(spark: SparkSession, folder: str, query: str = "", max_files_per_trigger: int = 1000) -> DataFrame:
    """Streaming DataFrame of matching lines of new files: ``file, value, entry``."""
    lines = spark.readStream.option("lineSep", "\n").option("maxFilesPerTrigger", max_files_per_trigger).text(folder)
    lines = lines.select(F.col("_metadata.file_name").alias("file"), strip_cr(F.col("value")).alias("value"))
    return classify(lines).where(compile_predicate(parse(query)))
