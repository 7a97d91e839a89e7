"""Reading texts and writing results."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of one or many UTF-8 files, each a document; all line ends become newlines."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.select("path", F.regexp_replace("value", "\r\n?", "\n").alias("text"))


def read_stdin(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("-", sys.stdin.read())], "path string, text string")


def report(df: DataFrame) -> DataFrame:
    """One JSON object a row, as column value."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def stats_line(out: Column | str, given: Column | str, what: str, original: Column | str, final: Column | str, budget: int) -> Column:
    return F.format_string(f"kept %d of %d {what} | %d -> %d tokens (budget {budget})", out, given, original, final)


def write_texts(df: DataFrame, path: str, text: str = "text") -> None:
    """Texts as they are, one part file a partition; a text that doesn't end with a newline gets one."""
    df.select(F.regexp_replace(text, "\n\\z", "").alias("value")).write.option("lineSep", "\n").text(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.json(path, ignoreNullFields=False)
