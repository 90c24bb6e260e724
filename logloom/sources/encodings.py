"""One encoding for each file, by what all of its lines say.

A short windows-1251 line may happen to be valid UTF-8; its file is not. Every line gives its evidence, how many of its characters beyond ASCII are
there and how many of them are broken as UTF-8. It adds up over the splits of a file, and the file's sum decides as a line would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions import text

# The name of the rule, beside those that decide line by line or for all lines.
BY_FILE = "file"


def encoding_evidence(lines: DataFrame) -> DataFrame:
    """`file_path`, `wide` (characters beyond ASCII, each broken byte being one) and `broken` (those that are no UTF-8); files in plain ASCII have no row."""
    beyond = lines.where(F.col("value").rlike(r"[^\x00-\x7F]") | ~F.is_valid_utf8("value"))
    wide, broken = text.utf8_evidence(F.col("value"))
    return beyond.groupBy("file_path").agg(F.sum(wide).alias("wide"), F.sum(broken).alias("broken"))


def file_votes(lines: DataFrame) -> DataFrame:
    """`file_path` and `cp1251`, whether the file is in windows-1251; other files are UTF-8, broken in places or not."""
    return encoding_evidence(lines).select("file_path", text.is_cp1251(F.col("wide"), F.col("broken")).alias("cp1251"))


def with_votes(df: DataFrame, votes: DataFrame) -> DataFrame:
    """`df`, which has `file_path`, with `__cp1251`. Only files in windows-1251 are looked up; `votes` is small enough to be sent along if Spark finds it so."""
    chosen = votes.where("cp1251").select(F.col("file_path").alias("__voted"), F.col("cp1251").alias("__cp1251"))
    return df.join(chosen, F.col("file_path") == F.col("__voted"), "left").drop("__voted").withColumn("__cp1251", F.coalesce("__cp1251", F.lit(False)))
