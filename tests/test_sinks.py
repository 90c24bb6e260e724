"""Tables that are replaced only when the new one is complete."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from logloom.sinks import FORMATS, _Place, read_table, write_table

TEXTS = ["plain", "two\nlines", 'say "hi", you', "  spaced  ", "", None, "back\\slash", "'single'", "ends with \"", "a,b;c\td", "日本 😀", "#no comment", "null"]


@pytest.fixture
def table(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "n int, t string")


@pytest.mark.parametrize("fmt", FORMATS)
def test_round_trip(spark, table, tmp_path, fmt):
    path = write_table(table, str(tmp_path / "t"), fmt)
    want = [(n, None if fmt == "csv" and t == "" else t) for n, t in table.collect()]
    assert sorted(map(tuple, read_table(spark, path, fmt, table.schema).collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("fmt", FORMATS)
def test_old_table_stays_if_the_job_fails(spark, table, tmp_path, fmt):
    path = write_table(table, str(tmp_path / "t"), fmt)
    breaks = table.repartition(4).withColumn("t", F.when(F.col("n") == 7, F.raise_error(F.lit("lost"))).otherwise(F.col("t")))
    with pytest.raises(Exception, match="lost"):
        write_table(breaks, path, fmt)
    assert read_table(spark, path, fmt, table.schema).count() == len(TEXTS)
    assert os.listdir(tmp_path) == ["t"]
    write_table(table.limit(2), path, fmt)
    assert read_table(spark, path, fmt, table.schema).count() == 2 and os.listdir(tmp_path) == ["t"]


def test_a_table_may_replace_what_it_is_made_from(spark, table, tmp_path):
    path = write_table(table, str(tmp_path / "t"), "parquet")
    write_table(read_table(spark, path, "parquet").where("n > 3"), path, "parquet")
    assert read_table(spark, path, "parquet").count() == len(TEXTS) - 4


def test_renames_that_fail(spark, table, tmp_path, monkeypatch):
    path = write_table(table, str(tmp_path / "t"), "parquet")
    real = _Place._move

    def fails(self, source, target):
        if source.endswith(".new"):
            raise OSError("no rename")
        real(self, source, target)

    with monkeypatch.context() as patch:
        patch.setattr(_Place, "_move", fails)
        with pytest.raises(OSError, match="no rename"):
            write_table(table.limit(1), path, "parquet")
    assert read_table(spark, path, "parquet").count() == len(TEXTS) and os.listdir(tmp_path) == ["t"]
    # a program that ended between the two renames
    os.rename(tmp_path / "t", tmp_path / "_t.old")
    breaks = table.withColumn("t", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        write_table(breaks, path, "parquet")
    assert read_table(spark, path, "parquet").count() == len(TEXTS) and os.listdir(tmp_path) == ["t"]


def test_other_modes(spark, table, tmp_path):
    path = write_table(table, str(tmp_path / "t"), "json")
    write_table(table, path, "json", mode="append")
    assert read_table(spark, path, "json", table.schema).count() == 2 * len(TEXTS)
    with pytest.raises(Exception, match="exists"):
        write_table(table, path, "json", mode="error")
    with pytest.raises(ValueError, match="format"):
        write_table(table, path, "xlsx")
