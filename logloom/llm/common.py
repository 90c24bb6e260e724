"""What the operators share: staged tables, clear column names, words."""

from __future__ import annotations

import atexit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.sources.events import scratch_folder

# A word is a run of anything but the six ASCII white-space characters.
BETWEEN_WORDS = r"[\x20\x09-\x0D]+"

#: Whether shuffle files go at the end of the query that made them.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_left: list[str] = []


def staged(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read back: later steps survive lost executors and don't repeat it."""
    return staged_at(df)[0]


def staged_at(df: DataFrame, release: bool = False) -> tuple[DataFrame, str]:
    """`staged`, and the folder that it wrote, for `drop_folder`. To `release` is to let go of the shuffle files of the writing when it is done.

    Spark keeps those files until the driver happens to collect its garbage. The session's setting is put back after the writing;
    a query that is started meanwhile loses its files when it ends, and would make them again if it needed them.
    """
    spark = df.sparkSession
    folder = scratch_folder(spark)
    if not _left:
        atexit.register(_remove, spark)
    _left.append(folder)
    before = spark.conf.get(RELEASE, None)
    if release:
        spark.conf.set(RELEASE, "true")
    try:
        df.write.parquet(folder)
    finally:
        if release:
            spark.conf.unset(RELEASE) if before is None else spark.conf.set(RELEASE, before)
    return spark.read.schema(df.schema).parquet(folder), folder


def _remove(spark: SparkSession) -> None:
    """Folders that `staged` made go with the session."""
    try:
        context = spark._jsc
        for folder in _left:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has already ended
        pass


def columns_of(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns, whatever else the table carries; a repeated name counts by its first column."""
    kept, chosen = {}, []
    for at, name in enumerate(df.columns):
        kept.setdefault(name.lower(), at)
    missing = [n for n in names if n.lower() not in kept]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} in {df.columns}")
    if len({c.lower() for c in df.columns}) < len(df.columns):
        df = df.toDF(*[f"_{at}" for at in range(len(df.columns))])
        chosen = [F.col(f"_{kept[n.lower()]}").alias(n) for n in names]
    else:
        chosen = [F.col(f"`{n.replace('`', '``')}`").alias(n) for n in names]
    return df.select(*chosen)


def null_safe_join(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
    """Inner join on columns of the same names, in which NULL equals NULL."""
    renamed = right.withColumnsRenamed({n: f"its {n}" for n in names})
    same = [F.col(n).eqNullSafe(F.col(f"its {n}")) for n in names]
    return left.join(renamed, same).drop(*[f"its {n}" for n in names])


def words(text: Column) -> Column:
    """The words of a text in order; none for NULL."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BETWEEN_WORDS, -1), lambda w: w != "")


def n_words(text: Column) -> Column:
    """How many words a text has, as a long."""
    text = F.coalesce(text, F.lit(""))
    edges = text.rlike(r"^[\x20\x09-\x0D]").cast("int") + text.rlike(r"[\x20\x09-\x0D]\z").cast("int")
    inner = F.size(F.split(text, BETWEEN_WORDS, -1)) - edges
    blank = ~text.rlike(r"[^\x20\x09-\x0D]")
    return F.when(blank, 0).otherwise(inner).cast("long")
