"""Sizes of what Spark hands to Python at once, and names of helper columns."""

from pyspark.sql import DataFrame

BATCH_BYTES = "4m"
BATCH_ROWS = "1000"


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with its session set to batches that suit whole texts and token
    sets: two tasks of an executor then need little beside its heap."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return df


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that ``df`` does not have, whatever their case."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        name = f"__{name}"
        while name in taken:
            name += "_"
        found.append(name)
        taken.add(name)
    return found
