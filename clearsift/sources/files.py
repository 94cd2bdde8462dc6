"""Small marker files in the store that holds the tables, by Hadoop's own API.

They make a claim or a commit: a file is there whole or not at all, and a name
can be taken once.  What a store guarantees for renaming and for creating
without overwriting holds here too.
"""

import uuid

from pyspark.sql import SparkSession


def _store(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    store, where = _store(spark, path)
    return store.exists(where)


def local_folder(spark: SparkSession, path: str) -> str | None:
    """The folder ``path``, made where it is not there, as tasks can open it: None
    if it does not lie in a file system that they mount."""
    store, where = _store(spark, path)
    if store.getUri().getScheme() != "file":
        return None
    store.mkdirs(where)
    return where.toUri().getPath()


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    store, where = _store(spark, folder)
    if not store.exists(where):
        return []
    return [f.getPath().getName() for f in store.listStatus(where)]


def read(spark: SparkSession, path: str) -> str:
    store, where = _store(spark, path)
    stream = store.open(where)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def claim(spark: SparkSession, path: str) -> bool:
    """Create an empty file; false if the name is taken."""
    store, where = _store(spark, path)
    store.mkdirs(where.getParent())
    return store.createNewFile(where)


def put(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file that appears whole; false if the name is taken."""
    store, where = _store(spark, path)
    if store.exists(where):
        return False
    store.mkdirs(where.getParent())
    _, part = _store(spark, f"{where.getParent()}/.{uuid.uuid4().hex}")
    stream = store.create(part, False)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    return store.rename(part, where)


def remove(spark: SparkSession, path: str) -> None:
    store, where = _store(spark, path)
    store.delete(where, True)
