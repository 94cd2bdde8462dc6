"""The inverted table as files that a search opens by need."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clearsift.functions.scale import cut


class InvertedTable:
    """Postings in order of lexeme and chunk, and a dictionary beside them that
    says which files hold a lexeme.  A frequent lexeme may fill several files, as
    files are cut by lexeme and chunk together."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.dictionary = spark.read.parquet(f"{path}/dictionary")
        self.schema = spark.read.parquet(f"{path}/postings").schema

    def read(self, files) -> DataFrame:
        """The postings in these files only; no other is opened."""
        paths = [f"{self.path}/postings/{name}" for name in sorted(files)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/postings")


def write_inverted(posting: DataFrame, path: str, files: int | None = None) -> InvertedTable:
    """Store postings (chunk_id, lexeme, weight, ...) under ``path``, which must
    not exist, in about ``files`` files; readers find them by their dictionary."""
    spark = posting.sparkSession
    held = cut(posting)  # choosing the cuts reads it once more
    keys = ["lexeme", "chunk_id"]
    ranged = held.repartitionByRange(files, *keys) if files else held.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys).write.mode("errorifexists").parquet(f"{path}/postings")
    stored = spark.read.parquet(f"{path}/postings")
    counted = (
        stored.select("lexeme", F.col("_metadata.file_name").alias("file"))
        .groupBy("lexeme", "file")
        .agg(F.count("*").alias("n"))
    )
    counted.write.mode("errorifexists").parquet(f"{path}/dictionary")
    return InvertedTable(spark, path)
