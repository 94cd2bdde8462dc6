"""Small helpers that keep plans safe when data grows: sized broadcasts,
balanced small inputs, lineage cuts and two-stage top-k."""

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from clearsift.sources import files

SMALL_ROWS = 200_000
SMALL_BYTES = 64 << 20


def collected(df: DataFrame, max_rows: int = SMALL_ROWS):
    """``df`` as an Arrow table if it has at most ``max_rows`` rows of
    SMALL_BYTES together, else None; one job that hands over no more rows."""
    table = df.limit(max_rows + 1).toArrow()
    return table if table.num_rows <= max_rows and table.nbytes <= SMALL_BYTES else None


def broadcast_if_small(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """A small ``df`` as a local table with a broadcast hint; beyond the bounds
    it is left as it is, the join shuffles and adaptive execution splits skewed
    partitions."""
    table = collected(df, max_rows)
    return df if table is None else F.broadcast(local(df.sparkSession, table, df.schema))


def local(spark: SparkSession, table, schema) -> DataFrame:
    """An Arrow table on the driver as rows of a plan."""
    return spark.createDataFrame(table, schema) if table.num_rows else spark.createDataFrame([], schema)


def hinted(df: DataFrame, rows: int | None) -> DataFrame:
    """Broadcast hint for a result whose row bound is known beforehand."""
    return F.broadcast(df) if rows is not None and rows <= SMALL_ROWS else df


def settle(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """Compute a costly result once, then broadcast it if it is small.  Its rows
    and bytes are observed while it is written."""
    seen = Observation()
    size = F.sum(F.octet_length(F.to_json(F.struct("*"))))
    kept = cut(df.observe(seen, F.count(F.lit(1)).alias("rows"), size.alias("size")))
    small = seen.get["rows"] <= max_rows and (seen.get["size"] or 0) <= SMALL_BYTES
    return F.broadcast(kept) if small else kept


def spread(df: DataFrame, *keys) -> DataFrame:
    """Balance a small input over the cores.

    Inputs already larger than one scan split per core are left as they are,
    so nothing is shuffled when the scan alone gives enough parallelism.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    plan = getattr(df, "_jdf", None)  # remote sessions do not tell the size
    if plan is None:
        return df
    size = plan.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(str(size)) > cores * split:
        return df
    return df.repartition(cores, *keys)


def _bytes(text: str) -> int:
    text = text.strip().lower().removesuffix("b")
    for unit, power in (("k", 10), ("m", 20), ("g", 30)):
        if text.endswith(unit):
            return int(text[:-1]) << power
    return int(text)


def with_fields(df: DataFrame, *fields) -> DataFrame:
    """Add costly columns that are computed once per row, where they stand.

    As plain columns they would be computed again in every filter that uses
    them, and such filters could move below a repartition meant to spread the
    work.  Rows pass through a one-element generator, which stops both.
    """
    return df.select("*", F.inline_outer(F.array(F.struct(*fields))))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    fallback = tempfile.mkdtemp(prefix="clearsift-")
    spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once, so later steps read it back
    instead of computing it again, also after losing executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def discard(df: DataFrame) -> None:
    """Remove what ``cut`` wrote, when nothing reads ``df`` any more."""
    if getattr(df, "_jdf", None) is None:
        return
    plan = df._jdf.queryExecution().analyzed()
    if plan.nodeName() == "LogicalRDD" and plan.rdd().getCheckpointFile().isDefined():
        files.remove(df.sparkSession, plan.rdd().getCheckpointFile().get())


def top_k(df: DataFrame, keys, order, k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group with their 1-based ``rank``.

    Every input partition first keeps only its own ``k`` rows per group.  On
    clusters with many partitions a salted round merges those before the final
    one, so a group holding most of the rows still ends in a small last task.
    """
    keys = list(keys)
    salts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 64
    if salts > 1:
        salted = Window.partitionBy(*keys, "__salt").orderBy(*order)
        df = (
            df.withColumn("__salt", F.spark_partition_id() % F.lit(salts))
            .withColumn(rank, F.row_number().over(salted))
            .where(F.col(rank) <= k)
            .drop("__salt", rank)
        )
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)
