"""Which batches of which streams a stored table consists of.

Every attempt of a batch writes folders of its own; the batch counts once its
entry is in the ledger, and readers see the folders of entries only.  So a retry
never overwrites anything, an attempt that failed leaves nothing to be seen, and
a stream whose checkpoint was cleared adds to what is there as a new writer.
"""

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clearsift.functions.scale import hinted
from clearsift.sources import files

ENTRY = "writer string, batch long, attempt string, fingerprint string"
_WAYS = ["writer", "batch", "attempt"]


class Fenced(Exception):
    """A batch the ledger may not take; nothing of it is visible."""


class Ledger:
    """The ledger under ``root``, held by the stream that opened it last."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def take_over(self) -> int:
        """Start an epoch; streams that opened the ledger before are fenced."""
        while True:
            epoch = self._newest() + 1
            if files.claim(self.spark, f"{self.root}/ledger/epochs/{epoch}"):
                return epoch

    def _newest(self) -> int:
        found = files.names(self.spark, f"{self.root}/ledger/epochs")
        return max((int(n) for n in found if n.isdigit()), default=0)

    def _path(self, writer: str, batch: int) -> str:
        return f"{self.root}/ledger/batches/{writer}-{batch}.json"

    def find(self, writer: str, batch: int) -> dict | None:
        path = self._path(writer, batch)
        return json.loads(files.read(self.spark, path)) if files.exists(self.spark, path) else None

    def done(self, writer: str, batch: int, fingerprint: str) -> bool:
        """Has this batch been committed already?  A batch that follows none of
        its writer's, or that holds other lines than the one committed under its
        number, is refused: the checkpoint and the ledger do not belong together."""
        found = self.find(writer, batch)
        if found is not None and found["fingerprint"] != fingerprint:
            raise Fenced(f"batch {batch} of {writer} is committed with other lines")
        if found is None and batch > 0 and self.find(writer, batch - 1) is None:
            raise Fenced(f"batch {batch} of {writer} follows none in the ledger")
        return found is not None

    def commit(self, epoch: int, writer: str, batch: int, attempt: str, fingerprint: str) -> None:
        """Make an attempt's folders the batch.  Last step of a batch."""
        if self._newest() != epoch:
            raise Fenced(f"another stream has taken over {self.root}")
        entry = {"writer": writer, "batch": batch, "attempt": attempt, "fingerprint": fingerprint}
        if not files.put(self.spark, self._path(writer, batch), json.dumps(entry)):
            raise Fenced(f"batch {batch} of {writer} was committed meanwhile")

    def entries(self) -> DataFrame:
        folder = f"{self.root}/ledger/batches"
        if not files.names(self.spark, folder):
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).json(folder)

    def read(self, name: str, schema: str) -> DataFrame:
        """The rows of the committed batches of one of the tables."""
        try:
            rows = self.spark.read.schema(
                f"{schema}, writer string, batch long, attempt string"
            ).parquet(f"{self.root}/{name}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)
        # As many entries as folders listed in planning already.
        kept = hinted(self.entries().select(*_WAYS), len(files.names(self.spark, f"{self.root}/ledger/batches")))
        return rows.join(kept, _WAYS, "left_semi").drop(*_WAYS)


def writer_of(spark: SparkSession, checkpoint: str) -> str:
    """The id Spark keeps inside a checkpoint: a cleared one gets another."""
    return json.loads(files.read(spark, f"{checkpoint.rstrip('/')}/metadata"))["id"]


def attempt_folder(writer: str, batch: int) -> tuple[str, str]:
    attempt = uuid.uuid4().hex
    return attempt, f"writer={writer}/batch={batch}/attempt={attempt}"


def fingerprint(rows: DataFrame, *columns) -> str:
    """A digest of a batch's rows that does not depend on their order."""
    value = F.xxhash64(*columns)
    many, xor, mixed = rows.agg(
        F.count("*"), F.bit_xor(value), F.bit_xor(F.xxhash64(value, F.lit(1)))
    ).first()
    return f"{many}:{xor or 0}:{mixed or 0}"
