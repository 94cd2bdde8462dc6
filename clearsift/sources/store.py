"""Tables in buckets by document, published by a manifest that names files.

A version is one small file that says, for every table, where each bucket lies.
Publishing writes the buckets that changed and then the next manifest; all other
buckets stay where they are and are named again.  Readers take the newest
manifest, so they see the version before or the new one whole.  A manifest's
name can be taken once: of two publishers that started from one version the
second is refused, and no version is lost.
"""

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clearsift.sources import files

BUCKETS = 32


class Conflict(Exception):
    """Another version was published since the one that was read."""


class Store:
    """``keys`` names the column that decides a row's bucket, for each table."""

    def __init__(self, spark: SparkSession, root: str, keys: dict[str, str], buckets: int = BUCKETS):
        self.spark, self.root, self.keys = spark, root, keys
        found = self.manifest()
        self.buckets = found["buckets"] if found["number"] else buckets

    def manifest(self) -> dict:
        """The version published last; number 0 and no tables before the first."""
        names = files.names(self.spark, f"{self.root}/manifests")
        newest = max((int(n[:-5]) for n in names if n.endswith(".json") and n[0] != "."), default=0)
        if not newest:
            return {"number": 0, "tables": {}, "next_ids": {}}
        return json.loads(files.read(self.spark, f"{self.root}/manifests/{newest}.json"))

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def buckets_of(self, rows: DataFrame, column: str) -> list[int]:
        """The buckets of some keys; no more than there are."""
        found = rows.select(self.bucket(F.col(column)).alias("bucket")).distinct().collect()
        return sorted(r.bucket for r in found)

    def read(self, table: str, manifest: dict, buckets=None, schema: T.StructType | None = None) -> DataFrame:
        """A table, or some of its buckets; an unknown table is empty, by ``schema``."""
        known = manifest["tables"].get(table)
        if known is None:
            return self.spark.createDataFrame([], schema)
        schema = T.StructType.fromJson(known["schema"])
        wanted = known["folders"] if buckets is None else {str(b) for b in buckets}
        paths = [
            f"{self.root}/{table}/{folder}/bucket={bucket}"
            for bucket, folder in sorted(known["folders"].items())
            if bucket in wanted
        ]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def publish(
        self,
        manifest: dict,
        tables: dict[str, DataFrame],
        buckets: dict[str, list[int]] | None = None,
        next_ids: dict[str, int] | None = None,
    ) -> dict:
        """The version after ``manifest``: ``tables`` replace these ``buckets`` of
        theirs (all, where none are given) and hold rows of no others."""
        after = {
            "number": manifest["number"] + 1,
            "buckets": self.buckets,
            "tables": dict(manifest["tables"]),
            "next_ids": {**manifest["next_ids"], **(next_ids or {})},
        }
        for name, rows in tables.items():
            folder = uuid.uuid4().hex
            keyed = rows.withColumn("bucket", self.bucket(F.col(self.keys[name])))
            # Rebalancing splits a bucket that one document fills.
            keyed.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(
                f"{self.root}/{name}/{folder}"
            )
            held = manifest["tables"].get(name, {"folders": {}})["folders"]
            gone = set(held) if buckets is None else {str(b) for b in buckets[name]}
            kept = {b: f for b, f in held.items() if b not in gone}
            written = [n[7:] for n in files.names(self.spark, f"{self.root}/{name}/{folder}") if n.startswith("bucket=")]
            after["tables"][name] = {
                "schema": json.loads(rows.schema.json()),
                "folders": {**kept, **dict.fromkeys(written, folder)},
            }
        path = f"{self.root}/manifests/{after['number']}.json"
        if not files.put(self.spark, path, json.dumps(after)):
            raise Conflict(f"version {after['number']} is published already")
        return after
