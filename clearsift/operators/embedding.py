"""Encoding text with a caller-supplied model, in Arrow batches."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clearsift import constants as C

PREFIXES = {"query": C.QUERY_PREFIX, "passage": C.PASSAGE_PREFIX}


def encode(
    rows: DataFrame,
    text_col: str,
    kind: str,
    encoder,
    dim: int = C.EMBEDDING_DIM,
    batch_size: int = C.ENCODE_BATCH,
    keep=None,
) -> DataFrame:
    """Add an L2-normalised ``embedding`` of ``text_col``.

    ``encoder(list of texts) -> 2-d array`` runs inside the tasks, ``batch_size``
    texts at a time.  ``kind`` says whether texts are questions or stored
    passages; mixing them up lowers quality silently, so it has no default.
    ``keep`` names the columns to carry (default: all but the text).
    """
    if kind not in PREFIXES:
        raise ValueError(f"kind must be one of {sorted(PREFIXES)}: {kind}")
    if batch_size <= 0:
        raise ValueError(f"batch_size must be positive: {batch_size}")
    prefix = PREFIXES[kind]
    keep = [c for c in rows.columns if c != text_col] if keep is None else list(keep)
    narrow = rows.select(*keep, F.col(text_col).alias("__text"))
    schema = T.StructType(
        [narrow.schema[c] for c in keep]
        + [T.StructField("embedding", T.ArrayType(T.FloatType()))]
    )

    def run(batches):
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            vectors = [np.zeros((0, dim), dtype=np.float32)]
            for at in range(0, len(texts), batch_size):
                raw = np.asarray(
                    encoder([prefix + t for t in texts[at : at + batch_size]]), dtype=np.float64
                )
                if raw.ndim != 2 or raw.shape[1] != dim:
                    raise ValueError(f"the encoder must return {dim} columns: {raw.shape}")
                norms = np.linalg.norm(raw, axis=1, keepdims=True)
                vectors.append((raw / np.where(norms == 0, 1.0, norms)).astype(np.float32))
            edges = np.arange(0, (len(texts) + 1) * dim, dim, dtype=np.int32)
            lists = pa.ListArray.from_arrays(edges, np.concatenate(vectors).ravel())
            columns = [batch.column(number) for number in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, lists], names=schema.names)

    return narrow.mapInArrow(run, schema)


def pending(rows: DataFrame, vectors: DataFrame, text_col: str) -> DataFrame:
    """The encoding worklist: distinct texts without a stored vector."""
    hashed = rows.groupBy(F.sha2(F.col(text_col), 256).alias("text_hash")).agg(
        F.any_value(text_col).alias(text_col)
    )
    return hashed.join(vectors.select("text_hash"), "text_hash", "left_anti")


def wrong_dimension(vectors: DataFrame, dim: int = C.EMBEDDING_DIM) -> DataFrame:
    """Rows whose vector is missing or of another length."""
    return vectors.where(F.coalesce(F.size("embedding") != dim, F.lit(True)))
