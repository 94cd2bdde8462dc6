"""Packing token sequences: balanced by attention cost, and by best fit.

Both packers run inside the scan's own tasks.  A task fills a block of bounded
size (``block_tokens`` tokens or ``block_docs`` documents), packs it, emits it
and goes on, so nothing is shuffled, memory does not grow with the input and a
lost task is simply run again.  Only the last sequence of a block can be short.
"""

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clearsift.llm.batches import small_batches
from clearsift.llm.tokens import default_path, encoded_rows

CAPACITY = 2048
BLOCK_TOKENS = 1 << 21
BLOCK_DOCS = 1 << 15


def balanced_pieces(lengths, capacity: int, linear: float, quadratic: float):
    """Pieces ``(document, start, length, sequence, offset)`` of a block.

    A document's cost is ``linear * n + quadratic * n * n``.  Whole multiples of
    the capacity fill sequences alone.  What is left of each document goes, in
    descending order, to the lowest-cost sequence with room for it; the number
    of sequences is the least possible, so a document that fits nowhere is cut
    over the lowest-cost sequences with any room left.
    """
    pieces, rest, sequences = [], [], 0
    for doc, length in enumerate(lengths):
        full = length // capacity
        for i in range(full):
            pieces.append((doc, i * capacity, capacity, sequences, 0))
            sequences += 1
        if length % capacity:
            rest.append((length % capacity, doc, full * capacity))
    rest.sort(key=lambda x: (-x[0], x[1]))
    many = -(-sum(r[0] for r in rest) // capacity)
    used = np.zeros(many, dtype=np.int64)
    cost = np.zeros(many)

    def put(doc, start, length, at):
        pieces.append((doc, start, length, sequences + at, int(used[at])))
        used[at] += length
        cost[at] += linear * length + quadratic * length * length

    homeless = []
    for length, doc, start in rest:
        at = int(np.argmin(np.where(used <= capacity - length, cost, np.inf)))
        if used[at] + length <= capacity:
            put(doc, start, length, at)
        else:
            homeless.append((length, doc, start))
    # Each cut fills a sequence or ends a document, so this loop is linear.
    open_by_cost = [(cost[i], i) for i in range(many) if used[i] < capacity]
    heapq.heapify(open_by_cost)
    for length, doc, start in homeless:
        while length:
            at = open_by_cost[0][1]
            part = int(min(length, capacity - used[at]))
            put(doc, start, part, at)
            if used[at] == capacity:
                heapq.heappop(open_by_cost)
            else:
                heapq.heapreplace(open_by_cost, (cost[at], at))
            start, length = start + part, length - part
    return pieces


class CapacityTree:
    """Segment tree over remaining capacities; each leaf holds its bins."""

    def __init__(self, capacity: int):
        self._width = 1 << capacity.bit_length()
        self._count = [0] * (2 * self._width)
        self._bins = [[] for _ in range(self._width)]

    def add(self, room: int, item: int) -> None:
        self._bins[room].append(item)
        node = self._width + room
        while node:
            self._count[node] += 1
            node >>= 1

    def take(self, needed: int):
        """Remove a bin with the least room of at least ``needed``, or None."""
        node, count = self._width + needed, self._count
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self._width:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self._width
        item = self._bins[room].pop()
        while node:
            count[node] -= 1
            node >>= 1
        return room, item


def best_fit_pieces(lengths, capacity: int):
    """Pieces as above by best fit decreasing; overlong documents are split at
    multiples of the capacity, nothing else is cut."""
    parts = [
        (min(capacity, length - start), doc, start)
        for doc, length in enumerate(lengths)
        for start in range(0, length, capacity)
    ]
    parts.sort(key=lambda x: (-x[0], x[1], x[2]))
    tree, sequences, pieces = CapacityTree(capacity), 0, []
    for length, doc, start in parts:
        room, at = tree.take(length) or (capacity, sequences)
        sequences += at == sequences
        pieces.append((doc, start, length, at, capacity - room))
        if room > length:
            tree.add(room - length, at)
    return pieces


def _blocks(batches, path, end_id, block_tokens, block_docs):
    keys, raws, tokens = [], [], 0
    for key, raw in encoded_rows(batches, path, end_id):
        # One text may be longer than a block; it is a block of its own then.
        if keys and (tokens + len(raw) // 4 > block_tokens or len(keys) == block_docs):
            yield keys, raws
            keys, raws, tokens = [], [], 0
        keys.append(key)
        raws.append(raw)
        tokens += len(raw) // 4
    if keys:
        yield keys, raws


def _first_sequence() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId() << 33


def cost_balanced(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = 1,
    linear: float = 1.0,
    quadratic: float = 1.0 / 1024,
    tokenizer_path: str | None = None,
    block_tokens: int = BLOCK_TOKENS,
    block_docs: int = BLOCK_DOCS,
) -> DataFrame:
    """Pack all documents into sequences of equal attention cost.

    One row per piece: the id, ``start``, ``length``, ``ids`` (little-endian
    32-bit token ids), ``doc_tokens`` (with the end id), ``sequence_id``,
    ``offset``, ``cost``.  Null and empty texts are the end id alone; repeated
    rows are packed each; a null id stays null; an empty table has no rows;
    other columns are left out.
    """
    from pyarrow import RecordBatch, array
    from pyspark.sql.pandas.types import to_arrow_schema

    path = tokenizer_path or default_path()
    out = T.StructType(
        [T.StructField(id_col, docs.schema[id_col].dataType)]
        + [T.StructField(n, T.LongType()) for n in ("start", "length")]
        + [T.StructField("ids", T.BinaryType())]
        + [T.StructField(n, T.LongType()) for n in ("doc_tokens", "sequence_id", "offset")]
        + [T.StructField("cost", T.DoubleType())]
    )
    schema = to_arrow_schema(out)

    def pack(batches):
        first = _first_sequence()
        for keys, raws in _blocks(batches, path, end_id, block_tokens, block_docs):
            lengths = [len(r) // 4 for r in raws]
            pieces = balanced_pieces(lengths, capacity, linear, quadratic)
            for at in range(0, len(pieces), 4096):
                rows = [
                    (
                        keys[d], start, n, raws[d][4 * start : 4 * (start + n)],
                        lengths[d], first + s, offset, linear * n + quadratic * n * n,
                    )
                    for d, start, n, s, offset in pieces[at : at + 4096]
                ]
                yield RecordBatch.from_arrays(
                    [array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema
                )
            first += 1 + max(p[3] for p in pieces)

    rows = small_batches(docs).select(F.col(id_col), F.col(text_col).alias("__text"))
    return rows.mapInArrow(pack, out)


def best_fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = 49407,
    pad_id: int = 0,
    tokenizer_path: str | None = None,
    block_tokens: int = BLOCK_TOKENS,
    block_docs: int = BLOCK_DOCS,
) -> DataFrame:
    """Pack all documents by best fit decreasing into rows of a token matrix.

    One row per sequence: ``sequence_id``; ``input_ids`` (``capacity``
    little-endian 32-bit ids, padded with ``pad_id``); ``position_ids`` (same
    shape, from 0 again in every segment, 0 in the padding); ``cu_seqlens``
    (0 and the end of every segment); ``segments`` (the id, start in the
    document and length of each).  Overlong documents are split without loss.
    Null and empty texts are the end id alone; repeated rows are packed each;
    null ids stay null; an empty table has no rows.
    """
    from pyarrow import RecordBatch, array
    from pyspark.sql.pandas.types import to_arrow_schema

    path = tokenizer_path or default_path()
    segment = T.StructType(
        [T.StructField(id_col, docs.schema[id_col].dataType)]
        + [T.StructField(n, T.LongType()) for n in ("start", "length")]
    )
    out = T.StructType(
        [
            T.StructField("sequence_id", T.LongType()),
            T.StructField("input_ids", T.BinaryType()),
            T.StructField("position_ids", T.BinaryType()),
            T.StructField("cu_seqlens", T.ArrayType(T.IntegerType(), False)),
            T.StructField("segments", T.ArrayType(segment)),
        ]
    )
    schema = to_arrow_schema(out)

    def pack(batches):
        counting = np.arange(capacity, dtype="<u4").tobytes()
        pad = np.array([pad_id], dtype="<u4").tobytes()
        first = _first_sequence()
        for keys, raws in _blocks(batches, path, end_id, block_tokens, block_docs):
            sequences = {}
            for piece in best_fit_pieces([len(r) // 4 for r in raws], capacity):
                sequences.setdefault(piece[3], []).append(piece)
            rows = []
            for number, own in sequences.items():
                ends = [0, *(p[4] + p[2] for p in own)]
                gap = capacity - ends[-1]
                rows.append(
                    (
                        first + number,
                        b"".join(raws[d][4 * a : 4 * (a + n)] for d, a, n, *_ in own) + pad * gap,
                        b"".join(counting[: 4 * p[2]] for p in own) + bytes(4 * gap),
                        ends,
                        [{id_col: keys[d], "start": a, "length": n} for d, a, n, *_ in own],
                    )
                )
                if len(rows) == 256 or len(rows) and number == len(sequences) - 1:
                    yield RecordBatch.from_arrays(
                        [array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema
                    )
                    rows = []
            if rows:
                yield RecordBatch.from_arrays(
                    [array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema
                )
            first += len(sequences)

    rows = small_batches(docs).select(F.col(id_col), F.col(text_col).alias("__text"))
    return rows.mapInArrow(pack, out)


def write_packed(packed: DataFrame, path: str) -> None:
    """Store packed sequences as Parquet files of binary matrix rows."""
    packed.write.parquet(path)
