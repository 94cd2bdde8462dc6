"""Ranked lexical search without an index of the documents.

All terms of the items make one Aho-Corasick automaton.  Every key stands
between two guards, and every break of a text is a guard, so a hit is a whole
term.  One scan of a text gives its term frequencies; an output of the
automaton is the number of a term, and rows of a sparse matrix lead from there
to the items that have it.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clearsift.functions.scale import cut, top_k
from clearsift.llm.batches import small_batches

GUARD = "\0"
#: Characters of distinct terms in one automaton (about 150 MB of a worker's
#: memory) and occurrences of terms in items beside it; more items are searched
#: in several parts.
AUTOMATON_CHARS = 1 << 20
POSTINGS = 4_000_000
CELLS = 2_000_000
B_PERCENT = 75
_ASCII_TERM = [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]


def _table() -> bytes:
    """ASCII bytes as the scan sees them: A-Z lower-cased, breaks as guards."""
    table = bytearray(256)
    for byte in range(256):
        if byte >= 0x80 or byte in _ASCII_TERM:
            table[byte] = byte + 32 if 0x41 <= byte <= 0x5A else byte
    return bytes(table)


TABLE = _table()


def guarded(raw: bytes) -> str:
    """A text with every break replaced by a guard, and one at both ends."""
    return GUARD + raw.translate(TABLE).decode("utf-8") + GUARD


def count_terms(text: str) -> int:
    parts = text.split(GUARD)
    return len(parts) - parts.count("")


def automaton_of(terms: list[str]):
    """Finds ``terms`` between guards; the output is a term's place in the list."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for number, term in enumerate(terms):
        found.add_word(GUARD + term + GUARD, number)
    found.make_automaton()
    return found


def frequencies(automaton, text: str):
    """Numbers of the terms in a guarded text, ascending, and their counts."""
    hits = np.fromiter((number for _, number in automaton.iter(text)), dtype=np.int64)
    return np.unique(hits, return_counts=True)


def _item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item``, ``terms``: every item's terms with repeats, in one row."""
    rows = items.select(
        F.col(id_col).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ).distinct()

    @F.pandas_udf("array<string>")
    def terms(texts):
        import pandas as pd

        return pd.Series([[t for t in guarded(x.encode()).split(GUARD) if t] for x in texts])

    return (
        rows.select("item", F.explode(terms("text")).alias("term"))
        .groupBy("item", "term")
        .agg(F.count("*").alias("times"))
    )


def _parts(wanted: DataFrame) -> int:
    """Parts that the items are searched in: each has a bounded automaton."""
    chars = wanted.select("term").distinct().agg(F.sum(F.length("term") + 2)).first()[0] or 0
    pairs = wanted.count()
    return max(1, -(-int(chars) // AUTOMATON_CHARS), -(-pairs // POSTINGS))


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id``, ``score``: the ``k`` documents
    of highest score above 0 for each item; ties go to the smaller id, null last.

    Terms are runs of ASCII letters and digits and of all other characters, with
    A-Z lower-cased.  A term's weight is ``floor(1000 ln((2N+2)/(2df+1)))``, its
    part of the score ``w * ((10^9 tf) div (1000 tf + 8 m))`` for each time the
    item has it, where ``m = 25 + (75 n N) div L``.  ``N`` counts documents with
    a term, ``L`` all terms, ``df`` documents with this term.

    Null and empty texts have no terms.  Each row of ``docs`` is a document, also
    of equal ids; equal rows of ``items`` count once, rows of one id and other
    texts are one item.  An item without terms, and every item when there are no
    documents, has no rows.  Other columns are left out.

    The automaton is broadcast; its size is counted first, and items beyond
    ``AUTOMATON_CHARS`` or ``POSTINGS`` are searched in several parts.  Only
    ``k`` rows per item and task are shuffled, never a document or its terms.
    """
    docs = small_batches(docs)
    wanted = cut(_item_terms(items, item_col, item_text_col))
    parts = _parts(wanted)
    found = None
    for part in range(parts):
        own = wanted.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part)
        more = _search_part(docs, own, k, id_col, text_col)
        found = more if found is None else found.union(more)
    return found.withColumnsRenamed({"item": item_col, "id": "doc_id"})


def _search_part(docs: DataFrame, wanted: DataFrame, k: int, id_col: str, text_col: str):
    spark = docs.sparkSession
    pairs = wanted.toArrow()  # at most POSTINGS or what one item has
    ids = docs.schema[id_col].dataType
    if not pairs.num_rows:
        out = [wanted.schema["item"], T.StructField("rank", T.IntegerType()), T.StructField("id", ids)]
        return spark.createDataFrame([], T.StructType([*out, T.StructField("score", T.LongType())]))
    terms = sorted(set(pairs.column("term").to_pylist()))
    number = {term: i for i, term in enumerate(terms)}
    names = sorted(set(pairs.column("item").to_pylist()), key=lambda x: (x is None, x))
    place = {name: i for i, name in enumerate(names)}
    of_term = np.array([number[t] for t in pairs.column("term").to_pylist()], dtype=np.int64)
    of_item = np.array([place[x] for x in pairs.column("item").to_pylist()], dtype=np.int64)
    times = np.array(pairs.column("times").to_pylist(), dtype=np.int64)
    order = np.argsort(of_term, kind="stable")
    of_item, times = of_item[order], times[order]
    edges = np.searchsorted(of_term[order], np.arange(len(terms) + 1))

    scanned = _scanned(docs, spark.sparkContext.broadcast(automaton_of(terms)), id_col, text_col)
    n_docs, n_terms, weights = _corpus(scanned, len(terms))
    shared = spark.sparkContext.broadcast((of_item, times, edges, weights, len(names)))
    best = _best(scanned, shared, n_docs, n_terms, k, ids)
    items = spark.createDataFrame(
        list(enumerate(names)),
        T.StructType([T.StructField("place", T.LongType()), wanted.schema["item"]]),
    )
    order = [F.desc("score"), F.asc_nulls_last("id")]
    ranked = top_k(best, ["place"], order, k)
    return ranked.join(F.broadcast(items), "place").select("item", "rank", "id", "score")


def _scanned(docs: DataFrame, automaton, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``n`` (terms), ``terms`` and ``tfs`` (packed 32-bit numbers) of
    each document with a term; written once, as the counts of all come first."""
    id_field = T.StructField("id", docs.schema[id_col].dataType)
    schema = T.StructType(
        [id_field, T.StructField("n", T.LongType())]
        + [T.StructField(c, T.BinaryType()) for c in ("terms", "tfs")]
    )

    def scan(batches):
        from pyarrow import RecordBatch, array

        finder = automaton.value
        for batch in batches:
            keep, rows = [], []
            for i, raw in enumerate(batch.column(1).cast("binary")):
                if not raw.is_valid:
                    continue
                text = guarded(raw.as_py())
                n = count_terms(text)
                if not n:
                    continue
                numbers, counts = frequencies(finder, text)
                keep.append(i)
                rows.append((n, numbers.astype("<u4").tobytes(), counts.astype("<u4").tobytes()))
            if keep:
                columns = list(zip(*rows))
                yield RecordBatch.from_arrays(
                    [batch.column(0).take(array(keep)), array(columns[0], "int64")]
                    + [array(c, "binary") for c in columns[1:]],
                    names=schema.names,
                )

    return cut(docs.select(id_col, text_col).mapInArrow(scan, schema))


def _corpus(scanned: DataFrame, n_terms: int):
    """``N``, ``L`` and the weight of every term, from counts of all documents.

    A task hands on one count per term; the driver gets one per term.
    """

    def count(batches):
        from pyarrow import RecordBatch, array

        df = np.zeros(n_terms, dtype=np.int64)
        for batch in batches:
            for raw in batch.column(0):
                df[np.frombuffer(raw.as_buffer(), dtype="<u4")] += 1
        seen = np.flatnonzero(df)
        if len(seen):
            yield RecordBatch.from_arrays([array(seen), array(df[seen])], names=["term", "df"])

    n_docs, length = scanned.agg(F.count("*"), F.sum("n")).first()
    counts = scanned.select("terms").mapInArrow(count, "term long, df long")
    weighted = counts.groupBy("term").agg(F.sum("df").alias("df")).select(
        "term", F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).alias("w")
    )
    weights = np.zeros(n_terms, dtype=np.int64)
    found = weighted.toArrow()
    weights[found.column("term").to_numpy()] = found.column("w").to_numpy()
    return n_docs, length or 0, weights


def _best(scanned: DataFrame, shared, n_docs: int, n_terms: int, k: int, id_type) -> DataFrame:
    """``place`` (of the item), ``id``, ``score``: the best ``k`` of each item in
    each task."""
    schema = T.StructType(
        [
            T.StructField("place", T.LongType()),
            T.StructField("id", id_type),
            T.StructField("score", T.LongType()),
        ]
    )

    def score(batches):
        import pyarrow as pa

        of_item, times, edges, weights, many = shared.value
        if not many:
            return
        best = _Best(k)
        step = max(1, CELLS // many)
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                lengths = part.column("n").to_pylist()
                terms = [np.frombuffer(x.as_buffer(), dtype="<u4") for x in part.column("terms")]
                tfs = [np.frombuffer(x.as_buffer(), dtype="<u4") for x in part.column("tfs")]
                of_doc = np.repeat(np.arange(len(terms)), [len(x) for x in terms])
                norms = [25 + (B_PERCENT * n * n_docs) // n_terms for n in lengths]
                norms = np.array(norms, dtype=np.int64)[of_doc]
                terms, tfs = np.concatenate(terms).astype(np.int64), np.concatenate(tfs).astype(np.int64)
                parts = weights[terms] * ((10**9 * tfs) // (1000 * tfs + 8 * norms))
                # Every term of a document meets the items that have it.
                spans = edges[terms + 1] - edges[terms]
                first = np.repeat(edges[terms] - np.cumsum(spans) + spans, spans)
                at = first + np.arange(len(first))
                cells = np.repeat(of_doc, spans) * many + of_item[at]
                scores = np.zeros(part.num_rows * many, dtype=np.int64)
                np.add.at(scores, cells, np.repeat(parts, spans) * times[at])
                best.add(scores.reshape(part.num_rows, many), part.column("id"))
        rows = best.rows()
        if rows is not None:
            places, ids, scores = rows
            for i in range(0, len(places), 50_000):
                j = i + 50_000
                yield pa.RecordBatch.from_arrays(
                    [pa.array(places[i:j]), ids.slice(i, j - i), pa.array(scores[i:j])],
                    names=schema.names,
                )

    return scanned.select("id", "n", "terms", "tfs").mapInArrow(score, schema)


class _Best:
    """The ``k`` best documents of each item seen so far; ties by smaller id."""

    def __init__(self, k: int):
        self.k, self.floor = k, None
        self.places, self.scores, self.ids = [], [], []
        self.held = 0

    def add(self, scores: np.ndarray, ids) -> None:
        if self.floor is None:
            self.floor = np.zeros(scores.shape[1], dtype=np.int64)
        docs, places = np.nonzero((scores > 0) & (scores >= self.floor))
        if not len(docs):
            return
        import pyarrow as pa

        self.places.append(places)
        self.scores.append(scores[docs, places])
        self.ids.append(ids.take(pa.array(docs)))
        self.held += len(docs)
        if self.held > max(200_000, 4 * self.k * len(self.floor)):
            self._prune()

    def _prune(self) -> None:
        import pyarrow as pa
        import pyarrow.compute as pc

        ids = pa.chunked_array(self.ids).combine_chunks()
        places, scores = np.concatenate(self.places), np.concatenate(self.scores)
        rank = np.empty(len(ids), dtype=np.int64)
        rank[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
        order = np.lexsort((rank, -scores, places))
        places, scores = places[order], scores[order]
        here = np.arange(len(order))
        first = np.maximum.accumulate(np.where(np.r_[True, places[1:] != places[:-1]], here, 0))
        nth = here - first
        last = nth == self.k - 1
        self.floor[places[last]] = scores[last]
        keep = nth < self.k
        self.places, self.scores = [places[keep]], [scores[keep]]
        self.ids = [ids.take(pa.array(order[keep]))]
        self.held = int(keep.sum())

    def rows(self):
        if not self.held:
            return None
        self._prune()
        return self.places[0], self.ids[0], self.scores[0]
