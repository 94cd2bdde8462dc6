"""Fill-in-the-middle texts: two cuts between lines, found in a skip list.

The lines of a text are the nodes of an indexable skip list.  Every link of an
express lane carries two widths: how many lines it passes and how many code
points.  A descent that adds up line widths stops exactly at a wanted rank, and
the code-point widths added on the way are the place to cut.
"""

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clearsift.functions.scale import with_fields
from clearsift.llm.batches import small_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
RATE = 100
SPM_RATE = 50
#: One node in so many is raised to the next lane.
RAISE = 4
_MULTIPLIER = 0x9E3779B97F4A7C15
_FOUND = T.StructType([T.StructField(c, T.IntegerType()) for c in ("n", "first", "second")])


class SkipList:
    """Line lengths as lanes of links; lane 0 has a link for every line.

    A node's height depends on a hash of its number, so lists of equal lengths
    are equal.  Lanes take 4/3 of the lines' space, a descent about
    ``RAISE * log(lines)`` steps.
    """

    def __init__(self, code_points):
        lengths = np.asarray(code_points, dtype=np.int64)
        units = np.ones(len(lengths), dtype=np.int64)
        hashes = (np.arange(len(lengths), dtype=np.uint64) + np.uint64(1)) * np.uint64(_MULTIPLIER)
        # A lane: widths of its links in lines and code points, and where each
        # link starts in the lane below.  The head is raised everywhere.
        self.lanes = [(units.tolist(), lengths.tolist(), None)]
        level = 0
        while len(units) > RAISE:
            level += 1
            raised = hashes >> np.uint64(64 - 2 * level) == 0
            raised[0] = True
            starts = np.flatnonzero(raised)
            if len(starts) == len(units):
                continue
            units = np.add.reduceat(units, starts)
            lengths = np.add.reduceat(lengths, starts)
            hashes = hashes[starts]
            self.lanes.append((units.tolist(), lengths.tolist(), starts.tolist()))

    def code_points_before(self, rank: int) -> int:
        """Code points of the first ``rank`` lines."""
        node, passed, offset = 0, 0, 0
        for units, lengths, starts in reversed(self.lanes):
            while node < len(units) and passed + units[node] <= rank:
                passed += units[node]
                offset += lengths[node]
                node += 1
            if passed == rank or starts is None:
                break
            node = starts[node]
        return offset


def lines_of(text: str) -> list[int]:
    """Code points of each line ``[^\\n]*\\n|[^\\n]+``."""
    lengths = [len(x) + 1 for x in text.split("\n")]
    lengths[-1] -= 1
    if not lengths[-1]:
        lengths.pop()
    return lengths


@F.pandas_udf(_FOUND)
def _cuts(texts, ones, others):
    """Lines of each text and the code points before its two cut ranks."""
    import pandas as pd

    rows = []
    for text, one, other in zip(texts, ones, others):
        lengths = lines_of(text)
        n = len(lengths)
        low, high = sorted((int(one) % (n + 1), int(other) % (n + 1)))
        found = SkipList(lengths)
        rows.append((n, found.code_points_before(low), found.code_points_before(high)))
    return pd.DataFrame(rows, columns=["n", "first", "second"])


def draws(id_col: str, seed: int) -> list[Column]:
    """Four numbers below 2^32 that id and seed decide; a null id is empty."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    digest = F.sha2(name, 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def draws_of(key, seed: int = SEED) -> list[int]:
    """The same numbers in plain Python, for one id."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def transform(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = SEED,
    rate: int = RATE,
    spm_rate: int = SPM_RATE,
) -> DataFrame:
    """``docs`` with ``fim_lines``, ``fim_form`` (``plain``, ``psm``, ``spm``),
    ``fim_prefix_chars``, ``fim_middle_chars`` (null if plain), ``fim_output``.

    Of 100 documents ``rate`` are cut, ``spm_rate`` of those begin with the
    suffix.  Texts that are empty or hold a marker stay plain.  A null text is
    empty; a null id draws like the empty name; rows of one id draw alike;
    an empty table gives no rows.  Columns of these names are replaced.  One
    pass, no shuffle; each text is a row of its own all the way.
    """
    docs = small_batches(docs)
    ours = ["fim_lines", "fim_form", "fim_prefix_chars", "fim_middle_chars", "fim_output"]
    rest = docs.drop(*ours)
    text = F.coalesce(F.col(text_col), F.lit(""))
    one, other, whether, which = draws(id_col, seed)
    marked = F.lit(False)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(text, F.lit(marker))
    form = (
        F.when((text == "") | marked | (F.pmod(whether, F.lit(100)) >= rate), "plain")
        .when(F.pmod(which, F.lit(100)) < spm_rate, "spm")
        .otherwise("psm")
    )
    cuts = "__cuts"
    while cuts in rest.columns:
        cuts += "_"
    found = rest.withColumn(cuts, _cuts(text, one, other))
    first, second = F.col(f"{cuts}.first"), F.col(f"{cuts}.second")
    found = with_fields(found, form.alias("fim_form"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    prefix = F.substring(text, F.lit(1), first)
    middle = F.substring(text, first + 1, second - first)
    suffix = F.substring(text, second + 1, F.length(text))
    output = (
        F.when(F.col("fim_form") == "plain", text)
        .when(F.col("fim_form") == "psm", _joined(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))
        .otherwise(_joined(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    )
    cut = F.col("fim_form") != "plain"
    return found.select(
        *(F.col(f"`{c}`") for c in rest.columns),
        F.col(f"{cuts}.n").cast("long").alias("fim_lines"),
        "fim_form",
        F.when(cut, first).cast("long").alias("fim_prefix_chars"),
        F.when(cut, second - first).cast("long").alias("fim_middle_chars"),
        output.alias("fim_output"),
    )


def _joined(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def restore(output: Column, form: Column) -> Column:
    """The text before the transformation, from its output and form alone.  No
    piece holds a marker, so each marker is found where it was put."""
    rest = F.substring(output, F.lit(4), F.length(output))

    def after(marker):
        return F.substring(
            rest, F.locate(marker, rest) + len(marker), F.length(output)
        )

    def until(piece, marker):
        return F.substring_index(piece, marker, 1)

    psm = F.concat(until(rest, SUFFIX), after(MIDDLE), until(after(SUFFIX), MIDDLE))
    spm = F.concat(until(after(PREFIX), MIDDLE), after(MIDDLE), until(rest, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
