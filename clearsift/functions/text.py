"""Text transforms as built-in column expressions (whole texts, one row each)."""

from math import ceil

from pyspark.sql import Column
from pyspark.sql import functions as F

from clearsift import constants as C


def strip(text) -> Column:
    """Trim Unicode white space at both ends, in linear time."""
    return F.btrim(_col(text), F.lit(C.SPACES))


def clean_private_glyphs(text) -> Column:
    """Private-use glyphs to readable ones; the length never changes."""
    spaced = F.replace(_col(text), F.lit(C.PRIVATE_SPACE), F.lit(" "))
    return F.regexp_replace(spaced, C.PRIVATE_USE, C.PRIVATE_REPLACEMENT)


def chunk_windows(
    text, max_chars: int = C.MAX_CHUNK_CHARS, overlap: int = C.CHUNK_OVERLAP
) -> Column:
    """Overlapping windows of one text, as an array in order.

    The text is cut once into blocks of ``max_chars - overlap`` characters and
    each window is a block plus the head of what follows, so the work is linear
    in the text however long it is.
    """
    if overlap >= max_chars:
        raise ValueError(f"overlap ({overlap}) must be smaller than max_chars ({max_chars})")
    step = max_chars - overlap
    text = _col(text)
    windows = let(
        F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{step}}}"), F.lit(0)),
        lambda blocks: _overlapping(blocks, max_chars, step, overlap),
    )
    return (
        F.when(F.length(strip(text)) == 0, F.array().cast("array<string>"))
        .when(F.length(text) <= max_chars, F.array(text))
        .otherwise(windows)
    )


def _overlapping(blocks: Column, max_chars: int, step: int, overlap: int) -> Column:
    join = lambda left, right: F.concat(left, F.coalesce(right, F.lit("")))
    following = F.slice(blocks, F.lit(2), F.size(blocks))
    for further in range(3, ceil(overlap / step) + 2):
        following = F.zip_with(following, F.slice(blocks, F.lit(further), F.size(blocks)), join)
    windows = F.zip_with(
        blocks, following, lambda block, rest: join(block, F.substring(rest, 1, overlap))
    )
    # Blocks are full but for the last; the first window to reach the end is the last.
    length = (F.size(blocks) - F.lit(1)) * F.lit(step) + F.length(F.element_at(blocks, -1))
    needed = F.ceil((length - F.lit(max_chars)) / F.lit(step)).cast("int") + F.lit(1)
    return F.slice(windows, F.lit(1), needed)


def let(value: Column, body) -> Column:
    """Bind a computed value that ``body`` uses more than once.

    Written out, the value would be computed once per use, and once per element
    inside a lambda.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lexemes(text, pattern: str = C.LEXEME) -> Column:
    """Lower-cased words, neither stemmed nor filtered; codes like 2.11.3 stay whole."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(pattern), F.lit(0))


def query_terms(query, pattern: str = C.HANGUL_ASCII_TERM) -> Column:
    """Distinct lower-cased terms of two or more characters, in query order.

    Letters of other scripts part terms; ``pattern=C.LEXEME`` keeps them.
    """
    words = F.regexp_extract_all(_col(query), F.lit(pattern), F.lit(0))
    long_enough = F.filter(words, lambda w: F.length(w) >= 2)
    return F.array_distinct(F.transform(long_enough, lambda w: F.lower(w)))


def indexed_text(code, title, text) -> Column:
    """What the keyword index sees; the stored text stays as it is."""
    return F.concat_ws(" ", _col(code), _col(title), _col(text))


def neutralize(text, max_chars: int = C.UNTRUSTED_MAX, keep_newlines: bool = False) -> Column:
    """Make untrusted text unable to forge the boundaries drawn around it."""
    out = F.regexp_replace(_col(text), r"\p{Cf}", "")
    breaks = r"[\p{Cc}\p{Zl}\p{Zp}&&[^\n]]" if keep_newlines else r"[\p{Cc}\p{Zl}\p{Zp}]"
    out = F.regexp_replace(out, breaks, " ")
    out = F.translate(out, C.ANGLE_BRACKETS, C.ANGLE_REPLACEMENTS)
    out = strip(out)
    out = F.replace(out, F.lit(C.TRUNCATION_MARK), F.lit(C.BROKEN_TRUNCATION_MARK))
    return F.when(
        F.length(out) > max_chars,
        F.concat(F.substring(out, 1, max_chars), F.lit(C.TRUNCATION_MARK)),
    ).otherwise(out)


def wrapped(label: str, body) -> Column:
    """Draw the labelled boundary around text that is already neutralized."""
    return F.concat(F.lit(f"<{label}>\n"), _col(body), F.lit(f"\n</{label}>"))


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value
