"""Documents to clauses to chunks.  A document is one row until it is split, so
nothing here shuffles text."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearsift import constants as C
from clearsift.functions.front_matter import header_fields
from clearsift.functions.scale import cut, with_fields
from clearsift.functions.text import chunk_windows, clean_private_glyphs, let, strip


class ParseError(Exception):
    """Some input documents cannot be read; ``rows`` has every path and reason."""

    def __init__(self, reasons, rows: DataFrame):
        super().__init__("; ".join(f"{n} files: {reason}" for reason, n in reasons))
        self.rows = rows


def split_front_matter(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parsed, rejected) from path and content.

    Parsed rows carry title, required_clearance, allowed_departments and body.
    Title and clearance are mandatory, and a header that is missing or cannot be
    read is a rejection: a default would publish what should be restricted.
    """
    head = F.regexp_extract("content", C.FRONT_MATTER, 1)
    has_header = F.regexp_like("content", F.lit(C.FRONT_MATTER))
    body = F.regexp_replace("content", C.FRONT_MATTER, "")
    # Only heads go to Python, never texts.
    given = files.withColumn("__head", header_fields(head))
    parsed = with_fields(
        given,
        F.col("__head.title").alias("title"),
        F.trim(F.col("__head.clearance")).try_cast("int").alias("required_clearance"),
        F.col("__head.departments").alias("allowed_departments"),
        body.alias("body"),
        (has_header & F.col("__head.error").isNull()).alias("__readable"),
    )
    good = (
        F.col("__readable") & F.col("title").isNotNull() & F.col("required_clearance").isNotNull()
    )
    accepted = parsed.where(good).drop("__readable", "__head")
    return accepted, parsed.where(~F.coalesce(good, F.lit(False))).select(*files.columns)


def with_clauses(
    documents: DataFrame, text_col: str, paged: bool = False, tail_marker: str = C.TAIL_MARKER
) -> DataFrame:
    """Add ``clauses``, the array of (pos, code, title, text) of each document.

    Headers and the texts between them come from the same pattern, so they
    align without any marker that a text could contain.  Text before the first
    header is dropped.  ``paged`` reads the paged-text form: the last clause
    ends at the tail marker, and of repeated codes (table of contents and body)
    the longest text stays, in order of first appearance.
    """
    text = F.col(text_col)
    pattern = C.PAGED_CLAUSE if paged else C.MARKDOWN_CLAUSE
    group = lambda n: F.regexp_extract_all(text, F.lit(pattern), F.lit(n))

    def clause(code, i, title, raw, following):
        if paged:
            raw = F.when(following.isNull(), F.substring_index(raw, tail_marker, 1)).otherwise(raw)
        return F.struct(
            i.cast("int").alias("pos"),
            code.alias("code"),
            strip(title).alias("title"),
            strip(raw).alias("text"),
        )

    def aligned(codes):
        zipped = F.arrays_zip(
            codes.alias("code"),
            group(2).alias("title"),
            F.slice(F.split(text, pattern, -1), F.lit(2), F.size(codes)).alias("raw"),
            F.slice(codes, F.lit(2), F.size(codes)).alias("following"),
        )
        return F.transform(
            zipped, lambda c, i: clause(c["code"], i, c["title"], c["raw"], c["following"])
        )

    clauses = let(group(1), aligned)
    if paged:
        clauses = let(clauses, _longest_per_code)
    return documents.withColumn("clauses", clauses)


def _longest_per_code(clauses: Column) -> Column:
    """Per code the longest text (the first on ties), by first appearance."""
    by_length = F.sort_array(
        F.transform(
            clauses,
            lambda c: F.struct(
                c["code"].alias("code"),
                (-F.length(c["text"])).alias("shorter"),
                c["pos"].alias("pos"),
                c.alias("clause"),
            ),
        )
    )
    by_place = F.sort_array(
        F.transform(clauses, lambda c: F.struct(c["code"].alias("code"), c["pos"].alias("pos")))
    )
    # Both lists hold each code once, in code order, so they pair up.
    pairs = F.zip_with(
        let(by_place, _first_of_runs),
        let(by_length, _first_of_runs),
        lambda first, best: F.struct(first["pos"].alias("first"), best["clause"].alias("clause")),
    )
    return F.transform(F.sort_array(pairs), lambda p: p["clause"])


def _first_of_runs(ordered: Column) -> Column:
    """The first of each run of structs with equal ``code``."""
    before = F.concat(
        F.array(F.lit(None).cast("string")), F.transform(ordered, lambda c: c["code"])
    )
    marked = F.zip_with(
        ordered,
        F.slice(before, F.lit(1), F.size(ordered)),
        lambda c, code: F.struct(c.alias("c"), (~c["code"].eqNullSafe(code)).alias("first")),
    )
    return F.transform(F.filter(marked, lambda m: m["first"]), lambda m: m["c"])


def clause_rows(documents: DataFrame, id_col: str = "document_id") -> DataFrame:
    """One row per clause; ``position`` is its order within the document."""
    return documents.select(
        id_col, F.posexplode("clauses").alias("position", "clause")
    ).select(
        id_col,
        "position",
        F.col("clause.code").alias("code"),
        F.col("clause.title").alias("title"),
        F.col("clause.text").alias("text"),
    )


def chunk_rows(
    clauses: DataFrame,
    max_chars: int = C.MAX_CHUNK_CHARS,
    overlap: int = C.CHUNK_OVERLAP,
    text_col: str = "text",
) -> DataFrame:
    """One row per chunk, ``ordinal`` from 0 inside its clause."""
    kept = [c for c in clauses.columns if c != text_col]
    return clauses.select(
        *kept, F.posexplode(chunk_windows(text_col, max_chars, overlap)).alias("ordinal", text_col)
    )


def join_pages(pages: DataFrame, id_col: str = "document_id") -> DataFrame:
    """Paged text to one cleaned text per document, pages in order."""
    ordered = F.sort_array(F.collect_list(F.struct("page_no", F.coalesce("text", F.lit("")).alias("text"))))
    joined = F.array_join(F.transform(ordered, lambda p: p["text"]), "\n")
    return pages.groupBy(id_col).agg(clean_private_glyphs(joined).alias("content"))


def parse_files(files: DataFrame) -> DataFrame:
    """Clauses of mixed documents, chosen by the extension of ``path``.

    Markdown brings its own permissions; paged text takes those already on the
    row.  Any other extension is an error, never skipped.
    """
    for name, kind in (
        ("title", "string"),
        ("required_clearance", "int"),
        ("allowed_departments", "array<string>"),
    ):
        if name not in files.columns:
            files = files.withColumn(name, F.lit(None).cast(kind))
    extension = F.lower(F.regexp_extract("path", r"(\.[^./]*)\z", 1))
    typed = files.withColumn("__ext", extension)
    markdown, rejected = split_front_matter(
        typed.where(F.col("__ext") == ".md").select("path", "content")
    )
    paged = typed.where(F.col("__ext") == ".pdf")
    refused = (
        typed.where(~F.col("__ext").isin(".md", ".pdf"))
        .select("path", F.lit("unsupported format").alias("reason"))
        .unionByName(rejected.select("path", F.lit("no readable front matter").alias("reason")))
        .unionByName(
            paged.where(F.col("required_clearance").isNull() | F.col("title").isNull()).select(
                "path", F.lit("no permissions given").alias("reason")
            )
        )
    )
    refused = cut(refused)
    reasons = refused.groupBy("reason").count().orderBy("reason").collect()  # three at most
    if reasons:
        raise ParseError([(r["reason"], r["count"]) for r in reasons], refused)
    permissions = ["path", "title", "doc_type", "required_clearance", "allowed_departments"]
    from_markdown = with_clauses(markdown.withColumn("doc_type", F.lit("md")), "body")
    cleaned = paged.withColumn("doc_type", F.lit("pdf")).withColumn(
        "content", clean_private_glyphs("content")
    )
    from_paged = with_clauses(cleaned, "content", paged=True)
    return from_markdown.select(*permissions, "clauses").unionByName(
        from_paged.select(*permissions, "clauses")
    )
