"""Citations in answers, checked against the hits they may rest on."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearsift import constants as C


def citations(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """(answer_id, code, position, status), each code once, in answer order.

    A bracketed code is always a citation: ``cited`` when among the hits,
    ``fabricated`` when not.  A bare code counts only when among the hits, since
    dates have the same shape.
    """
    found = answers.select(
        "answer_id",
        F.posexplode(F.regexp_extract_all("answer", F.lit(C.CITATION), F.lit(1))).alias(
            "pos", "token"
        ),
    )
    bracketed = F.col("token").startswith("[")
    mentioned = found.groupBy(
        "answer_id", F.translate("token", "[]", "").alias("code")
    ).agg(
        F.min("pos").alias("first_pos"), F.min(F.when(bracketed, F.col("pos"))).alias("bracket_pos")
    )
    retrieved = (
        hits.where(F.col("clause_code").isNotNull())
        .select("answer_id", F.col("clause_code").alias("code"), F.lit(True).alias("hit"))
        .distinct()
    )
    judged = mentioned.join(retrieved, ["answer_id", "code"], "left")
    return judged.where(F.col("hit") | F.col("bracket_pos").isNotNull()).select(
        "answer_id",
        "code",
        F.when(F.col("hit"), F.col("first_pos")).otherwise(F.col("bracket_pos")).alias("position"),
        F.when(F.col("hit"), "cited").otherwise("fabricated").alias("status"),
    )


def split_evidence(hits: DataFrame, cited: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits the answer cites, hits only related); uncoded hits are related."""
    codes = cited.where(F.col("status") == "cited").select(
        "answer_id", F.col("code").alias("clause_code")
    )
    keys = ["answer_id", "clause_code"]
    return hits.join(codes, keys, "left_semi"), hits.join(codes, keys, "left_anti")
