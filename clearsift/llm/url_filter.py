"""URL filter: path rules first, then boosted trees on lexical features."""

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearsift.functions.scale import cut

RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
LABELLED_ROWS = 20_000
FEATURES = (
    "url_length host_length path_length depth labels digit_ratio entropy parameters hyphens "
    "secure suffix_rate suffix_seen"
).split()


def host_of(url: Column) -> Column:
    """Behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(
        F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("")
    )


def path_of(url: Column) -> Column:
    """Behind the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict, or nulls."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):  # the longest goes outside
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def suffix_of(host: Column) -> Column:
    return F.element_at(F.split(host, r"\."), -1)


def lexical(urls: DataFrame, url_col: str) -> DataFrame:
    """Lexical features of the whole url; a null url is empty."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    urls = urls.withColumns(
        {"__url": url, "__host": host_of(F.col(url_col)), "__path": path_of(F.col(url_col))}
    )
    size = F.greatest(F.length("__url"), F.lit(1)).cast("double")
    share = lambda c: (F.length("__url") - F.length(F.replace("__url", c, F.lit("")))) / size
    entropy = F.aggregate(
        F.array_distinct(F.split("__url", "")),
        F.lit(0.0),
        lambda total, c: total - F.when(share(c) > 0, share(c) * F.log2(share(c))).otherwise(0.0),
    )
    asked = F.regexp_extract("__url", r"\?([^#]*)", 1)
    return urls.withColumns(
        {
            "url_length": F.length("__url").cast("double"),
            "host_length": F.length("__host").cast("double"),
            "path_length": F.length("__path").cast("double"),
            "depth": F.regexp_count("__path", F.lit("/[^/]")).cast("double"),
            "labels": F.size(F.split("__host", r"\.")).cast("double"),
            "digit_ratio": F.regexp_count("__url", F.lit("[0-9]")) / size,
            "entropy": entropy,
            "parameters": F.when(asked == "", 0.0).otherwise(
                F.size(F.split(asked, "&")).cast("double")
            ),
            "hyphens": F.regexp_count("__host", F.lit("-")).cast("double"),
            "secure": F.col("__url").startswith("https://").cast("double"),
            "__suffix": suffix_of(F.col("__host")),
        }
    )


class UrlModel:
    """Trees, and how often each suffix was labelled block."""

    def __init__(self, model, suffixes: DataFrame, rate: float):
        self.model, self.suffixes, self.rate = model, suffixes, rate

    def with_suffixes(self, urls: DataFrame) -> DataFrame:
        return urls.join(self.suffixes, "__suffix", "left").withColumns(
            {
                "suffix_rate": F.coalesce("suffix_rate", F.lit(self.rate)),
                "suffix_seen": F.coalesce("suffix_seen", F.lit(0.0)),
            }
        )

    def block_probability(self, urls: DataFrame, url_col: str, out: str) -> DataFrame:
        """``urls`` with the probability of block; helper columns are dropped."""
        columns = urls.columns
        if self.model is None:
            return urls.withColumn(out, F.lit(self.rate))
        # Only distinct urls are judged, beside the rows and their own columns.
        rows = urls.select(F.col(url_col).alias("__of")).distinct()
        judged = self.with_suffixes(lexical(rows, "__of"))
        judged = VectorAssembler(inputCols=FEATURES, outputCol="__features").transform(judged)
        judged = self.model.transform(judged).select(
            "__of", vector_to_array("__probability")[1].alias(out)
        )
        return urls.join(judged, F.col(url_col).eqNullSafe(F.col("__of")), "left").select(
            *[F.col(c) for c in columns if c != out], out
        )


def train(
    labelled: DataFrame,
    url_col: str = "url",
    label_col: str = "block",
    max_rows: int = LABELLED_ROWS,
    trees: int = 20,
    depth: int = 4,
) -> UrlModel:
    """Fit boosted trees to labelled urls (label 1.0: block).

    Suffixes and the share of block are counted over all rows.  The trees are
    fitted to at most ``max_rows`` pairs of url and label, those with the
    smallest hash of their url, each weighted by its number of rows.  Rows
    without url or label count for nothing.  With labels of one kind only, or
    none, the model answers their share of block, or 0.0.
    """
    counted = cut(
        labelled.select(F.col(url_col).alias("__of"), F.col(label_col).cast("double").alias("label"))
        .where("__of IS NOT NULL AND label IS NOT NULL")
        .groupBy("__of", "label")
        .agg(F.count("*").cast("double").alias("__rows"))
    )
    blocked = F.sum(F.col("label") * F.col("__rows"))
    rate = counted.agg(blocked / F.nullif(F.sum("__rows"), F.lit(0.0))).first()[0] or 0.0
    suffixes = cut(
        counted.groupBy(suffix_of(host_of(F.col("__of"))).alias("__suffix")).agg(
            ((blocked + 10 * F.lit(rate)) / (F.sum("__rows") + 10)).alias("suffix_rate"),
            F.log1p(F.sum("__rows")).alias("suffix_seen"),
        )
    )
    model = UrlModel(None, suffixes, rate)
    if 0.0 < rate < 1.0:
        rows = counted.orderBy(F.xxhash64("__of"), "__of", "label").limit(max_rows)
        rows = cut(lexical(rows, "__of"))
        seen = VectorAssembler(inputCols=FEATURES, outputCol="__features").transform(
            model.with_suffixes(rows)
        )
        boosted = GBTClassifier(
            featuresCol="__features", labelCol="label", weightCol="__rows", maxIter=trees, maxDepth=depth,
            stepSize=0.2, minInstancesPerNode=20, seed=7,
        )
        boosted.setPredictionCol("__prediction").setRawPredictionCol("__raw")
        boosted.setProbabilityCol("__probability")
        model.model = boosted.fit(seen.select("__features", "label", "__rows").repartition(4))
    return model


def judge(
    urls: DataFrame, model: UrlModel, url_col: str = "url", rules=RULES, threshold: float = 0.5
) -> DataFrame:
    """``urls`` with ``host``, ``path``, ``rule`` and ``verdict``: the longest
    fitting rule's, else block where the trees give ``threshold`` or more.

    A null url or one without ``://`` has an empty host and path and is left to
    the trees.  Columns of those names are replaced; repeated rows stay.
    """
    url = F.col(url_col)
    # New columns are made under names of their own, as the input may have them.
    judged = model.block_probability(urls, url_col, "__block")
    rule, verdict = rule_of(host_of(url), path_of(url), rules)
    trees = F.when(F.col("__block") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return judged.withColumns(
        {
            "host": host_of(url),
            "path": path_of(url),
            "rule": rule,
            "verdict": F.coalesce(verdict, trees),
        }
    ).drop("__block")
