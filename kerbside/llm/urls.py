"""URL filters: longest-prefix rules, then logistic regression on hashed character n-grams of host and path.

All of it is DataFrame functions and JVM-side ``pyspark.ml``: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host, path prefix); a rule fits its host and all subdomains.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

#: The labelled URL table: names of hosts whose trade is blocked, and of others. Each stands with all prefixes, and
#: in turn with the domains and paths, so that those say nothing of the label.
BLOCKED_NAMES = (
    "cheap-pills", "cheap-meds", "pills-online", "casino-win", "casino-online", "big-casino", "free-bets",
    "best-bets", "bets-win", "adult-x", "adult-cam", "x-adult", "ads-track", "ads-server", "track-clicks",
    "spam-farm", "link-farm", "spam-links", "cheap-loans", "free-casino", "win-prizes", "pills-shop", "adult-chat",
    "ad-farm", "bets-online", "track-ads", "free-pills", "cheap-watches",
)
ALLOWED_NAMES = (
    "library", "daily-news", "garden", "travel", "school", "weather", "theater", "thornton", "harbor", "tionsh",
    "ththan", "theran", "research", "recipes", "museum", "ththin", "history", "theron", "music", "ththou", "therst",
    "city-council", "open-data", "tionble", "river", "ththre", "physics", "sports",
)
PREFIXES, DOMAINS = ("", "www.", "m.", "blog."), ("example.net", "example.com", "test", "example.org", "example")
PATHS = ("/en/1", "/fr/22.html", "/de/77#top", "/es/15/", "/en/410?utm_source=feed", "/de/9102?page=2", "/")
LABELLED = tuple(
    (f"http{'s' * (i % 2)}://{prefix}{name}.{DOMAINS[(i + j) % len(DOMAINS)]}{PATHS[(i + 2 * j) % len(PATHS)]}", label)
    for label, names in ((1, BLOCKED_NAMES), (0, ALLOWED_NAMES))
    for i, name in enumerate(names)
    for j, prefix in enumerate(PREFIXES)
)

GRAM_SIZES = (3, 4, 5)
BUCKETS = 1 << 14


def host_of(url: Column) -> Column:
    """What is between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule (host and path together) that fits, as ``struct<verdict, rule>``, or null. Ties go to block."""
    def fits(rule):
        _, name, prefix = rule
        return ((host == name) | host.endswith(f".{name}")) & path.startswith(prefix)

    ordered = sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), r[0] != "block", r))
    found = [
        F.when(fits(r), F.struct(F.lit(r[0]).alias("verdict"), F.lit(r[1] + r[2]).alias("rule"))) for r in ordered
    ]
    return F.coalesce(*found) if found else F.lit(None).cast("struct<verdict: string, rule: string>")


def grams(host: Column, path: Column, sizes=GRAM_SIZES) -> Column:
    """Character n-grams of host and path, each marked by the part that it is from; of paths only the shortest, with one 0 for a number."""
    def of(text: Column, mark: str) -> list[Column]:
        framed = F.concat(F.lit("^"), text, F.lit("$"))
        return [
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.length(framed) - n + 1, F.lit(1))),
                lambda i, n=n: F.concat(F.lit(mark), framed.substr(i, F.lit(n))),
            )
            for n in sizes
        ]

    return F.concat(*of(host, "h:"), *of(F.regexp_replace(path, "[0-9]+", "0"), "p:")[:1])


def labelled_urls(spark: SparkSession) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(url).alias("url"), F.lit(label).alias("label")) for url, label in LABELLED])
    return spark.range(1).select(F.inline(rows))


def _featured(urls: DataFrame, sizes=GRAM_SIZES, buckets: int = BUCKETS) -> DataFrame:
    return HashingTF(inputCol="_grams", outputCol="_features", numFeatures=buckets, binary=True).transform(
        urls.withColumn("_grams", grams(F.col("host"), F.col("path"), sizes))
    )


def train(labelled: DataFrame, reg: float = 0.001):
    """Logistic regression on a small labelled table (``url``, ``label`` 0 or 1); rows with a null label are left out."""
    parts = labelled.filter("label is not null").select(
        host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("label").cast("double").alias("label")
    )
    return LogisticRegression(featuresCol="_features", labelCol="label", regParam=reg, maxIter=50).fit(_featured(parts))


def judge_urls(pages: DataFrame, labelled: DataFrame, *, rules=RULES, threshold: float = 0.5) -> DataFrame:
    """Per page: host, path, the rule that fits (or null), the verdict, and the model's probability of block.

    A null URL, or one without ``://``, has an empty host and path, no rule, and the
    model's verdict on the empty host. Null ids stay null, repeated rows give repeated
    rows, no pages give no rows. Columns beside ``page_id`` and ``url`` are not read.
    Nothing is shuffled: every verdict is made from its own row.
    """
    model = train(labelled)
    model.setFeaturesCol("_features").setProbabilityCol("_probability").setRawPredictionCol("_raw").setPredictionCol("_label")
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    scored = model.transform(_featured(parts)).withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    blocked = vector_to_array("_probability")[1]
    return scored.select(
        "page_id",
        "host",
        "path",
        F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), F.when(blocked >= threshold, "block").otherwise("allow")).alias("verdict"),
        blocked.alias("p_block"),
    )
