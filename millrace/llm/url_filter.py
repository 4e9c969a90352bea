"""URL verdicts: host and path rules first, else logistic regression on hashed character n-grams.

Everything that touches the pages is a column expression. The model is fitted on a small labelled
table of URLs (``labelled``, by default ``LABELLED``) and enters the plan as one constant array.

Defined cases: a null URL or one without ``://`` has an empty host and path, no rule, and the score of
an empty URL (the intercept); repeated rows are judged alike; an empty table gives an empty table;
columns besides the id and the URL are ignored, whatever their names.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 4096
SIZES = (3, 4, 5)

# The rules, as (verdict, host, path).
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

# The labelled table: 1 is a URL to block. Names and paths are of our own making, and no host of the given pages is
# among them; both kinds share the words beside the telling ones, and the ends and paths, so that these say nothing.
_TELLING = {1: ("casino", "pills", "bets", "adult", "spam", "ads"), 0: ("daily", "library", "museum", "garden", "school", "physics", "cooking", "travel", "history", "weather", "parliament", "recipes")}
_BESIDE = ("royal", "online", "now", "best", "club")
_AROUND = (("", ".example.com", "/en/12"), ("www.", ".example.org", "/de/7.html"), ("blog.", ".example.com", "/fr/40?page=2"), ("m.", ".example.org", "/es/9#top"))


def _labelled() -> list[tuple[str, int]]:
    rows = []
    for label, words in _TELLING.items():
        names = [n for word in words for other in _BESIDE for n in (f"{word}-{other}", f"{other}-{word}")] + list(words)
        for k, name in enumerate(names):
            before, end, path = _AROUND[k % len(_AROUND)]
            rows.append((f"https://{before}{name}{end}{path}", label))
    return rows


LABELLED = tuple(_labelled())


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...]
    intercept: float


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a URL; both empty without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(part(1), upper, upper.lower()), part(2)


def _grams(text: Column, side: str) -> Column:
    """Bucket numbers of the n-grams of ``^text$``, for every size; the cost is in proportion to the text."""
    letters = F.split(F.concat(F.lit("^"), text, F.lit("$")), "")

    def of(size: int) -> Column:
        grams = letters
        for k in range(1, size):  # each gram grows by the letter that follows it; at the end there is none
            grams = F.zip_with(grams, F.slice(letters, k + 1, F.size(letters)), lambda x, y: F.concat(x, y))
        whole = F.filter(grams, lambda x: x.isNotNull())
        return F.transform(whole, lambda x: F.pmod(F.xxhash64(F.lit(side), x), F.lit(BUCKETS)).cast("int"))

    return F.concat(*[of(n) for n in SIZES])


def _share(grams: Column) -> Column:
    """Long names weigh no more than short ones."""
    return F.lit(1.0) / F.sqrt(F.greatest(F.size(grams), F.lit(1)))


def fit(labelled: DataFrame, url: str = "url", label: str = "label") -> Model:
    """Fit on a small labelled table: one row per URL, label 1 for those to block."""
    host, path = host_and_path(F.col(url))
    rows = labelled.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("label"), _grams(host, "h").alias("h"), _grams(path, "p").alias("p"))
    count = lambda grams, j: F.size(F.filter(grams, lambda x: x == j)) * _share(grams)
    dense = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda j: count(F.col("h"), j) + count(F.col("p"), j))
    fitted = LogisticRegression(maxIter=50, regParam=0.0005, standardization=False).fit(rows.select("label", array_to_vector(dense).alias("features")))
    return Model(tuple(float(x) for x in fitted.coefficients), float(fitted.intercept))


def score(model: Model, host: Column, path: Column) -> Column:
    """Log-odds that the URL is to be blocked."""
    weights = F.from_json(F.lit(json.dumps(model.weights)), "array<double>")

    def side(grams: Column) -> Column:
        total = F.aggregate(grams, F.lit(0.0), lambda sum_, j: sum_ + F.get(weights, j))
        return total * _share(grams)

    return F.lit(model.intercept) + side(_grams(host, "h")) + side(_grams(path, "p"))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; null if none fits. The list is part of the plan, so keep it short."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):  # the longest is tested first
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def labelled_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LABELLED), "url string, label int")


def judge(pages: DataFrame, model: Model, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's log-odds for every row of ``pages``."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict, "score": score(model, F.col("host"), F.col("path"))})
    own = F.when(F.col("score") > 0, F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "score")
