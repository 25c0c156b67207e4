"""URL filters: host and path rules, then a logistic regression, in DataFrame functions.

The regression works on hashed character n-grams of host and path and is fitted
on a small labelled URL table; rules come first, the longest that fits wins.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.translate(_host(url), UPPER, LOWER)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def _host(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*", 0)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, else null.

    ``rules`` are (verdict, host, path): a rule fits its host and all its
    subdomains if the path starts with the rule's.  Of equally long rules the
    first in the order of their text wins.  The list is written into the plan:
    meant for some hundreds of rules.
    """
    tried = [
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p),
               F.struct(F.lit(-len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in rules
    ]
    if not tried:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    return F.array_min(F.filter(F.array(*tried), lambda x: x.isNotNull()))


def grams(host: Column, path: Column, sizes: tuple[int, ...] = (3, 4, 5)) -> Column:
    """Character n-grams of host and path, marked by where they come from."""

    def of(text: Column, mark: str, n: int) -> Column:
        last = F.length(text) - (n - 1)
        some = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), last)), lambda i: F.concat(F.lit(mark), F.substring(text, i, F.lit(n))))
        return F.when(last >= 1, some).otherwise(F.array().cast("array<string>"))

    framed_host, framed_path = F.concat(F.lit("."), host, F.lit(".")), F.concat(path, F.lit(" "))
    return F.concat(*(of(framed_host, "h", n) for n in sizes), *(of(framed_path, "p", n) for n in sizes))


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "block", most: int = 20_000, bits: int = 14, penalty: float = 0.02) -> LogisticRegressionModel | None:
    """Fit the regression on (url, block 0/1).

    ``most`` bounds the sample: larger tables are thinned by a hash of the URL.
    Rows without url or label are left out.  None if there is no labelled row.
    """
    rows = labelled.select(F.col(url_col).alias("url"), F.col(label_col).cast("double").alias("label")).dropna().filter(F.col("label").isin(0.0, 1.0))
    n = rows.count()
    if not n:
        return None
    share = min(1.0, most / n)
    kept = rows.filter(F.pmod(F.xxhash64("url"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))) if share < 1 else rows
    featured = _vectors(kept, bits).select("label", "x").repartition(8).cache()
    model = LogisticRegression(featuresCol="x", labelCol="label", maxIter=25, regParam=penalty).fit(featured)
    featured.unpersist()
    return model


def _vectors(rows: DataFrame, bits: int) -> DataFrame:
    made = rows.withColumn("grams", F.array_distinct(grams(host_of(F.col("url")), path_of(F.col("url")))))
    return HashingTF(inputCol="grams", outputCol="x", numFeatures=1 << bits, binary=True).transform(made)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], model: LogisticRegressionModel | None, id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """Verdict for each row: ``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``score``.

    ``verdict`` is the rule's, or block if the regression's probability
    (``score``) exceeds ``threshold``, else allow.  A null or malformed URL has
    an empty host and path and is judged by the regression on them.  Without a
    model the score is 0.
    """
    url = F.coalesce(F.col(url_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), url.alias("url")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rows = rows.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    if model is None:
        scored = rows.withColumn("score", F.lit(0.0))
    else:
        scored = model.transform(_vectors(rows, model.numFeatures.bit_length() - 1)).withColumn("score", vector_to_array("probability")[1])
    return scored.select("page_id", "host", "path", F.col("hit.rule").alias("rule"),
                         F.coalesce("hit.verdict", F.when(F.col("score") > threshold, "block").otherwise("allow")).alias("verdict"), "score")
