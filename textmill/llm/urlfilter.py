"""URL filters: rules first, then logistic regression on hashed character n-grams of host and path.

A page's host and path are cut out of its url; the longest rule that fits decides. Urls that no rule fits are
judged by a logistic regression (`pyspark.ml`) on counts of hashed character 3- and 4-grams, those of the host and
those of the path apart. It is trained from a small labelled table of urls: `labelled_by_rules` takes at most
``per_verdict`` distinct urls of each verdict, the first by a hash, from those that rules decide, and so the model
carries the rules over to urls like them. Cutting, n-grams, rules and scores are expressions on a row: nothing but
the labelled urls is shuffled, and a hot host costs no more than any other.

Defined results: a null url or one without ``://`` has an empty host and an empty path, fits no rule and is judged by the
model all the same; repeated rows get equal results; rules of one length: the one with the longer host, then block, wins;
labels of one verdict only: that verdict; no labels: allow; an empty table gives an empty result; extra columns
are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ._scratch import written
from ._text import ascii_lower

SCHEMA = "host string, path string, blocked int"


@dataclass(frozen=True)
class Rule:
    """Fits a host and its subdomains where the path begins with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self) -> Column:
        host = F.col("host")
        return ((host == self.host) | host.endswith("." + self.host)) & F.col("path").startswith(self.path)


@dataclass
class Model:
    """P(block) of a url; ``regression`` is absent where the labels held one verdict or none."""

    hashing: HashingTF
    regression: LogisticRegressionModel | None
    always: float = 0.0


def split_url(url: Column) -> dict[str, Column]:
    """host and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    return {"host": ascii_lower(F.regexp_extract(rest, r"\A[^/?#]*", 0)), "path": F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)}


def _first_rule(rules: list[Rule]) -> list[Rule]:
    return sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.verdict != "block"))


def ruled(pages: DataFrame, rules: list[Rule], url_col: str = "url", *more: str) -> DataFrame:
    """(``more``, host, path, rule, verdict), the last two null where no rule fits."""
    cut = pages.select(*more, *[c.alias(n) for n, c in split_url(F.col(url_col)).items()])
    order = _first_rule(rules)

    def first(of) -> Column:
        return F.coalesce(*[F.when(r.fits(), F.lit(of(r))) for r in order], F.lit(None).cast("string"))

    return cut.withColumn("rule", first(lambda r: r.text)).withColumn("verdict", first(lambda r: r.verdict))


def _grams(text: Column, mark: str) -> Column:
    """The 3- and 4-grams of a text's code points, two marks at either end, taken apart once."""
    padded = F.concat(F.lit("^^"), F.coalesce(text, F.lit("")), F.lit("$$"))

    def of(chars: Column, n: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(chars) - n), lambda i: F.concat(F.lit(mark), *[chars[i + k] for k in range(n)]))

    return F.flatten(F.transform(F.array(F.split(padded, "")), lambda chars: F.concat(of(chars, 3), of(chars, 4))))


def with_grams(rows: DataFrame) -> DataFrame:
    return rows.withColumn("grams", F.concat(_grams(F.col("host"), "h"), _grams(F.col("path"), "p")))


def labelled_by_rules(pages: DataFrame, rules: list[Rule], per_verdict: int = 1000, url_col: str = "url") -> DataFrame:
    """(host, path, blocked): distinct urls that rules decide, ``per_verdict`` of each verdict at most."""
    known = ruled(pages, rules, url_col).filter(F.col("verdict").isNotNull()).select("host", "path", (F.col("verdict") == "block").cast("int").alias("blocked")).distinct()
    rank = F.row_number().over(W.partitionBy("blocked").orderBy(F.xxhash64("host", "path"), "host", "path"))  # each task keeps its first rows only
    return known.withColumn("rank", rank).filter(F.col("rank") <= per_verdict).drop("rank")


def fit(labelled: DataFrame, buckets: int = 1 << 14, strength: float = 1e-3) -> Model:
    """Trains on the small table (host, path, blocked); in one partition and order, so that equal tables give equal models."""
    small = written(labelled.select("host", "path", F.col("blocked").cast("double").alias("label")), "labelled-urls")
    hashing = HashingTF(inputCol="grams", outputCol="features", numFeatures=buckets)
    seen = sorted(r.label for r in small.select("label").distinct().collect())
    if len(seen) < 2:
        return Model(hashing, None, *seen)
    rows = with_grams(small.repartition(1).sortWithinPartitions("host", "path", "label"))
    learner = LogisticRegression(maxIter=60, regParam=strength, standardization=False)
    return Model(hashing, learner.fit(hashing.transform(rows).select("features", "label")))


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` (host, path and more) with ``score``, the probability that a url is to be blocked."""
    if model.regression is None:
        return rows.withColumn("score", F.lit(model.always))
    out = model.regression.transform(model.hashing.transform(with_grams(rows)))
    return out.select(*rows.columns, vector_to_array("probability")[1].alias("score"))


def judge(pages: DataFrame, rules: list[Rule], model: Model, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row."""
    rows = scored(ruled(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")), rules, "url", "page_id"), model)
    verdict = F.coalesce("verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
