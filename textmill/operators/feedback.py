"""Learning from accepted feedback, packing of blocks, and handlers by name."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizerModel, IndexToString, NGram, RegexTokenizer, SQLTransformer, StopWordsRemover, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from .scratch import sized, written


def learn(patterns: list[dict], keywords: set[str], keep: int) -> list[dict]:
    """Adds to the first pattern that shares two keywords, or makes one; the ``keep`` most frequent stay."""
    same = next((p for p in patterns if len(p["keywords"] & keywords) >= 2), None)
    if same:
        same["count"] += 1
        return patterns
    return sorted([*patterns, {"keywords": keywords, "count": 1}], key=lambda p: -p["count"])[:keep]


def learned_patterns(feedback: DataFrame, keep: int = 20) -> DataFrame:
    """feedback(category, event_id, keywords) of accepted entries -> patterns of each category. The order of
    events decides: Spark sorts each category's rows, and only ``keep`` patterns go from batch to batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, patterns = None, []

        def made() -> pa.RecordBatch:
            words, counts = [",".join(sorted(p["keywords"])) for p in patterns], [p["count"] for p in patterns]
            return pa.RecordBatch.from_arrays([pa.array([key] * len(words), pa.string()), pa.array(words, pa.string()), pa.array(counts, pa.int64())], ["category", "keywords", "success_count"])

        for b in batches:
            for category, keywords in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if patterns and category != key:
                    yield made()
                    patterns = []
                key, patterns = category, learn(patterns, set(keywords), keep)
        if patterns:
            yield made()

    rows = feedback.repartition("category").sortWithinPartitions("category", "event_id").select("category", "keywords")
    return rows.mapInArrow(run, "category string, keywords string, success_count long")


def packed(blocks: DataFrame, most: int = 1500, overlap: int = 100) -> DataFrame:
    """blocks(path, block, text) -> chunks of up to ``most`` characters; a chunk begins with the lines of the
    one before that fit ``overlap``. A block over the limit is cut at lines. What is carried over starts
    anew with each chunk, so a file is packed in one group."""

    def tail(lines: list[str]) -> list[str]:
        out: list[str] = []
        for line in reversed(lines):
            if sum(map(len, out)) + len(out) + len(line) > overlap:
                break
            out.insert(0, line)
        return out

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        chunks, now = [], []
        for text in pdf.sort_values("block")["text"]:
            lines = text.split("\n")
            if now and sum(map(len, now)) + len(now) + len(text) > most:
                chunks.append(now)
                now = tail(now)
            for line in lines:
                if now and sum(map(len, now)) + len(now) + len(line) > most:
                    chunks.append(now)
                    now = tail(now)
                now.append(line)
        if now:
            chunks.append(now)
        return pd.DataFrame([(key[0], i, "\n".join(c)) for i, c in enumerate(chunks)], columns=["path", "chunk", "text"])

    return blocks.groupBy("path").applyInPandas(run, "path string, chunk int, text string")


def intent_model(labelled: DataFrame, features: int = 1000, text: str = "text", label: str = "intent", least: int = 5) -> PipelineModel:
    """TF-IDF of words and word pairs and logistic regression over labelled(text, intent); rows where either is null or
    empty are no samples, and under ``least`` samples it is an error. Adds probability, ``confidence`` (its largest) and ``predicted``."""
    usable = labelled.filter((F.col(text) != "") & (F.col(label) != ""))
    if (n := usable.limit(least).count()) < least:
        raise ValueError(f"intent_model: {n} samples, at least {least} are needed")
    index = StringIndexer(inputCol=label, outputCol="y", handleInvalid="skip").fit(usable)
    to_terms = PipelineModel([RegexTokenizer(inputCol=text, outputCol="words", pattern=r"[^\p{L}\p{N}_]+", minTokenLength=2), StopWordsRemover(inputCol="words", outputCol="terms")])
    terms = written(to_terms.transform(index.transform(usable)).select("y", "terms"), "intent-terms")  # texts are cut to words once
    grams = PipelineModel([NGram(n=2, inputCol="terms", outputCol="pairs"), SQLTransformer(statement="SELECT *, concat(terms, pairs) AS grams FROM __THIS__")])
    count = CountVectorizerModel.from_vocabulary(frequent_grams(terms, features) or [""], inputCol="grams", outputCol="tf")
    counted = written(count.transform(grams.transform(terms)).select("y", "tf"), "intent-counts")
    weigh = IDF(inputCol="tf", outputCol="x").fit(counted)
    learned = LogisticRegression(featuresCol="x", labelCol="y", maxIter=20, regParam=0.01).fit(weigh.transform(counted))
    return PipelineModel([*to_terms.stages, *grams.stages, count, weigh, learned, IndexToString(inputCol="prediction", outputCol="predicted", labels=index.labels)])


def frequent_grams(rows: DataFrame, most: int) -> list[str]:
    """The ``most`` most frequent words and pairs of neighbours in rows(terms), ties to the first by name. A pair is no more frequent than
    its rarer word, so once there are ``most`` words only pairs of words as frequent as the last of them are counted, not all pairs."""
    best = lambda df: [tuple(r) for r in df.orderBy(F.desc("n"), "gram").limit(most).collect()]
    words = written(rows.select(F.explode("terms").alias("gram")).groupBy("gram").agg(F.count("*").alias("n")), "intent-words")
    top = best(words)
    kept = words.filter(F.col("n") >= (top[-1][1] if len(top) == most else 1))
    few = sized(written(kept.select("gram"), "intent-kept"))
    both = F.arrays_zip(F.slice("terms", 1, F.greatest(F.lit(0), F.size("terms") - 1)).alias("a"), F.slice("terms", 2, F.size("terms")).alias("b"))
    pairs = rows.filter("size(terms) > 1").select(F.explode(both).alias("p")).select("p.a", "p.b")
    for side in ("a", "b"):
        pairs = pairs.join(few, F.col(side) == F.col("gram"), "left_semi")
    counted = pairs.groupBy("a", "b").agg(F.count("*").alias("n")).select(F.concat_ws(" ", "a", "b").alias("gram"), "n")
    return [g for g, _ in sorted([*top, *best(counted)], key=lambda x: (-x[1], x[0]))[:most]]


def intents(model: PipelineModel | None, rows: DataFrame, sure: float = 0.3, text: str = "text") -> DataFrame:
    """``rows`` with ``intent``, ``confidence`` and ``learned``: the model's intent where its probability is over ``sure``, else that
    of the keyword rules; without a model all come from the rules. Null and blank texts are general."""
    ruled = rules.intent(F.col(text))
    blank = F.coalesce(F.trim(text) == "", F.lit(True))
    if model is None:
        out = rows.withColumn("learned", F.lit(False))
        return out.withColumns({"intent": F.when(blank, "general").otherwise(ruled["intent"]), "confidence": ruled["confidence"].cast("double")})
    scored = model.transform(rows.withColumn(text, F.coalesce(text, F.lit("")))).withColumn("p", F.array_max(vector_to_array("probability")))
    learned = ~blank & (F.col("p") > sure)
    chosen = F.when(blank, "general").when(learned, F.col("predicted")).otherwise(ruled["intent"])
    more = {"learned": learned, "intent": chosen, "confidence": F.when(learned, F.col("p")).otherwise(ruled["confidence"].cast("double"))}
    return scored.select(*[scored[c] for c in rows.columns if c not in more], *[c.alias(n) for n, c in more.items()])


class Handlers:
    """Functions from frame to frame by name; rows go to the one named in their column ``handler``."""

    def __init__(self, default: str | None = None):
        self.default, self.by_name, self.about = default, {}, {}

    def register(self, name: str, handler: Callable[[DataFrame], DataFrame], **about: str) -> None:
        self.by_name[name], self.about[name] = handler, about

    def scalar(self, spark: SparkSession, name: str, function: Callable, returns: str, **about: str) -> Callable[..., Column]:
        """Registers a function of values, by batches of pandas Series: in SQL by its name, here as a function of columns."""
        self.about[name] = about
        return spark.udf.register(name, F.pandas_udf(function, returns))

    def names(self, **about: str) -> list[str]:
        """Names in the order of registration, of those whose metadata hold all that is asked."""
        return [n for n in self.by_name if about.items() <= self.about[n].items()]

    def execute(self, rows: DataFrame) -> DataFrame:
        if not self.by_name:
            raise ValueError("no handler is registered")
        other = self.default if self.default in self.by_name else next(iter(self.by_name))
        to = F.when(F.col("handler").isin([*self.by_name]), F.col("handler")).otherwise(other)
        routed, out = rows.withColumn("handler", to), None
        for name, handler in self.by_name.items():
            part = handler(routed.filter(F.col("handler") == name))
            out = part if out is None else out.unionByName(part)
        return out
