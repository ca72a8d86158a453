"""Context for questions out of a project's files: relevance, budgeted selection, light context, learned examples.

Many questions are served at once. What a question shares with a file (its name, its tags) is found by equi-joins on trigrams;
files that share nothing are ranked once for all questions, and only as many as the budget can hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import search as S
from .scratch import sized, written
from .windows import last_n

# Words of a question that asks for faults.
DEBUG_WORDS = ["fix", "issue", "bug", "crash", "error", "problem", "wrong", "broken", "list"]


def stem(path: Column) -> Column:
    """A path's last part in lower case without its last extension."""
    last = F.regexp_extract(F.lower(path), r"[^/]+$", 0)
    return F.when(last.rlike(r"^.+\.[^.]*$"), F.regexp_replace(last, r"\.[^.]*$", "")).otherwise(last)


def words_of(questions: DataFrame) -> DataFrame:
    """questions(qid, text) -> (qid, word): the distinct lower-cased words between white space."""
    return questions.select("qid", F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+"))).alias("word")).filter("word <> ''")


def held(words: DataFrame, names: DataFrame, around: bool) -> DataFrame:
    """words(qid, word), names(name) -> (qid, name): names that a question's word holds and, with ``around``, names that hold
    one of its words of more than three characters."""
    vocabulary = written(words.select(F.col("word").alias("token")).distinct(), "question-words")
    names = written(names.select(F.col("name").alias("word")).filter("word <> ''").distinct(), "names")
    holds = F.contains("token", "word")
    pairs = S.containing(vocabulary, names).filter(holds | ((F.length("token") > 3) & F.contains("word", "token")) if around else holds)
    grams = vocabulary.select("token", F.explode(F.array_distinct(_short_grams(F.col("token")))).alias("word"))
    short = grams.hint("merge").join(names.filter(F.length("word") < 3), "word").select("token", "word")
    found = pairs.select("token", "word").unionByName(short).distinct()
    return words.select("qid", F.col("word").alias("token")).hint("merge").join(found, "token").select("qid", F.col("word").alias("name")).distinct()


def _short_grams(text: Column) -> Column:
    at = F.sequence(F.lit(1), F.length(text))
    return F.concat(F.transform(at, lambda i: F.substring(text, i, F.lit(1))), F.transform(at, lambda i: F.substring(text, i, F.lit(2))))


def shared(questions: DataFrame, files: DataFrame, tags: DataFrame) -> DataFrame:
    """(qid, path, gain): 2 where the file's name stands in the question or holds one of its words of more than three
    characters, and 1 for each of the file's tags(path, tag) in the question. Tags are single words."""
    words = written(words_of(questions), "words")
    named = files.select("path", stem(F.col("path")).alias("name"))
    by_name = held(words, named, True).hint("merge").join(named, "name").select("qid", "path", F.lit(2.0).alias("gain"))
    low = tags.select("path", F.col("tag").alias("name")).distinct()
    by_tag = held(words, low, False).hint("merge").join(low, "name").select("qid", "path", F.lit(1.0).alias("gain"))
    return by_name.unionByName(by_tag).groupBy("qid", "path").agg(F.sum("gain").alias("gain"))


def relevant_files(questions: DataFrame, files: DataFrame, tags: DataFrame, scripts: DataFrame, k: int = 10) -> DataFrame:
    """(qid, path, score, rank): the ``k`` files of a question with a score over 0. A scene gains 1 for each script
    of scripts(scene, script) that the question names by its path."""
    words = written(words_of(questions), "words")
    low = scripts.select("scene", F.lower("script").alias("name")).distinct()
    scenes = held(words, low, False).hint("merge").join(low, "name").select("qid", F.col("scene").alias("path"), F.lit(1.0).alias("gain"))
    score = shared(questions, files, tags).unionByName(scenes).groupBy("qid", "path").agg(F.sum("gain").alias("score"))
    return last_n(score, ["qid"], [F.desc("score"), F.col("path")], k)


def selected_context(questions: DataFrame, files: DataFrame, tags: DataFrame, issues: DataFrame, scripts: DataFrame, budget: int = 8000) -> DataFrame:
    """(qid, files, context): files(path, content) in the order of their score, until the first that would exceed the budget; if
    that is the first of all, its beginning. Scores are what question and file share, 0.5 for each scene of
    scripts(scene, script) that uses the file and, where the question asks for faults, 0.5 for each of its issues(path, n). A file needs no score."""
    scenes = scripts.select("scene", F.col("script").alias("path")).distinct().groupBy("path").agg(F.count("*").alias("scenes"))
    sized_files = files.filter("content <> ''").select("path", F.length("content").alias("n_chars"))
    base = sized_files.hint("merge").join(scenes, "path", "left").hint("merge").join(issues.groupBy("path").agg(F.sum("n").alias("issues")), "path", "left").na.fill(0)
    asks = F.exists(F.array(*[F.lit(w) for w in DEBUG_WORDS]), lambda w: F.contains(F.lower("text"), w))
    kinds = base.select("path", "n_chars", F.explode(F.array(F.lit(False), F.lit(True))).alias("debug"), "scenes", "issues")
    kinds = written(kinds.select("debug", "path", "n_chars", (F.col("scenes") * 0.5 + F.when(F.col("debug"), F.col("issues") * 0.5).otherwise(0.0)).alias("base")), "files")
    # the files that a question without a match gets, and the one that crosses the budget: nothing after it can come in
    order = [F.desc("base"), F.col("path")]
    first = last_n(kinds, ["debug"], order, budget + 1)
    before = F.coalesce(F.sum("n_chars").over(W.partitionBy("debug").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    first = written(first.withColumn("before", before).filter(F.col("before") <= budget).select("debug", "path"), "first-files")
    asked = written(questions.select("qid", F.coalesce(asks, F.lit(False)).alias("debug")).distinct(), "asked")
    gains = written(shared(questions, sized_files, tags), "gains")
    rows = asked.join(sized(first), "debug").select("qid", "debug", "path").unionByName(gains.hint("merge").join(asked, "qid").select("qid", "debug", "path")).distinct()
    rows = rows.hint("merge").join(kinds, ["debug", "path"]).hint("merge").join(gains, ["qid", "path"], "left").withColumn("score", F.col("base") + F.coalesce("gain", F.lit(0.0)))
    best = last_n(rows, ["qid"], [F.desc("score"), F.col("path")], budget + 1)
    spent = F.sum("n_chars").over(W.partitionBy("qid").orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    best = best.withColumn("spent", spent).filter((F.col("spent") <= budget) | (F.col("rank") == 1))
    text = best.select("qid", "rank", "path", "spent").hint("merge").join(files.select("path", "content"), "path")
    cut = F.when(F.col("spent") > budget, F.concat(F.substring("content", 1, budget), F.lit("\n# [TRUNCATED]"))).otherwise(F.col("content"))
    part = F.concat(F.lit("### "), "path", F.lit("\n```gdscript\n"), cut, F.lit("\n```"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", part.alias("part")))), lambda x: x["part"]), "\n\n")  # the budget bounds it
    return text.groupBy("qid").agg(F.count("*").alias("files"), joined.alias("context"))


def light_context(questions: DataFrame, files: DataFrame, tags: DataFrame, expanded: DataFrame, budget: int = 300) -> DataFrame:
    """(qid, context): the file that a question names, the first ``name.gd`` in its text, with what ``expanded`` (target, pos, path) says
    it depends on; where it names none that is there, the most relevant file. Each file is a line of 150 characters, and files follow while
    the budget holds. Of files of one name the first path counts."""
    named = questions.select("qid", F.nullif(F.lower(F.regexp_extract("text", r"(?i)\b([\w_-]+\.gd)\b", 1)), F.lit("")).alias("name")).filter("name IS NOT NULL")
    at = files.select("path", F.regexp_extract(F.lower("path"), r"[^/]+$", 0).alias("name")).groupBy("name").agg(F.min("path").alias("target"))
    hit = written(named.hint("merge").join(at, "name").select("qid", "target"), "named-files")
    rest = questions.hint("merge").join(hit, "qid", "left_anti")
    none = files.sparkSession.createDataFrame([], "scene string, script string")
    best = relevant_files(rest, files, tags, none, 1).select("qid", F.lit(0).alias("pos"), "path")
    chosen = hit.hint("merge").join(expanded, "target").select("qid", "pos", "path").unionByName(best)
    line = F.concat(F.lit("["), "path", F.lit("] "), F.substring(F.replace(F.substring("content", 1, 200), F.lit("\n"), F.lit(" ")), 1, 150))
    parts = chosen.hint("merge").join(files.filter("content <> ''").select("path", "content"), "path").select("qid", "pos", line.alias("part"))
    run = F.sum(F.length("part") + 2).over(W.partitionBy("qid").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))  # a few files a question
    kept = parts.withColumn("run", run).filter(F.col("run") - 2 <= budget)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]), "\n\n")
    return kept.groupBy("qid").agg(F.substring(joined, 1, budget).alias("context"))


def learning_context(questions: DataFrame, history: DataFrame, patterns: DataFrame, last: int = 100, over: float = 0.3, k: int = 5) -> DataFrame:
    """questions(qid, category, general, text), history(event_id, query, fix, accepted), patterns(category, keywords, success_count) ->
    (qid, rank, kind, label, example, weight): what was learned in the question's category, then in its general one, and the accepted ones of
    the ``last`` entries that hold more than ``over`` of the question's words; the best ``k`` by success_count or ten times that share."""
    own = [questions.select("qid", F.col(c).alias("category"), F.lit(o).alias("kind")) for o, c in enumerate(["category", "general"])]
    learned = own[0].unionByName(own[1]).hint("merge").join(patterns, "category").select("qid", "kind", F.col("keywords").alias("label"), F.lit(None).cast("string").alias("example"), F.col("success_count").cast("double").alias("weight"), F.lit(0).cast("long").alias("at"))
    recent = history.orderBy(F.desc("event_id")).limit(last).filter("accepted")  # a bounded table
    ask = questions.select("qid", F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")).alias("w"))
    words = ask.select("qid", F.size("w").alias("n"), F.explode("w").alias("word"))
    told = recent.select("event_id", F.explode(F.array_distinct(F.filter(F.split(F.lower("query"), r"\s+"), lambda w: w != ""))).alias("word"))
    both = words.join(sized(written(told, "recent-words")), "word").groupBy("qid", "event_id").agg((F.count("*") / F.max("n")).alias("share")).filter(F.col("share") > over)
    few = recent.select("event_id", F.col("query").alias("label"), F.substring("fix", 1, 300).alias("example"))
    like = both.join(sized(written(few, "recent")), "event_id").select("qid", F.lit(2).alias("kind"), "label", "example", (F.col("share") * 10).alias("weight"), F.col("event_id").alias("at"))
    rows = last_n(learned.unionByName(like), ["qid"], [F.desc("weight"), F.col("kind"), F.col("at"), F.col("label")], k)
    return rows.select("qid", "rank", "kind", "label", "example", F.round("weight", 6).alias("weight"))
