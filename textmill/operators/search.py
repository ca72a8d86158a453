"""Keyword, Jaccard, TF-IDF, structural and hybrid search of many queries at once.

Postings are a long table (token, id, tf); queries meet them in an equi-join on the token, so
the work follows the matching postings. Scores are summed per query and document, and the best k
of each query are taken by a ranked window, which Spark limits in each task before the shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import tokens as T
from .scratch import dealt, sized, written


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None) -> DataFrame:
    """(id, token, tf): token frequency of each document. Texts are dealt by id once; counts, sizes and norms
    of a document then need no shuffle of their own. An inner explode would have Spark infer a filter on the array's size and make
    the tokens three times; an outer one makes them once."""
    t = tokens if tokens is not None else T.code_tokens(F.col(text_col))
    return dealt(docs, id_col).select(F.col(id_col).alias("id"), F.explode_outer(t).alias("token")).filter("token IS NOT NULL").groupBy("id", "token").agg(F.count("*").alias("tf"))


def query_tokens(queries: DataFrame, qid: str = "item_id", text_col: str = "text", tokens: Column | None = None) -> DataFrame:
    t = tokens if tokens is not None else T.code_tokens(F.col(text_col), numbers=False)
    return queries.select(F.col(qid).alias("qid"), F.explode(F.array_distinct(t)).alias("token"))


def top_k(scored: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The best k of each query, ties to the smaller id."""
    rank = F.row_number().over(W.partitionBy("qid").orderBy(F.desc(score), "id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def token_sets(docs: DataFrame, id_col: str, text_col: str = "text", tokens: Column | None = None, keep: tuple[str, ...] = (), name: str = "id") -> DataFrame:
    """(``name``, n, token and ``keep``): the distinct tokens of each row and their number; nothing is shuffled."""
    t = tokens if tokens is not None else T.code_tokens(F.col(text_col))
    sets = docs.select(F.col(id_col).alias(name), *keep, F.array_distinct(t).alias("set"))
    return sets.select(name, *keep, F.size("set").alias("n"), F.explode_outer("set").alias("token")).filter("token IS NOT NULL")


def meetings(sets: DataFrame, asked: DataFrame, *keep: str) -> DataFrame:
    """(qid, id, both, n, m and ``keep``) of queries and documents with common tokens: how many, and how many each has. The
    queries' tokens are written first; if they are few, documents drop the others before anything is shuffled."""
    few = sized(written(asked.select("qid", F.col("n").alias("m"), "token"), "asked"))
    return sets.join(few, "token").groupBy("qid", "id").agg(F.count("*").alias("both"), *[F.max(c).alias(c) for c in ("n", "m", *keep)])


def jaccard_of(met: DataFrame) -> DataFrame:
    return met.select("qid", "id", F.round(F.col("both") / (F.col("n") + F.col("m") - F.col("both")), 6).alias("score"))


def keyword_scores(posts: DataFrame, asked: DataFrame, weight: Column | None = None) -> DataFrame:
    """score: distinct query tokens that the document holds, times its weight."""
    return asked.hint("merge").join(posts, "token").groupBy("qid", "id").agg(F.sum(weight if weight is not None else F.lit(1)).cast("double").alias("score"))


def jaccard_scores(posts: DataFrame, asked: DataFrame) -> DataFrame:
    """Share of the distinct tokens of query and document that are in both."""
    sizes = posts.groupBy("id").agg(F.count("*").alias("n"))
    asked_n = asked.groupBy("qid").agg(F.count("*").alias("m"))
    both = asked.hint("merge").join(posts, "token").groupBy("qid", "id").agg(F.count("*").alias("both"))
    return both.hint("merge").join(sizes, "id").hint("merge").join(asked_n, "qid").select("qid", "id", F.round(F.col("both") / (F.col("n") + F.col("m") - F.col("both")), 6).alias("score"))


def idf(posts: DataFrame, total: DataFrame, smooth: bool) -> DataFrame:
    """Inverse document frequency: ln(N / (df + 1)) + 1 if smooth, else ln(N / df). total(n): one row."""
    df = posts.groupBy("token").agg(F.count("*").alias("df")).join(F.broadcast(total))
    return df.select("token", "df", _idf(F.col("df"), F.col("n"), smooth).alias("idf"))


def _idf(df: Column, n: Column | int, smooth: bool) -> Column:
    return F.log(F.lit(n) / (df + 1)) + 1 if smooth else F.log(F.lit(n) / df)


def _in_groups(docs: DataFrame, id_col: str, text_col: str, tokens: Column, each: int) -> tuple[DataFrame, int]:
    """(id, tokens, g) and the number of groups: texts dealt by id to groups of about ``each`` and 16 MB, as many as the table needs."""
    n, size = docs.agg(F.count("*"), F.sum(F.octet_length(text_col))).first()
    groups = max(1, -(-n // each), (size or 0) >> 24)
    return docs.select(F.col(id_col).alias("id"), tokens.alias("tokens"), _part(id_col, groups).alias("g")), groups


def _part(c: str, m: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(m)).cast("int")


def _every(m: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(m - 1)))


def _counted(texts: pa.Table) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts(id, tokens): the ids from the smallest, null first, and the tokens; and for each id and token that meet, by id, their places
    in these and how often they do. Rows of one id are one text."""
    ids = texts["id"].combine_chunks().dictionary_encode(null_encoding="encode")
    order = pc.sort_indices(ids.dictionary, null_placement="at_start")
    place = np.empty(len(order), int)
    place[order.to_numpy()] = np.arange(len(order))
    lists = texts["tokens"].combine_chunks()
    flat = lists.flatten().dictionary_encode()
    row = np.repeat(place[ids.indices.to_numpy()], lists.value_lengths().fill_null(0))
    pairs, tf = np.unique(row * max(1, len(flat.dictionary)) + flat.indices.to_numpy(), return_counts=True)
    row, of = np.divmod(pairs, max(1, len(flat.dictionary)))
    return ids.dictionary.take(order), flat.dictionary, row, of, tf


def _token_counts(key: tuple, texts: pa.Table) -> pa.Table:
    _, tokens, _, of, _ = _counted(texts)
    return pa.table({"g": pa.array(np.full(len(tokens), key[0].as_py()), pa.int32()), "token": tokens, "n": np.bincount(of, minlength=len(tokens))})


def _cosine_best(k: int, least: float, weigh_documents: bool, slice_rows: int = 256):
    """Of one group of texts and one block of queries: the best k texts of each query. Rows of ``weights`` without a qid are the idf of the group's
    tokens. Of a slice's texts the products are summed by text and query where they meet in a token."""

    def best(key: tuple, texts: pa.Table, weights: pa.Table) -> pa.Table:
        ids, tokens, row, of, tf = _counted(texts)
        own, asked = weights.filter(pc.is_null(weights["qid"])), weights.filter(pc.is_valid(weights["qid"]))
        first = np.flatnonzero(np.diff(row, prepend=-1))
        most = np.zeros(len(ids))
        most[row[first]] = (np.add if weigh_documents else np.maximum).reduceat(tf, first) if len(first) else 0
        w = tf / most[row]
        if weigh_documents:
            w *= own["w"].to_numpy()[pc.index_in(tokens, own["token"].combine_chunks()).to_numpy(zero_copy_only=False)[of].astype(int)]
        norm = np.sqrt(np.bincount(row, w * w, len(ids)))
        norm[ids.is_null().to_numpy(zero_copy_only=False)] = 0  # a text without an id counts for frequencies only
        qids = asked["qid"].combine_chunks().dictionary_encode()
        wq, q = asked["w"].to_numpy(), qids.indices.to_numpy()
        qnorm = np.sqrt(np.bincount(q, wq * wq, len(qids.dictionary)))
        at = pc.index_in(asked["token"].combine_chunks(), tokens).fill_null(len(tokens)).to_numpy()
        asks = np.argsort(at, kind="stable")
        n = np.bincount(at, minlength=len(tokens) + 1)
        begin, out = np.cumsum(n) - n, []
        for a in range(0, len(ids), slice_rows):
            size = min(slice_rows, len(ids) - a), len(qnorm)
            part = slice(*np.searchsorted(row, [a, a + slice_rows]))
            each = n[of[part]]
            hit = asks[np.repeat(begin[of[part]] - (np.cumsum(each) - each), each) + np.arange(each.sum())]
            dot = np.bincount(np.repeat(row[part] - a, each) * size[1] + q[hit], np.repeat(w[part], each) * wq[hit], size[0] * size[1]).reshape(size)
            norms = norm[a : a + size[0], None] * qnorm
            scores = np.round(np.divide(dot, norms, out=np.zeros(size), where=norms > 0), 6)
            top = np.argsort(-scores, axis=0, kind="stable")[:k]
            who = np.broadcast_to(np.arange(size[1]), top.shape)
            good = scores[top, who] >= least
            out.append((who[good], a + top[good], scores[top, who][good]))
        who, i, x = (np.concatenate(c) for c in zip(*out)) if out else ([np.zeros(0, int)] * 2 + [np.zeros(0)])
        return pa.table({"qid": qids.dictionary.take(pa.array(who)), "id": ids.take(pa.array(i)), "score": x})

    return best


def cosine_top(docs: DataFrame, asked_tf: DataFrame, k: int, least: float, weigh_documents: bool, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None, each: int = 4_000, block: int = 250) -> DataFrame:
    """Cosine of TF-IDF vectors: the best k texts of each query of asked_tf(qid, token, tf) that score ``least``, which is over 0, or more.
    Frequencies of a text are divided by its largest, and only the query has idf, ln(N / df); if ``weigh_documents``, they are divided by their
    sum, and both have idf, ln(N / (df + 1)) + 1. Texts are dealt in groups of about ``each`` and 16 MB. A group sends its distinct tokens with the
    number of texts that hold each, gets their idf back, and only its best leave it: neither postings nor hits are shuffled."""
    texts, groups = _in_groups(docs, id_col, text_col, tokens if tokens is not None else T.code_tokens(F.col(text_col)), each)
    types = {f.name: f.dataType.simpleString() for f in [*texts.schema, *asked_tf.schema]}
    counts = texts.repartition(groups, "g").groupBy("g").applyInArrow(_token_counts, "g int, token string, n long")
    share = (F.sum if weigh_documents else F.max)("tf").over(W.partitionBy("qid"))
    asked = written(asked_tf.withColumn("share", F.col("tf") / share), "asked")
    few = sized(asked.select("token").distinct())
    if weigh_documents:
        counts = written(counts, "token-counts")
    df = counts.join(few, "token", "left_semi").groupBy("token").agg(F.sum("n").alias("df"))
    idf = _idf(F.col("df"), docs.count(), weigh_documents)
    q = asked.hint("merge").join(df, "token", "left").select("qid", "token", (F.col("share") * F.coalesce(idf, F.lit(1.0 if weigh_documents else 0.0))).alias("w"))
    blocks = max(1, -(-asked.select("qid").distinct().count() // block))
    weights = written(q.filter("qid IS NOT NULL").withColumn("b", _part("qid", blocks)), "asked-weights").withColumn("g", _every(groups))
    if weigh_documents:
        own = counts.select("g", "token", _idf(F.sum("n").over(W.partitionBy("token")), docs.count(), True).alias("w"))
        weights = weights.unionByName(own.withColumn("b", _every(blocks)).withColumn("qid", F.lit(None).cast(types["qid"])))
    dealt_out = lambda df: df.repartition(groups * blocks, "g", "b").groupBy("g", "b")
    met = dealt_out(texts.withColumn("b", _every(blocks))).cogroup(dealt_out(weights))
    return top_k(met.applyInArrow(_cosine_best(k, least, weigh_documents), f"qid {types['qid']}, id {types['id']}, score double"), k)


def containing(vocabulary: DataFrame, words: DataFrame) -> DataFrame:
    """Pairs (token, word) of which one holds the other. A word of three characters or more that
    holds another holds its first trigram: an equi-join on trigrams instead of all pairs."""
    grams = lambda c: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(c, i, 3)))).alias("g")
    first = lambda c: F.substring(c, 1, 3).alias("g")
    v, w = F.col("token"), F.col("word")
    long_v, long_w = vocabulary.filter(F.length(v) >= 3), words.filter(F.length(w) >= 3)
    inside = long_v.select("token", grams(v)).hint("merge").join(long_w.select("word", first(w)), "g").filter(F.contains(v, w))
    around = long_v.select("token", first(v)).hint("merge").join(long_w.select("word", grams(w)), "g").filter(F.contains(w, v))
    return inside.select("token", "word").unionByName(around.select("token", "word")).distinct()


def first_holding(named: DataFrame, words: DataFrame, k: int) -> DataFrame:
    """named(id, token), words(word) -> (word, id): the ``k`` smallest ids of tokens that hold the word. Ids are limited for each
    token, then for each word, in each task before the shuffle, so work grows with the tokens' rows and not with the hits."""
    first = lambda df, key: df.withColumn("r", F.row_number().over(W.partitionBy(key).orderBy("id"))).filter(F.col("r") <= k).drop("r")
    ids = first(named.select("token", "id").distinct(), "token")
    pairs = containing(named.select("token").distinct(), words.select("word").distinct()).filter(F.contains("token", "word"))
    return first(pairs.hint("merge").join(ids, "token").select("word", "id").distinct(), "word")


def with_knowledge(scored: DataFrame, known: DataFrame) -> DataFrame:
    """Jaccard scores over 0.1; those of knowledge, the ids of ``known``, over 0.15 and with 0.1 more."""
    marked = scored.hint("merge").join(known.select("id", F.lit(True).alias("known")), "id", "left")
    own = F.coalesce("known", F.lit(False))
    return marked.filter(F.col("score") > F.when(own, 0.15).otherwise(0.1)).select("qid", "id", F.round(F.col("score") + F.when(own, 0.1).otherwise(0.0), 6).alias("score"))


def _substring_best(k: int, slice_rows: int = 256):
    """Of one group of texts and one block of queries: the best k texts of each query. A word's hits are looked up once: whole among the
    pieces of query words, and by its trigrams among their beginnings. Of a slice's texts they are summed by query word, then by query."""

    def best(key: tuple, texts: pa.Table, asked: pa.Table) -> pa.Table:
        qids, words = asked["qid"].combine_chunks().dictionary_encode(), asked["word"].combine_chunks().dictionary_encode()
        named = words.dictionary.to_pylist()
        times = np.zeros((len(named), len(qids.dictionary)))
        np.add.at(times, (words.indices.to_numpy(), qids.indices.to_numpy()), asked["times"].to_numpy())
        holders, begins = {}, {}
        for w, word in enumerate(named):
            begins.setdefault(word[:3], []).append(w)
            for piece in {word[i:j] for i in range(len(word)) for j in range(i + 3, len(word) + 1)}:
                holders.setdefault(piece, []).append(w)

        def hits(token: str) -> list[int]:
            return holders.get(token, []) + [w for g in {token[i : i + 3] for i in range(len(token) - 2)} for w in begins.get(g, ()) if named[w] in token and named[w] != token]

        ids, tokens, row, of, tf = _counted(texts)
        tokens = tokens.to_pylist()
        found = [hits(token) for token in tokens]
        n = np.fromiter(map(len, found), int, len(found))
        word = np.fromiter((w for ws in found for w in ws), int, n.sum())
        share = np.fromiter((1.5 if named[w] == token else 0.5 for token, ws in zip(tokens, found) for w in ws), float, n.sum())
        first, out = np.cumsum(n) - n, []
        for at in range(0, len(ids), slice_rows):
            a, b = np.searchsorted(row, [at, at + slice_rows])
            each = n[of[a:b]]
            hit = np.repeat(first[of[a:b]] - (np.cumsum(each) - each), each) + np.arange(each.sum())
            size = min(slice_rows, len(ids) - at), len(named)
            held = np.bincount(np.repeat(row[a:b] - at, each) * size[1] + word[hit], np.repeat(tf[a:b], each) * share[hit], size[0] * size[1])
            scores = held.reshape(size) @ times
            top = np.argsort(-scores, axis=0, kind="stable")[:k]
            q = np.broadcast_to(np.arange(scores.shape[1]), top.shape)
            good = scores[top, q] > 0
            out.append((q[good], at + top[good], scores[top, q][good]))
        q, i, x = (np.concatenate(c) for c in zip(*out)) if out else ([np.zeros(0, int)] * 2 + [np.zeros(0)])
        return pa.table({"qid": qids.dictionary.take(pa.array(q)), "id": ids.take(pa.array(i)), "score": x})

    return best


def substring_top(docs: DataFrame, asked: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None, each: int = 4_000, block: int = 250) -> DataFrame:
    """0.5 for every place of an index word that holds a query word or is held by one, and 1 more for equal ones: the best k texts
    of each query in asked(qid, token). Texts are dealt once, in groups of about ``each`` and 16 MB, and meet blocks of about ``block`` queries
    there; only the best of a group leave it, so neither words nor hits are shuffled. Words under three characters count nothing."""
    t = F.filter(tokens if tokens is not None else T.code_tokens(F.col(text_col)), lambda x: F.length(x) >= 3)
    texts, groups = _in_groups(docs, id_col, text_col, t, each)
    blocks = max(1, -(-asked.select("qid").distinct().count() // block))
    texts = texts.withColumn("b", _every(blocks))
    words = asked.filter(F.length("token") >= 3).groupBy("qid", F.col("token").alias("word")).agg(F.count("*").alias("times")).withColumn("b", _part("qid", blocks))
    words = written(words, "asked-words").withColumn("g", _every(groups))
    types = {f.name: f.dataType.simpleString() for f in [*texts.schema, *words.schema]}
    best = texts.groupBy("g", "b").cogroup(words.groupBy("g", "b")).applyInArrow(_substring_best(k), f"qid {types['qid']}, id {types['id']}, score double")
    return top_k(best, k)


def structural_scores(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """docs(id, name), queries(qid, target): 1.0 where the lower-cased name holds the target. Targets are
    words, so names are cut to words and met by the trigram join."""
    name = docs.select("id", F.lower("name").alias("token"))
    pairs = containing(name.select("token").distinct(), queries.select(F.lower("target").alias("word")).distinct()).filter(F.contains("token", "word"))
    return queries.select("qid", F.lower("target").alias("word")).hint("merge").join(pairs, "word").hint("merge").join(name, "token").groupBy("qid", "id").agg(F.lit(1.0).alias("score"))


def hybrid(keyword: DataFrame, jaccard: DataFrame, structural: DataFrame, k: int) -> DataFrame:
    """0.3 keyword and 0.5 Jaccard, the best 2k of each, and 0.8 structural, the best k: summed, best k."""
    parts = [(keyword, 0.3, 2 * k), (jaccard, 0.5, 2 * k), (structural, 0.8, k)]
    rows = None
    for scored, weight, most in parts:
        part = top_k(scored, most).select("qid", "id", (F.col("score") * weight).alias("score"))
        rows = part if rows is None else rows.unionByName(part)
    return top_k(rows.groupBy("qid", "id").agg(F.round(F.sum("score"), 6).alias("score")), k)


def signature(posts_with_place: DataFrame, n: int = 10) -> DataFrame:
    """(id, token, tf, first) -> the n most frequent tokens joined by ':', ties to the first seen."""
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc("tf"), "first"))
    best = posts_with_place.withColumn("r", rank).filter(F.col("r") <= n)
    return best.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "token"))), lambda x: x.token), ":").alias("signature"))


def without(posts: DataFrame, gone: DataFrame) -> DataFrame:
    """Postings after documents were removed: gone(id)."""
    return posts.hint("merge").join(gone, "id", "left_anti")
