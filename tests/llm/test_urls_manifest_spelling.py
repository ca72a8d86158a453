"""URL filters, Merkle manifest and spelling variants against plain Python, and their edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmill.llm import entries, merkle, spelling, urlfilter

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
URLS = [
    "https://WWW.Example.NET/en/1?q=1#top", "http://net/", "http://net", "ftp://a.net?x=/en/", "http://example.net/en", "http://xexample.net/en/2", "https://example.com/de/", "https://example.com/DE/",
    "https://m.example.com/de/x/://y", "http://a.org/fr/#", "http://org/fr/9", "http://torg/fr/9", "mailto:someone", "", None, "://", "http:///de/", "http://example.com#/de/", "x://y://z/a", "http://Ünï.org/fr/\nz?a", "http://a.net/" + "p" * 20_000,
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    return host.translate(LOW), path


def rule_of(host, path, rules):
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return min(fit, key=lambda r: (-len(r.text), -len(r.host), r.verdict != "block"), default=None)


def test_hosts_paths_rules_and_scores_equal_plain_python(spark):
    df = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate([*URLS, URLS[0]])] + [(None, URLS[0], "h", "v")], "page_id long, url string, host string, verdict string")
    rules = entries.URL_RULES
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    model = urlfilter.fit(urlfilter.labelled_by_rules(pages, rules))
    got = urlfilter.judge(df, rules, model).collect()
    assert len(got) == len(URLS) + 2
    weights, bias = model.regression.coefficients.toArray(), model.regression.intercept
    for r in got:
        host, path = parts(URLS[0] if r.page_id is None or r.page_id == len(URLS) else URLS[r.page_id])
        rule = rule_of(host, path, rules)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule.text)
        z = bias
        for mark, text in (("h", f"^^{host}$$"), ("p", f"^^{path}$$")):
            z += sum(weights[model.hashing.indexOf(mark + text[i : i + n])] for n in (3, 4) for i in range(len(text) - n + 1))
        assert r.score == pytest.approx(1 / (1 + np.exp(-z)))
        assert r.verdict == (rule.verdict if rule else "block" if r.score >= 0.5 else "allow")


def test_the_model_carries_rules_over_to_urls_kept_back(spark):
    pages, rules = spark.read.parquet("/root/testdata/sf0.1/pages.parquet"), entries.URL_RULES
    back = F.crc32("url") % 4 == 2
    labelled = urlfilter.labelled_by_rules(pages.filter(~back), rules, 300)
    assert max(r["count"] for r in labelled.groupBy("blocked").count().collect()) == 300
    rows = urlfilter.judge(pages.filter(back), rules, urlfilter.fit(labelled)).filter("rule IS NOT NULL").collect()
    assert len(rows) > 100 and sum((r.score >= 0.5) == (r.verdict == "block") for r in rows) / len(rows) > 0.97


def test_labels_of_one_verdict_or_none(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x"), (2, "http://b.net/x")], "page_id long, url string")
    verdict = lambda labels: {r.page_id: r.verdict for r in urlfilter.judge(pages, entries.URL_RULES, urlfilter.fit(labels)).collect()}
    labels = spark.createDataFrame([("a", "/", 1), ("b", "/", 1)], urlfilter.SCHEMA)
    assert verdict(labels) == {1: "block", 2: "block"}
    assert verdict(labels.limit(0)) == {1: "allow", 2: "block"}
    assert urlfilter.judge(pages.limit(0), [], urlfilter.fit(labels)).count() == 0


# 12


def digest(texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf(row):
    return digest("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row)


def tree(level):
    """All levels of a tree of fan-out eight."""
    out = [level]
    while len(out[-1]) > 1:
        out.append([digest(out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def by_hand(rows):
    """rows: (doc_id, source, lang, n_chars, text) -> sorted (doc_id, leaf, subroot, root, proof, folded, verified)"""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    sort = lambda g: sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {g: tree([leaf(r) for r in sort(g)]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, r in enumerate(sort(g)):
            way, changed = [], r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                changed = (*r[:4], r[4] and r[4].translate(LOW))
            h = leaf(changed)
            for levels, at in ((trees[g], i), (top, k)):
                for level in levels[:-1]:
                    run, slot = level[at - at % 8 : at - at % 8 + 8], at % 8
                    way += run[:slot] + run[slot + 1 :]
                    h = digest([*run[:slot], h, *run[slot + 1 :]])
                    at //= 8
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], digest(way), h, h == top[-1][0]))
    return sorted(out, key=repr)


FIELDS = "doc_id long, source string, lang string, n_chars int, text string, pos long, h string"


def made(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], FIELDS)
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    out = merkle.manifest(df, entries.MANIFEST_FIELDS, changed)
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def plain(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("sizes", [[1], [1, 1], [8, 9], [64, 65, 1, 7, 2, 3, 3, 8, 17], [4097, 3], [4096]])
def test_trees_of_many_sizes_equal_plain_python(spark, sizes):
    rows = [(1000 * k + i * 7 % 4999, f"s{i % 3}", f"g{k}é", i, f"Text {i} É") for k, n in enumerate(sizes) for i in range(n)]
    assert plain(made(spark, rows)) == by_hand(rows)


def test_manifest_of_odd_rows(spark):
    rows = [(1, "a", None, 3, "Abc"), (1, "a", None, 3, "Abc"), (None, "a", "en", 3, "ABC"), (None, None, "en", None, None), (2, "a", "", 3, ""), (3, "a", "-", 0, "x" * 300_000), (1, "b", "en", 1, "Z"), (-5, "b", "en", 1, "Z")]
    assert plain(made(spark, rows)) == by_hand(rows)
    assert plain(made(spark, [])) == []


def test_manifest_of_the_documents(spark):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = plain(entries.QUERIES["op12_merkle"](spark, SF))
    assert got == by_hand(rows) and {r[-1] for r in got} == {True, False}


# 13


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_hand(counts):
    words = sorted(counts)
    form, n_near = {}, {}
    for w in words:
        others = [o for o in words if near(w, o)]
        n_near[w] = len(others)
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        if best and counts[best] >= 5 * counts[w]:
            form[w] = best
    out = []
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, counts[w], n_near[w], counts[form[w]] if w in form else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("tile", [512, 2])
def test_near_words_equal_all_pairs(spark, tile):
    rng = random.Random(tile)
    counts = {}
    for _ in range(60):
        base = "".join(rng.choice("abàé") for _ in range(rng.randint(6, 14)))
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                i = rng.randrange(len(w))
                w[i : i + 1] = rng.choice([[], [rng.choice("abcßé")], [w[i], rng.choice("abß")]])
            if len(w) >= 6:
                counts["".join(w)] = rng.choice([5, 6, 30, 31, 160, 1000])
    counts |= {"aaaaaa" + "a" * k: 5 * 6**k for k in range(6)} | {"xyzxyz" * 60: 5, "xyzxyz" * 60 + "x": 50, "z" + "xyzxyz" * 60: 50}  # a chain of forms, long words, a tie
    got = spark.createDataFrame(list(counts.items()), "word string, n long")
    near_rows = {r.word: (r.n_near, r.best_n, r.best) for r in spelling.near_words(got, tile=tile).collect()}
    want = variants_by_hand(counts)
    assert {w: (n, counts[b], b) for w, n, b in ((w, sum(near(w, o) for o in counts), min((o for o in counts if near(w, o)), key=lambda o: (-counts[o], o), default=None)) for w in counts) if n} == near_rows
    forms = spark.createDataFrame([(r[0], r[1]) for r in want if r[1]], "word string, form string")
    assert {r.word: r.root for r in spelling.roots(forms).collect()} == {r[0]: r[2] for r in want if r[1]}


def test_buckets_cut_into_blocks_lose_no_pair(spark):
    words = [f"prefix{a}{b}suffix" for a in "abcdefghijklmnop" for b in "abcdefghijklmnop"] + [f"prefix{a}suffix" for a in "abcdefghijklmnop"]
    df = spark.createDataFrame([(w, 10 + i) for i, w in enumerate(words)], "word string, n long")
    runs = [{(r.word, r.n_near, r.best) for r in spelling.near_words(df, tile=t).collect()} for t in (3, 40, 512)]
    assert runs[0] == runs[1] == runs[2] == {(w, sum(near(w, o) for o in words), max((o for o in words if near(w, o)), key=words.index)) for w in words}


def test_spelling_of_odd_rows(spark):
    texts = ["Straße straßen", "LETTERS lettérs letters", None, "", "letters " * 40, "12345 abc", "y" * 90_000 + " tiny"]
    rows = [(i, t, 1, "w") for i, t in enumerate(texts)] + [(None, "letters lettrs " * 6, 1, "w"), (4, texts[4], 1, "w")]
    counts = {}
    for i, t, *_ in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", t or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                counts[run] = counts.get(run, 0) + 1
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, word string")
    got = sorted(map(tuple, spelling.variants(df).collect()), key=repr)
    assert got == variants_by_hand({w: n for w, n in counts.items() if n >= 5}) and len(got) == 2
    assert spelling.variants(df.limit(0)).count() == 0
