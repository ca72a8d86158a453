"""The pipeline's stages one by one, each against plain Python on its own input."""

import base64
import random
import re

import numpy as np
import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from textmill.llm import decontam

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    junk = docs.limit(2).withColumn("doc_id", F.col("doc_id") + 10_000).withColumn("text", F.lit("123 456 !!"))
    docs.unionByName(junk).write.parquet(str(tmp_path / "sf/documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "sf/benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "sf/documents.parquet"))
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, str(tmp_path / "sf"))
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        check(name, before, after)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == columns
        before = after
    rows = lambda df: sorted((r.doc_id, r.n_tokens, bytes(r.packed), r.decoded_sha256) for r in df.collect())
    assert rows(corpus_pipeline.run(spark, str(tmp_path / "sf"))) == rows(before)


def check(name, before, after):
    old, new = {r.doc_id: r for r in before.collect()}, {r.doc_id: r for r in after.collect()}
    assert set(new) <= set(old)
    if name == "language_id":
        assert set(old) - set(new) == {i for i, r in old.items() if not re.search("[^\\W\\d_]", r.text)}
    if name == "line_dedup":
        holders = {}
        key = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for i, r in old.items():
            for x in r.text.split("\n"):
                holders.setdefault(key(x), set()).add(i)
        for i, r in old.items():
            kept = [x for x in r.text.split("\n") if len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)]) == i]
            assert new[i].text == "\n".join(kept) and new[i].n_chars == len(new[i].text)
    if name == "near_dedup":
        shingles = {}
        for i, r in old.items():
            w = r.text.lower().split()
            shingles[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}
        alike = lambda a, b: len(shingles[a] & shingles[b]) / max(1, len(shingles[a] | shingles[b]))
        gone = set(old) - set(new)
        assert all(any(alike(i, j) > 0.6 for j in old if j < i) for i in gone)  # clean documents stay
        copies = {(a, b) for a in new for b in new if a < b and alike(a, b) > 0.95}
        assert not copies
    if name == "decontamination":
        items = [(r.item_id, r.text) for r in after.sparkSession.read.parquet(f"{SF}/benchmark.parquet").collect()]
        for i, r in old.items():
            if any(t in r.text for _, t in items):
                assert i not in new
        index = decontam.Index(items, 8, 64, 0.1, 24)
        assert all((i in new) == (not index.regions(decontam.fold(r.text)[0])) for i, r in old.items())
    if name == "byte_bpe":
        with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        assert set(old) == set(new)
        for i, r in old.items():
            assert bytes(new[i].packed) == np.array(e.encode_ordinary(r.text), "<u4").tobytes() and new[i].n_tokens * 4 == len(new[i].packed)


WORDS = re.compile("[^\\x20\\x09-\\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORDS.findall((text or "").translate(UPPER))
    return frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()


def groups(texts):
    """Smallest id of each document's component at a Jaccard similarity of 0.8, from all pairs; documents without words are one."""
    ids, sets, top = sorted(texts), {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both * 9 >= 4 * (len(sets[a]) + len(sets[b])):  # 0.8 or more of the union
                top[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in ids}


def test_near_dedup_equals_all_pairs_on_documents_and_families_of_copies(spark):
    rng = random.Random(9)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    for f in range(2):
        base = [word() for _ in range(150)]
        for i in range(120):
            copy = list(base)
            for _ in range(rng.randrange(5)):
                copy[rng.randrange(150)] = word()
            texts[10_000 + 1000 * f + i] = " ".join(copy)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    left = {r.doc_id for r in corpus_pipeline.STAGES[2][1](spark, df, SF).collect()}
    want = groups(texts)
    assert left == set(want.values()) and len(texts) - len(left) > 200


ODD = [
    (1, "A first line of text here\nsecond line of the text", "en"), (1, "A first line of text here\nsecond line of the text", "en"), (2, "  a FIRST line of text here\t\nother", "en"), (3, None, None),
    (4, "", "de"), (None, "text without an id and nothing else", "fr"), (5, "\n\n", None), (6, " ".join(f"word{i % 977}" for i in range(30_000)), "en"),
]
CLASHING = "doc_id long, text string, lang string, source string, n_chars int, row int, rk string, h1 long, id long, root long, s string, fp string, gone int, cell int, pos int"


def test_stages_on_odd_rows(spark):
    """Nulls, empty and very long texts, repeated rows, an empty table and columns named like the operators' own."""
    rows = [(*r, "src", len(r[1] or ""), 1, "a", 2, 3, 4, "b", "c", 5, 6, 7) for r in ODD]
    odd, nothing = spark.createDataFrame(rows, CLASHING), spark.createDataFrame([], CLASHING)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF)
        kept[name] = out.collect()
        assert stage(spark, nothing, SF).count() == 0
        if name != "byte_bpe":
            assert out.columns == odd.columns
            assert all((r.row, r.rk, r.h1, r.id, r.root, r.s, r.fp, r.gone, r.cell, r.pos) == (1, "a", 2, 3, 4, "b", "c", 5, 6, 7) for r in kept[name])
    ids = lambda name: sorted(str(r.doc_id) for r in kept[name])
    assert ids("language_id") == ["1", "1", "2", "6", "None"]  # without a letter: gone
    lines = {(r.doc_id, r.text) for r in kept["line_dedup"]}
    assert (3, "") in lines and (2, "other") in lines and (1, ODD[0][1]) in lines and len(kept["line_dedup"]) == len(ODD)
    assert ids("near_dedup") == ["1", "2", "3", "6", "None"]  # 3, 4 and 5 have no words and are one group; repeated rows leave one
    assert ids("decontamination") == ["1", "1", "2", "3", "4", "5", "6", "None"]
    tokens = [(r.doc_id, r.n_tokens, len(r.packed)) for r in kept["byte_bpe"]]
    assert len(tokens) == len(ODD) and (3, 0, 0) in tokens and (4, 0, 0) in tokens and all(n * 4 == size for _, n, size in tokens)
