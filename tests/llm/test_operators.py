"""The ten operators against brute force, libraries and SQL, and their edge cases."""

import base64
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

from tests.oracle import database, rows_of, rows_of_sql
from textmill.llm import bytebpe, decontam, entries, langid, licences, linededup, sharding, simhash, substrings, tokencount, topk

SF = "/root/testdata/sf0.001"
#: nulls, empty and repeated rows, ties, a long text, columns named like the operators' own
SCHEMA = "doc_id long, text string, lang string, fp string, shard int, rk string, gone int, h1 long, row string"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
ODD = [
    (1, "A first line of text here\nsecond line of the text", "en"),
    (1, "A first line of text here\nsecond line of the text", "en"),
    (2, "  a FIRST line of text here\t\nother", "en"),
    (3, None, None),
    (4, "", "de"),
    (None, "text without an id and nothing else", "fr"),
    (5, "\n\n", None),
    (6, LONG, "en"),
    (7, "äöü ß licensed under the MIT License, CC BY 4.0", "de"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "x", 1, "y", 2, 3, "z") for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(entries.ORACLES))
def test_sql(spark, name):
    df = entries.QUERIES[name](spark, SF)
    names, want = rows_of_sql(database(SF), entries.ORACLES[name])
    assert set(names) <= set(df.columns)
    assert rows_of(df.select(*names)) == want


# 1


def ring_by_hand(rows, n, arcs, spark):
    """Walks key by key: arcs in ring order, keys of an arc in ring order, each to the next shard with room."""
    cells = {r.cell: (r.arc, r.shard) for r in arcs.collect()}
    owner = {a: s for a, s in cells.values()}
    order = sorted(owner)
    room = [len(rows) // n + (s < len(rows) % n) for s in range(n)]
    by_arc = {}
    for r in rows:
        by_arc.setdefault(cells[r.cell][0], []).append(r)
    used, out = [0] * n, {}
    for i, arc in enumerate(order):
        walk = list(dict.fromkeys(owner[a] for a in order[i:] + order[:i]))
        for r in sorted(by_arc.get(arc, []), key=lambda r: ((r.cell - arc - 1) % 65536, r.key)):
            s = next(s for s in walk if used[s] < room[s])
            out[r.doc_id] = (s, used[s])
            used[s] += 1
    return out


def test_ring_equals_a_walk_by_hand(spark, docs):
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.bounded_ring(docs, 7).collect()}
    key = F.xxhash64("doc_id")
    rows = docs.select("doc_id", key.alias("key"), F.pmod(key, F.lit(65536)).alias("cell")).collect()
    assert got == ring_by_hand(rows, 7, sharding.ring_arcs(spark, 7, 64, 16), spark)


def test_shards_differ_by_one_and_slots_have_no_gap(spark, docs, odd, nothing):
    for df in (docs, odd):
        rows = sharding.bounded_ring(df, 16).collect()
        assert len(rows) == df.count()
        slots = {}
        for r in rows:
            slots.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        sizes = [len(slots.get(s, [])) for s in range(16)]
        assert max(sizes) - min(sizes) <= 1
    by_id = {r.doc_id: r for r in sharding.bounded_ring(odd, 4).collect()}
    assert by_id[3].size == 1 and by_id[3].text_crc32 == 0
    assert by_id[7].size == len(ODD[8][1].encode()) + 1 and by_id[7].text_crc32 == zlib.crc32(ODD[8][1].encode())
    assert sharding.bounded_ring(nothing, 4).count() == 0


def test_a_new_shard_moves_few_rows(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    a = {r.doc_id: r.shard for r in sharding.bounded_ring(df, 8).collect()}
    b = {r.doc_id: r.shard for r in sharding.bounded_ring(df, 9).collect()}
    assert sum(a[k] != b[k] for k in a) < 0.2 * len(a)  # hashing modulo the number moves 8 of 9


# 2


def test_planted_passages_are_found_and_clean_documents_left_alone(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [text(30) for _ in range(8)]
    rows, want = [], set()
    for i in range(60):
        body = text(120)
        if i % 3 == 0:
            leak = list(items[i % 8])
            for _ in range(len(leak) // 25 if i % 2 else 0):
                leak[rng.randrange(len(leak))] = rng.choice(["", "x", "qq"])
            body = f"{body[:300]} {''.join(leak).upper() if i % 4 == 0 else ''.join(leak)}, {body[300:]}"
            want.add((i, i % 8))
        rows.append((i, body))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = decontam.contaminated(d, b).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want
    assert all(r.start_char < r.end_char <= len(rows[r.doc_id][1]) for r in found)
    blocked = decontam.contaminated(d, b, block_chars=300).collect()
    assert {(r.doc_id, r.item_id) for r in blocked} == want
    assert {r.doc_id for r in decontam.clean(d, b).collect()} == set(range(60)) - {i for i, _ in want}


def fewest_edits(points, part):
    row = np.zeros(len(points) + 1, int)  # free ends in the text
    for i, c in enumerate(part):
        new = [i + 1]
        for j in range(len(points)):
            new.append(min(row[j] + (c != points[j]), row[j + 1] + 1, new[j] + 1))
        row = np.array(new)
    return int(row.min())


@pytest.mark.parametrize("often, reach", [(64, 1 << 15), (1, 150)])
def test_bands_keep_what_edit_distance_keeps(monkeypatch, often, reach):
    """Items of several segments that share beginnings, q-grams left out or not, long texts in stretches or not."""
    monkeypatch.setattr(decontam, "_OFTEN", often)
    monkeypatch.setattr(decontam, "_REACH", reach)
    rng = random.Random(9)
    hits = 0
    for _ in range(6):
        items = [(j or None, "".join(rng.choice("abcd ") for _ in range(rng.randint(70, 150)))) for j in range(4)]
        items += [(9, items[0][1][:90] + "xyz" * 10), (8, items[0][1][:64])]
        index = decontam.Index(items, 8, 64, 0.1, 24)
        texts = []
        for _ in range(3):
            near = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, 12)):
                near[rng.randrange(len(near))] = rng.choice(["", "a", "bc"])
            texts.append("".join(rng.choice("efgh ") for _ in range(rng.randint(0, 120))) + "".join(near))
        folded = [decontam.fold(t)[0] for t in texts]
        for points, regions in zip(folded, index.regions_of(folded)):
            got = {}
            for seg, edits, first, last in regions:
                assert 0 <= first < last <= len(points)
                got[seg] = min(edits, got.get(seg, edits))
            want = {s: fewest_edits(points, index.points[s, : index.size[s]]) for s in range(len(index.size))}
            want = {s: n for s, n in want.items() if n <= index.edits[s]}
            assert got == want
            hits += len(want)
    assert hits > 10


def test_a_prompt_that_thousands_of_items_share_costs_little(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    prompt = "what is the correct answer among the following choices"
    items = [(i, f"{prompt} " + " ".join(word() for _ in range(20))) for i in range(2000)]
    index = decontam.Index(items, 8, 64, 0.1, 24)
    points = decontam.fold(" ".join([prompt] * 20))[0]
    at, slot = index.lookup(decontam.qgram_hashes(points, 8))
    assert index.count[slot].sum() < 40 * len(points)  # not 2,000 for each place
    hit = decontam.fold(items[7][1])[0]
    own = [s for s, o in enumerate(index.owners) if 7 in o]
    assert own and set(own) <= {r[0] for r in index.regions(hit)}


def test_decontamination_of_odd_input(spark, odd, nothing):
    passage = "the quick brown fox jumps over the lazy dog near the river bank today"
    b = spark.createDataFrame([(1, None), (2, ""), (3, "second"), (3, "second"), (4, "econd"), (None, passage), (5, "漢字かな"), (6, passage), (6, passage), (6, "first line of text")], "item_id long, text string")
    more = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(20, f"so {passage.upper()}!"), (21, "これは漢字かなです"), (22, "seconds")], "doc_id long, text string"))
    got = sorted(((r.doc_id, r.item_id, r.segments, r.edits, r.cover) for r in decontam.contaminated(more, b).collect()), key=repr)
    whole = len({passage[s : s + 64] for s in (0, len(passage) - 64)})
    assert got == sorted([(1, 3, 1, 0, 1.0), (1, 3, 1, 0, 1.0), (1, 6, 1, 0, 1.0), (1, 6, 1, 0, 1.0), (2, 6, 1, 0, 1.0), (20, None, whole, 0, 1.0), (20, 6, whole, 0, 1.0), (21, 5, 1, 0, 1.0)], key=repr)
    kept = decontam.clean(more, b)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["3", "4", "None", "5", "6", "7", "22"])
    few = spark.createDataFrame([(1, None), (2, "")], "item_id long, text string")
    assert decontam.clean(odd, few).count() == odd.count() and decontam.clean(odd, few).columns == odd.columns
    assert decontam.contaminated(nothing, b).count() == 0 and decontam.clean(odd, b.limit(0)).count() == len(ODD)


# 3


def fingerprint_by_hand(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_by_hand(prints, k):
    top = {i: i for i, _ in prints}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for n, (a, f) in enumerate(prints):
        for b, g in prints[:n]:
            if (f ^ g).bit_count() <= k:
                top[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i, _ in prints}


def test_simhash_equals_brute_force(spark, docs):
    rows = docs.collect()
    prints = [(r.doc_id, fingerprint_by_hand(r.text)) for r in rows]
    want = components_by_hand(prints, 4)
    got = simhash.near_duplicates(docs).collect()
    assert {(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in got} == {(i, f, want[i]) for i, f in prints}


def test_links_of_dense_groups_equal_brute_force(spark):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(4)]
    prints = list({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for c in centres for _ in range(60)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    cell = F.explode(F.array(*[F.struct(F.lit(i).cast("short").alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(simhash.block_masks(len(prints), 4))])).alias("cell")
    roots = {r.id: r.root for r in simhash.links(nodes.select(F.col("fp").alias("id"), F.col("fp").alias("f"), cell).select("cell.c", "cell.v", "id", "f"), 4).collect()}
    want = components_by_hand([(i, p & (1 << 64) - 1) for i, p in sorted((s, s) for s in signed)], 4)
    groups = lambda f: {frozenset(x for x in signed if f(x) == v) for v in {f(x) for x in signed}}
    assert groups(lambda x: roots.get(x, x)) == groups(lambda x: want[x])


def test_dense_buckets_are_cut_again_and_lose_no_link(spark, monkeypatch):
    """Fingerprints that share 40 bits and vary in 24: buckets of all of them, hardly a link."""
    monkeypatch.setattr(simhash, "DENSE", 20)
    rng = random.Random(11)
    shared = rng.getrandbits(40) << 24
    prints = list({shared | rng.getrandbits(24) for _ in range(500)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    cell = F.explode(F.array(*[F.struct(F.lit(m).cast("long").alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for m in simhash.block_masks(500, 4)])).alias("cell")
    cells = nodes.select(F.col("fp").alias("id"), F.col("fp").alias("f"), cell).select("cell.c", "cell.v", "id", "f")
    roots = {r.id: r.root for r in simhash.links(cells, 4, finer=lambda c: simhash.finer_masks(c, 4)).collect()}
    want = components_by_hand([(s, s & (1 << 64) - 1) for s in sorted(signed)], 4)
    groups = lambda f: {frozenset(x for x in signed if f(x) == v) for v in {f(x) for x in signed}}
    assert groups(lambda x: roots.get(x, x)) == groups(lambda x: want[x]) and len(set(want.values())) < 500


def test_finer_masks_meet_every_pair_within_k():
    rng = random.Random(2)
    masks = [m & (1 << 64) - 1 for m in simhash.block_masks(1000, 4)]
    for _ in range(200):
        x = sum(1 << b for b in rng.sample(range(64), 4))
        level = [m for m in masks if not x & m]
        for _ in range(5):
            assert level
            level = [f & (1 << 64) - 1 for f in simhash.finer_masks(level[0], 4)]
            level = [f for f in level if not x & f]
    assert level


def test_block_masks_meet_every_pair_within_k():
    rng = random.Random(2)
    masks = [m & (1 << 64) - 1 for m in simhash.block_masks(100_000, 4)]
    for _ in range(300):
        x = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not x & m for m in masks)


def test_simhash_of_odd_input(odd, nothing):
    got = collected(simhash.near_duplicates(odd))
    assert len(got) == len(ODD)
    zero = {r[0]: r for r in got if r[1] == "0" * 16}
    assert set(zero) == {3, 4, 5} and all(r[2] == 3 for r in zero.values())
    assert simhash.near_duplicates(nothing).count() == 0


def test_similar_documents_group_near_copies_only(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for g in range(20):
        body = [word() for _ in range(200)]
        rows.append((3 * g, " ".join(body)))
        body[50] = word()
        rows.append((3 * g + 1, " ".join(body)))
        rows.append((3 * g + 2, " ".join(word() for _ in range(200))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(df).collect()}
    assert got == {i: i - (i % 3 == 1) for i in range(60)}
    left = simhash.one_of_each(df.unionByName(df), 5, 0.8)
    assert sorted(r.doc_id for r in left.collect()) == [i for i in range(60) if i % 3 != 1]


def test_one_of_each_of_odd_input(odd, nothing):
    left = simhash.one_of_each(odd)
    assert left.columns == odd.columns
    ids = [r.doc_id for r in left.collect()]
    assert sorted(map(str, ids)) == ["1", "2", "3", "6", "7", "None"]  # 3, 4 and 5 have no words
    assert simhash.one_of_each(nothing).count() == 0


# 4


def test_lines_of_odd_input(odd, nothing):
    got = {r.doc_id: r for r in linededup.drop_repeated_lines(odd).collect()}
    assert len(got) == len(ODD) - 1  # repeated rows are one id
    assert (got[1].n_lines, got[1].n_dropped) == (2, 0)
    assert (got[2].n_dropped, got[2].kept_text) == (1, "other")
    assert (got[3].n_lines, got[3].kept_text) == (1, "") and (got[5].n_lines, got[5].kept_text) == (3, "\n\n")
    assert linededup.drop_repeated_lines(nothing).count() == 0
    kept = linededup.without_repeated_lines(odd)
    assert kept.columns == odd.columns and kept.count() == len(ODD)


def test_line_keys_are_stripped_at_the_two_ends_only(spark):
    ends = ["", " ", "\u0085", "\u2028", "\u2029", " \u0085", "\u0085 ", " \u2028\t", "\u2029\r", "\t\u2029"]
    rows = [(i, f"mnopqrstuvwx{e}") for i, e in enumerate(ends)] + [(50 + i, f"{e}mnopqrstuvwx") for i, e in enumerate(ends)]
    key = lambda x: re.sub(r"\A[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", x)
    first = {}
    for i, x in rows:
        first.setdefault(key(x), i)
    got = {r.doc_id: r.n_dropped for r in linededup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: int(first[key(x)] != i) for i, x in rows} and 0 < sum(got.values()) < len(rows) - 1


def test_lines_over_three_documents(spark):
    df = spark.createDataFrame([(i, f"a common line of text\nline number {i} alone") for i in range(3)] + [(9, "twice in one text\ntwice in one text")], "doc_id long, text string")
    got = {r.doc_id: r.n_dropped for r in linededup.drop_repeated_lines(df, min_docs=3).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 9: 0}


# 5, 6

STRANGE = ["", None, "don't'rex we'll", "a" * 3000, "<|endoftext|>x<|startoftext|>", "ΣΑΣ İ é é ½²٣", " \n\t  x", "!?'s''", LONG]


def fuzz(n):
    rng, parts = random.Random(n), [*"ab '''sdtrevlm!?12é漢字😀\x1c\u0085ßΣςİ \n\t.ÅÅ½²٣", "'re", "'ve", "  "]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_token_counts_equal_the_library(spark, docs):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = [*STRANGE, *fuzz(800), *[r.text for r in docs.collect()]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in tokencount.count_tokens(df, P.path("word_bpe_49k.json")).collect()}
    ids = t.encode_batch([x or "" for x in texts], add_special_tokens=False)
    assert got == {i: (len((x or "").encode()), len(e.ids)) for i, (x, e) in enumerate(zip(texts, ids))}


def test_automaton_counts_every_word_as_the_library():
    counter, t = tokencount.counter(P.path("word_bpe_49k.json")), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rng = random.Random(50)
    words = ["the", "zzzzqx", "t", "thé", "internationalisation", *("a" * n for n in range(1, 300)), "etaoin" * 3000, "日本" * 3000]
    for letters in ("ab", "etaoinshrdlu", "abcdefghijklmnopqrstuvwxyz", "éßωж日本語"):
        words += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 50))) for _ in range(600)]
    coded = [w.encode() for w in words]
    sizes = np.array([len(w) for w in coded])
    want = [len(e.ids) for e in t.encode_batch(words, add_special_tokens=False)]
    data = np.frombuffer(b"".join(coded), np.uint8)
    assert counter.counted(data, np.cumsum(sizes) - sizes, sizes).tolist() == want
    # the last words alone, so that they are stepped one by one from the start
    assert [int(counter.counted(np.frombuffer(w, np.uint8), np.zeros(1, np.int64), np.array([len(w)]))[0]) for w in coded[-200:]] == want[-200:]


def test_pairs_that_outlive_their_merges():
    counter = tokencount.counter(P.path("word_bpe_49k.json"))
    rng, tokens = np.random.default_rng(4), np.flatnonzero(counter.size > 0)
    s, t = rng.choice(tokens, 3000), rng.choice(tokens, 3000)
    raw = {i: [i] for i in counter.inner.tolist()}

    def split(x):
        return raw[x] if x in raw else split(int(counter.left[x])) + split(int(counter.right[x]))

    flat = [split(a) + split(b) for a, b in zip(s.tolist(), t.tolist())]
    sizes = np.array([len(x) for x in flat])
    ids, n = counter.merge(np.array([i for x in flat for i in x]), sizes)
    first = np.cumsum(n) - n
    want = [bool(k == 2 and ids[f] == a) for f, k, a in zip(first, n, s)]
    assert counter.lives(s, t).tolist() == want and [counter._pair(a, b) for a, b in zip(s.tolist(), t.tolist())] == want


def test_state_maps_compose_like_one_pass():
    rng = np.random.default_rng(3)
    kinds = rng.integers(0, 10, 5000).astype(np.uint8)
    step, state, want = tokencount.transitions(), 0, []
    for k in kinds:
        state = step[k, state]
        want.append(state)
    assert tokencount.states(kinds).tolist() == want


def encoder():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_equals_the_library_and_decodes(spark, docs):
    e = encoder()
    texts = [*STRANGE, *fuzz(801), *[r.text for r in docs.collect()]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    args = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    got = {r.doc_id: (bytes(r.packed), bytes(r.decoded)) for r in bytebpe.round_trip(df, *args).collect()}
    for i, x in enumerate(texts):
        ids = e.encode_ordinary(x or "")
        assert got[i] == (np.array(ids, "<u4").tobytes(), (x or "").encode())
    coded = bytebpe.encode(df.limit(20), *args)
    again = {r.doc_id: bytes(r.data).decode() for r in bytebpe.decode(coded, *args).collect()}
    assert all(again[i] == (texts[i] or "") for i in again)


def test_tokenizers_of_odd_input(odd, nothing):
    assert tokencount.count_tokens(odd, P.path("word_bpe_49k.json")).count() == len(ODD)
    assert tokencount.count_tokens(nothing, P.path("word_bpe_49k.json")).count() == 0
    assert bytebpe.round_trip(nothing, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


# 7


def test_top_k_equals_brute_force_over_many_shards(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(0, 0.2, (700, 12)), 2)  # ties
    rows = [(i, [float(v) for v in x[i]], "c") for i in range(700)]
    rows += [(701, None, "c"), (702, [1.0, None], "c"), (703, [float("nan")] * 12, "c"), (704, [], "c"), (None, [1.0] * 12, "c"), (750, [2.0, 3.0], "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, shard string")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(df, every=10, shard_rows=60, block_rows=16, leaf=8).collect()}
    v = np.floor(x * 256).astype(int)
    want = {}
    for q in range(0, 700, 10):
        s = v @ v[q]
        best = sorted((-s[i], i) for i in range(700) if i != q)[:5]
        want |= {(q, r + 1): (i, -n) for r, (n, i) in enumerate(best)}
    assert got == want
    assert topk.top_k(df.limit(0)).count() == 0


def test_top_k_leaves_cells_out_that_cannot_hold_a_better_score(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 3, (20, 8))
    x = np.round(np.repeat(centres, 40, axis=0) + rng.normal(0, 0.05, (800, 8)), 2)
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(800)], "vec_id long, embedding array<double>")
    tables = {}
    monkeypatch.setattr(topk, "written", lambda t, name, put=topk.written: tables.setdefault(name, put(t, name)))
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(df, every=10, shard_rows=20, block_rows=16, leaf=8).collect()}
    v = np.floor(x * 256).astype(int)
    want = {}
    for q in range(0, 800, 10):
        best = sorted((-int(v[i] @ v[q]), i) for i in range(800) if i != q)[:5]
        want |= {(q, r + 1): (i, -n) for r, (n, i) in enumerate(best)}
    assert got == want
    cells = tables["trees"].select("cell").distinct().count()
    assert cells >= 20 and tables["going"].count() < 0.5 * 80 * cells  # query and cell pairs left


def test_top_k_of_repeated_rows_and_few_candidates(spark):
    rows = [(0, [1.0, 0.0])] * 60 + [(1, [2.0, 0.0])] * 3 + [(50, [0.0, 1.0, 0.0]), (7, [0.0, 1.0, 1.0]), (100, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(df, shard_rows=16).collect())
    one = 256 * 512
    assert got == [(0, 1, 1, one), (0, 2, 1, one), (0, 3, 1, one), (50, 1, 7, 65536)]


# 8


def repeats_by_hand(texts, length):
    words = [(t or "").encode().split() for t in texts]
    seen = {}
    for d, w in enumerate(words):
        for s in range(len(w) - length + 1):
            seen.setdefault(tuple(w[s : s + length]), []).append((d, s))
    gone = [set() for _ in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, s in places:
                gone[d].update(range(s, s + length))
    return [(len(w), len(g), b" ".join(x for i, x in enumerate(w) if i not in g).decode()) for w, g in zip(words, gone)]


def test_repeats_equal_brute_force(spark):
    rng = random.Random(6)
    w = lambda n: [rng.choice("abcdef") * rng.randint(1, 2) for _ in range(n)]
    shared = [w(rng.randint(10, 60)) for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = [w(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            s = list(rng.choice(shared))
            if rng.random() < 0.4:
                s[rng.randrange(len(s))] = "zz"
            parts += [s, w(rng.randint(0, 30))]
        texts.append(rng.choice([" ", "\n"]).join(x for p in parts for x in p))
    texts += [texts[0], "a " * 200, "b " * 40, None, "", "a b " * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substrings.repeats(df, length=12, k=4).collect()}
    assert got == dict(enumerate(repeats_by_hand(texts, 12)))


def test_repeats_of_odd_input(odd, nothing):
    got = {r.doc_id: r for r in substrings.repeats(odd, length=5, k=2).collect()}
    assert got[1].n_removed == 11 and got[1].kept_text == "" and got[3].n_words == 0
    assert substrings.repeats(nothing).count() == 0


# 9


def licences_by_hand(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    places = [(i, label) for phrase, label in licences.PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_licences_equal_brute_force(spark, docs, odd, nothing):
    more = ["MIT License mit license\nApache License", "gnu general public licenses", "GNU General Public License, version 3. CC-BY", None, ""]
    texts = [*more, *[r.text for r in docs.collect()]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in licences.scan(df).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == licences_by_hand(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert licences.scan(odd).count() == len(ODD) and licences.scan(nothing).count() == 0


def test_notices_are_found_with_words_lost_and_added(spark):
    notice = "This program is free software: you can redistribute it and/or modify it under terms of the new GNU General Public License"
    df = spark.createDataFrame([(1, f"x y z {notice} q"), (2, "the program is under the work of the terms " * 20)], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licences.scan(df).collect()}
    assert got == {1: "gpl", 2: ""}


def test_whole_licences_with_words_lost_and_added(spark):
    texts, rng = licences.licence_texts(), random.Random(7)
    assert {"mit", "bsd", "isc", "apache", "gpl", "lgpl", "mpl", "unlicense", "zlib", "cc-by", "cc-by-sa", "cc0"} <= {x for x, _ in texts}
    rows = []
    for label, text in texts:
        edited = text.split()
        n = (len(edited) - 4) * 2 // 25  # an edit costs five k-grams at most, so three fifths are left
        for i in range(n, 0, -1):
            at = i * len(edited) // (n + 1)
            edited[at : at + 1] = [edited[at], "added"] if rng.random() < 0.5 else []
        rows.append((len(rows), label, "before it " + " ".join(edited).upper() + " after it"))
    shuffled = dict(texts)["zlib"].split()
    rng.shuffle(shuffled)
    rows.append((len(rows), None, " ".join(shuffled)))
    whole = dict(texts)["zlib"].split()
    rows.append((len(rows), None, " ".join(whole[: len(whole) // 3])))
    df = spark.createDataFrame(rows, "doc_id long, want string, text string")
    got = {r.doc_id: r.labels.split(",") for r in licences.scan(df).collect()}
    for i, label, text in rows:
        assert label in got[i] if label else "zlib" not in got[i], (i, label, got[i])


def test_licences_of_one_family_are_told_apart_as_the_sql_does(spark, tmp_path):
    texts = [(i, f"before {text} after") for i, (_, text) in enumerate(licences.licence_texts())]
    df = spark.createDataFrame([*texts, (100, None), (101, ""), (102, "GNU General Public License")], "doc_id long, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in licences.scan(df).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == set(con.sql(entries.ORACLES["op9_license_scan"]).fetchall())
    for i, _, _, _, _, base, labels, _ in got:
        if i < 100:
            assert set(labels.split(",")) == {licences.licence_texts()[i][0], *filter(None, base.split(","))}


# 10


def test_language_id_on_the_held_out_fold(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.predict(docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").filter(langid.held_out(F.col("doc_id"))).collect()
    assert len(got) > 200 and sum(r.lang_pred == r.lang for r in got) / len(got) > 0.98
    assert all(0 <= r.score <= 1 for r in got) and sum(r.rejected for r in got) <= 2


def test_language_id_learns_from_training_folds_only(spark, docs):
    trusted = docs.filter(~langid.held_out(F.col("doc_id")))
    poisoned = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), "zz").otherwise(F.col("lang")))
    assert langid.fit(poisoned).labels == langid.fit(trusted).labels
    assert langid.held_out(F.lit(1)) is not None and [r[0] for r in spark.range(8).select(langid.held_out(F.col("id"))).collect()] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(8)]


def test_language_id_of_odd_input(spark, docs, odd, nothing):
    model = langid.fit(docs)
    got = {r.doc_id: r for r in langid.predict(odd, model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].rejected and got[i].score == 0 for i in (3, 4, 5))
    assert got[7].lang_pred in model.labels and not got[7].rejected
    assert langid.accepted(odd, model).columns == odd.columns
    assert langid.predict(nothing, model).count() == 0
    assert {r.lang_pred for r in langid.predict(odd, langid.fit(nothing)).collect()} == {"und"}


def test_predictions_equal_a_plain_softmax_over_the_models_table(docs):
    model = langid.fit(docs)
    for r in docs.limit(40).collect():
        found = langid.features([r.text], len(model.table))[0]
        odds = (model.table[found].mean(axis=0) + model.bias) / model.temperature
        p = np.exp(odds - odds.max()) / np.exp(odds - odds.max()).sum()
        (lang,), (score,), (bad,) = model.predict([r.text])
        assert lang == model.labels[int(p.argmax())] and abs(score - p.max()) < 1e-9 and bad == (p.max() < model.threshold)


def test_features_are_those_of_a_plain_loop():
    texts = ["Ab c", "x", "", "12 !", "Été"]
    found, first = langid.features(texts, 1 << 16)
    for i, t in enumerate(texts):
        chars = re.sub(r" +", " ", "".join(c.lower() if c.isalpha() else " " for c in f" {t} "))
        grams = [chars[j : j + n] for n in (2, 3) for j in range(len(chars) - n + 1) if chars[j : j + n].strip()]
        assert first[i + 1] - first[i] == len(grams)
    again, _ = langid.features(texts[:1], 1 << 16)
    assert sorted(again.tolist()) == sorted(found[first[0] : first[1]].tolist())


def test_texts_in_languages_not_learned_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    rng = random.Random(3)
    junk = [" ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randint(2, 8))) for _ in range(40)) for _ in range(20)]
    other = ["Правительство сегодня решило, что все дети должны ходить в школу " * 4, "政府は本日、すべての子供が学校に通わなければならないと決定しました" * 4, "Rząd zdecydował dzisiaj, że wszystkie dzieci muszą chodzić do szkoły " * 4]
    assert 1 / len(model.labels) < model.threshold < 1
    assert all(model.predict(other)[2]) and sum(model.predict(junk)[2]) >= 18


def test_a_hot_id_doesnt_widen_the_sample(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(langid, "train", lambda texts, langs, put=langid.train: taken.append(len(texts)) or put([], []))
    df = spark.range(500).select(F.lit(3).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("en").alias("lang"))
    langid.fit(df, per_class=20)
    assert taken == [20]


def test_training_equals_plain_training_on_the_same_rows(spark, docs):
    """Shares made in tasks are those of the texts; the sample is bounded in rows and in labels."""
    few = docs.filter("lang IS NOT NULL")
    model = langid.fit(few, per_class=10**6, most_rows=10**6)
    rows = sorted((r for r in few.withColumn("h", F.xxhash64("text")).filter(~langid.held_out(F.col("doc_id"))).collect()), key=lambda r: (r.doc_id, r.lang, r.h))
    want = langid.train([langid.shares(r.text or "", langid.BUCKETS) for r in rows], [r.lang for r in rows])
    assert model.labels == want.labels and np.allclose(model.table, want.table) and model.threshold == pytest.approx(want.threshold)
    assert len(langid.fit(few, most_labels=2).labels) == 2


def test_without_languages_only_texts_without_letters_are_rejected(odd):
    bare = odd.withColumn("lang", F.lit(None).cast("string"))
    assert langid.accepted(bare, langid.fit(bare)).count() == len(ODD) - 3


def test_queries_return_their_contracts_columns(spark, docs):
    want = {
        "op1_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
        "op2_decontamination": "doc_id bigint, item_id bigint",
        "op3_simhash": "doc_id bigint, fingerprint string, component_id bigint",
        "op5_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
        "op6_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
        "op10_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    }
    texts = {r.doc_id: r.text for r in docs.collect()}
    t, e = Tokenizer.from_file(P.path("word_bpe_49k.json")), encoder()
    for name, columns in want.items():
        df = entries.QUERIES[name](spark, SF)
        kinds = dict(df.dtypes)
        assert all(kinds[c.split()[0]] == c.split()[1] for c in columns.split(", "))
        rows = {r.doc_id: r for r in df.collect()}
        for i, r in list(rows.items())[:60]:
            if name == "op1_sharding":
                assert (r.law, r.grown_shard, r.size, r.text_crc32) == ("rows", None, len(texts[i].encode()) + 1, zlib.crc32(texts[i].encode()))
            if name == "op5_token_counts":
                n = len(t.encode(texts[i], add_special_tokens=False).ids)
                assert (r.n_tokens, r.over_limit, r.n_bytes) == (n, n > 2048, len(texts[i].encode()))
            if name == "op6_byte_bpe":
                ids = np.array(e.encode_ordinary(texts[i]), "<u4")
                assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(texts[i].encode()).hexdigest())
            if name == "op10_language_id":
                assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1


@pytest.mark.parametrize("shared, of", [(160, 200), (170, 200), (180, 200)])
def test_near_dedup_finds_planted_pairs_at_and_over_the_threshold(spark, shared, of):
    """Recall of the whole stage on pairs of a Jaccard similarity of 0.80, 0.85 and 0.90 among other texts."""
    rng = random.Random(of + shared)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    rows = []
    for g in range(150):  # texts of n + 4 words: n shingles, the first ``shared`` of them in both
        body = [word() for _ in range(shared + 4)]
        a, b = (of - shared) // 2, (of - shared) - (of - shared) // 2
        rows += [(3 * g, " ".join(body + [word() for _ in range(a)])), (3 * g + 1, " ".join(body + [word() for _ in range(b)])), (3 * g + 2, " ".join(word() for _ in range(of)))]
    left = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), 5, 0.8).collect()}
    assert {3 * g for g in range(150)} | {3 * g + 2 for g in range(150)} <= left  # nothing clean is lost
    assert sum(3 * g + 1 not in left for g in range(150)) >= 149


def test_candidates_of_near_dedup_at_the_threshold_miss_few_pairs_at_any_size():
    rng = np.random.default_rng(3)
    bands = simhash.band_count(0.8, 5, 0.0005)
    met, n = 0, 2000
    for _ in range(n):
        words = rng.integers(0, 1 << 64, 90, np.uint64)  # 80 of 100 shingles are shared
        more = rng.integers(0, 1 << 64, 10, np.uint64)
        a, b = (simhash.min_bands(x, bands, 5) for x in (words, np.concatenate([words[:80], more])))
        met += bool((a == b).any())
    assert (1 - 0.8**5) ** bands <= 0.0005 and met >= n - 6
    other = [simhash.min_bands(rng.integers(0, 1 << 64, 90, np.uint64), bands, 5) for _ in range(300)]
    assert all(len({x[c] for x in other}) == 300 for c in range(bands))  # no chance meetings that a larger input would need wider blocks for


def test_near_dedup_takes_jaccard_of_sets_on_both_sides_of_the_threshold(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    pairs, rows = {}, []
    for g in range(60):  # two texts of n + 4 words that part after the first m + 4: m of 2n - m shingles are shared
        n, m = (180, 160) if g < 20 else (180, 159) if g < 40 else (190, 160)
        body = [word() for _ in range(m + 4)]
        rows += [(2 * g + i, " ".join(body + [word() for _ in range(n - m)])) for i in range(2)]
        pairs[2 * g + 1] = m / (2 * n - m)
    assert {x >= 0.8 for x in pairs.values()} == {True, False} and 0.8 in pairs.values()
    noise = [word() for _ in range(5)] * 200  # one repeated phrase outvotes all else, sets differ
    rows += [(200 + i, " ".join([*noise, *(word() for _ in range(60))])) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r.doc_id for r in simhash.one_of_each(df, 5, 0.8).collect()}
    assert left == {i for i, _ in rows} - {i for i, x in pairs.items() if x >= 0.8}


def test_near_dedup_loses_no_pair_that_bands_or_fingerprints_miss(spark):
    """Pairs of a Jaccard similarity of 0.8 that share no band, or whose fingerprints differ in more bits than pairs at 0.8 are taken to; with
    two below it beside them."""

    def pair(seed, shared, more):  # the second text has ``more`` words after the first one's
        rng = random.Random(seed)
        word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
        body = [word() for _ in range(shared + 4)]
        return " ".join(body), " ".join(body + [word() for _ in range(more)])

    bands = simhash.band_count(0.8, 5, 0.0005)
    sets = lambda texts: [simhash.shingles(t.encode(), 5) for t in texts]
    apart = [pair(i, 20, 5) for i in (3792, 4573, 6487, 10187)]
    for a, b in map(sets, apart):
        assert not (simhash.min_bands(a, bands, 5) == simhash.min_bands(b, bands, 5)).any()
    far = [pair(i, 4, 1) for i in (32216, 33577)]
    for a, b in map(sets, far):
        assert (simhash.votes(a) ^ simhash.votes(b)).bit_count() > 26
    below = [pair(1, 19, 5), pair(2, 20, 6)]
    rows = [(2 * i + k, t) for i, texts in enumerate(apart + far + below) for k, t in enumerate(texts)]
    left = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), 5, 0.8).collect()}
    assert left == set(range(16)) - {2 * i + 1 for i in range(6)}


@pytest.mark.parametrize("low", [0, 0.05, 0.4, 1])
def test_prefixes_of_any_two_sets_at_the_similarity_meet(spark, monkeypatch, low):
    """Sets of 1 to 40 elements around a few bases, elements that many sets hold among them, repeated sets; one that is alone has no cell."""
    monkeypatch.setattr(simhash, "LOW", min(int(low * 2**64), 2**64 - 1))
    rng = np.random.default_rng(11)
    common = rng.integers(0, 1 << 64, 12, np.uint64)
    sets = [np.unique(rng.integers(0, 1 << 64, 30, np.uint64))]
    for _ in range(25):
        base = np.concatenate([rng.integers(0, 1 << 64, int(rng.integers(1, 40)), np.uint64), rng.permutation(common)[: int(rng.integers(0, 12))]])
        for _ in range(8):
            n = int(rng.integers(0, 1 + len(base) // 6))
            sets.append(np.unique(np.concatenate([rng.permutation(base)[n:], rng.integers(0, 1 << 64, int(rng.integers(0, n + 2)), np.uint64)])))
    ids = {x.tobytes(): i for i, x in enumerate(sets)}
    firsts = [(ids[x.tobytes()], *simhash.first_elements(x, 0.8)) for x in sets]
    rows = [(i, x.view(np.int64).tolist(), skip) for i, x, skip in firsts] * 2
    cells = simhash.prefix_cells(spark.createDataFrame(rows, "id long, low array<long>, skip int").repartition(3)).collect()
    held = {}
    for r in cells:
        held.setdefault(r.id, set()).add(r.v)
    assert len(cells) == sum(map(len, held.values())) and 0 not in held
    near = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(np.intersect1d(a, b))
            if ids[a.tobytes()] != ids[b.tobytes()] and both / (len(a) + len(b) - both) >= 0.8:
                near += 1
                assert held[ids[a.tobytes()]] & held[ids[b.tobytes()]]
    assert near > 100


def test_set_links_equal_a_comparison_of_all_pairs_of_a_cell(spark):
    """Families of copies around a text that needn't stand in each cell, some on either side of the threshold."""
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(4):
        base = rng.integers(0, 1 << 62, 100, np.uint64)
        sets.append(base)
        for _ in range(25):
            n = int(rng.integers(2, 22))
            sets.append(np.concatenate([rng.permutation(base)[n:], rng.integers(0, 1 << 62, n, np.uint64)]))
    cells, near = [], {}
    for i, x in enumerate(sets):
        for c, v in enumerate(simhash.min_bands(x, 8, 2).view(np.int64).tolist()):
            cells.append((c, v, i, 0))
            near.setdefault((c, v), []).append(i)
    top = list(range(len(sets)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for group in near.values():
        for a in group:
            for b in group:
                both = len(np.intersect1d(sets[a], sets[b]))
                if a < b and both / (len(sets[a]) + len(sets[b]) - both) >= 0.8:
                    top[max(root(a), root(b))] = min(root(a), root(b))
    df = spark.createDataFrame(cells, "c short, v long, id long, f long")
    held = spark.createDataFrame([(i, [int(v) for v in x.view(np.int64)]) for i, x in enumerate(sets)], "id long, s array<long>")
    got = {r.id: r.root for r in simhash.set_links(df, held, 0.8, 64).collect()}
    assert [got.get(i, i) for i in range(len(sets))] == [root(i) for i in range(len(sets))] and len(got) > 20


def test_set_links_make_no_row_for_a_pair_of_unlike_sets(spark, monkeypatch):
    """A family below the threshold that shares what its head lacks, with one pair over it, in blocks of 100 sets."""
    from tests.test_growth import most_rows

    rng = np.random.default_rng(8)
    sets = [[*range(100), *(1000 + rng.choice(140, 25, False)).tolist()] for _ in range(300)]
    sets[7] = [*sets[150][:-5], *range(5000, 5005)]  # 120 of 130
    made, components = [], simhash.components
    monkeypatch.setattr(simhash, "components", lambda edges: (made.append(most_rows(edges)), components(edges))[1])
    monkeypatch.setattr(simhash, "NODES", 100, raising=False)
    alike = {(a, b) for a in range(300) for b in range(a) if len({*sets[a]} & {*sets[b]}) >= 250 * 4 / 9}
    assert len(alike) < 30 and (150, 7) in alike
    top = list(range(300))
    for a, b in sorted(alike):
        top = [min(top[a], top[b]) if x in (top[a], top[b]) else x for x in top]
    df = spark.createDataFrame([(0, 0, i, 0) for i in range(300)], "c short, v long, id long, f long")
    held = spark.createDataFrame(list(enumerate(sets)), "id long, s array<long>")
    got = {r.id: r.root for r in simhash.set_links(df, held, 0.8, 64).collect()}
    assert [got.get(i, i) for i in range(300)] == top and max(made) <= 2000
