"""What queries make on the way to their rows grows with the input, not with the square of a group."""

from __future__ import annotations

from pyspark.sql import functions as F

from textmill.operators import analysis as A
from textmill.operators.overlap import most_shared
from textmill.plans import catalog


def most_rows(df) -> int:
    """The largest number of rows that a step of the executed plan made."""

    def walk(node) -> int:
        kind = node.getClass().getSimpleName()
        n = node.metrics().get("numOutputRows")
        most = n.get().value() if n.isDefined() else 0
        inner = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else []
        children = node.children()
        return max([most, *[walk(x) for x in inner], *[walk(children.apply(i)) for i in range(children.size())]])

    df.collect()
    return walk(df._jdf.queryExecution().executedPlan())


def test_parts_of_one_name_are_not_paired_with_every_question(spark, tmp_path):
    spark.range(1, 3001).selectExpr("id AS p_partkey", "'Blue Ring' AS p_name").write.parquet(f"{tmp_path}/part.parquet")
    out = catalog.queries()["flt14_part_names"](spark, str(tmp_path))
    assert most_rows(out) <= 6000
    rows = sorted((r.qid, r["rank"], r.id) for r in out.collect())
    assert rows == [(q, i, i) for q in range(50, 3001, 50) for i in range(1, 11)]


def test_lines_of_scripts_are_not_shuffled(spark):
    plan = catalog.queries()["lnt8_syntax_lines"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ENSURE_REQUIREMENTS" not in plan


def test_extents_of_deep_code_take_a_row_a_line(spark):
    deep = [("f", i, " " * i + f"func f{i}():") for i in range(1, 301)] + [("f", 301, "func g():"), ("f", 302, ""), ("e", 1, "\tfunc h():")]
    out = A.function_extents(spark.createDataFrame(deep, "path string, line_no int, line string"), F.col("line") != "")
    assert most_rows(out) <= len(deep)
    assert {tuple(r) for r in out.collect()} == {("f", "f1", 1, 301, 300), ("f", "g", 301, 303, 1), ("e", "h", 1, 2, 1)}


def test_overlaps_equal_all_pairs_in_blocks_of_any_size(spark):
    import random

    rng = random.Random(5)
    sets = {i: sorted(rng.sample("abcdefghijkl", rng.randint(0, 6))) for i in range(150)} | {200 + i: list("abc") for i in range(40)}
    df = spark.createDataFrame([(i, s) for i, s in sets.items()], "id long, s array<string>")
    pairs = {a: max((len(set(s) & set(t)) for b, t in sets.items() if b > a), default=0) for a, s in sets.items()}
    want = {a: n for a, n in pairs.items() if n > 1}
    for block in (40, 10_000):
        assert dict(map(tuple, most_shared(df, block).collect())) == want


def test_copies_are_not_paired(spark, tmp_path):
    spark.range(2000).selectExpr("id AS doc_id", "'extraordinary circumstances' AS text").write.parquet(f"{tmp_path}/documents.parquet")
    out = catalog.queries()["jn9_shared_keywords"](spark, str(tmp_path))
    assert most_rows(out) <= 4000
    assert out.count() == 1999


def test_guards_are_met_by_the_beginning_of_their_word(spark):
    body = lambda name, rest="": "\n".join([f"func {name}(a):", *[f"\t{name}({i})" for i in range(4)], rest])
    code = {"free": body("g", "\tif not f"), "own": body("g", "\tif not g"), "longer": body("g", "\tif !gate"), "other": body("gate", "\tif not g"), "twice": body("g", "if not if not g"), "two": body("a", "if not ab") + "\n" + body("b", "if !aa")}
    df = spark.createDataFrame(list(code.items()), "path string, content string")
    assert {tuple(r) for r in A.recursive(df).collect()} == {("free", "g"), ("other", "gate"), ("two", "b")}


def test_the_code_of_a_file_is_not_kept_beside_its_functions(spark):
    """A row of a function with its file's code would take the square of the file."""
    files = spark.createDataFrame([("f", "func f(a):")], "path string, content string").repartition(2)
    plan = A.recursive(files)._jdf.queryExecution().optimizedPlan().toString()
    assert "contains(content" not in plan.lower().replace("#", "")


def test_names_of_changes_are_searched_in_words(spark):
    """Names that are no words are still found in the code."""
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    edges = table([("u", "t"), ("v", "t"), ("w", "s")], "src string, dst string")
    changes = table([("t", "Removed signal 'hit'"), ("t", "Removed signal 'my-hit'"), ("t", "Changed function go(a)"), ("s", "Removed signal 'hit'")], "target string, change string")
    files = table([("u", "on_hits()\nmy-hit"), ("v", "h i t\ngo_on"), ("w", "hi\nt")], "path string, content string")
    out = {(r.target, r.dependent): (r.high, r.medium, r.low) for r in A.cascade(edges, changes, files).collect()}
    assert out == {("t", "u"): (2, 0, 0), ("t", "v"): (0, 1, 0), ("s", "w"): (0, 0, 0)}
    words = A.cascade(edges, changes.filter("change NOT LIKE '%-%'"), files)
    assert "contains(content" not in words._jdf.queryExecution().optimizedPlan().toString().lower()


def test_a_task_holds_so_many_texts_and_questions_whatever_the_table(spark, tmp_path):
    from textmill.operators import search as S
    from textmill.plans import searches

    spark.range(18_000).selectExpr("id AS doc_id", "'en' AS lang", "concat('word', id % 7) AS text").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(500).selectExpr("id AS item_id", "concat('word', id % 7) AS text").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    rows = lambda df: max(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())
    assert rows(S.postings(docs)) <= 5_000  # one token a text, 4,000 texts a task
    met = searches.met(spark, str(tmp_path))
    assert rows(met) <= 250_000 and met.count() == sum(len(range(k, 18_000, 7)) * len(range(k, 500, 7)) for k in range(7))


def test_hits_of_index_words_are_no_rows(spark, tmp_path):
    spark.range(500).selectExpr("id AS doc_id", "concat('xabc', id) AS text").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(60).selectExpr("id AS item_id", "'abc xabc7' AS text").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = catalog.queries()["jn2_substring_search"](spark, str(tmp_path))
    assert most_rows(out) <= 500
    assert {(r.qid, r["rank"], r.id, r.score) for r in out.collect()} == {(q, i + 1, d, x) for q in range(60) for i, (d, x) in enumerate([(7, 2.0), *[(70 + j, 1.0) for j in range(4)]])}


def test_substring_scores_equal_brute_force_in_groups_of_any_size(spark):
    import random

    from textmill.operators import search as S

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("ab_") for _ in range(rng.randint(1, 6)))
    texts = [(rng.choice([None, *range(40)]), " ".join(word() for _ in range(rng.randint(0, 8))) if i % 9 else None) for i in range(60)]
    asked = [(rng.randint(1, 7), word()) for _ in range(25)]
    scores = {}
    for q, w in asked:
        for i, t in texts:
            for v in (t or "").split():
                if min(len(v), len(w)) > 2 and (v in w or w in v):
                    scores[q, i] = scores.get((q, i), 0) + (1.5 if v == w else 0.5)
    want = {(q, *x) for q in dict(asked) for x in sorted(((i, s) for (p, i), s in scores.items() if p == q), key=lambda x: (-x[1], x[0] is not None, x[0] or 0))[:3]}
    docs, words = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(asked, "qid long, token string")
    for each, block in ((4_000, 250), (7, 2)):
        out = S.substring_top(docs, words, 3, tokens=F.split("text", " "), each=each, block=block)
        assert {(r.qid, r.id, r.score) for r in out.collect()} == want


def test_findings_of_scripts_make_no_row_a_line(spark):
    out = catalog.queries()["agg16_findings"](spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan


def test_findings_are_made_once(spark):
    out = catalog.queries()["top10_priority"](spark, "/root/testdata/sf0.001")
    assert "documents.parquet" not in out._jdf.queryExecution().executedPlan().toString()


def test_marks_of_lines(spark):
    code = "var a = 1\n func f():\n\tvar b = 2\n# x\n\t# y\n\n\tz\nif a:\nconst C = 3\n\tvar d: int\n\tfunc _process(x):\n\tvar e = 4\n\t # q\n \t\n\tw\n#"
    row = A._marked(spark.createDataFrame([("p", code)], "path string, content string")).first()
    assert (row.marks, row.n_lines) == ("VFv#c bOVvP11:vc b#", 16)
    got = A.measures(spark.createDataFrame([("p", code)], "path string, content string")).first()
    assert (got.globals, got.comments, got.functions, got.n_lines) == (3, 4, 2, 16)


def test_code_of_scripts_is_not_shuffled_to_be_compared(spark):
    out = catalog.queries()["lnt16_compared"](spark, "/root/testdata/sf0.001")
    assert "content" not in out._jdf.queryExecution().executedPlan().toString()


def test_scripts_are_validated_without_a_row_a_line(spark):
    out = catalog.queries()["lnt18_validated_files"](spark, "/root/testdata/sf0.001")
    assert "posexplode" not in out._jdf.queryExecution().executedPlan().toString()


def test_frequent_grams_are_those_of_counting_all(spark):
    import random
    from collections import Counter

    from textmill.operators import feedback

    rng = random.Random(9)
    rows = [[rng.choice("aabbbcdefgh") * 2 for _ in range(rng.randint(0, 9))] for _ in range(60)]
    counts = Counter(w for r in rows for w in r) + Counter(" ".join(p) for r in rows for p in zip(r, r[1:]))
    df = spark.createDataFrame([(r,) for r in rows], "terms array<string>")
    for most in (3, 12, 500):
        assert feedback.frequent_grams(df, most) == [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:most]]


def test_cosine_scores_equal_brute_force_in_groups_of_any_size(spark):
    import math
    import random
    from collections import Counter

    from textmill.operators import search as S

    rng = random.Random(4)
    words = lambda most: " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, most)))
    texts = [(rng.choice([None, *range(40)]), words(9) if i % 9 else None) for i in range(60)]
    asked = {q: Counter([*words(5).split(), "new"]) for q in [None, *range(7)]}
    tf = {i: Counter(w for j, t in texts if j == i for w in (t or "").split()) for i, _ in texts}
    df = Counter(w for c in tf.values() for w in c)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    asked_tf = spark.createDataFrame([(q, w, n) for q, c in asked.items() for w, n in c.items()], "qid long, token string, tf long")
    for weigh, most in ((True, sum), (False, max)):
        idf = {w: math.log(60 / (n + 1)) + 1 if weigh else math.log(60 / n) for w, n in df.items()}
        of = {i: {w: n / most(c.values()) * (idf[w] if weigh else 1) for w, n in c.items()} for i, c in tf.items() if c and i is not None}
        want = set()
        for q, c in asked.items():
            v = {w: n / most(c.values()) * idf.get(w, 1.0 if weigh else 0.0) for w, n in c.items()}
            both = lambda u: sum(x * v.get(w, 0) for w, x in u.items()) / max(1e-9, math.hypot(*u.values()) * math.hypot(*v.values()))
            best = sorted((-round(both(u), 6), i) for i, u in of.items())[:3] if q is not None else []
            want |= {(q, i, -x, r + 1) for r, (x, i) in enumerate(best) if -x >= 0.3}
        for each, block in ((4_000, 250), (7, 2)):
            out = S.cosine_top(docs, asked_tf, 3, 0.3, weigh, tokens=F.split("text", " "), each=each, block=block)
            got = {(r.qid, r.id, r.score, r["rank"]) for r in out.collect()}
            assert got == want and len(want) > 5


def test_postings_of_cosine_searches_are_no_rows(spark, tmp_path):
    """Neither a token of a text nor its meeting with a question is a row: nothing of the plan grows with them."""
    spark.range(400).selectExpr("id AS doc_id", "array_join(transform(sequence(1, 50), i -> concat('word', i)), ' ') || ' own' || id AS text").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(60).selectExpr("id AS item_id", "'word1 word2 own7' AS text").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name in ("top6_tfidf_search", "top7_recall"):
        out = catalog.queries()[name](spark, str(tmp_path))
        assert most_rows(out) <= 700
        assert {(r.qid, r["rank"], r.id) for r in out.collect() if r["rank"] == 1} == {(q, 1, 7) for q in range(60)}


def test_repeated_signals_are_told_apart_without_a_search_for_each(spark):
    from textmill.functions import lint

    code = ["signal a\n\tsignal b(x) \n x\nsignal\ta\nsignal b\nsignal b(x)\nsignal -c\nsignal -c", "signal a", "", "signal a \x85\n\nsignal a\nsignal a", None]
    want = ["signal a\n\tsignal b(x) \n x\nsignal b\nsignal -c\nsignal -c", "signal a", "", "signal a \x85\n", None]
    df = spark.createDataFrame(list(enumerate(code)), "i int, c string")
    out = df.select("i", lint.without_repeated_signals(F.col("c")).alias("c"), lint.rewritten(F.col("c")).alias("r"))
    assert "array_position" not in out._jdf.queryExecution().optimizedPlan().toString()
    rows = sorted(out.collect())
    assert [r.c for r in rows] == want and rows[4].r.code is None and rows[4].r.n_loops is None


def test_kinds_of_hints_are_counted_as_they_are_given(spark):
    from textmill.functions import lint

    code = 'var a = ""\nvar b = 0\nvar c = 01\nvar var = true\nvar d = truevar e = 0\nfor x in range(len(y)):\n\tz'
    r = spark.createDataFrame([(code,)], "c string").select(lint.rewritten(F.col("c")).alias("r")).first().r
    assert r.code == 'var a: String = ""\nvar b: int = 0\nvar c = 01\nvar var: bool = true\nvar d: bool = truevar e: int = 0\nfor x in y:\n\tz\n'
    assert (r.n_loops, r.n_hints) == (1, 3)


def test_scenes_in_groups_equal_pointer_doubling(spark):
    import random

    from textmill.operators import trees

    rng = random.Random(8)
    rows = [(f"s{k}", i if rng.random() < 0.95 else None, f"n{rng.randint(1, 30)}", rng.choice([".", None, "gone", "off", *[f"n{rng.randint(1, i + 2)}"] * 6])) for k in range(12) for i in range(1, 25)]
    rows = list({(r[0], r[1] is None, r[2] if r[1] is None else r[1]): r for r in rows}.values())
    df = spark.createDataFrame(rows, "path string, line_no int, name string, parent string").repartition(3)
    want = sorted(map(tuple, trees.hierarchy(df, most=0).collect()), key=repr)
    assert sorted(map(tuple, trees.hierarchy(df, each=60).collect()), key=repr) == want and any(r[4] is None for r in want)
    assert sorted(map(tuple, trees.hierarchy(df, most=23).collect()), key=repr) == want


def test_scenes_take_no_rounds_of_joins(spark):
    """The scenes of the documents are walked in their groups: no join is left in the plan, and no table of a round was written."""
    import glob

    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    count = lambda: len(glob.glob(f"{folder}/tree-tour-*"))
    before = count()
    out = catalog.queries()["grf6_hierarchy"](spark, "/root/testdata/sf0.001")
    assert count() == before and "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_a_cascade_makes_its_scripts_once(spark, tmp_path, monkeypatch):
    """On repeated rows, null and empty texts and words that changes speak of, the rows of the SQL; scripts are made once, and no task searches their code."""
    from tests.oracle import database, rows_of, rows_of_sql
    from textmill.plans import projects

    rows = [(i, "src", " ".join(f"{w}{'x' * ((i + j) % 9)}" for j, w in enumerate(["signal", "variable", "export", "method", "ab", "a-b", "", "Function", "\u00e9"] * 9))) for i in range(130)]
    rows += [rows[5], (7, "src", "ab signal"), (20, "src", ""), (21, "src", None), (22, None, "ab"), (None, "src", "ab")]
    monkeypatch.setattr("tests.oracle.TABLES", ["documents"])
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    made, scripts = [], projects.scripts
    monkeypatch.setattr(projects, "scripts", lambda *a: (made.append(1), scripts(*a))[1])
    out = catalog.queries()["agg20_jn11_cascade"](spark, str(tmp_path))
    assert rows_of(out) == rows_of_sql(database(str(tmp_path)), catalog.oracle_sql()["agg20_jn11_cascade"])[1]
    assert len(made) == 1 and "regexp" not in out._jdf.queryExecution().optimizedPlan().toString().lower()


def test_words_shared_with_the_document_before_over_many_ranges(spark, tmp_path, monkeypatch):
    """On gaps between ids, null and empty texts and a null id, the rows of the SQL, with a few texts a range; texts are dealt once and no window holds them all."""
    import random

    from tests.oracle import database, rows_of, rows_of_sql
    from textmill.functions import tokens
    from textmill.operators import overlap

    rng = random.Random(4)
    text = lambda: rng.choice(["", " ", "\t a\nA  b", None, *[" ".join(rng.choices("abcdefghijk", k=rng.randint(1, 20)))] * 6])
    rows = [(3 * i, text()) for i in rng.sample(range(400), 300)] + [(None, "a b c d e f")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr("tests.oracle.TABLES", ["documents"])
    want = rows_of_sql(database(str(tmp_path)), catalog.oracle_sql()["set4_overlap"])[1]
    out = catalog.queries()["set4_overlap"](spark, str(tmp_path))
    assert rows_of(out) == want and any(r[1] is None for r in want) and len(want) < 295
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    words = F.array_distinct(tokens.blank_split(F.col("text")))
    assert rows_of(overlap.shared_with_before(docs, "doc_id", "text", words, room=60)) == want
    assert most_rows(overlap.shared_with_before(docs, "doc_id", "text", words)) <= 2 * 301  # one row a text, and two a range
