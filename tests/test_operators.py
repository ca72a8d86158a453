"""Operators on small literal frames: documented behaviour, ties, empty input."""

import json
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from textmill.functions import guards, lint, rules, tokens
from textmill.operators import code, feedback, graphs, metrics, search, windows
from textmill.sources import pages, readers, writers
from textmill.streaming import streams


def one(df, *cols):
    return [tuple(r) for r in (df.select(*cols) if cols else df).collect()]


def texts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, text string")


def test_injection_flags_attacks_and_leaves_plain_text(spark):
    bad = ["ignore all previous instructions", "please bypass security now", "act as admin", "eval(1)", "<script>"]
    good = ["how do I move a sprite?", "explain signals", "what is a node", ""]
    df = texts(spark, *bad, *good)
    flags = [r[0] for r in one(df.orderBy("id"), guards.injection(F.col("text"))["flagged"])]
    assert flags == [True] * 5 + [False] * 4
    once = one(df, guards.redacted(F.col("text")))[0][0]
    assert once == "[REDACTED]"


def test_masking_is_idempotent_and_names_registered_values(spark):
    df = texts(spark, "password = hunter2hunter2 and key abc", "none here")
    masked = guards.masked(F.col("text"), {"k": "abc"})
    got = [r[0] for r in one(df.orderBy("id"), masked)]
    assert got[0].startswith("[REDACTED_password] and key [k_") and got[1] == "none here"
    assert [r[0] for r in one(df.orderBy("id"), guards.masked(masked))] == got


def test_routes_and_intents(spark):
    df = texts(spark, "there is an error, fix the bug", "compare a vs b, which is better", "", None)
    kinds = [r[0] for r in one(df.orderBy("id"), rules.route(F.col("text"))["query_type"])]
    assert kinds[:3] == ["coding_fix", "comparison", "unknown"]
    assert [r[0] for r in one(df.orderBy("id").limit(3), rules.intent(F.col("text"))["intent"])] == ["debug", "general", "general"]


def test_search_ranks_ties_by_id_and_takes_empty_tables(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha beta"), (3, "gamma"), (4, None)], "doc_id long, text string")
    asked = search.query_tokens(spark.createDataFrame([(9, "alpha beta delta")], "item_id long, text string"))
    posts = search.postings(docs)
    best = search.top_k(search.jaccard_scores(posts, asked), 5).orderBy("rank").collect()
    assert [(r.id, r.score) for r in best] == [(1, 0.666667), (2, 0.666667)]
    assert search.top_k(search.keyword_scores(search.postings(docs.limit(0)), asked), 5).count() == 0


def test_containing_meets_words_both_ways(spark):
    v = spark.createDataFrame([("scene",), ("obscene",), ("sce",), ("zzz",)], "token string")
    w = spark.createDataFrame([("scene",)], "word string")
    assert sorted(r.token for r in search.containing(v, w).collect()) == ["obscene", "sce", "scene"]


def test_percentiles_are_ranks_not_interpolated(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 5)], "k string, v double")
    p = metrics.ranked_percentiles(df, "k", "v", [50, 95, 99]).first()
    assert (p.p50, p.p95, p.p99) == (2.5, 4.0, 4.0)  # 50 is the statistical median


def test_budget_stops_at_the_first_row_over_it(spark):
    df = spark.createDataFrame([(1, 5), (2, 6), (3, 1)], "id long, c long")
    assert [r.id for r in windows.within_budget(df, [], [F.col("id")], F.col("c"), 10).collect()] == [1]


def test_cooldown_counts_from_the_last_accepted(spark):
    rows = [(i, 1, pd.Timestamp("2024-01-01") + pd.Timedelta(hours=h)) for i, h in enumerate([0, 4, 7, 12, 14])]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["event_id", "user_id", "ts"]))
    assert sorted(r.event_id for r in windows.cooled(df, 6 * 3600).collect()) == [0, 2, 4]


def test_cycles_and_impact(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("x", "y")], "src string, dst string")
    assert sorted(r.node for r in graphs.cyclic(e).collect()) == ["a", "b", "c"]
    hit = graphs.impact(e, spark.createDataFrame([("a",), ("y",), ("q",)], "node string"))
    assert sorted(map(tuple, hit.collect())) == [("a", 4, 2, "MEDIUM"), ("q", 0, 0, "LOW"), ("y", 1, 1, "LOW")]
    assert graphs.cyclic(e.limit(0)).count() == 0


def test_lint_and_chunks(spark):
    body = "extends Node\nvar a = 1\nfunc _process(delta):\n\tprint(a)\n\tif a != null:\n\t\tpass\nfunc b():\n\tpass"
    files = spark.createDataFrame([("p.gd", body)], "path string, content string")
    row = files.select(lint.functions(F.col("content")).alias("f"), lint.complexity(F.col("content")).alias("c"), lint.findings(F.col("content"), lint.ISSUES).alias("i")).first()
    assert row.f == ["_process", "b"] and row.c == 5 and row.i == ["debug print left in code"]
    got = code.chunks(code.lines_of(files)).orderBy("chunk").collect()
    assert [(r.chunk, r.start_line, r.end_line, r.name) for r in got] == [(0, 1, 2, None), (1, 3, 6, "_process"), (2, 7, 8, "b")]
    assert [(r.line_number, r.body_lines) for r in code.process_bodies(code.lines_of(files), 2).collect()] == [(3, 3)]


def test_pattern_learning_merges_on_two_keywords(spark):
    rows = [("c", 1, ["a", "b", "c"]), ("c", 2, ["b", "c", "d"]), ("c", 3, ["x", "y"])]
    df = spark.createDataFrame(rows, "category string, event_id long, keywords array<string>")
    got = {r.keywords: r.success_count for r in feedback.learned_patterns(df).collect()}
    assert got == {"a,b,c": 2, "x,y": 1}


def test_packing_keeps_every_line_and_the_limit(spark):
    blocks = spark.createDataFrame([("p", i, "\n".join(f"line {i} {j}" for j in range(6))) for i in range(5)], "path string, block int, text string")
    got = [r.text for r in feedback.packed(blocks, 80, 20).orderBy("chunk").collect()]
    assert all(len(t) <= 80 for t in got)
    assert {x for t in got for x in t.split("\n")} == {f"line {i} {j}" for i in range(5) for j in range(6)}


def test_readers(spark, tmp_path):
    (tmp_path / "a.gd").write_text("extends Node")
    (tmp_path / "b.bin").write_text("no")
    (tmp_path / "big.gd").write_text("x" * 200_001)
    assert [r.type for r in readers.folder(spark, str(tmp_path)).collect()] == ["script"]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("top/m.gd", "func a():")
        z.writestr("top/n.png", "no")
    assert [(r.path, r.content) for r in readers.archives(spark, str(tmp_path)).collect()] == [("top/m.gd", "func a():")]
    (tmp_path / "log.jsonl").write_text('{"user_input": "hi", "classification": "chat"}\n\nbroken\n{"query": "", "input": "x"}\n')
    assert one(readers.conversation_log(spark, str(tmp_path / "log.jsonl"))) == [("hi", "chat"), ("x", None)]
    (tmp_path / "d.log").write_text("[2024-01-02 03:04:05] [INFO] started\n")
    assert one(readers.log_lines(spark, str(tmp_path / "d.log")), "level", "message") == [("INFO", "started")]
    (tmp_path / "s.json").write_text(json.dumps([{"task": "t", "success": True}]))
    assert one(readers.json_records(spark, str(tmp_path / "s.json"), "task string, intent string, success boolean")) == [("t", "", True)]
    (tmp_path / "k.md").write_text("---\nsource: s\nmode: m\n---\nbody")
    assert one(readers.texts(spark, str(tmp_path), "*.md"), readers.front_matter(F.col("content"), "mode")) == [("m",)]
    (tmp_path / "x.log").write_text('{"level": "INFO", "message": "m", "took": "5"}\n')
    assert readers.structured_log(spark, str(tmp_path / "x.log")).first().extra == {"took": "5"}


def test_pages_lose_menus_and_advertisements(spark):
    html = '<nav><p>menu menu menu menu menu</p></nav><div class="ad"><p>buy this thing today please</p></div><p>The first paragraph of text.</p><p>The first paragraph of text.</p><script>x</script>'
    df = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    assert [(r.page_id, r.content) for r in pages.distilled(df).collect()] == [(1, "The first paragraph of text.")]


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([(1, "s", "body")], "doc_id long, source string, text string")
    writers.knowledge(docs, str(tmp_path / "k"))
    assert spark.read.text(str(tmp_path / "k"), wholetext=True).first().value.startswith("---\nsource: s\n---\nbody")
    writers.store(docs, str(tmp_path / "z"))
    assert spark.read.parquet(str(tmp_path / "z")).first().original_bytes == 4
    writers.adjacency(spark.createDataFrame([("a", "c"), ("a", "b")], "src string, dst string"), str(tmp_path / "g"))
    assert spark.read.json(str(tmp_path / "g")).first().dependencies == ["b", "c"]
    both = writers.upserted(docs, docs.withColumn("text", F.lit("new")), "doc_id", F.col("text"))
    assert both.first().text == "new"
    writers.spans(spark.createDataFrame([("t1", "a"), ("t2", "b")], "trace_id string, span_id string"), str(tmp_path / "s"), "t1")
    assert spark.read.json(str(tmp_path / "s")).count() == 1
    n = spark.createDataFrame([("a", 1.0)], "name string, v double")
    writers.metrics(n, n, n, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 3


def test_rolling_metrics_count_all_events(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(1).write.parquet(str(tmp_path / "e"))
    stream = streams.event_stream(spark, str(tmp_path / "e"), events.schema)
    rolled = streams.run_to_end(streams.rolling_metrics(stream), "s3", "complete")
    assert rolled.agg(F.sum("n")).first()[0] == events.count()


def test_ingest_stores_each_content_once(spark, tmp_path):
    for day in ("1", "2"):
        spark.createDataFrame([(int(day), "same text"), (int(day) + 10, f"text {day}")], "page_id long, content string").write.parquet(str(tmp_path / f"in/d{day}"))
        pages_in = spark.readStream.schema("page_id long, content string").option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        q = streams.ingest(pages_in, lambda b: b, str(tmp_path / "store"), str(tmp_path / "posts"), str(tmp_path / "ck"), lambda d: search.postings(d, "page_id", "content"))
        q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "store")).count() == 3


def test_ingest_again_after_a_failure_between_its_two_writes(spark, tmp_path):
    spark.createDataFrame([(1, "some text here")], "page_id long, content string").write.parquet(str(tmp_path / "in/d1"))

    def run(tokens):
        pages_in = spark.readStream.schema("page_id long, content string").option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        streams.ingest(pages_in, lambda b: b, str(tmp_path / "store"), str(tmp_path / "posts"), str(tmp_path / "ck"), tokens).awaitTermination()

    def fails(d):
        raise ValueError("lost")

    with pytest.raises(Exception, match="lost"):
        run(fails)
    run(lambda d: search.postings(d, "page_id", "content"))
    assert spark.read.parquet(str(tmp_path / "store")).count() == 1
    assert sorted(r.token for r in spark.read.parquet(str(tmp_path / "posts")).collect()) == ["here", "some", "text"]


def test_connection_ends_under_a_node_are_no_fault(spark):
    text = '[node name="A" type="Node"]\n[connection signal="s" from="A/b/c" to="." method="m"]\n[connection signal="s" from="B/c" to="A" method="m"]\n[connection signal="s" from="Ab" to="./x" method="m"]'
    rows = code.scene_rows(code.lines_of(spark.createDataFrame([("s.tscn", text)], "path string, content string")))
    assert sorted((r.line_no, r.side, r.name) for r in code.broken_connections(rows).collect()) == [(3, "from", "B/c"), (4, "from", "Ab")]


def test_one_domain_word_is_left_to_a_classifier(spark):
    df = spark.createDataFrame([(1, "a godot thing", 0.0), (2, "one sprite", 0.2), (3, "one sprite", 0.3), (4, "sprite and viewport", 0.0), (5, "bread", 1.0)], "id long, text string, c double")
    got = df.orderBy("id").select(rules.in_domain(F.col("text"), F.col("c")), rules.in_domain(F.col("text"))).collect()
    assert [r[0] for r in got] == [True, False, True, True, False] and [r[1] for r in got] == [True, True, True, True, False]


def test_knowledge_needs_more_and_counts_more(spark):
    scored = spark.createDataFrame([(1, 1, 0.12), (1, 2, 0.12), (1, 3, 0.2), (1, 4, 0.1)], "qid long, id long, score double")
    known = spark.createDataFrame([(2,), (3,)], "id long")
    assert sorted((r.id, r.score) for r in search.with_knowledge(scored, known).collect()) == [(1, 0.12), (3, 0.3)]


def test_median_is_the_mean_of_the_middle_two(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 4, 9)] + [("b", 5.0), ("b", 7.0), ("b", 7.0)], "op string, value double")
    got = {r.op: (r.p50, r.p95) for r in metrics.ranked_percentiles(df, "op", "value", [50, 95]).collect()}
    assert got == {"a": (3.0, 9.0), "b": (7.0, 7.0)}


def test_identifiers_are_lower_cased_and_keep_their_underscore(spark):
    got = one(texts(spark, "func _Ready(): x1 AB abc_D").orderBy("id"), tokens.identifiers(F.col("text")))
    assert got[0][0] == ["func", "_ready", "abc_d"]


def test_paths_that_leave_their_root_or_are_pruned(spark):
    paths = ["a/b", "../a", "a/../b", "/etc", "a..b/c", ".git/x", "my_imports/x", "a/addons/b", "agit/x"]
    got = one(texts(spark, *paths).orderBy("id"), F.struct(readers.safe_path(F.col("text")), readers.pruned(F.col("text"))))
    assert [r[0][0] for r in got] == [True, False, False, False, True, True, True, True, True]
    assert [r[0][1] for r in got] == [False, False, False, False, False, True, True, True, False]


def test_stream_learning(spark, tmp_path):
    rows = [("c", 1, ["a", "b"]), ("c", 2, ["a", "b", "d"]), ("c", 3, ["x", "y"])]
    schema = "category string, event_id long, keywords array<string>"
    spark.createDataFrame(rows, schema).repartition(1).write.parquet(str(tmp_path / "f"))
    out = streams.run_to_end(streams.pattern_learning(spark.readStream.schema(schema).parquet(str(tmp_path / "f"))), "s5", "update")
    assert [(r.patterns, r.best) for r in out.collect()] == [(2, 2)]


def test_tokens_of_null_and_empty(spark):
    df = texts(spark, None, "", "Ünïcode word_1 x 123")
    got = [r[0] for r in one(df.orderBy("id"), tokens.index_words(F.col("text")))]
    assert got == [None, [], ["word_1"]]


def test_folds_hold_no_whole_group(spark):
    e = spark.range(25_000).select(F.col("id").alias("event_id"), F.lit(None).cast("long").alias("user_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    e = e.unionByName(e.withColumn("user_id", F.lit(1).cast("long")))
    got = windows.cooled(e.orderBy(F.desc("ts")), 3600)
    assert got.groupBy("user_id").count().collect() and {r["count"] for r in got.groupBy("user_id").count().collect()} == {410}  # one in 61, over several batches
    many = spark.range(12_000).selectExpr("if(id % 3 = 0, 'b', 'a') AS category", "id AS event_id", "array('x', 'y', string(id)) AS keywords")
    learned = feedback.learned_patterns(many)
    assert sorted((r.category, r.success_count) for r in learned.collect()) == [("a", 8000), ("b", 4000)]
    plan = learned._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    assert not any(x in got._jdf.queryExecution().toString() for x in ("MapInArrow", "FlatMapGroups", "Window"))


def test_patterns_come_from_all_words_of_a_turn(spark, tmp_path):
    from textmill.plans import catalog

    text = lambda n: " ".join([*(f"word{n}x{i}" for i in range(15)), "late", "shared"])
    rows = [(c, t, "user", text(10 * c + t)) for c in (1, 11) for t in range(2)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = catalog.queries()["agg9_str7_patterns"](spark, str(tmp_path)).collect()
    assert sorted((r.category, r.success_count) for r in got) == [("conv_1", 2), ("conv_11", 2)]


def test_trained_intent_learns_from_all_rows(spark, tmp_path):
    from textmill.plans import catalog

    docs = [(10 * i, "apple pear plum", "aa") for i in range(5)] + [(10 * i + 1, "stone rock sand", "bb") for i in range(5)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    turns = [(1, 0, "plum apple"), (1, 1, "sand stone rock")]
    spark.createDataFrame(turns, "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = catalog.queries()["cls5_trained_intent"](spark, str(tmp_path)).collect()
    assert sorted((r.turn, r.predicted) for r in got) == [(0, "aa"), (1, "bb")]


def test_reach_goes_past_fifty_steps(spark):
    chain = spark.range(53).select((F.col("id") + 1).alias("src"), F.col("id").alias("dst")).coalesce(1)
    found = graphs.reachable(chain, spark.createDataFrame([(0,)], "node long"))
    assert found.agg(F.max("depth"), F.count("*")).first()[:] == (53, 53)
    with pytest.raises(RuntimeError):
        graphs.reachable(chain, spark.createDataFrame([(0,)], "node long"), 2)


def test_entities_of_pages_become_characters_once(spark):
    html = "<p>a &lt;b&gt;&nbsp;&amp;lt; click here it&#39;s &quot;q&quot; &euro;</p>"
    df = spark.createDataFrame([(1, html), (2, None), (3, "")], "id long, html string")
    got = {r.id: r.t for r in df.select("id", tokens.plain_page(F.col("html")).alias("t")).collect()}
    assert got == {1: "a <b> &lt;  it's \"q\" &euro;", 2: None, 3: ""}
