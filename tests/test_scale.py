"""Operators whose one key may hold all rows: scans, selection, cooldown, components, trees; against plain Python."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from textmill.functions import shapes
from textmill.operators import graphs, metrics, spread, trees, windows
from textmill.sources import feeds


def test_running_sums_and_carried_values_over_null_and_hot_keys(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, "a", "a", "a", "b"]), rng.randrange(50), rng.choice([None, 1, 2, 3])) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, k string, t int, v int").repartition(7)
    order = [F.desc("t"), F.col("id")]
    got = {r.id: (r.s, r.n) for r in spread.running(df, ["k"], order, {"s": F.col("v"), "n": F.lit(1)}).collect()}
    last = {r.id: r.x for r in spread.carried(df, ["k"], order, {"x": F.col("v")}).collect()}
    ahead = {r.id: r.s for r in spread.running(df, ["k"], order, {"s": F.col("v")}, before=True).collect()}
    for k in (None, "a", "b"):
        s = n = 0
        x = None
        for i, _, _, v in sorted((r for r in rows if r[1] == k), key=lambda r: (-r[2], r[0])):
            assert ahead[i] == s and last[i] == x
            s, n, x = s + (v or 0), n + 1, v if v is not None else x
            assert got[i] == (s, n)
    assert spread.running(df.limit(0), ["k"], order, {"s": F.col("v")}).count() == 0


def test_no_task_holds_a_key_of_all_rows(spark):
    """A window of a scan stands on key and range, so Spark deals a single key to many tasks."""
    df = spark.range(100_000).select(F.lit(1).alias("k"), "id", (F.col("id") % 7).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small a table would be one task
    try:
        out = spread.running(df, ["k"], [F.col("id")], {"s": F.col("v")})
        parts = out.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r["count"] for r in parts) < 60_000 and out.agg(F.max("s")).first()[0] == sum(i % 7 for i in range(100_000))


def test_selection_equals_sorted_lists(spark):
    rng = random.Random(1)
    make = [lambda: rng.gauss(0, 1), lambda: float(rng.randrange(3)), lambda: rng.choice([1e-300, 1.0, 1e300, -1e308, 1e308]), lambda: 5.0, lambda: 2.0 ** rng.randrange(-900, 900)]
    rows = [(f"k{i % 5}", make[i % 5]()) for i in range(3000)] + [("k0", None), ("k0", float("nan")), (None, 1.5), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r.k: (r.p50, r.p95, r.p99, r.p1) for r in metrics.ranked_percentiles(df, "k", "v", [50, 95, 99, 1]).collect()}
    held = defaultdict(list)
    for k, v in rows:
        if v is not None and v == v:
            held[k].append(v)
    for k, vs in held.items():
        vs.sort()
        n = len(vs)
        at = lambda p: vs[min(n * p // 100, n - 1)]
        assert got[k] == ((vs[(n - 1) // 2] + vs[n // 2]) / 2, at(95), at(99), at(1))
    assert set(got) == set(held)
    plan = metrics.selected(df, "k", "v", {"m": lambda n: F.floor(n / 2)})._jdf.queryExecution().toString()
    assert "Window [" not in plan


def test_statistics_keep_groups_without_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), (None, 3.0)], "op string, v double")
    got = {r.op: (r.n, r.p50) for r in metrics.operation_stats(df, "op", "v", F.col("v") > 0).collect()}
    assert got == {"a": (1, 1.0), "b": (1, None), None: (1, 3.0)}


def test_cooldown_of_ties_nulls_and_long_chains(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, 1, 1, 1, 2, 3]), rng.choice([None, *range(400)])) for i in range(3000)] + [(9000, 7, None), (9001, 7, None)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, s long").select("event_id", "user_id", F.timestamp_seconds("s").alias("ts")).repartition(5)
    got = sorted(r.event_id for r in windows.cooled(df, 3).collect())
    want, last = [], {}
    for i, u, s in sorted(rows, key=lambda r: (r[2] is None, r[2] or 0, r[0])):
        if u not in last or (s is not None and last[u] is not None and s - last[u] > 3):
            want.append(i)
            last[u] = s
    assert got == sorted(want) and len(want) > 250
    assert windows.cooled(df.limit(0), 3).count() == 0


def test_sessions_equal_a_fold(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 1, None]), rng.randrange(40_000)) for _ in range(1500)]
    df = spark.createDataFrame(rows, "user_id long, s long").select("user_id", F.timestamp_seconds("s").alias("ts"))
    got = sorted(((r.user_id, r.start_ts.timestamp(), r.n) for r in windows.sessions(df, 60).collect()), key=repr)
    want = []
    for u in (1, None):
        times = sorted(s for k, s in rows if k == u)
        start, n = times[0], 1
        for a, b in zip(times, times[1:]):
            if b - a >= 60:
                want.append((u, float(start), n))
                start, n = b, 0
            n += 1
        want.append((u, float(start), n))
    assert got == sorted(want, key=repr)


def components_by_hand(edges):
    out, nodes = defaultdict(set), {x for e in edges for x in e}
    for a, b in edges:
        out[a].add(b)

    def reach(a):
        seen, todo = set(), [a]
        while todo:
            for y in out[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        return seen

    far = {a: reach(a) for a in nodes}
    return {frozenset({b for b in far[a] if a in far[b]} | {a}) for a in nodes if a in far[a] and len({b for b in far[a] if a in far[b]} | {a}) > 1}, far


@pytest.mark.parametrize("n, m", [(40, 60), (12, 60)])
def test_components_and_impact_equal_plain_reachability(spark, n, m):
    rng = random.Random(n)
    edges = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)] + [("n1", "n1"), ("lone", "lone"), ("n1", "n1")]
    df = spark.createDataFrame(edges, "src string, dst string")
    want, far = components_by_hand(set(edges))
    found = defaultdict(set)
    for r in graphs.strong_components(df).collect():
        found[r.root].add(r.node)
    assert {frozenset(x) for x in found.values()} == want and all(k in v for k, v in found.items())
    assert {r.node for r in graphs.cyclic(df).collect()} == {a for a in far if a in far[a]}
    starts = spark.createDataFrame([(x,) for x in [*far, "absent", "n1"]], "node string")
    got = {r.start: (r.dependents, r.direct) for r in graphs.impact(df, starts).collect()}
    assert got == {x: (sum(x in far[y] for y in far), len({a for a, b in edges if b == x})) for x in [*far, "absent"]}


def test_a_ring_of_many_nodes_takes_few_rounds(spark, monkeypatch):
    n, rounds = 100_000, []
    monkeypatch.setattr(graphs, "written", lambda df, name, put=graphs.written: rounds.append(name) or put(df, name))
    ring = spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"))
    tail = spark.range(10).select((F.col("id") + n).alias("src"), (F.col("id") * 7).alias("dst"))
    got = graphs.strong_components(ring.unionByName(tail)).groupBy("root").count().collect()
    assert [r["count"] for r in got] == [n] and rounds.count("graph-labels") < 130


def test_graph_statistics(spark):
    e = spark.createDataFrame([("a.gd", "b.gd"), ("b.gd", "a.gd"), ("s.tscn", "a.gd"), ("s.tscn", "a.gd"), ("c.gd", "c.gd")], "src string, dst string")
    files = spark.createDataFrame([("a.gd",), ("b.gd",), ("c.gd",), ("s.tscn",), ("x.png",)], "path string")
    r = graphs.stats(files, e).first()
    assert (r.files, r.scripts, r.scenes, r.edges, r.cycles) == (5, 3, 1, 4, 2)
    assert [tuple(x) for x in r.most_depended_on] == [("a.gd", 2), ("b.gd", 1), ("c.gd", 1)]
    none = graphs.stats(files, e.limit(0)).first()
    assert (none.edges, none.cycles, none.most_depended_on) == (0, 0, [])


def test_preorder_equals_recursion(spark):
    rng = random.Random(6)
    rows = []
    for scene in "st":
        for i in range(1, 120):
            rows.append((scene, i, f"n{i}", rng.choice([".", None, "gone", *[f"n{rng.randrange(1, i + 1)}"] * 9]) if i > 1 else "."))
    rows = [r for r in rows if r[2] != r[3]] + [("u", 1, "p", "q"), ("u", 2, "q", "p"), ("u", 3, "under", "p")]
    got = {(r.path, r.name): (r.full_path, r.depth, r.position, r.size) for r in trees.hierarchy(spark.createDataFrame(rows, "path string, line_no int, name string, parent string")).collect()}
    want = {("u", "p"): ("q/p", 1, None, None), ("u", "q"): ("p/q", 1, None, None), ("u", "under"): ("q/p/under", 2, None, None)}
    for scene in "st":
        names = {n for s, _, n, _ in rows if s == scene}
        below = defaultdict(list)
        for s, i, n, p in rows:
            if s == scene:
                below[None if p in (None, ".") else p].append((i, n))
        roots = sorted(below[None] + [(min(below[p])[0], p) for p in below if p is not None and p not in names])
        count = 0

        def walk(name, trail, real):
            nonlocal count
            at = count
            count += real
            for _, n in sorted(below[name]):
                walk(n, [*trail, name], 1)
            if real:
                want[(scene, name)] = ("/".join([*trail, name]), len(trail), at, count - at)

        for _, n in roots:
            walk(n, [], int(n in names))
    assert got == want


def test_a_chain_of_ten_thousand_nodes(spark):
    n = 10_000
    chain = spark.range(n).select(F.lit("s").alias("path"), F.col("id").cast("int").alias("line_no"), F.concat(F.lit("n"), "id").alias("name"), F.when(F.col("id") == 0, ".").otherwise(F.concat(F.lit("n"), F.col("id") - 1)).alias("parent"))
    t = trees.written(trees.hierarchy(chain), "chain")
    bad = t.filter("name <> concat('n', position) OR depth <> position OR size <> 10000 - position OR length(full_path) - length(replace(full_path, '/', '')) <> depth")
    assert t.count() == n and bad.isEmpty()
    part = trees.below(t, spark.createDataFrame([("s", "n9990"), ("s", "absent")], "path string, name string")).orderBy("position").collect()
    assert [(r.name, r.depth, r.position) for r in part] == [(f"n{9990 + i}", i, i) for i in range(10)]


def test_objects_end_where_their_braces_close(spark):
    cases = {
        '{"a": 1} and {"b": 2}': '{"a": 1}', 'x {"a": {"b": 1,},} y}': '{"a": {"b": 1}}', '{ {"a": None}': '{"a": null}', "```json\n{\"a\": True,}\n``` {\"b\": 1}": '{"a": true}',
        '{"a": 1}': '{"a": 1}', "[1, 2]": "[1, 2]", "} {": None, "": None, "no": None, '{"a": }': None, '{"a": 1} tail': '{"a": 1}',
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    got = {r.t: r.j for r in df.select("t", shapes.lenient_json(F.col("t")).alias("j")).collect()}
    assert got == cases | {None: None}


RSS = '<?xml version="1.0"?><rss version="2.0" xmlns:m="http://m"><channel><title>The feed</title><link>http://f</link>' + "".join(f"<item><title>One &amp; Two Three Four {i}</title><m:title>no</m:title><link>http://x/{i}</link><description>&lt;b&gt;text {i}&lt;/b&gt;</description></item>" for i in range(5)) + "</channel></rss>"
ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><title>Notes</title><entry><title>Only Entry</title><link rel="self" href="http://s"/><link href="http://a"/><content>body</content></entry></feed>'


def test_both_dialects_of_feeds(spark):
    df = spark.createDataFrame([(1, RSS), (2, ATOM), (3, None), (4, ""), (5, "<rss><channel>"), (6, "<rss><channel><title>t</title></channel></rss>"), (7, "<rss><channel><item><title>Bare</title></item></channel></rss>")], "feed_id long, xml string")
    got = {(r.feed_id, r.place): r for r in feeds.entries(df).collect()}
    assert set(got) == {(1, 0), (1, 1), (1, 2), (2, 0), (7, 0)}
    assert got[1, 0].topic == "one & two" and got[1, 2].content == "Title: One & Two Three Four 2\nSource: The feed\nURL: http://x/2\n\nSummary: <b>text 2</b>"
    assert got[2, 0].content == "Title: Only Entry\nSource: Notes\nURL: http://a\n\nSummary: body"
    assert got[7, 0].content == "Title: Bare\nSource: Unknown\nURL: \n\nSummary: "
