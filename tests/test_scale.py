"""Operators that must not depend on reused exchanges, hubs, many groups or many queries: against plain versions."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import evals, graph, sessions, vector


@pytest.fixture
def no_reuse(spark):
    spark.conf.set("spark.sql.exchange.reuse", "false")
    yield
    spark.conf.unset("spark.sql.exchange.reuse")


def test_numbers_without_reused_exchanges(spark, no_reuse):
    rows = spark.range(120_000).select(F.col("id").alias("k"), F.xxhash64("id").alias("s"))
    got = vector.stable_ids(rows, "k", "s").agg(F.countDistinct("internal_id"), F.min("internal_id"), F.max("internal_id")).first()
    assert tuple(got) == (120_000, 0, 119_999)
    values = rows.select((F.col("s") % 1_000_003).alias("v"), F.when(F.col("k") % 5 > 0, "a").when(F.col("k") % 3 > 0, "b").alias("g"))
    held = defaultdict(list)
    for v, g in values.collect():
        held[g].append(v)
    place = lambda x: sorted(x)[min(len(x) - 1, round((len(x) - 1) * 0.95))]
    every = [v for x in held.values() for v in x]
    assert evals.p95(values, "v").select("n", "p95").first() == (len(every), place(every))
    assert {r.g: (r.n, r.p95, r.mean) for r in evals.p95(values, "v", "g").collect()} == {g: (len(x), place(x), round(sum(x) / len(x), 6)) for g, x in held.items()}


def test_nodes_equal_those_of_all_paths(spark):
    r = random.Random(5)
    for depth in (1, 2, 3, 4):
        pairs = [(r.randrange(9), r.randrange(9)) for _ in range(13)]
        edges = spark.createDataFrame([(i, f"n{a}", f"n{b}", "R") for i, (a, b) in enumerate(pairs)], "edge_id long, src_id string, dst_id string, relationship string")
        start = spark.createDataFrame([("n0",), ("n1",), ("n5",), ("none",)], "id string")
        want = {(x.start, x.id): x.depth for x in graph.paths(edges, start, depth).groupBy("start", "id").agg(F.min("depth").alias("depth")).collect()}
        got = [(x.start, x.id, x.depth) for x in graph.neighbor_nodes(edges, start, depth).collect()]
        assert len(got) == len(want) and {(a, b): d for a, b, d in got} == want


def test_neighbors_stop_at_the_limit(spark):
    edges = spark.createDataFrame([(i, "hub", f"n{i}", "R") for i in range(400)] + [(1_000 + i, f"n{i}", f"n{i + 1}", "R") for i in range(399)], "edge_id long, src_id string, dst_id string, relationship string")
    start = spark.createDataFrame([("hub",)], "id string")
    got = graph.neighbors(edges, start, 8, 50).collect()
    assert [x.depth for x in got] == [1] * 50 and [x.id for x in got] == sorted(f"n{i}" for i in range(400))[:50]
    few = graph.neighbors(edges, spark.createDataFrame([("n0",)], "id string"), 2, 500).collect()
    assert len(few) == len(graph.paths(edges, spark.createDataFrame([("n0",)], "id string"), 2).collect())


def test_nearest_of_many_starts(spark):
    r = random.Random(8)
    pairs = [(r.randrange(30), r.randrange(30)) for _ in range(40)] + [(0, i) for i in range(30, 70)]
    edges = spark.createDataFrame([(i, f"n{a:02d}", f"n{b:02d}", "R") for i, (a, b) in enumerate(pairs)], "edge_id long, src_id string, dst_id string, relationship string")
    names = sorted({f"n{x:02d}" for p in pairs for x in p} | {"none"})
    beside = {n: {f"n{y:02d}" for a, b in pairs for x, y in ((a, b), (b, a)) if f"n{x:02d}" == n} for n in names}
    starts = spark.createDataFrame([(n,) for n in names], "id string")
    for depth, limit in ((1, 3), (2, 4), (3, 7), (4, 200)):
        want = set()
        for s in names:
            found, front = {s: 0}, {s}
            for d in range(1, depth + 1):
                front = {y for x in front for y in beside[x]} - set(found)
                found |= dict.fromkeys(front, d)
            want |= {(s, n, d) for d, n in sorted((d, n) for n, d in found.items() if d)[:limit]}
        got = [tuple(x) for x in graph.nearest_nodes(edges, starts, depth, limit).collect()]
        assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("group", [None, "g"])
def test_many_queries_equal_plain(spark, group, monkeypatch):
    monkeypatch.setattr(vector, "QUERY_BYTES", 2_000)
    monkeypatch.setattr(vector, "QUERY_ROWS", 7)
    r = np.random.default_rng(3)
    base = np.round(r.normal(size=(40, 4)), 1)
    rows = [(i, base[r.integers(40)].tolist(), None if i % 11 == 0 else f"g{r.integers(30)}") for i in range(500)] + [(500, [0.0] * 4, "z"), (501, None, "z")]
    asked = [(i, base[r.integers(40)].tolist()) for i in range(90)]
    got = vector.batch_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, g string").repartition(5), spark.createDataFrame(asked, "query_id long, embedding array<double>"), 6, group=group).collect()
    found = defaultdict(list)
    for x in sorted(got, key=lambda x: (x.query_id, x["rank"])):
        found[x.query_id].append((x.id, x.similarity, x.g) if group else (x.id, x.similarity))
    for i, q in asked:
        cos = lambda v: round(float(np.dot(q, v) / (np.linalg.norm(q) * np.linalg.norm(v) or 1)), 6) + 0.0
        every = [(-cos(v), k, g) for k, v, g in rows if v is not None]
        if group:
            best = {}
            for s, k, g in sorted(every, key=lambda x: x[:2]):
                best.setdefault(g, (s, k))
            want = sorted(((s, g or "", k, g) for g, (s, k) in best.items()), key=lambda x: x[:2])[:6]
            assert [(k, pytest.approx(-s, abs=1e-6), g) for s, _, k, g in want] == found[i]
        else:
            assert [(k, pytest.approx(-s, abs=1e-6)) for s, k, _ in sorted(every, key=lambda x: x[:2])[:6]] == found[i]


def test_property_containment(spark):
    text = '{"a": {"b": [1, "x", {"c": null}], "d.e": true}, "n": 2.0, "s": "2", "z": null, "q\'s": 1}'
    rows = spark.createDataFrame([(text,), ("no json",), (None,)], "p string")
    holds = lambda wanted: [r[0] for r in rows.select(vector.contains_properties("p", wanted)).collect()]
    for wanted in ({}, {"a": {}}, {"a": {"b": [1]}}, {"a": {"b": ["x", 1]}}, {"a": {"b": [{"c": None}]}}, {"a": {"d.e": True}}, {"n": 2}, {"s": "2"}, {"z": None}, {"q's": 1}, {"n": 2, "s": "2"}):
        assert holds(wanted) == [True, False, False], wanted
    for wanted in ({"a": {"b": [2]}}, {"a": {"b": "x"}}, {"a": {"d": {"e": True}}}, {"n": "2"}, {"s": 2}, {"z": False}, {"y": None}, {"a": {"d.e": 1}}, {"a": {"b": {"c": None}}}):
        assert holds(wanted) == [False] * 3, wanted


def test_context_before_each_event(spark):
    r = random.Random(2)
    rows = [(f"s{r.randrange(3)}", i, i // 2, r.choice(["a", "bcd", "é🎉", None, "x" * 9])) for i in range(200)]
    df = spark.createDataFrame(rows, "session string, idx long, ts long, p string").repartition(4)
    got = {(x.session, x.idx): x.context for x in sessions.pre_context(df, F.col("p"), 25).collect()}
    for s, i, t, _ in rows:
        before = ",".join(p for q, j, u, p in sorted(rows, key=lambda x: (x[2], x[1])) if q == s and (u, j) < (t, i) and p is not None)
        assert got[s, i] == f"[{before}]"[-25:]
