"""Operators on small tables, and all oracle queries on the smallest scale."""

import collections
import hashlib
import heapq
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemolake.operators import agentic as AG
from mnemolake.operators import freshness as FR
from mnemolake.operators import graph as G
from mnemolake.operators import inspection as I
from mnemolake.operators import queues as QU
from mnemolake.operators import retrieval as R
from mnemolake.operators import versioned as VR
from mnemolake.plans import registry
from mnemolake.sources import chat_export as S
from mnemolake.streaming import feeds

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if hasattr(v, "as_tuple") or isinstance(v, float):
        return round(float(v), 6) + 0.0
    return tuple(_plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    df = registry.queries()[name](spark, DATA)
    got = sorted(repr(tuple(_plain(r[c]) for c in sorted(df.columns))) for r in df.collect())
    ran = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in ran.description]
    want = sorted(repr(tuple(_plain(row[names.index(c)]) for c in sorted(names))) for row in ran.fetchall())
    assert sorted(names) == sorted(df.columns) and got == want


def _walk(edges, community, seeds, max_depth, budget, prefer):
    """A bounded best-first walk, one node at a time."""
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    best, heap, n, out, done = {}, [], 0, [], set()
    for s in seeds:
        if s not in best:
            best[s] = (0, 0)
            heapq.heappush(heap, (0, 0, n, s))
            n += 1
    while heap and len(out) < budget:
        depth, crossed, _, node = heapq.heappop(heap)
        own = best[node]
        if node in done or (depth, own[0] if prefer else 0) != (own[1], crossed):
            continue
        done.add(node)
        out.append((node, depth, own[0]))
        if depth < max_depth:
            for other in sorted(near.get(node, ())):
                found = (own[0] + (community.get(node) != community.get(other)), depth + 1)
                if other not in done and (other not in best or found < best[other]):
                    best[other] = found
                    heapq.heappush(heap, (found[1], found[0] if prefer else 0, n, other))
                    n += 1
    return out


def _graph(spark, edges):
    return spark.createDataFrame([(a, b, "topical", True, "user", 1) for a, b in edges], "source long, target long, kind string, active boolean, origin string, version long")


def test_traversal_prefers_its_community(spark):
    edges, own = [(1, 2), (1, 3), (2, 4), (3, 5)], {1: 1, 3: 1, 5: 1, 2: 2, 4: 2}
    com = spark.createDataFrame(list(own.items()), "node long, community int")
    got = G.traverse(_graph(spark, edges), com, spark.createDataFrame([(0, 1, 0)], "walk long, node long, place long"), 2, 10)
    assert [r["node"] for r in got.orderBy("place").collect()] == [1, 3, 2, 5, 4]


def test_traversal_equals_a_loop(spark):
    rng = random.Random(8)
    edges = [(a, b) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(110)) if a != b]
    own = {i: rng.randrange(3) for i in range(55)}
    com = spark.createDataFrame(list(own.items()), "node long, community int")
    walks = [(w, [rng.randrange(60) for _ in range(2)]) for w in range(6)]
    seeds = spark.createDataFrame([(w, s, k) for w, ss in walks for k, s in enumerate(ss)], "walk long, node long, place long")
    for prefer, depth, budget in ((True, 5, 40), (False, 4, 25)):
        rows = G.traverse(_graph(spark, edges), com, seeds, depth, budget, prefer).orderBy("walk", "place").collect()
        for w, ss in walks:
            assert [(r["node"], r["depth"], r["boundaries"]) for r in rows if r["walk"] == w] == _walk(edges, own, ss, depth, budget, prefer), (w, prefer)


def test_duplicate_context_refuses_what_is_too_large(spark):
    edges = _graph(spark, [(i, i + 1) for i in range(140)]).withColumn("kind", F.lit("duplicate"))
    seed = spark.createDataFrame([(130,)], "node long")
    assert G.duplicate_context(edges.where("source >= 100"), seed)[0].count() == 41
    with pytest.raises(ValueError, match="ids"):
        G.duplicate_context(edges, seed, 12)
    with pytest.raises(ValueError, match="seeds"):
        G.duplicate_context(edges, spark.range(20).withColumnRenamed("id", "node"))


def test_community_generations(spark):
    members = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "node long, community string")
    nodes = members.select("node")
    assert {r["community"]: r["members"] for r in G.publish_communities(1, 2, members, nodes).collect()} == {"a": [1, 2], "b": [3]}
    for args in ((1, 3, members, nodes), (1, 2, members, nodes.where("node < 3")), (1, 2, members.union(members), nodes)):
        with pytest.raises(ValueError):
            G.publish_communities(*args)


def test_components_of_a_chain(spark):
    got = dict(tuple(r) for r in G.components(_graph(spark, [(i, i + 1) for i in range(2000)])).collect())
    assert got == dict.fromkeys(range(2001), 0)


def test_cursors_are_bound_to_snapshot_and_query(spark):
    rows = spark.range(300)
    page, cursor = VR.page_cursor(rows, ["id"], 7, "all", None, 100)
    assert [r["id"] for r in page.collect()] == list(range(100))
    page, _ = VR.page_cursor(rows, ["id"], 7, "all", cursor, 100)
    assert page.first()["id"] == 100
    for cut, query in ((8, "all"), (7, "other")):
        with pytest.raises(ValueError, match="cursor"):
            VR.page_cursor(rows, ["id"], cut, query, cursor)


def test_approvals_must_be_offered(spark):
    offered = spark.createDataFrame([(1, 5), (1, 6)], "session long, id long")
    assert AG.approved(offered, lambda o: o.where("id = 5")).count() == 1
    for bad in (lambda o: o.union(o), lambda o: o.withColumn("id", F.col("id") + 10)):
        with pytest.raises(Exception, match="repeated or not offered"):
            AG.approved(offered, bad).collect()
    searched = spark.createDataFrame([(1, 5)], "session long, id long")
    assert AG.confirm(searched, searched.where("false"), searched).count() == 1
    with pytest.raises(Exception, match="not evaluated"):
        AG.confirm(searched, searched.where("false"), offered).collect()


def test_centroids_equal_a_loop(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 6)).astype(np.float32)
    community = rng.integers(0, 4, 300)
    rows = [(int(i), int(community[i]), x[i].tolist()) for i in range(300)] + [(900, 9, [1.0] * 6), (901, 9, [0.0, 1.0, 0.0, 0.0, 0.0, 0.0])]
    got = collections.defaultdict(dict)
    for r in R.community_centroids(spark.createDataFrame(rows, "id long, c int, v array<float>"), "c", "id", "v").collect():
        got[r["c"]][r["centroid_no"]] = r["centroid"]
    for c in range(4):
        m = x[community == c]
        unit = m / np.linalg.norm(m, axis=1, keepdims=True)
        mean = m.mean(0)
        seeds = [int(np.argmax(unit @ mean))]
        while len(seeds) < 4:
            near = (unit @ unit[seeds].T).max(1)
            near[seeds] = np.inf
            seeds.append(int(np.argmin(near)))
        cent = m[seeds].copy()
        for _ in range(2):
            own = np.argmax(unit @ (cent / np.linalg.norm(cent, axis=1, keepdims=True)).T, axis=1)
            cent = np.stack([m[own == j].mean(0) if (own == j).any() else cent[j] for j in range(4)])
        assert np.allclose(cent, np.array([got[c][j] for j in range(4)]), atol=1e-5)
    assert len(got[9]) == 2


def test_freshness_history_folds_the_whole_table(spark, tmp_path):
    rng = random.Random(4)
    kinds = ["purchase", "click", "view"]
    rows = [(i, rng.randrange(8) if i < 20_000 else rng.randrange(12), rng.choice(kinds)) for i in sorted(rng.sample(range(60_000), 400))]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    got = registry.queries()["freshness_history"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    ran = con.execute(registry.oracle_sql()["freshness_history"])
    names = [d[0] for d in ran.description]
    assert sorted(tuple(r) for r in got.select(*names).collect()) == sorted(ran.fetchall())


@pytest.mark.parametrize("name", ["streaming_deduplicated", "streaming_freshness"])
def test_streams_are_waited_for(spark, tmp_path, monkeypatch, name):
    from pyspark.sql.streaming import StreamingQuery

    whole = StreamingQuery.awaitTermination
    monkeypatch.setattr(StreamingQuery, "awaitTermination", lambda q, timeout=None: whole(q) if timeout is None else whole(q, 0.01))
    rows = [(i, i % 7, "click", 1.0) for i in range(300)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = registry.queries()[name](spark, str(tmp_path)).collect()
    assert [r["n"] for r in got] == [300] if name == "streaming_deduplicated" else len(got) == 7


def test_closure_reaches_the_end_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(70)], "key long, needs long")
    assert G.closure(chain.where("key = 0"), chain).count() == 71


def test_vector_search_of_many_queries(spark):
    rows = [(i, [float(i % 7 + 1), float(i % 11 + 1)]) for i in range(2300)]
    vectors = spark.createDataFrame(rows[:20], "vec_id long, embedding array<float>")
    queries = spark.createDataFrame(rows, "query_id long, query array<float>")
    got = R.vector_search(vectors, queries, "vec_id", "embedding", 3)
    few = R.vector_search(vectors, queries.where("query_id < 1000"), "vec_id", "embedding", 3)
    assert got.count() == 3 * 2300
    assert sorted(got.where("query_id < 1000").collect()) == sorted(few.collect())


def test_fold_equals_a_loop(spark):
    rng = random.Random(3)
    rows = [(k, p, p, rng.choice([-60, 5, 25, 50])) for k in range(5) for p in sorted(rng.sample(range(20_000), 60))]
    got = {r["memory_id"]: r["score"] for r in FR.fold(spark.createDataFrame(rows, "memory_id long, position long, event_id long, amount int"), "memory_id", 21_000).collect()}
    for k in range(5):
        own = [r for r in rows if r[0] == k]
        start, score, steps = own[0][1], 100, 0
        for _, p, _, a in own:
            now = (p - start) // 10
            score = min(max(max(score - (now - steps), -100) + a, -100), 100)
            steps = now
        assert got[k] == max(score - ((21_000 - start) // 10 - steps), -100)


def test_policy_ratios():
    with pytest.raises(ValueError):
        FR.Policy(outside=11)
    assert FR.Policy().hops == 9


def test_components_any_order(spark):
    edges = [(1, 2), (2, 3), (7, 8), (9, 7), (3, 3)]
    rows = [(a, b, "d", True, "u", 1) for a, b in edges]
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        got = dict(tuple(r) for r in G.components(spark.createDataFrame(rows, "source long, target long, kind string, active boolean, origin string, version long")).collect())
        assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7}


def test_routing_falls_back(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.0, 1.0], "b")], "id long, v array<float>, c string")
    q = spark.createDataFrame([(0, [1.0, 0.1])], "query_id long, query array<float>")
    cent = R.community_centroids(v, "c", "id", "v")
    got = R.routed_search(v, q, cent, "id", "v", "c", top=1).collect()
    assert [r["id"] for r in got] == [1] and not got[0]["global_fallback"]
    empty = R.routed_search(v, q, cent.where("false"), "id", "v", "c").orderBy("rank").collect()
    assert [r["id"] for r in empty] == [1, 2] and empty[0]["global_fallback"]


def test_insert_once_reports_conflicts(spark):
    old = spark.createDataFrame([(1, "a", 1)], "k long, t string, v long")
    new = spark.createDataFrame([(1, "b"), (2, "c"), (2, "c"), (3, None)], "k long, t string")
    fresh, bad = VR.insert_once(old, new, ["k"], "v")
    assert [tuple(r) for r in fresh.orderBy("k").collect()] == [(2, "c", 2), (3, None, 3)]
    assert [r[0] for r in bad.collect()] == [1]


def test_reconcile_relations(spark):
    def rows(n, other=99):
        return spark.createDataFrame([(i, f"x{i}" if i < other else f"y{i}") for i in range(1, n + 1)], "i long, d string")

    relation = lambda a, b: VR.reconcile(a, b, "i", "d").first()
    assert relation(rows(5), rows(5))["relation"] == "identical"
    assert relation(rows(5), rows(3))["relation"] == "left_extends_right"
    assert relation(rows(3), rows(5))["relation"] == "right_extends_left"
    assert relation(rows(5), rows(5, 4))["relation"] == "diverged" and relation(rows(5), rows(5, 4))["common_prefix"] == 3


def test_import_remaps_parents(spark, tmp_path):
    (tmp_path / "x.json").write_text(
        '[{"conversation_id":"c","mapping":{"a":{"id":"a","parent":null,"message":{"author":{"role":"user"},"create_time":1.0,"content":{"content_type":"text","parts":["hi"]}}},'
        '"b":{"id":"b","parent":"a","message":{"author":{"role":"tool"},"create_time":2.0,"content":{"content_type":"text","parts":["x"]}}},'
        '"c":{"id":"c","parent":"b","message":{"author":{"role":"assistant"},"create_time":3.0,"content":{"content_type":"text","parts":["yo"]}}}}}]'
    )
    turns, left_out = S.plan_import(S.read_export(spark, str(tmp_path / "x.json")))
    assert {r["node_id"]: r["parent_id"] for r in turns.collect()} == {"a": None, "c": "a"}
    assert {r["reason"]: r["n"] for r in left_out.collect()} == {None: 2, "role": 1}


def test_parents_on_a_cycle_are_an_error(spark):
    links = spark.createDataFrame([("c", "a", "b", False), ("c", "b", "a", False), ("c", "k", "a", True)], "conv_id string, node_id string, parent_id string, kept boolean")
    with pytest.raises(ValueError, match="cycle"):
        S.remap_parents(links, 4)


def test_manifest_and_verified_files(spark, tmp_path):
    (tmp_path / "m.json").write_text(
        '{"conversations":[{"id":"c"}],"turns":[{"conversation_id":"c","id":"a","parent_id":null,"role":"user","timestamp_ns":5,"content":"hi"},{"conversation_id":"c","id":"b","parent_id":"a","role":"assistant","timestamp_ns":6,"content":"yo"}],'
        '"branches":[{"conversation_id":"c","id":"main","leaf":"b"}],"episodes":[{"conversation_id":"c","start":"a","end":"b"}]}'
    )
    m = S.read_manifest(spark, str(tmp_path / "m.json"))
    assert {k: df.count() for k, df in m.items()} == {"conversations": 1, "turns": 2, "branches": 1, "episodes": 1}
    assert m["turns"].where("id = 'b'").first()["parent_id"] == "a"
    (tmp_path / "files").mkdir()
    for name, body in (("x.txt", b"good"), ("y.txt", b"bad")):
        (tmp_path / "files" / name).write_bytes(body)
    expected = spark.createDataFrame([(n, hashlib.sha256(b"good").hexdigest()) for n in ("x.txt", "y.txt", "z.txt")], "path string, sha256 string")
    assert [r["path"] for r in S.verified_files(spark, str(tmp_path / "files"), expected).collect()] == ["x.txt"]


def test_stages_stop_when_one_is_held_or_missing():
    ran = lambda x: lambda: x
    assert I.coordinate({"entities": ran("done"), "relationships": ran("held"), "vectors": ran("done")}) == {"entities": "done", "relationships": "held"}
    assert I.coordinate({"entities": ran("done")}) == {"entities": "done", "relationships": "missing"}
    assert I.coordinate({"entities": ran("done")}, required=("entities",)) == {"entities": "done"}


def test_feed_applies_in_versions_and_stops_at_a_gap(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    first = [(1, "upsert", 1, 1, "h", True), (2, "upsert", 1, 2, "h", True), (3, "visibility", 1, 1, None, False)]
    spark.createDataFrame(first, feeds.CHANGE).coalesce(1).write.parquet(src)
    feeds.apply_feed(spark, src, out, cp).awaitTermination(120)
    assert {(r["message"], r["visible"]) for r in spark.read.parquet(f"{out}/v1").collect()} == {(1, False), (2, True)}
    spark.createDataFrame([(4, "delete", 1, 0, None, None)], feeds.CHANGE).coalesce(1).write.mode("append").parquet(src)
    feeds.apply_feed(spark, src, out, cp).awaitTermination(120)
    assert spark.read.parquet(f"{out}/v2").count() == 0
    spark.createDataFrame([(6, "upsert", 2, 1, "h", True)], feeds.CHANGE).coalesce(1).write.mode("append").parquet(src)
    with pytest.raises(Exception, match="gap"):
        feeds.apply_feed(spark, src, out, cp).awaitTermination(120)


def test_claims_honour_leases(spark):
    log = spark.createDataFrame(
        [("a", 1, "pending", 0, 0, 1), ("b", 1, "processing", 0, 50, 0), ("c", 1, "processing", 0, 500, 0), ("d", 1, "failed", 90, 0, 2), ("e", 1, "pending", 0, 0, 0), ("e", 2, "complete", 0, 0, 0)],
        "item string, revision long, state string, retry_at long, lease_until long, priority int",
    ).withColumns({c: F.lit(0) for c in ("source_through", "conversation", "start")})
    assert [r["item"] for r in QU.claim(log, 100, 10).collect()] == ["b", "a", "d"]
