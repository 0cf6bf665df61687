"""Joins of large tables: the same rows as a plain loop, and no product of two tables in their plans."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemolake.functions import blocks as BL
from mnemolake.functions import temporal as TP
from mnemolake.functions import text as T
from mnemolake.operators import agentic as AG
from mnemolake.operators import candidates as CD
from mnemolake.operators import entities as E
from mnemolake.operators import extraction as X
from mnemolake.operators import queues as QU
from mnemolake.operators import retrieval as R
from mnemolake.plans import registry


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _no_product(df):
    return "NestedLoop" not in _plan(df) and "CartesianProduct" not in _plan(df)


SPAN = "{0} long, place int, kind string, start long, end long"


@pytest.mark.parametrize("wide", [False, True])
def test_match_is_a_loop_without_products(spark, wide):
    rng = random.Random(11)
    lengths = [0, 1, TP.DAY // 2, TP.DAY, 3 * TP.DAY] + [500 * TP.DAY, 40_000 * TP.DAY] * wide

    def spans(n):
        out = []
        for i in range(n):
            for place in range(rng.choice([1, 1, 1, 9])):
                start = rng.randrange(19_000, 19_030) * TP.DAY + rng.choice([0, 5, -1])
                end = start + rng.choice(lengths)
                if wide and rng.random() < 0.2:
                    start, end = rng.choice([(None, end), (start, None), (None, None)])
                out.append((i, place, rng.choice(["day", "week"]), start, end))
        return out

    qs, ms = spans(25), spans(40)
    overlap = lambda q, m: (-(1 << 62) if q[3] is None else q[3]) < ((1 << 62) if m[4] is None else m[4])
    want = {}
    for (qi, q), (mi, m) in itertools.product([(k, list(g)) for k, g in itertools.groupby(qs, lambda x: x[0])], [(k, list(g)) for k, g in itertools.groupby(ms, lambda x: x[0])]):
        met = sorted((x[1], y[1], TP.SCORES.get(x[2], TP.OVERLAP) if x[2:] == y[2:] else TP.OVERLAP) for x in q for y in m if overlap(x, y) and overlap(y, x))
        if met:
            want[qi, mi] = max(s for _, _, s in met[:6])
    # every row twice: repeats count once
    found = TP.match(spark.createDataFrame(qs + qs, SPAN.format("query_id")), spark.createDataFrame(ms + ms, SPAN.format("memory_id")))
    rows = found.collect()
    assert len(rows) == len(want) and {(r["query_id"], r["memory_id"]): r["score"] for r in rows} == want
    assert _no_product(found)


@pytest.mark.parametrize("bounds", [(128, 65_536, 16_384), (3, 7, 10)])
def test_match_joins_blocks_of_equal_spans(spark, monkeypatch, bounds):
    """Single spans of equal bounds meet as blocks: no join makes the pairs, in large groups and in small ones, open or far away."""
    for name, n in zip(("BLOCK", "GATHERED", "SPREAD"), bounds):
        monkeypatch.setattr(BL, name, n)
    at = lambda day, ns=0: day * TP.DAY + ns
    kinds = [("day", at(9000), at(9001)), ("day", at(9000), at(9004)), ("week", at(8999, 5), at(9000, 1)), ("day", at(9001), at(9002)), ("day", at(9003, -1), at(9003, -1)), ("day", None, at(8990)), ("day", at(9300), None), ("day", at(-3, -7), at(9000, 1))]
    qs = [(i, 0, *kinds[i % 3 + i % 2 * 5 % 8]) for i in range(40)] + [(900, 0, *kinds[6]), (901, 0, *kinds[4])]
    ms = [(i, i % 2, *kinds[i % 8]) for i in range(400)]
    low, high = (lambda x: -(1 << 62) if x is None else x), (lambda x: 1 << 62 if x is None else x)
    want = {(q[0], m[0]): TP.SCORES.get(q[2], TP.OVERLAP) if q[2:] == m[2:] else TP.OVERLAP for q in qs for m in ms if low(q[3]) < high(m[4]) and low(m[3]) < high(q[4])}
    found = TP.match(spark.createDataFrame(qs, SPAN.format("query_id")), spark.createDataFrame(ms, SPAN.format("memory_id")))
    rows = found.collect()
    assert len(rows) == len(want) > 5000 and {(r["query_id"], r["memory_id"]): r["score"] for r in rows} == want
    assert _no_product(found)
    if bounds[0] == 128:
        assert _rows_into_joins(found) < 500


def test_delivery_reads_only_the_tail(spark):
    log = spark.createDataFrame([(i, 10 + i) for i in range(1, 301)], "sequence long, bytes int")
    cursors = spark.createDataFrame([(c, c) for c in range(0, 311)], "subscriber long, cursor long")
    found = QU.deliver(log, cursors, 50, most=20, most_bytes=3000)

    def verdict(c):
        if c > 300:
            return "error"
        if c + 1 < 50:
            return "resync_required"
        if c == 300:
            return "up_to_date"
        return "resync_required" if 300 - c > 20 or sum(10 + i for i in range(c + 1, 301)) > 3000 else "deliver"

    assert {r["subscriber"]: (r["verdict"], r["next"]) for r in found.collect()} == {c: (verdict(c), c + 1 if verdict(c) == "deliver" else None) for c in range(311)}
    assert _rows_into_joins(found) <= 311


def _entities(spark, n):
    rows = [(i, f"alpha{i % 3} beta{i % 7}", [f"Alias {i % 5}", f"gamma{i % 11}"], "principal" if i % 13 == 0 else f"kind{i % 2}") for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, name string, aliases array<string>, kind string")


def _rows_into_joins(df):
    """The most rows that any join of an executed query has made."""
    df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        if "Join" in name:
            most = max(most, node.metrics().apply("numOutputRows").value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return most


def test_mention_candidates_join_only_the_first_entities(spark):
    rows, e = _entities(spark, 600)
    found = E.mention_candidates(e.select(F.col("id").alias("mention_id"), F.when(F.col("id") % 2 == 0, F.upper("name")).otherwise(F.get("aliases", F.lit(1))).alias("surface")), e)
    want = set()
    for i, name, aliases, _ in rows:
        surface = name.upper() if i % 2 == 0 else aliases[1]
        plain = lambda x: "".join(c for c in x.lower() if c.isalnum())
        hits = sorted((0 if n == surface else 1 if plain(n) == plain(surface) else 2, j) for j, n, al, _ in rows if n == surface or plain(n) == plain(surface) or surface in al)
        want |= {(i, j, how, k + 1) for k, (how, j) in enumerate(hits[:8])}
    assert {(r["mention_id"], r["entity"], r["how"], r["rank"]) for r in found.collect()} == want
    assert _rows_into_joins(found) <= 3 * 8 * 600


def test_creation_conflicts_join_only_the_first_entities(spark):
    rows, e = _entities(spark, 600)
    found = E.creation_conflicts(e, e.select((F.col("id") + 1000).alias("id"), "name", "kind"))
    want = set()
    for i, name, _, kind in rows:
        hits = [j for j, n, _, k in rows if n == name and k == kind]
        want |= {(i + 1000, j, k + 1) for k, j in enumerate(hits[:8])}
    assert {(r["proposal"], r["entity"], r["rank"]) for r in found.collect()} == want
    assert _rows_into_joins(found) <= 2 * 8 * 600


def test_reconciliation_exchanges_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(E, "SPREAD", 7)
    rng = random.Random(5)
    words = [f"word{i}" for i in range(40)]
    rows = [(i, " ".join(rng.sample(words, rng.choice([1, 2, 3]))), [rng.choice(words), rng.choice(words).upper()], rng.choice(["a", "b", "principal"])) for i in range(200)]
    e = spark.createDataFrame(rows, "id long, name string, aliases array<string>, kind string")
    count = {w: sum(w in r[1].split() for r in rows if r[3] != "principal") for w in words}
    want = {}
    for x, y in itertools.combinations([r for r in rows if r[3] != "principal"], 2):
        if x[3] != y[3]:
            continue
        claims = [{c.lower() for c in (r[1], *r[2])} for r in (x, y)]
        s, t = set(x[1].split()), set(y[1].split())
        score = 1000 * len(s & t) // len(s | t)
        if claims[0] & claims[1]:
            want[x[0], y[0]] = (True, E.EXACT)
        elif any(count[w] <= 12 for w in s & t) and (score >= 330 or len(s & t) == min(len(s), len(t))):
            want[x[0], y[0]] = (False, score)
    found = E.reconciliation_pairs(e, None, 12)
    got = found.collect()
    assert len(got) == len(want) and {(r["a"], r["b"]): (r["exact"], r["score"]) for r in got} == want
    assert "keys=[a#" not in _plan(found)


@pytest.mark.parametrize("bounds", [(128, 65_536, 16_384), (5, 11, 8)])
def test_reconciliation_joins_blocks_of_equal_entities(spark, monkeypatch, bounds):
    """Entities with equal claims and tokens meet as blocks: no join makes their pairs; those of a repeated id are merged."""
    monkeypatch.setattr(BL, "BLOCK", bounds[0])
    monkeypatch.setattr(BL, "GATHERED", bounds[1])
    monkeypatch.setattr(E, "SPREAD", bounds[2])
    rows = [(i, f"common{i % 3} thing{i % 2}", [f"Alias {i % 3}", None, "  "], "a" if i % 5 else "b") for i in range(300)]
    rows += [(1000 + i, f"rare{i // 6} word{i}", None, "a") for i in range(30)] + [(7, "common1 thing1", ["Alias 2"], "a"), (7, "common1 thing1", ["Alias 2"], "a"), (1001, "other1 rare2", [], "a"), (None, "common1 thing1", [], "a")]
    count = {w: sum(w in r[1].split() for r in rows) for r in rows for w in r[1].split()}
    claims = [{c.strip().lower() for c in (r[1], *(r[2] or ())) if c and c.strip()} for r in rows]
    want = {}
    for (x, p), (y, q) in itertools.permutations(list(zip(rows, claims)), 2):
        if x[0] is None or y[0] is None or x[3] != y[3] or x[0] >= y[0]:
            continue
        s, t = set(x[1].split()), set(y[1].split())
        score, inside = 1000 * len(s & t) // len(s | t), len(s & t) == min(len(s), len(t))
        lexical = score if any(count[w] <= 32 for w in s & t) and (inside or score >= 330) else -1
        if p & q or lexical >= 0:
            old = want.get((x[0], y[0]), (False, -1))
            want[x[0], y[0]] = (old[0] or bool(p & q), max(old[1], E.EXACT if p & q else lexical))
    e = spark.createDataFrame(rows, "id long, name string, aliases array<string>, kind string")
    got = E.reconciliation_pairs(e, None).collect()
    assert {(r["a"], r["b"]): (r["exact"], r["score"]) for r in got} == want and len(got) == len(want) > 10_000
    if bounds[0] == 128:
        assert _rows_into_joins(E.reconciliation_pairs(e.where("id <> 7"), None)) < 1000


def test_guard_keys_split_a_surface_once(spark):
    df = spark.createDataFrame([("Brand/HttpServer Module",), ("plain name",), ("",), ("//",), (None,)], "s string")
    keys = df.select(T.guard_keys(F.col("s"), ["brand"]).alias("k"))
    assert [r["k"] for r in keys.collect()] == [["brandhttpserver", "brandhttpservermodule", "httpserver", "httpservermodule"], ["plainname"], [], [], []]
    assert _plan(keys).count("regexp_replace") <= 4


VECTORS = "{0} long, {1} array<float>"


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(R, "BLOCK_ROWS", 20)
    monkeypatch.setattr(R, "QUERY_ROWS", 7)


def _made(n, seed):
    """Vectors with many copies, a zero one and odd ones."""
    rng = np.random.default_rng(seed)
    some = rng.normal(size=(n // 4, 4)).round(1)
    rows = [(i, [float(x) for x in some[i % len(some)]]) for i in range(n)]
    return rows + [(n, [0.0] * 4), (n + 1, None), (n + 2, [1.0])]


def _cos(a, b):
    if a is None or b is None or len(a) != len(b):
        return 0.0
    a, b = np.float32(a).astype(float), np.float32(b).astype(float)
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return round(float(a @ b / n), 12) if n else 0.0


def test_vector_search_in_blocks(spark, small_blocks):
    vs, qs = _made(90, 1), _made(30, 2)[:32]
    v, q = spark.createDataFrame(vs, VECTORS.format("vec_id", "embedding")), spark.createDataFrame(qs, VECTORS.format("query_id", "query"))
    found = R.vector_search(v, q, "vec_id", "embedding", 5)
    want = set()
    for i, x in qs:
        hits = sorted((-_cos(x, y), j) for j, y in vs if _cos(x, y) > 0)
        want |= {(i, j, k + 1) for k, (_, j) in enumerate(hits[:5])}
    assert {(r["query_id"], r["vec_id"], r["rank"]) for r in found.collect()} == want
    assert _no_product(found)


def test_vector_search_with_floor_and_bounds(spark, small_blocks):
    vs = _made(90, 3)
    v = spark.createDataFrame(vs, VECTORS.format("vec_id", "embedding"))
    q = v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    found = R.vector_search(v, q, "vec_id", "embedding", 6, 9, 0.5, 0.6, 0.75, F.col("vec_id") + 1, F.col("query_id"))
    want = set()
    for i, x in vs[:91]:
        hits = sorted((-round(_cos(x, y) * 0.5 + 0.6, 9), j) for j, y in vs[:91] if j < i and _cos(x, y) * 0.5 + 0.6 >= 0.75 and any(x) and any(y))
        want |= {(i, j, k + 1) for k, (_, j) in enumerate(hits[:6])}
    assert {(r["query_id"], r["vec_id"], r["rank"]) for r in found.collect()} == want


def test_routed_search_in_blocks(spark, small_blocks):
    vs, qs = _made(90, 4), _made(30, 5)[:30]
    label = lambda i: None if i % 10 == 9 else i % 3
    v = spark.createDataFrame([(i, x, label(i)) for i, x in vs], "vec_id long, embedding array<float>, c int")
    q = spark.createDataFrame(qs, VECTORS.format("query_id", "query"))
    cents = [(0, [1.0, 0.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0, 0.0]), (2, [-1.0, -1.0, 0.0, 0.5])]
    found = R.routed_search(v, q, spark.createDataFrame([(c, 0, x) for c, x in cents], "c int, centroid_no int, centroid array<float>"), "vec_id", "embedding", "c", 4, 2)
    want = set()
    for i, x in qs:
        near = [c for _, c in sorted((-_cos(x, y), c) for c, y in cents)][:2]
        hits = sorted((-_cos(x, y), j) for j, y in vs if _cos(x, y) > 0 and (label(j) is None or label(j) in near))
        want |= {(i, j, k + 1) for k, (_, j) in enumerate(hits[:4])}
    assert {(r["query_id"], r["vec_id"], r["rank"]) for r in found.collect()} == want
    assert _no_product(found)


def test_diversify_by_vectors(spark):
    vs = _made(60, 6)[:60]
    cand = spark.createDataFrame([(q, i, i % 2, 1.0 / (1 + (i * 7 + q) % 13), x) for q in range(3) for i, x in vs], "query_id long, id long, conversation long, score double, vector array<float>")
    over = spark.createDataFrame([(i, j, max(0.0, _cos(x, y))) for i, x in vs for j, y in vs if i < j], "a long, b long, overlap double")
    plain = lambda df: sorted((r["query_id"], r["rank"], round(r["score"], 9)) for r in df.collect())
    assert plain(R.diversify(cand, None, 8)) == plain(R.diversify(cand.drop("vector"), over, 8))


def test_query_turn_in_blocks(spark, small_blocks):
    vs, qs = _made(90, 7), _made(12, 8)
    m = spark.createDataFrame([(i, i * 7 % 20, x, "needle" if i % 31 == 0 else "hay") for i, x in vs], "id long, freshness int, vector array<float>, text string")
    s = spark.createDataFrame(qs, VECTORS.format("session", "query"))
    chosen = {(q, i) for q, _ in qs for i, _ in vs if (q + i) % 4 == 0}
    sel = spark.createDataFrame(sorted(chosen), "session long, id long")
    turn = AG.query(m, s, ["needle"], F.col("text"), sel, lambda o: o.where("session % 2 = 0 and id % 3 = 0"))
    raw = {(q, i) for q, x in qs for i, y in vs if i % 31 == 0 or _cos(x, y) > 0}
    off = set()
    for q, _ in qs:
        off |= set(sorted((x for x in raw - chosen if x[0] == q), key=lambda x: (-(x[1] * 7 % 20), x[1]))[:10])
    yes = {(q, i) for q, i in off if q % 2 == 0 and i % 3 == 0}
    pairs = lambda df: {(r["session"], r["id"]) for r in df.collect()}
    assert pairs(turn.searched) == off and pairs(turn.approved) == yes
    assert pairs(turn.provided) == {x for x in raw & chosen if x[0] not in {q for q, _ in yes}}
    assert _no_product(turn.searched) and _no_product(turn.provided)


def test_refine_exchanges_its_state_once(spark):
    m = spark.createDataFrame([(i, i % 5) for i in range(50)], "id long, freshness int")
    state = spark.createDataFrame([(s, i) for s in range(6) for i in range(60)], "session long, id long")
    turn = AG.refine(m, state.where("(id + session) % 3 = 0"), state.where("(id + session) % 9 = 0"), lambda o: o.where("id % 2 = 0"))
    assert {(r["session"], r["id"]) for r in turn.approved.collect()} == {(s, i) for s in range(6) for i in range(50) if (s + i) % 3 == 0 and (s + i) % 9 and i % 2 == 0}
    assert "SortMergeJoin" not in _plan(turn.approved) and "session#" in _plan(turn.approved)


def test_refine_by_memory_equals_a_loop(spark):
    """Repeats, nulls, memories that are not known, and an id whose sessions are in several rows."""
    m = spark.createDataFrame([(i, i % 5) for i in range(20)], "id long, freshness int")
    rows = [(i, [s for s in range(30) if (i + s) % 3 == 0] * 2, [s for s in range(40) if (i + s) % 9 == 0] if i % 4 else None) for i in range(0, 25)] + [(3, [100, 101], [101]), (4, None, [5]), (5, [7], [])]
    state = spark.createDataFrame(rows, "id long, searched array<long>, selected array<long>")
    turn = AG.refine_by_memory(m, state, lambda o: o.where("session % 2 = 0"))
    want = {(s, i) for i, searched, selected in rows if i < 20 for s in searched or () if s % 2 == 0 and s not in (selected or ())}
    got = turn.approved.collect()
    assert {(r["session"], r["id"]) for r in got} == want and len(got) == len(want) > 50
    assert {(r["session"], r["id"]) for r in turn.searched.collect()} == {(s, i) for i, searched, _ in rows for s in searched or ()}
    with pytest.raises(Exception, match="repeated or not offered"):
        AG.refine_by_memory(m, state, lambda o: o.select((F.col("session") + 1000).alias("session"), "id")).approved.collect()


def test_refine_query_exchanges_no_pairs(spark, monkeypatch):
    from mnemolake.plans import q_composed

    def got():
        found = registry.queries()["agentic_refine"](spark, "/root/testdata/sf0.001")
        assert "Exchange hashpartitioning(session" not in _plan(found)
        return sorted((r["session"], r["id"]) for r in found.collect())

    ids = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id").collect()]
    want = sorted((s, i) for s in ids if s % 20 == 0 for i in ids if (s + i) % 3 == 0 and (s + i) % 9 and i % 2 == 0)
    assert got() == want
    monkeypatch.setattr(q_composed, "SESSIONS", 6, raising=False)
    monkeypatch.setattr(q_composed, "PAIRS", 300, raising=False)
    assert got() == want


def test_traverse_makes_no_product(spark):
    assert _no_product(registry.queries()["agentic_traverse"](spark, "/root/testdata/sf0.001"))


def test_coverage_has_no_cut(spark, tmp_path):
    """A fragment's only eligible memory comes after 1,100 closer ones."""
    x, near = [1.0] + [0.0] * 63, [0.8, 0.6] + [0.0] * 62
    rows = [(1, near, 0)] + [(3 * i, x, 0) for i in range(1, 1200)] + [(4100, x, 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["fragment_id"]: r["coverage"] for r in registry.queries()["semantic_coverage"](spark, str(tmp_path)).collect()}
    assert got[4100] == "event-planned"


def test_inferences_are_dealt_by_rows(spark, monkeypatch):
    """Ten rows a task, whatever they weigh; a text meets its inferences once, and is not sorted again."""
    monkeypatch.setattr(TP, "SHARE", 10, raising=False)
    texts = spark.range(45).select("id", F.lit("It began yesterday.").alias("text"))
    row = lambda i, *x: (i, *x, 1715731200 * 10**9)
    said = [row(i, "relative", 9, 18, "yesterday", "2024-01-01" if i % 3 else "some day") for i in range(40)]
    said += [row(7, "relative", 9, 18, "yesterday", "2024-01-01"), row(41, "relative", 0, 2, "It", "2024-01-01"), row(42, "relative", 9, 18, "today", "2024-01-01"), row(99, "relative", 9, 18, "yesterday", "2024-01-01"), row(None, "relative", 9, 18, "yesterday", "2024-01-01")]
    asked = spark.createDataFrame(said, "id long, kind string, start int, end int, evidence string, expression string, ref long")
    got = TP.with_inferences(texts, asked)
    want = [(i, "repeated" if i == 7 else "accepted" if i % 3 else "not resolvable") for i in range(40)] + [(7, "repeated"), (41, "no such indication"), (42, "evidence differs"), (99, "evidence differs")]
    assert sorted((r["id"], r["verdict"]) for r in got.where("id is not null").collect()) == sorted(want)
    assert [r["verdict"] for r in got.where("id is null").collect()] == ["evidence differs"]
    plan = _plan(got)
    assert plan.count("REPARTITION_BY_NUM") == plan.count("Exchange hashpartitioning(id") == 3
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_evidence_sorts_no_texts(spark):
    """Sizes of texts, not texts, meet the turns; a null request counts as none."""
    asked = spark.createDataFrame([(i, r, f"{i}:{r}") for i in range(6) for r in range(5 if i == 4 else 2)] + [(5, None, "5:x")], "item long, request int, node_id string")
    said = spark.createDataFrame([(r["item"], r["node_id"], ("é" * 40_000 if r["item"] == 1 else "x") if r["item"] != 3 else None) for r in asked.where("item <> 2").collect()], "item long, node_id string, text string")
    got = X.evidence_errors(asked, said)
    assert {r["item"]: r["error"] for r in got.collect()} == {0: None, 1: "bounds", 2: "coverage", 3: None, 4: "too many requests", 5: None}
    groups = [x for x in _plan(got).splitlines() if "Aggregate" in x]
    assert groups and not any("octet_length" in x for x in groups)


def test_ranked_candidates_makes_its_pool_once(spark, monkeypatch):
    made, pool = [], CD.discovery_pool
    monkeypatch.setattr(CD, "discovery_pool", lambda *x: made.append(1) or pool(*x))
    got = registry.queries()["ranked_candidates"](spark, "/root/testdata/sf0.001")
    assert len(made) == 1 and "split(" not in _plan(got)
