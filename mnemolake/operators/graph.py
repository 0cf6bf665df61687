"""Relation graphs as edge tables (source, target, kind, active, origin, version)."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .versioned import latest

ASSOCIATION = "association"


def current_edges(log: DataFrame, cut: int | None = None) -> DataFrame:
    return latest(log if cut is None else log.where(F.col("version") <= cut), ["source", "target", "kind"], "version")


def shape_errors(edges: DataFrame) -> DataFrame:
    """Edges that break a rule: no self edges; an association joins a memory to an entity and is not organised; others join memories."""
    reason = (
        F.when(F.col("source") == F.col("target"), "self edge")
        .when((F.col("kind") == ASSOCIATION) & ((F.col("source_type") != "memory") | (F.col("target_type") != "entity") | (F.col("origin") == "organiser")), "association")
        .when((F.col("kind") != ASSOCIATION) & ((F.col("source_type") != "memory") | (F.col("target_type") != "memory") | (F.col("origin") == "perception")), "memory relation")
    )
    return edges.withColumn("reason", reason).where("reason is not null")


def incident(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Active edges at the anchors (``node``): outgoing first."""
    live = edges.where("active")
    out = live.join(nodes, live["source"] == nodes["node"]).select("node", F.lit("out").alias("direction"), F.col("target").alias("other"), "kind")
    into = live.join(nodes, live["target"] == nodes["node"]).select("node", F.lit("in").alias("direction"), F.col("source").alias("other"), "kind")
    return out.unionByName(into)


def active_nodes(edges: DataFrame) -> DataFrame:
    live = edges.where(F.col("active") & (F.col("kind") != ASSOCIATION))
    return live.select(F.explode(F.array("source", "target")).alias("node")).distinct()


def undirected(edges: DataFrame) -> DataFrame:
    live = edges.where("active and source <> target")
    return live.select(F.col("source").alias("a"), F.col("target").alias("b")).union(live.select("target", "source")).distinct()


def adjacency(edges: DataFrame, searchable: DataFrame) -> DataFrame:
    """Sorted neighbours over active edges whose ends are both searchable."""
    both = undirected(edges).join(searchable.select(F.col("node").alias("a")), "a", "left_semi").join(searchable.select(F.col("node").alias("b")), "b", "left_semi")
    return both.groupBy("a").agg(F.array_sort(F.collect_set("b")).alias("neighbours"))


def _cut(df: DataFrame) -> DataFrame:
    """End the lineage of a small iterative table by a reliable checkpoint, in the folder the session names.

    Where it names none, on one machine only, a temporary folder stands in."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
            folder = tempfile.mkdtemp(prefix="mnemolake-")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): least node reachable.

    Vertices move to their least neighbour, by id in one round and by a hash in the next; moves are followed to their
    ends by pointer doubling, and edges are contracted.  Rounds are logarithmic, in chains too."""
    pairs = undirected(edges).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    placed = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().withColumn("component", F.col("node"))
    pairs, placed, step = _cut(pairs), _cut(placed), 0
    while not pairs.isEmpty():
        rank = (lambda c, k=step: F.struct(F.xxhash64(F.lit(k), c), c)) if step % 2 else (lambda c: F.struct(c))
        both = pairs.union(pairs.select("b", "a"))
        least = both.groupBy(F.col("a").alias("_u")).agg(F.min_by("b", rank(F.col("b"))).alias("_m"))
        move = _ends(_cut(least.where(rank(F.col("_m")) < rank(F.col("_u")))))
        placed = _cut(placed.join(move, placed["component"] == move["_u"], "left").select("node", F.coalesce("_m", "component").alias("component")))
        a = pairs.join(move, pairs["a"] == move["_u"], "left").select(F.coalesce("_m", "a").alias("a"), "b")
        b = a.join(move, a["b"] == move["_u"], "left").select("a", F.coalesce("_m", "b").alias("b"))
        pairs = _cut(b.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        step += 1
    least = placed.groupBy("component").agg(F.min("node").alias("_least"))
    return placed.join(least, "component").select("node", F.col("_least").alias("component"))


def _ends(move: DataFrame) -> DataFrame:
    """Moves (_u, _m) followed until they end."""
    while True:
        then = move.select(F.col("_u").alias("_m"), F.col("_m").alias("_far"))
        move = _cut(move.select("_u", "_m").join(then, "_m", "left").select("_u", F.coalesce("_far", "_m").alias("_m"), F.col("_far").isNotNull().alias("_went")))
        if move.where("_went").isEmpty():
            return move.select("_u", "_m")


def within_hops(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(seed, node, depth): least depth up to ``hops``, undirected."""
    near = undirected(edges)
    reached = frontier = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("depth"))
    for d in range(1, hops + 1):
        step = frontier.join(near, frontier["node"] == near["a"]).select("seed", F.col("b").alias("node")).distinct()
        frontier = _cut(step.join(reached, ["seed", "node"], "left_anti").withColumn("depth", F.lit(d)))
        reached = reached.unionByName(frontier)
    return reached


def outgoing(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Active edges that leave the anchors."""
    return incident(edges, nodes).where("direction = 'out'").drop("direction")


def incoming(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Active edges that reach the anchors."""
    return incident(edges, nodes).where("direction = 'in'").drop("direction")


def _crossed(a: str, b: str) -> Column:
    """1 if two communities differ; none counts as a community of its own."""
    return F.when(F.col(a).eqNullSafe(F.col(b)), 0).otherwise(1)


def _not_improved(level: DataFrame, near: DataFrame, own: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """A level without the nodes that an earlier node of the same level reaches over fewer boundaries, and those: they
    come one level later.  An earlier node that is itself moved on moves no other."""
    at = level.withColumn("at", F.row_number().over(Window.partitionBy("walk").orderBy(*order))).join(own, "node", "left")
    x, y = (at.select("walk", *[F.col(c).alias(f"{side}_{c}") for c in ("node", "boundaries", "at", "community")]) for side in "xy")
    met = x.join(near, F.col("x_node") == F.col("a")).join(y.withColumnRenamed("walk", "_walk"), (F.col("y_node") == F.col("b")) & (F.col("walk") == F.col("_walk")))
    better = (F.col("y_at") < F.col("x_at")) & (F.col("y_boundaries") + _crossed("y_community", "x_community") < F.col("x_boundaries"))
    pairs = _cut(met.where(better).select("walk", F.col("x_node").alias("x"), F.col("y_node").alias("y")).distinct())
    if pairs.isEmpty():
        return level, None
    moved = _cut(pairs.select("walk", F.col("x").alias("node")).where("false"))
    while True:
        alive = pairs.join(moved.withColumnRenamed("node", "y"), ["walk", "y"], "left_anti")
        firm = alive.join(alive.select("walk", F.col("x").alias("y")).distinct(), ["walk", "y"], "left_anti")
        new = _cut(firm.select("walk", F.col("x").alias("node")).distinct().join(moved, ["walk", "node"], "left_anti"))
        if new.isEmpty():
            return level.join(moved, ["walk", "node"], "left_anti"), level.join(moved, ["walk", "node"], "left_semi").select("walk", "node", F.col("boundaries").alias("_was"))
        moved = _cut(moved.unionByName(new))


def traverse(edges: DataFrame, community: DataFrame, seeds: DataFrame, max_depth: int, budget: int, prefer_inside: bool = True) -> DataFrame:
    """Bounded best-first walks: (walk, node, depth, boundaries, place) of each walk's first ``budget`` nodes.

    ``seeds``: walk, node, place.  The walk takes the node of least (depth, crossed boundaries if preferred, discovery); a
    node is improved by (boundaries, depth).  Depth rules, so the walk is a loop over depths, of all walks at once; a node's
    discovery is the place of the node it was found from, then its own id.  Each depth keeps ``budget`` nodes a walk."""
    near, own = undirected(edges), community.select("node", "community")
    order = ["boundaries", "found", "node"] if prefer_inside else ["found", "node"]
    seen = moved = None
    level = seeds.groupBy("walk", "node").agg(F.min("place").alias("found")).withColumn("boundaries", F.lit(0))
    for depth in range(max_depth + 1):
        if depth:
            here = level.join(own, "node", "left").select("walk", F.col("node").alias("a"), "boundaries", "place", F.col("community").alias("_from"))
            step = here.join(near, "a").join(own.withColumnRenamed("node", "b"), "b", "left")
            step = step.select("walk", F.col("b").alias("node"), (F.col("boundaries") + _crossed("_from", "community")).alias("boundaries"), F.col("place").alias("found"))
            new = step.join(seen.select("walk", "node"), ["walk", "node"], "left_anti")
            if moved is not None:
                new = new.join(moved, ["walk", "node"], "left").where("_was is null or boundaries < _was").drop("_was")
            # with boundaries first, the discovery that counts is that of the fewest; else the first of all
            best = F.min(F.struct("boundaries", "found")) if prefer_inside else F.struct(F.min("boundaries").alias("boundaries"), F.min("found").alias("found"))
            level = _cut(new.groupBy("walk", "node").agg(best.alias("_best")).select("walk", "node", "_best.*"))
            if level.isEmpty():
                break
        if 0 < depth < max_depth:
            level, moved = _not_improved(level, near, own, order)
        level = level.withColumns({"place": F.row_number().over(Window.partitionBy("walk").orderBy(*order)).cast("long"), "depth": F.lit(depth)})
        if seen is not None:
            level = level.join(seen.groupBy("walk").agg(F.count("*").alias("_n")), "walk").withColumn("place", F.col("place") + F.col("_n"))
        level = _cut(level.where(F.col("place") <= budget).select("walk", "node", "depth", "boundaries", "place"))
        seen = level if seen is None else _cut(seen.unionByName(level))
    return seen


def duplicate_context(edges: DataFrame, seeds: DataFrame, limit: int = 128, max_seeds: int = 17, max_edges: int = 256) -> tuple[DataFrame, DataFrame]:
    """(ids, edges) of the seeds' components over active duplicate edges; an error beyond the bounds, never a part."""
    live = edges.where("active and kind = 'duplicate'")
    ids = frontier = _cut(seeds.select("node").distinct())
    if ids.limit(max_seeds + 1).count() > max_seeds or limit > 128:
        raise ValueError("duplicate context: too many seeds, or too high a limit")
    near = undirected(live)
    while True:
        step = near.join(frontier.select(F.col("node").alias("a")), "a").select(F.col("b").alias("node")).distinct()
        frontier = _cut(step.join(ids, "node", "left_anti"))
        if frontier.isEmpty():
            break
        ids = _cut(ids.unionByName(frontier))
        if ids.limit(limit + 1).count() > limit:
            raise ValueError("duplicate context: too many ids")
    inside = live.join(F.broadcast(ids), live["source"] == ids["node"], "left_semi")  # at most `limit` ids
    if inside.limit(max_edges + 1).count() > max_edges:
        raise ValueError("duplicate context: too many edges")
    return ids, inside


def publish_communities(current: int, offered: int, members: DataFrame, nodes: DataFrame) -> DataFrame:
    """The members of the next generation, sorted: it follows the current one, members are disjoint and cover the active nodes."""
    if offered != current + 1:
        raise ValueError("the generation offered must follow the current one")
    if not community_errors(members, nodes).isEmpty():
        raise ValueError("members must be disjoint and cover the active nodes")
    return members.groupBy("community").agg(F.array_sort(F.collect_list("node")).alias("members")).withColumn("generation", F.lit(offered))


def closure(seeds: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Fixpoint of seeds over (key, needs), as many rounds as it takes."""
    reached = frontier = seeds.select("key").distinct()
    while True:
        step = frontier.join(dependencies, "key").select(F.col("needs").alias("key")).distinct()
        frontier = _cut(step.join(reached, "key", "left_anti"))
        if frontier.isEmpty():
            return reached
        reached = _cut(reached.unionByName(frontier))


def community_errors(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Members in several communities, members that are no active node, and active nodes in none."""
    n = members.groupBy("node").agg(F.count("*").alias("n"))
    joined = n.join(nodes.withColumn("_active", F.lit(True)), "node", "full_outer")
    reason = F.when(F.col("n") > 1, "overlap").when(F.col("_active").isNull(), "not active").when(F.col("n").isNull(), "not covered")
    return joined.select("node", reason.alias("reason")).where("reason is not null")
