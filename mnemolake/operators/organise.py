"""Pair organisation: lane ranks and fusion, candidate discovery, relation diffs, lifecycle, representatives."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import rrf

LANES = {"semantic": 24, "prior": 3, "lexical": 8, "temporal": 8}
SELECTED = 12
STATES = ("canonical", "knowledge", "extracted")


def lane_ranks(candidates: DataFrame) -> DataFrame:
    """Ranks by lane for (source, id, semantic, lexical, temporal, source_time, time): positive finite scores only.

    The prior lane ranks all positive semantic scores of candidates not later than the source.  Ranks beyond a lane's
    size are null."""
    def rank(score: Column) -> Column:
        ok = score.isNotNull() & (score > 0) & (score < float("inf"))
        place = F.row_number().over(Window.partitionBy("source", ok).orderBy(F.desc(score), "id"))
        return F.when(ok, place)

    prior = F.when(F.col("time") <= F.col("source_time"), F.col("semantic"))
    ranked = candidates.withColumn("_prior", prior).withColumns({
        "r_semantic": rank(F.col("semantic")), "r_prior": rank(F.col("_prior")), "r_lexical": rank(F.col("lexical")), "r_temporal": rank(F.col("temporal")),
    }).drop("_prior")
    return ranked.withColumns({f"r_{k}": F.when(F.col(f"r_{k}") <= n, F.col(f"r_{k}")) for k, n in LANES.items()})


def fused(candidates: DataFrame) -> DataFrame:
    """Candidates in some lane, with their fused score."""
    ranked = lane_ranks(candidates)
    score = rrf(**{k: F.col(f"r_{k}") for k in LANES})
    return ranked.withColumn("fused", score).where("fused > 0")


def select(candidates: DataFrame, k: int = SELECTED) -> DataFrame:
    """Those of the prior lane first, then by fused score up to k; the result in fused order."""
    rows = fused(candidates)
    first = F.row_number().over(Window.partitionBy("source").orderBy(F.col("r_prior").isNull(), F.desc("fused"), "id"))
    kept = rows.withColumn("_k", first).where(F.col("_k") <= k)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("fused"), "id"))).drop("_k")


def canonical_pair(a: str = "a", b: str = "b") -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def unseen_pairs(pairs: DataFrame, evaluated: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs neither evaluated nor related in either direction, and no self pairs."""
    p = pairs.select(*canonical_pair()).where("a <> b").distinct()
    live = edges.where("active").select(F.col("source").alias("a"), F.col("target").alias("b")).select(*canonical_pair())
    return p.join(evaluated.select(*canonical_pair()).union(live).distinct(), ["a", "b"], "left_anti")


def rare_term_candidates(terms: DataFrame, key: str, term: str, rarest: int = 16, postings: int = 4, most: int = 32) -> DataFrame:
    """(source, id) over each source's rarest terms, a few postings each, by hits then id."""
    df = terms.groupBy(term).agg(F.count("*").alias("_df"))
    t = terms.join(df, term)
    mine = t.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy("_df", term))).where(F.col("_k") <= rarest).select(F.col(key).alias("source"), term)
    few = t.withColumn("_k", F.row_number().over(Window.partitionBy(term).orderBy(key))).where(F.col("_k") <= postings).select(F.col(key).alias("id"), term)
    hits = mine.join(few, term).where("source <> id").groupBy("source", "id").agg(F.count("*").alias("hits"))
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("hits"), "id"))
    return hits.withColumn("_k", rank).where(F.col("_k") <= most).select("source", "id", "hits")


def time_neighbours(rows: DataFrame, key: str, time: str, partition: str, each: int = 12) -> DataFrame:
    """(source, id): the neighbours in time before and after, within a partition."""
    w = Window.partitionBy(partition).orderBy(time, key)
    sides = [F.lag(key, i).over(w) for i in range(1, each + 1)] + [F.lead(key, i).over(w) for i in range(1, each + 1)]
    near = rows.select(F.col(key).alias("source"), F.array(*sides).alias("_near"))
    return near.select("source", F.explode("_near").alias("id")).where("id is not null")


def relation_diff(desired: DataFrame, current: DataFrame, evaluated: DataFrame) -> DataFrame:
    """Changes (source, target, kind, change) on evaluated pairs: missing edges on, own edges no longer wanted off."""
    key = ["source", "target", "kind"]
    live = current.where("active")
    own = live.where("origin = 'organiser'")
    pairs = evaluated.select(*canonical_pair()).distinct()
    judged = own.withColumn("a", F.least("source", "target")).withColumn("b", F.greatest("source", "target")).join(pairs, ["a", "b"], "left_semi")
    on = desired.select(*key).distinct().join(live.select(*key), key, "left_anti").withColumn("change", F.lit("activate"))
    off = judged.select(*key).join(desired.select(*key), key, "left_anti").withColumn("change", F.lit("deactivate"))
    return on.unionByName(off)


def duplicate_chain(members: DataFrame) -> DataFrame:
    """Edges of each component's chain by (time, id): (source, target) with the later first.  Members: component, id, time."""
    before = F.lag("id").over(Window.partitionBy("component").orderBy(F.col("time").asc_nulls_last(), "id"))
    return members.withColumn("target", before).where("target is not null").select(F.col("id").alias("source"), "target")


def representative(members: DataFrame) -> DataFrame:
    """The unarchived member of best state, earliest source time (null last), least id, by component."""
    order = F.when(F.col("state") == "canonical", 0).when(F.col("state") == "knowledge", 1).when(F.col("state") == "extracted", 2).otherwise(3)
    key = F.struct(order.alias("s"), F.coalesce("time", F.lit((1 << 63) - 1)).alias("t"), F.col("id"))
    return members.where("not archived").groupBy("component").agg(F.min_by("id", key).alias("representative"))


def promotes(authority: Column, category: Column, kind: Column) -> Column:
    """Whether an authority makes a memory canonical."""
    return authority.isin("direct", "correction") & (category.isin("decision", "preference", "constraint", "fact") | kind.isin("decision", "preference", "rule"))


def lifecycle(facts: DataFrame) -> DataFrame:
    """New state and archive flag: superseded, then extracted duplicates, then authority, then knowledge."""
    superseded = F.col("superseded_by").isNotNull()
    duplicate = (F.col("state") == "extracted") & F.col("has_duplicate")
    state = (
        F.when(superseded | duplicate, F.col("state")).when(F.col("promotes"), "canonical")
        .when(F.col("state") == "extracted", "knowledge").otherwise(F.col("state"))
    )
    return facts.select("id", state.alias("new_state"), (F.col("archived") | superseded | duplicate).alias("new_archived"))


def decided(pairs: DataFrame, decide, schema: str) -> DataFrame:
    """Apply an injected decision function to batches of pairs: ``decide`` maps a DataFrame to one with the schema."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield decide(batch)

    return pairs.mapInPandas(run, schema)


MANAGED = ("duplicate", "supersedes", "topical", "factual", "causal", "recurrent")
FAR = (1 << 63) - 1


def evaluate(decisions: DataFrame, facts: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What pair decisions change: relations (source, target, kind, change) and lifecycles (id, superseded_by).

    ``decisions``: a, b, relation (none, or a managed kind), direction (a_to_b, b_to_a or none), place; ``facts``: id, time;
    ``relations``: source, target, kind, active, origin.  Pairs with an unknown memory count for nothing.  Of an evaluated
    pair, own active edges that no decision wants go; the last decision about a superseded memory holds."""
    time = lambda c: facts.select(F.col("id").alias(c), F.coalesce("time", F.lit(FAR)).alias(f"_t{c}"))
    known = decisions.where("a <> b").join(time("a"), "a").join(time("b"), "b")
    later = F.struct("_ta", "a") > F.struct("_tb", "b")
    forward = (
        F.when(F.col("relation") == "duplicate", later)
        .when(F.col("relation") == "supersedes", F.when(F.col("direction") == "a_to_b", True).when(F.col("direction") == "b_to_a", False))
        .otherwise(F.col("direction") != "b_to_a")
    )
    directed = known.where(F.col("relation").isin(*MANAGED)).withColumn("_f", forward).where("_f is not null")
    source, target = F.when(F.col("_f"), F.col("a")).otherwise(F.col("b")), F.when(F.col("_f"), F.col("b")).otherwise(F.col("a"))
    desired = directed.select(source.alias("source"), target.alias("target"), F.col("relation").alias("kind"), "place")
    own = relations.where(F.col("active") & (F.col("origin") == "organiser")).select("source", "target", "kind").distinct()
    key = ["source", "target", "kind"]
    pairs = known.select(*canonical_pair()).distinct()
    judged = own.where(F.col("kind").isin(*MANAGED)).withColumns({"a": F.least("source", "target"), "b": F.greatest("source", "target")}).join(pairs, ["a", "b"], "left_semi")
    wanted = desired.select(*key).distinct()
    changes = wanted.join(own, key, "left_anti").withColumn("change", F.lit("activate")).unionByName(judged.select(*key).join(wanted, key, "left_anti").withColumn("change", F.lit("deactivate")))
    gone = desired.where("kind = 'supersedes'").groupBy(F.col("target").alias("id")).agg(F.max_by("source", F.struct("place", "source")).alias("superseded_by"))
    return changes, gone


def plan(decisions: DataFrame, facts: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The whole plan of a snapshot: (relation changes, lifecycles).

    Beyond ``evaluate``: every component of active duplicates that a decision touches becomes one chain by (time, id), own
    edges off the chain go, and edges with a user's edge in either direction are never changed.  ``facts`` also: state,
    archived, promotes.  A lifecycle that supersedes by a memory that is itself archived is an error."""
    from .graph import components

    key = ["source", "target", "kind"]
    changes, gone = evaluate(decisions, facts, relations)
    user = relations.where("origin = 'user'")
    protected = user.select(*key).union(user.select("target", "source", "kind")).distinct()
    free = changes.join(protected, key, "left_anti")
    now = relations.select(*key, "active").join(free.select(*key, (F.col("change") == "activate").alias("_set")), key, "full_outer").select(*key, F.coalesce("_set", "active").alias("active"))
    component = components(now.where("kind = 'duplicate'"))
    touched = decisions.where("relation = 'duplicate' and a <> b").select(F.explode(F.array("a", "b")).alias("node")).join(component, "node").select("component").distinct()
    members = component.join(touched, "component", "left_semi").join(facts.select(F.col("id").alias("node"), "time"), "node").select("component", F.col("node").alias("id"), "time")
    chain = duplicate_chain(members).withColumn("kind", F.lit("duplicate"))
    live = relations.where("active")
    inside = live.where("origin = 'organiser' and kind = 'duplicate'")
    for end in ("source", "target"):
        inside = inside.join(members.select(F.col("id").alias(end), F.col("component").alias(f"_{end}")), end)
    off = inside.where("_source = _target").select(*key).join(chain, key, "left_anti").withColumn("change", F.lit("deactivate"))
    on = chain.select(*key).join(live.select(*key), key, "left_anti").withColumn("change", F.lit("activate"))
    planned = free.where("kind <> 'duplicate'").unionByName(off).unionByName(on).join(protected, key, "left_anti").distinct()
    sources = decisions.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    after = facts.join(gone, "id", "left").withColumn("_gone", F.col("superseded_by").isNotNull()).join(component.withColumnRenamed("node", "id"), "id", "left")
    peers = after.where(~F.col("archived") & ~F.col("_gone") & F.col("component").isNotNull()).groupBy("component").agg(F.count("*").alias("_peers"))
    joined = after.join(peers, "component", "left").join(sources, "id", "left_semi")
    others = F.coalesce("_peers", F.lit(0)) - F.when(F.col("archived") | F.col("_gone") | F.col("component").isNull(), 0).otherwise(1)
    life = lifecycle(joined.withColumn("has_duplicate", others > 0)).join(after.select("id", "superseded_by"), "id")
    dead = life.where("new_archived").select(F.col("id").alias("superseded_by"), F.lit(True).alias("_dead"))
    bad = F.when(F.col("_dead"), F.raise_error(F.lit("a superseding memory is archived itself")).cast("string")).otherwise(F.col("new_state"))
    return planned, life.join(dead, "superseded_by", "left").select("id", bad.alias("new_state"), "new_archived", "superseded_by")


def live_cuts(cuts: DataFrame, current: DataFrame, graph_version: int, now_version: int) -> DataFrame:
    """Cuts (id, revision, body_id) against the current state: ``eligible``, ``not eligible`` (state) or ``stale``.

    A graph of another version makes every cut stale."""
    joined = cuts.join(current.select("id", F.col("revision").alias("_rev"), F.col("body_id").alias("_body"), "state"), "id", "left")
    same = F.col("revision").eqNullSafe(F.col("_rev")) & F.col("body_id").eqNullSafe(F.col("_body")) & F.lit(graph_version == now_version)
    verdict = F.when(~same, "stale").when(F.col("state").isin("knowledge", "canonical"), "eligible").otherwise("not eligible")
    return joined.select("id", verdict.alias("verdict"))


def pair_contexts(pairs: DataFrame, memories: DataFrame) -> DataFrame:
    """Both memories of each pair (a, b) as structs, the older first where times tell."""
    whole = lambda side: memories.select(F.col("id").alias(side), F.struct(*memories.columns).alias(f"_{side}"))
    both = pairs.join(whole("a"), "a").join(whole("b"), "b")
    swap = F.coalesce(F.col("_b.time") < F.col("_a.time"), F.lit(False))
    return both.select("a", "b", F.when(swap, F.col("_b")).otherwise(F.col("_a")).alias("older"), F.when(swap, F.col("_a")).otherwise(F.col("_b")).alias("newer"))
