"""Inspection: provenance, neighbours, submissions, generations and coverage, as named DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .versioned import latest


def provenance(memories: DataFrame, sources: DataFrame, owner: str) -> DataFrame:
    """absent (no source), direct (made by management), unavailable, restricted (another owner's, hidden) or available."""
    s = sources.select(F.col("node_id").alias("source_node"), F.col("owner").alias("_owner"), F.col("text").alias("_text"))
    joined = memories.join(s, "source_node", "left")
    status = (
        F.when(F.col("origin") == "management", "direct").when(F.col("source_node").isNull(), "absent").when(F.col("_owner").isNull(), "unavailable")
        .when(F.col("_owner") != owner, "restricted").otherwise("available")
    )
    return joined.select("memory_id", status.alias("status"), F.when(status == "available", F.col("_text")).alias("text"))


def neighbours(edges: DataFrame, anchors: DataFrame, available: DataFrame) -> DataFrame:
    """Active edges at an anchor whose ends are both available, with the direction from the anchor."""
    live = edges.where("active").join(available.select(F.col("node").alias("source")), "source", "left_semi").join(available.select(F.col("node").alias("target")), "target", "left_semi")
    out = live.join(anchors, live["source"] == anchors["node"]).select("node", F.lit("out").alias("direction"), F.col("target").alias("other"), "kind")
    return out.unionByName(live.join(anchors, live["target"] == anchors["node"]).select("node", F.lit("in").alias("direction"), F.col("source").alias("other"), "kind"))


def submissions(log: DataFrame, operations: DataFrame) -> DataFrame:
    """Latest state of each submission and what it allows: cancel if all operations are cancelled, finalise if all completed."""
    now = latest(log, ["submission"], "revision")
    ops = operations.groupBy("submission").agg(F.bool_and(F.col("op_state") == "cancelled").alias("_c"), F.bool_and(F.col("op_state") == "completed").alias("_d"))
    allows = F.when(F.col("state") != "pending", "none").when(F.col("_c"), "cancel").when(F.col("_d"), "finalise").otherwise("wait")
    return now.join(ops, "submission", "left").select("submission", "state", allows.alias("allows"))


def publish_generation(bound: DataFrame, rows: DataFrame, dimensions: int) -> DataFrame:
    """Judgement of vector rows (profile, body, content_id, vector): bound, no-op, conflict, or of a wrong width."""
    old = bound.select("profile", "body", F.col("content_id").alias("_old"))
    joined = rows.join(old, ["profile", "body"], "left")
    verdict = F.when(F.size("vector") != dimensions, "width").when(F.col("_old").isNull(), "bound").when(F.col("_old") == F.col("content_id"), "noop").otherwise("conflict")
    return joined.select("profile", "body", verdict.alias("verdict"))


def profile_repair(profiles: DataFrame, bindings: DataFrame, bodies: DataFrame) -> DataFrame:
    """Profiles that cover every body stay, the others retire."""
    n = bodies.select("body").distinct().agg(F.count("*").alias("_n"))
    have = bindings.join(bodies.select("body").distinct(), "body", "left_semi").groupBy("profile").agg(F.count_distinct("body").alias("_h"))
    return profiles.join(have, "profile", "left").join(F.broadcast(n)).select("profile", F.when(F.coalesce("_h", F.lit(0)) == F.col("_n"), "keep").otherwise("retire").alias("verdict"))


def import_coverage(nodes: DataFrame) -> DataFrame:
    """Counters by reason of omission."""
    reasons = ("empty", "hidden", "role", "content", "untimed", "window")
    return nodes.agg(F.count("*").alias("nodes"), F.count_if(F.col("reason").isNull()).alias("accepted"), *[F.count_if(F.col("reason") == r).alias(f"omitted_{r}") for r in reasons])


def supplied_evidence(evidence: DataFrame, memories: DataFrame, owner: str) -> DataFrame:
    """Evidence (memory_id, score) a host supplies: verdict on each row; tombstoned memories are skipped."""
    n = evidence.groupBy("memory_id").agg(F.count("*").alias("_n"), F.max("score").alias("score"))
    joined = n.join(memories.select("memory_id", "owner", "archived", "tombstoned"), "memory_id", "left")
    verdict = (
        F.when(F.col("_n") > 1, "duplicate").when(~F.coalesce((F.col("score") >= 0) & (F.col("score") <= 1), F.lit(False)), "invalid score")
        .when(F.col("owner").isNull(), "unknown").when(F.col("owner") != owner, "other owner").when(F.col("tombstoned"), "skipped").when(F.col("archived"), "archived").otherwise("selected")
    )
    return joined.select("memory_id", verdict.alias("verdict"))


STAGES = ("entities", "relationships", "vectors", "organisation", "freshness")


def coordinate(stages: dict[str, Callable[[], str]], required: tuple[str, ...] = STAGES) -> dict[str, str]:
    """Run the stages in order until one is held or a required one is missing: the outcome of each that ran."""
    done: dict[str, str] = {}
    for name in STAGES:
        if name not in stages:
            if name in required:
                done[name] = "missing"
                break
            continue
        done[name] = stages[name]()
        if done[name] == "held":
            break
    return done
