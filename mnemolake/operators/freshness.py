"""Freshness: clamped decay on an activity clock, ordered folds, due boundaries, propagation along edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import _cut, undirected

LOW, HIGH = -100, 100


@dataclass(frozen=True)
class Policy:
    decay: int = 10
    access: int = 25
    linkage: int = 50
    local: int = 5
    outside: int = 10

    def __post_init__(self) -> None:
        if min(self.decay, self.access, self.linkage, self.local, self.outside) <= 0 or self.outside != 2 * self.local or self.access != 5 * self.local or self.linkage != 10 * self.local:
            raise ValueError("outside = 2 local, access = 5 local and linkage = 10 local are needed")

    @property
    def hops(self) -> int:
        """Steps after which a linkage has nothing left."""
        return (self.linkage - 1) // self.local


DEFAULT = Policy()


def score_at(score: Column, admitted: Column, accounted: Column, turn: Column, p: Policy = DEFAULT) -> Column:
    """Decayed score; rows never admitted do not decay; null if the clock went back."""
    steps = F.floor((turn - accounted) / p.decay)
    return F.when(admitted.isNull(), score).when(turn < accounted, None).otherwise(F.greatest(score - steps, F.lit(LOW))).cast("int")


def state(score: Column) -> Column:
    return F.when(score >= 1, "fresh").when(score >= -50, "stale").otherwise("dormant")


def next_boundary(score: Column, accounted: Column, p: Policy = DEFAULT) -> Column:
    """The turn at which the state changes next."""
    return F.when(score >= 1, accounted + score * p.decay).when(score >= -50, accounted + (score + 51) * p.decay)


def due(records: DataFrame, turn: int, key: str, limit: int, p: Policy = DEFAULT) -> DataFrame:
    b = next_boundary(F.col("score"), F.col("accounted"), p)
    now = score_at(F.col("score"), F.col("admitted"), F.col("accounted"), F.lit(turn), p)
    return (
        records.withColumn("boundary", b).where(F.col("admitted").isNotNull() & (F.col("boundary") <= turn))
        .select(key, "boundary", state(F.col("score")).alias("from_state"), state(now).alias("to_state"))
        .orderBy("boundary", key).limit(limit)
    )


def crossings(records: DataFrame, turn: int, key: str, p: Policy = DEFAULT) -> DataFrame:
    """Every state change up to a turn, in order: at most two a record."""
    s, a = F.col("score"), F.col("accounted")
    both = F.array(
        F.struct((a + s * p.decay).alias("boundary"), F.lit("fresh").alias("from_state"), F.lit("stale").alias("to_state")),
        F.struct((a + (s + 51) * p.decay).alias("boundary"), F.lit("stale").alias("from_state"), F.lit("dormant").alias("to_state")),
    )
    live = F.when(s >= 1, both).when(s >= -50, F.slice(both, 2, 1)).otherwise(F.slice(both, 1, 0))
    rows = records.where("admitted is not null").select(key, F.explode(live).alias("x")).select(key, "x.*")
    return rows.where(F.col("boundary") <= turn)


def fold(events: DataFrame, key: str, cut: int, p: Policy = DEFAULT, start: int = 100) -> DataFrame:
    """Scores from (key, position, event_id, amount) events in order: decay since the last, floor, add, cap.

    Scores are as of the turn ``cut``; events after it do not count.
    The first event admits the record.  Steps between are x -> min(max(x - d, low) + a, high), and such maps
    compose into one of the same kind, (add, low, high): so a key's events are composed in chunks first and a hot
    key's history never meets in one task as rows."""
    ordered = F.array_sort(F.collect_list(F.struct("position", "event_id", "amount")))
    chunk = F.floor(F.col("position") / 4096)
    parts = events.where(F.col("position") <= cut).dropDuplicates([key, "event_id"]).groupBy(key, chunk.alias("_c")).agg(ordered.alias("_e"))
    firsts = parts.groupBy(key).agg(F.min(F.get("_e", F.lit(0))["position"]).alias("admitted"))
    parts = parts.join(firsts, key)
    d = p.decay
    turn0 = F.col("admitted")
    identity = F.struct(F.lit(0).cast("long").alias("add"), F.lit(-10**6).cast("long").alias("lo"), F.lit(10**6).cast("long").alias("hi"))

    def then(f: Column, add, lo, hi) -> Column:
        """x -> clip(x + add, lo, hi) after f."""
        return F.struct(
            (f["add"] + add).cast("long").alias("add"),
            F.least(F.greatest(f["lo"] + add, lo), hi).cast("long").alias("lo"),
            F.least(F.greatest(f["hi"] + add, lo), hi).cast("long").alias("hi"),
        )

    # a chunk's map works on scores as of the decay steps done at its first event; steps are counted from admission
    steps = lambda t: F.floor((t - turn0) / d)

    def step(acc: Column, e: Column) -> Column:
        now = steps(e["position"])
        decayed = then(acc["f"], -(now - acc["at"]), F.lit(LOW), F.lit(10**6))
        added = then(decayed, e["amount"], F.lit(LOW), F.lit(HIGH))
        return F.struct(now.cast("long").alias("at"), added.alias("f"))

    entry = steps(F.get("_e", F.lit(0))["position"]).cast("long")
    composed = parts.select(
        key, "admitted", "_c", entry.alias("_from"),
        F.aggregate("_e", F.struct(entry.alias("at"), identity.alias("f")), step).alias("m"),
    )
    chunks = composed.groupBy(key, "admitted").agg(F.array_sort(F.collect_list(F.struct("_c", "_from", "m"))).alias("_m"))

    def join(acc: Column, c: Column) -> Column:
        x = F.greatest(acc["score"] - (c["_from"] - acc["at"]), F.lit(LOW))
        x = F.least(F.greatest(x + c["m"]["f"]["add"], c["m"]["f"]["lo"]), c["m"]["f"]["hi"])
        return F.struct(c["m"]["at"].alias("at"), x.cast("long").alias("score"))

    end = F.aggregate("_m", F.struct(F.lit(0).cast("long").alias("at"), F.lit(start).cast("long").alias("score")), join)
    done = chunks.select(key, "admitted", end.alias("r"))
    last = F.floor((F.lit(cut) - F.col("admitted")) / d)
    return done.select(key, "admitted", F.greatest(F.col("r.score") - (last - F.col("r.at")), F.lit(LOW)).cast("int").alias("score"))


def initial_carry(position: Column, age: Column, p: Policy = DEFAULT) -> Column:
    """Turns of the first interval already used when a record is rewritten."""
    return F.pmod(age, F.lit(p.decay))


def propagate(edges: DataFrame, roots: DataFrame, communities: DataFrame, excluded: DataFrame | None = None, p: Policy = DEFAULT) -> DataFrame:
    """Strongest-path credit: (event_id, node, credit).

    ``roots``: event_id, node, amount.  Each community of origin spreads on its own: a step into it costs ``local``,
    any other ``outside``; nodes without a community are outside.  Credits stay > 0, so hops are bounded by the
    policy.  Excluded (event_id, node) neither receive nor conduct."""
    near = undirected(edges)
    placed = communities.select(F.col("node"), F.col("community"))
    start = roots.join(placed, "node", "left").select("event_id", F.col("community").alias("origin"), "node", F.col("amount").cast("int").alias("credit"))
    if excluded is not None:
        start = start.join(excluded, ["event_id", "node"], "left_anti")
    best = _cut(start.groupBy("event_id", "origin", "node").agg(F.max("credit").alias("credit")))
    steps = near.join(placed.select(F.col("node").alias("b"), F.col("community").alias("_to")), "b", "left")
    frontier = best
    for _ in range(p.hops):
        cost = F.when(F.col("_to") == F.col("origin"), p.local).otherwise(p.outside)
        moved = frontier.join(steps, frontier["node"] == steps["a"]).select("event_id", "origin", F.col("b").alias("node"), (F.col("credit") - cost).alias("credit")).where("credit > 0")
        if excluded is not None:
            moved = moved.join(excluded, ["event_id", "node"], "left_anti")
        moved = moved.groupBy("event_id", "origin", "node").agg(F.max("credit").alias("credit"))
        old = best.withColumnRenamed("credit", "_old")
        same = (moved["event_id"] == old["event_id"]) & moved["origin"].eqNullSafe(old["origin"]) & (moved["node"] == old["node"])
        frontier = _cut(moved.join(old, same, "left").where("_old is null or credit > _old").select(moved["event_id"], moved["origin"], moved["node"], "credit"))
        if frontier.isEmpty():
            break
        best = _cut(best.unionByName(frontier).groupBy("event_id", "origin", "node").agg(F.max("credit").alias("credit")))
    return best.groupBy("event_id", "node").agg(F.max("credit").alias("credit"))


def accept_use(uses: DataFrame, amount: int = DEFAULT.access) -> DataFrame:
    """One event for each source of each use, whatever the repeats of a receipt: (use_id, source, amount).

    A use_id that comes with different sources is a conflict and yields nothing here; see ``use_conflicts``."""
    payload = F.array_sort(F.array_distinct("sources"))
    once = uses.groupBy("use_id").agg(F.min(payload).alias("sources"), F.max(payload).alias("_other")).where(F.col("sources") == F.col("_other"))
    return once.select("use_id", F.explode(F.array_sort(F.array_distinct("sources"))).alias("source"), F.lit(amount).alias("amount"))


def semantic_plan(candidates: DataFrame, most: int = 64) -> DataFrame:
    """Bonuses of (fragment_id, memory_id, cosine, eligible): best first in nine digits, at most ``most`` for a fragment."""
    from pyspark.sql import Window

    from ..functions.vectors import semantic_bonus

    scored = candidates.where("eligible").withColumn("bonus", semantic_bonus(F.col("cosine"))).where("bonus > 0")
    rank = F.row_number().over(Window.partitionBy("fragment_id").orderBy(F.desc(F.round("cosine", 9)), "memory_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= most)


def use_conflicts(uses: DataFrame) -> DataFrame:
    """Receipts whose repeats differ in their sources: (use_id, first, other)."""
    payload = F.array_sort(F.array_distinct("sources"))
    return uses.groupBy("use_id").agg(F.min(payload).alias("first"), F.max(payload).alias("other")).where("first <> other")


def late_events(applied: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """The verdict of each event of a batch against those applied: ``replay`` (same id and payload), ``conflict`` (same id,
    other payload), ``regressed`` (a position before its record's last) or ``apply``.  Events: key, event_id, position, amount."""
    old = applied.select("event_id", F.struct(key, "position", "amount").alias("_old"))
    last = applied.groupBy(key).agg(F.max("position").alias("_last"))
    joined = batch.join(old, "event_id", "left").join(last, key, "left")
    same = F.col("_old").eqNullSafe(F.struct(key, "position", "amount"))
    verdict = F.when(F.col("_old").isNotNull() & same, "replay").when(F.col("_old").isNotNull(), "conflict").when(F.col("position") < F.col("_last"), "regressed").otherwise("apply")
    return joined.select(key, "event_id", "position", "amount", verdict.alias("verdict"))


def availability(memories: DataFrame, evidence: DataFrame, episodes: DataFrame, positions: DataFrame) -> DataFrame:
    """What a memory's provenance supports: (memory_id, cohort, availability, position, coverage).

    ``memories``: memory_id, episode_id, cohort_id, archived, superseded; ``evidence``: memory_id, node; ``episodes``:
    episode_id, complete, nodes; ``positions``: node, position of the activity clock.  Supported from the latest position
    of all its evidence; evidence off the clock, an incomplete episode or none at all support nothing."""
    episode = episodes.select("episode_id", F.coalesce("complete", F.lit(False)).alias("complete"), F.coalesce("nodes", F.array()).alias("nodes"))
    known = memories.join(episode, "episode_id", "left")
    path = known.where("complete").select("memory_id", F.explode("nodes").alias("node"))
    nodes = evidence.select("memory_id", "node").where("node is not null").unionByName(path)
    placed = nodes.join(positions.select("node", "position"), "node", "left")
    found = placed.groupBy("memory_id").agg(F.max("position").alias("position"), F.min(F.when(F.col("position").isNull(), F.col("node"))).alias("missing"))
    joined = known.join(found, "memory_id", "left")
    unknown = F.col("episode_id").isNotNull() & F.col("complete").isNull()
    coverage = (
        F.when(F.col("archived") | F.col("superseded"), "lifecycle-excluded")
        .when(unknown, F.raise_error(F.concat(F.lit("unknown episode of memory "), F.col("memory_id").cast("string"))).cast("string"))
        .when(F.col("episode_id").isNotNull() & ~F.col("complete"), "episode-incomplete")
        .when(F.col("position").isNull() & F.col("missing").isNull(), "missing-provenance")
        .when(F.col("missing").isNotNull(), F.concat(F.lit("missing-evidence:"), F.col("missing").cast("string"))).otherwise("supported")
    )
    excluded = F.col("archived") | F.col("superseded")
    cohort = F.when(excluded, F.coalesce("cohort_id", F.col("memory_id").cast("string"))).otherwise(F.coalesce("cohort_id", "episode_id", F.col("memory_id").cast("string")))
    status = F.when(F.col("coverage") == "supported", "supported").when(F.col("coverage") == "lifecycle-excluded", "credit_excluded").otherwise("unsupported")
    return joined.withColumn("coverage", coverage).select(
        "memory_id", cohort.alias("cohort"), status.alias("availability"), F.when(F.col("coverage") == "supported", F.col("position")).alias("position"), "coverage"
    )


def cohort_conflicts(plans: DataFrame) -> DataFrame:
    """Cohorts whose supported members disagree about the position."""
    return plans.where("availability = 'supported'").groupBy("cohort").agg(F.min("position").alias("first"), F.max("position").alias("last")).where("first <> last")


def propagate_historical(
    edges: DataFrame, events: DataFrame, communities: DataFrame, authorized: DataFrame, available: DataFrame, excluded: DataFrame | None = None, p: Policy = DEFAULT
) -> DataFrame:
    """(event_id, position, node, credit): propagation over the authorised part of a graph, credit by availability.

    ``events``: event_id, position, node (a root), amount.  A memory gets credit if it is supported from a position above 0
    and not after the event's, and not excluded; what gets none still conducts.  A root that is not authorised is an error."""
    allowed = authorized.select("node").distinct()
    inside = edges
    for end in ("source", "target"):
        inside = inside.join(allowed.select(F.col("node").alias(end)), end, "left_semi")
    known = events.join(allowed.withColumn("_ok", F.lit(True)), "node", "left")
    roots = known.withColumn("node", F.when(F.col("_ok"), F.col("node")).otherwise(F.raise_error(F.lit("a root is not authorised")).cast("bigint")))
    spread = propagate(inside, roots.select("event_id", "node", "amount"), communities, None, p)
    at = events.groupBy("event_id").agg(F.max("position").alias("position"))
    from_ = available.where("availability = 'supported' and position > 0").select(F.col("memory_id").alias("node"), F.col("position").alias("_from"))
    credit = spread.join(at, "event_id").join(from_, "node").where(F.col("_from") <= F.col("position"))
    if excluded is not None:
        credit = credit.join(excluded.select("event_id", "node").distinct(), ["event_id", "node"], "left_anti")
    return credit.select("event_id", "position", "node", "credit")


def dream_events(memories: DataFrame, proofs: DataFrame, links: DataFrame, representatives: DataFrame, p: Policy = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """First-cycle links of imported memories as credits: (events, coverage).

    ``memories``: id, cohort, birth, eligible; ``proofs``: id, completed, roots, duplicate_origin; ``links``: source,
    target, origin, completed, direct; ``representatives``: id, representative.  A proof's roots are taken as they are;
    without a proof an eligible memory takes its completed direct links; what neither covers is unsupported.  Roots are
    replaced by their representatives and must be eligible, born earlier and of another cohort."""
    direct = links.where("completed and direct and origin = 'organiser'")
    pairs = direct.select(F.col("source").alias("id"), F.col("target").alias("root")).union(direct.select("target", "source")).groupBy("id").agg(F.collect_set("root").alias("linked"))
    known = memories.join(proofs.select("id", "completed", "roots", "duplicate_origin", F.lit(True).alias("proof")), "id", "left").join(pairs, "id", "left")
    proof, some = F.coalesce(F.col("proof"), F.lit(False)), F.size(F.coalesce("roots", F.array())) > 0
    coverage = (
        F.when(F.col("birth").isNull() | (proof & ~F.coalesce("completed", F.lit(False))), "unsupported")
        .when(proof & ~some, "verified-no-link").when(proof & ~F.col("eligible") & ~F.coalesce("duplicate_origin", F.lit(False)), "unsupported")
        .when(proof, "actual-first-cycle").when(F.col("eligible"), "completed-graph-approximation").otherwise("unsupported")
    )
    covered = known.withColumn("coverage", coverage)
    roots = F.when(F.col("coverage") == "actual-first-cycle", F.col("roots")).when(F.col("coverage") == "completed-graph-approximation", F.col("linked"))
    asked = covered.select(F.col("id").alias("event_id"), F.col("cohort").alias("_cohort"), F.col("birth").alias("position"), F.explode(roots).alias("root"))
    chosen = asked.join(representatives.select(F.col("id").alias("root"), "representative"), "root", "left").withColumn("node", F.coalesce("representative", "root"))
    of = lambda c, names: memories.select(F.col("id").alias(c), *[F.col(x).alias(y) for x, y in names.items()])
    judged = chosen.join(of("root", {"cohort": "_root_cohort"}), "root").join(of("node", {"cohort": "_node_cohort", "eligible": "_eligible", "birth": "_birth"}), "node")
    good = judged.where((F.col("_root_cohort") != F.col("_cohort")) & (F.col("_node_cohort") != F.col("_cohort")) & F.col("_eligible") & (F.col("_birth") > 0) & (F.col("_birth") < F.col("position")))
    events = good.select("event_id", "position", "node", F.lit(p.linkage).alias("amount")).distinct()
    return events, covered.select("id", "coverage")


def semantic_coverage(fragments: DataFrame, targets: DataFrame, pairs: DataFrame, most: int = 64) -> tuple[DataFrame, DataFrame]:
    """Bonuses of fragments for earlier memories, and why a fragment has none: (effects, coverage).

    ``fragments``: fragment_id, position (null: no activity), evidence, usable; ``targets``: memory_id, position (null or
    0: not supported), eligible; ``pairs``: fragment_id, memory_id, cosine."""
    live = fragments.where("position is not null and evidence and usable").select("fragment_id", F.col("position").alias("_at"))
    able = targets.where("eligible and position > 0").select("memory_id", F.col("position").alias("_from"))
    met = pairs.join(live, "fragment_id").join(able, "memory_id").where(F.col("_from") <= F.col("_at"))
    effects = semantic_plan(met.select("fragment_id", "memory_id", "cosine", F.lit(True).alias("eligible")), most)
    planned = effects.select("fragment_id").distinct().withColumn("_planned", F.lit(True))
    reason = (
        F.when(F.col("position").isNull(), "non-activity-only-fragment").when(~F.col("evidence"), "fragment-evidence-unavailable")
        .when(~F.col("usable"), "complete-no-usable-source-rows").when(F.col("_planned"), "event-planned").otherwise("complete-no-eligible-match")
    )
    return effects.select("fragment_id", "memory_id", "bonus", "rank"), fragments.join(planned, "fragment_id", "left").select("fragment_id", reason.alias("coverage"))


def score_import(
    events: DataFrame, retained: DataFrame, edges: DataFrame, communities: DataFrame, authorized: DataFrame, available: DataFrame, cut: int, excluded: DataFrame | None = None, p: Policy = DEFAULT
) -> DataFrame:
    """Scores at a cut of what an import's events spread and what was retained: (memory_id, admitted, score).

    ``retained``: memory_id, position, event_id, amount.  An event after the cut is an error, not left out."""
    inside = F.when(F.col("position") <= cut, F.col("position")).otherwise(F.raise_error(F.lit("an event is after the cut")).cast("bigint"))
    spread = propagate_historical(edges, events.withColumn("position", inside), communities, authorized, available, excluded, p)
    columns = ["memory_id", "position", "event_id", "amount"]
    both = spread.select(F.col("node").alias("memory_id"), "position", "event_id", F.col("credit").alias("amount")).select(*columns).unionByName(retained.select(*columns))
    return fold(both, "memory_id", cut, p)
