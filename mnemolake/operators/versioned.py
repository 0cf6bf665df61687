"""Versioned state: append-only revisions, tombstones, reads as of a cut, guarded writes, rewrites, prunes, pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def latest(revisions: DataFrame, key: Sequence[str], version: str) -> DataFrame:
    """The row of greatest version for each key: a combining aggregate, no sort of a key's history."""
    rest = [c for c in revisions.columns if c not in key]
    best = revisions.groupBy(*key).agg(F.max_by(F.struct(*rest), version).alias("_row"))
    return best.select(*key, "_row.*")


def as_of(revisions: DataFrame, key: Sequence[str], version: str, cut: int, tombstones: DataFrame | None = None) -> DataFrame:
    """State at a cut: the latest revision at or before it, without keys tombstoned by then."""
    state = latest(revisions.where(F.col(version) <= cut), key, version)
    if tombstones is not None:
        state = state.join(tombstones.where(F.col(version) <= cut).select(*key).distinct(), list(key), "left_anti")
    return state


def history_status(revisions: DataFrame, bodies: DataFrame, tombstones: DataFrame, key: str, version: str, body: str, cut: int) -> DataFrame:
    """Each key ever seen: available, tombstoned, absent (no payload) or unavailable (nothing by the cut)."""
    keys = revisions.select(key).distinct()
    now = latest(revisions.where(F.col(version) <= cut), [key], version).select(key, body, F.lit(True).alias("_seen"))
    dead = tombstones.where(F.col(version) <= cut).select(key).distinct().withColumn("_dead", F.lit(True))
    has = bodies.select(body).distinct().withColumn("_body", F.lit(True))
    joined = keys.join(now, key, "left").join(dead, key, "left").join(has, body, "left")
    status = (
        F.when(F.col("_dead"), "tombstoned").when(F.col("_seen").isNull(), "unavailable").when(F.col("_body").isNull(), "absent").otherwise("available")
    )
    return joined.select(key, status.alias("status"))


def rewrite_filter(
    rows: DataFrame, include: Sequence | None = None, exclude: Sequence | None = None, states: Sequence[str] | None = None,
    archived: bool | None = None, superseded: bool | None = None, created: tuple | None = None, updated: tuple | None = None,
    source_time: tuple | None = None, min_freshness: int | None = None, key: str = "memory_id",
) -> DataFrame:
    """Rows that pass every condition given; ranges are half-open and a null never passes one."""
    conditions: list[Column] = []
    if include is not None:
        conditions.append(F.col(key).isin(list(include)))
    if exclude:
        conditions.append(~F.col(key).isin(list(exclude)))
    if states is not None:
        conditions.append(F.col("state").isin(list(states)))
    if archived is not None:
        conditions.append(F.col("archived") == archived)
    if superseded is not None:
        conditions.append(F.col("superseded_by").isNotNull() == superseded)
    for column, span in (("created", created), ("updated", updated), ("source_time", source_time)):
        if span:
            conditions += [F.col(column) >= x for x in span[:1] if x is not None] + [F.col(column) < x for x in span[1:] if x is not None]
    if min_freshness is not None:
        conditions.append(F.col("freshness") >= min_freshness)
    keep = F.lit(True)
    for c in conditions:
        keep = keep & F.coalesce(c, F.lit(False))
    return rows.where(keep)


def revision_filter(revisions: DataFrame, key: str, revision: str, version: str, mode: str, cut: int = 0) -> DataFrame:
    """``latest``, ``all``, or ``since`` a version."""
    if mode == "latest":
        return latest(revisions, [key], revision).select(*revisions.columns)
    return revisions if mode == "all" else revisions.where(F.col(version) >= cut)


def insert_once(stored: DataFrame, batch: DataFrame, key: Sequence[str], version: str) -> tuple[DataFrame, DataFrame]:
    """(rows to append, conflicts).  Equal rows of a known key are no-ops, different ones conflicts; versions go on."""
    value = [c for c in batch.columns if c not in key]
    both = stored.select(*key, *value, F.lit(0).alias("_new")).unionByName(batch.select(*key, *value, F.lit(1).alias("_new")))
    judged = both.groupBy(*key).agg(
        F.min("_new").alias("_new"), F.count_distinct(F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in value])).alias("_values"),
        *[F.min_by(c, "_new").alias(c) for c in value],
    )
    top = stored.agg(F.coalesce(F.max(version), F.lit(0)).alias("_top"))
    fresh = judged.where("_values = 1 and _new = 1").select(*key, *value)
    number = F.col(key[0]) if isinstance(batch.schema[key[0]].dataType, NumericType) else F.xxhash64(*key)
    fresh = with_versions(fresh.withColumn("_order", number), ["_order", *key], version).drop("_order")
    fresh = fresh.join(F.broadcast(top)).withColumn(version, F.col(version) + F.col("_top")).drop("_top")
    return fresh, judged.where("_values > 1").select(*key)


def publish(current: DataFrame, proposals: DataFrame, key: str, revision: str) -> DataFrame:
    """Optimistic writes: a proposal holds if its expected revision is the current one (0: none).  Ties: least mutation id."""
    joined = proposals.join(current.select(key, F.col(revision).alias("_now")), key, "left").withColumn("_now", F.coalesce("_now", F.lit(0)))
    first = F.row_number().over(Window.partitionBy(key, "expected").orderBy("mutation_id"))
    verdict = F.when(F.col("expected") != F.col("_now"), "stale").when(F.col("_k") > 1, "conflict").otherwise("applied")
    return joined.withColumn("_k", first).select(key, "mutation_id", verdict.alias("verdict"), F.when(verdict == "applied", F.col("_now") + 1).alias("new_revision"))


def prune(bodies: DataFrame, references: DataFrame, tombstones: DataFrame, targets: DataFrame, key: str, body: str) -> DataFrame:
    """Bodies with a payload only where it stays: a target must be tombstoned and its body shared with no other key."""
    allowed = targets.join(tombstones.select(key).distinct(), key, "left_semi")
    owned = references.select(key, body).distinct()
    chosen = owned.join(allowed, key, "left_semi").select(body).distinct()
    shared = owned.join(allowed, key, "left_anti").select(body).distinct()
    gone = chosen.join(shared, body, "left_anti").withColumn("_gone", F.lit(True))
    payload = [c for c in bodies.columns if c != body]
    joined = bodies.join(gone, body, "left")
    return joined.select(body, *[F.when(F.col("_gone").isNull(), F.col(c)).alias(c) for c in payload], F.col("_gone").isNotNull().alias("pruned"))


def reclaim(objects: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """Objects that something refers to."""
    return objects.join(references.select(key).distinct(), key, "left_semi")


def reconcile(left: DataFrame, right: DataFrame, ordinal: str, digest: str) -> DataFrame:
    """One row: the common prefix and which history extends the other."""
    a, b = left.select(ordinal, F.col(digest).alias("_a")), right.select(ordinal, F.col(digest).alias("_b"))
    both = a.join(b, ordinal, "full_outer")
    differs = F.when(~F.col("_a").eqNullSafe(F.col("_b")), F.col(ordinal))
    m = both.agg(F.count("_a").alias("n_left"), F.count("_b").alias("n_right"), F.min(differs).alias("first"), F.count("*").alias("n"))
    prefix = F.coalesce(F.col("first") - 1, F.col("n"))
    relation = (
        F.when(F.col("first").isNull(), "identical").when(prefix == F.col("n_right"), "left_extends_right")
        .when(prefix == F.col("n_left"), "right_extends_left").otherwise("diverged")
    )
    return m.select("n_left", "n_right", prefix.alias("common_prefix"), relation.alias("relation"))


def keyset_page(rows: DataFrame, key: str, after, limit: int) -> DataFrame:
    return rows.where(F.col(key) > after).orderBy(key).limit(limit)


def budget_page(rows: DataFrame, order: Sequence[str], offset: int, most: int = 128, most_bytes: int = 256 * 1024) -> DataFrame:
    """The next rows that fit the item and byte budgets.  Only the page's candidates are numbered, not the table."""
    head = rows.orderBy(*order).limit(offset + most)
    w = Window.orderBy(*order)
    numbered = head.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") > offset)
    size = F.octet_length(F.to_json(F.struct(*[c for c in rows.columns])))
    return numbered.withColumn("_sum", F.sum(size).over(w)).where(F.col("_sum") <= most_bytes).drop("_rn", "_sum")


def running_total(rows: DataFrame, order: Sequence[str], value: Column, into: str, parts: int = 64) -> DataFrame:
    """Add the sum of ``value`` over the rows up to each one; the order's first column is numeric.

    Ranges of that column, cut at ``parts`` quantiles, are summed each on its own and shifted by the sums before
    them, so no task orders the whole table.  Ranges are an expression of the row: a recomputed task agrees."""
    first = order[0]
    found = rows.agg(F.percentile_approx(first, [k / parts for k in range(1, parts)], 10_000)).first()[0]
    bounds = sorted({b for b in found or [] if b is not None})
    bucket = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < F.col(first))) if bounds else F.lit(0)
    tagged = rows.withColumns({"_bucket": bucket, "_value": value.cast("long")})
    sums = tagged.groupBy("_bucket").agg(F.sum("_value").alias("_s"))  # at most `parts` rows
    shift = sums.select("_bucket", (F.sum("_s").over(Window.orderBy("_bucket")) - F.col("_s")).alias("_shift"))
    own = F.sum("_value").over(Window.partitionBy("_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return tagged.withColumn(into, own).join(F.broadcast(shift), "_bucket").withColumn(into, F.col(into) + F.col("_shift")).drop("_bucket", "_shift", "_value")


def with_versions(rows: DataFrame, order: Sequence[str], version: str, start: int = 0) -> DataFrame:
    """Consecutive versions in an order whose first column is numeric."""
    return running_total(rows, order, F.lit(1), version).withColumn(version, F.col(version) + start)


def rewrite(revisions: DataFrame, kept: DataFrame, tombstones: DataFrame, key: str, version: str, unsupported: DataFrame | None = None) -> DataFrame:
    """The history of a new owner: revisions and tombstones of the keys kept, in their order, numbered from 1.

    ``change`` tells ``revision`` from ``tombstone``; a tombstone closes its key's history.  Operational state that
    cannot be carried over is an error, not left out."""
    if unsupported is not None and not unsupported.isEmpty():
        raise ValueError("the history holds state that a rewrite does not carry over")
    rest = [c for c in revisions.columns if c not in (key, version)]
    live = revisions.join(kept.select(key).distinct(), key, "left_semi").select(key, version, *rest, F.lit("revision").alias("change"))
    dead = tombstones.join(kept.select(key).distinct(), key, "left_semi").select(key, version, *[F.lit(None).cast(revisions.schema[c].dataType).alias(c) for c in rest], F.lit("tombstone").alias("change"))
    both = live.unionByName(dead).withColumn("_order", (F.col("change") == "tombstone").cast("int"))
    return with_versions(both, [version, "_order", key], "new_version").drop("_order", version)


def update_records(current: DataFrame, asked: DataFrame, applied: DataFrame, key: str, immutable: Sequence[str]) -> DataFrame:
    """Guarded updates of records (key, revision, updated_at, immutable fields): the verdict of each mutation.

    A mutation id that was applied before is a replay if its digest is the same and else an error; the revision expected
    must be the current one, immutable fields stay, and updated_at does not go back."""
    old = applied.select("mutation_id", F.col("digest").alias("_digest"))
    now = current.select(key, F.col("revision").alias("_revision"), F.col("updated_at").alias("_updated"), *[F.col(c).alias(f"_{c}") for c in immutable])
    joined = asked.join(old, "mutation_id", "left").join(now, key, "left")
    changed = F.lit(False)
    for c in immutable:
        changed = changed | (F.col("_revision").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"_{c}")))
    verdict = (
        F.when(F.col("_digest").isNotNull() & (F.col("_digest") == F.col("digest")), "replay").when(F.col("_digest").isNotNull(), "reused mutation")
        .when(F.col("expected") != F.coalesce("_revision", F.lit(0)), "stale").when(changed, "immutable field")
        .when(F.col("updated_at") < F.col("_updated"), "clock went back").otherwise("applied")
    )
    return joined.select(key, "mutation_id", verdict.alias("verdict"))


def prune_targets(targets: DataFrame, tombstones: DataFrame, references: DataFrame, guards: DataFrame, key: str, body: str, most: int = 128) -> DataFrame:
    """The verdict of each of up to ``most`` targets: ``pruned`` or why not.

    A target must be tombstoned; its body must not be shared with a key that is no target, nor be referred to by a guard
    (a vector, a relation, a manifest)."""
    if targets.limit(most + 1).count() > most:
        raise ValueError("too many targets")
    chosen = targets.select(key).distinct()
    dead = tombstones.select(key).distinct().withColumn("_dead", F.lit(True))
    owned = references.select(key, body).distinct()
    shared = owned.join(chosen, key, "left_anti").select(body).distinct().withColumn("_shared", F.lit(True))
    held = guards.select(body).distinct().withColumn("_held", F.lit(True))
    joined = chosen.join(dead, key, "left").join(owned, key, "left").join(shared, body, "left").join(held, body, "left")
    verdict = F.when(F.col("_dead").isNull(), "not tombstoned").when(F.col("_shared"), "shared body").when(F.col("_held"), "referenced").otherwise("pruned")
    return joined.groupBy(key).agg(F.max(verdict).alias("verdict"))


def page_cursor(rows: DataFrame, order: Sequence[str], cut: int, query: str, cursor: tuple[int, str, int] | None, most: int = 128) -> tuple[DataFrame, tuple[int, str, int]]:
    """A page of a snapshot and the cursor after it; a cursor of another cut or another query is an error."""
    import hashlib

    digest = hashlib.sha256(query.encode()).hexdigest()
    if cursor is not None and cursor[:2] != (cut, digest):
        raise ValueError("the cursor belongs to another snapshot or query")
    offset = cursor[2] if cursor else 0
    return budget_page(rows, order, offset, most), (cut, digest, offset + most)


def ego_writes(stored: DataFrame, writes: DataFrame) -> DataFrame:
    """The verdict of writes (kind, key, expected, previous) to an ego's records (kind, key, revision).

    An identity is written once; a synthesis must name the one before it; personality and anchors follow revisions."""
    now = stored.groupBy("kind", "key").agg(F.max("revision").alias("_now"))
    joined = writes.join(now, ["kind", "key"], "left").withColumn("_now", F.coalesce("_now", F.lit(0)))
    verdict = (
        F.when((F.col("kind") == "identity") & (F.col("_now") > 0), "identity is fixed")
        .when((F.col("kind") == "synthesis") & (F.coalesce("previous", F.lit(0)) != F.col("_now")), "not the latest synthesis")
        .when((F.col("kind") != "synthesis") & (F.col("expected") != F.col("_now")), "stale").otherwise("applied")
    )
    return joined.select("kind", "key", verdict.alias("verdict"), F.when(verdict == "applied", F.col("_now") + 1).alias("new_revision"))
