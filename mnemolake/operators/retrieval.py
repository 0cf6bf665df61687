"""Retrieval: lexical, vector and hybrid search, community routing, fusion, diversification, snapshot assembly."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from .graph import _cut
from .versioned import with_versions

#: Queries and vectors of a block, two of which a task holds at a time; and queries whose products it holds.
QUERY_ROWS = 2048
BLOCK_ROWS = 8192
CHUNK = 256
#: Communities whose sizes go to every task, at most.
MAX_COMMUNITIES = 50_000
#: Centroids that go to every task, at most.
MAX_CENTROIDS = 10_000


def lexical_matches(docs: DataFrame, query: Sequence[str], text: Column, *keep: str) -> DataFrame:
    """All rows with a positive lexical score, with the columns named."""
    # not deterministic, so the filter stays above the score instead of taking it twice
    bound = docs.select(*keep, F.struct(T.lexical_score(text, query).alias("score"), F.monotonically_increasing_id().alias("barrier")).alias("_s"))
    return bound.where("_s.score > 0").select(*keep, "_s.score")


def lexical_search(docs: DataFrame, query: Sequence[str], text: Column, key: str, limit: int | None = 10) -> DataFrame:
    """Score > 0, best first, ties by key; without a limit all matches, in no order."""
    hits = lexical_matches(docs, query, text, key)
    return hits if limit is None else hits.orderBy(F.desc("score"), key).limit(limit)


def raw_search(turns: DataFrame, query: Sequence[str], text: Column, key: str, time: str, limit: int = 10) -> DataFrame:
    """Turns by score, later first, then key."""
    return lexical_matches(turns, query, text, key, time).orderBy(F.desc("score"), F.desc(time), key).limit(limit)


def file_search(files: DataFrame, query: Sequence[str], name: str, key: str, limit: int = 10) -> DataFrame:
    """File names by score, then name, then key; contents are not read."""
    return lexical_matches(files, query, F.col(name), key, name).orderBy(F.desc("score"), name, key).limit(limit)


def first_of_each(ranked: DataFrame, identity: Sequence[str], rank: Sequence[str]) -> DataFrame:
    """Of ordered candidates, the first of each identity."""
    rest = [c for c in ranked.columns if c not in identity]
    return ranked.groupBy(*identity).agg(F.min_by(F.struct(*rest), F.struct(*rank)).alias("_row")).select(*identity, "_row.*")


def in_blocks(vectors: DataFrame, queries: DataFrame, run: Callable, schema: str, vector_key: str = "k", query_key: str = "q") -> DataFrame:
    """``run(key, left, right)`` on every block of ``vectors`` with every block of ``queries`` of the same ``c``, as Arrow tables.

    Rows are dealt to blocks by a hash of their key and sent once for each block of the other side, so a task holds two
    bounded blocks, nothing is broadcast and no table of pairs is made.  Without a column ``c`` there is one group."""
    if "c" in vectors.columns:
        count = lambda df, to, size: df.groupBy("c").agg(F.ceil(F.count("*") / size).alias(to))
        sizes = count(vectors, "_vn", BLOCK_ROWS).join(count(queries, "_qn", QUERY_ROWS), "c")
        groups, total = sizes.agg(F.count("*"), F.sum(F.col("_vn") * F.col("_qn"))).first()
        sizes = F.broadcast(sizes) if groups <= MAX_COMMUNITIES else sizes
        vectors, queries = vectors.join(sizes, "c"), queries.join(sizes, "c")
    else:
        counts = {"_vn": max(1, -(-vectors.count() // BLOCK_ROWS)), "_qn": max(1, -(-queries.count() // QUERY_ROWS))}
        total = counts["_vn"] * counts["_qn"]
        vectors, queries = (df.withColumns({"c": F.lit(""), **{k: F.lit(n).cast("long") for k, n in counts.items()}}) for df in (vectors, queries))
    own = lambda key, n: F.pmod(F.xxhash64(key), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = vectors.withColumn("g", own(vector_key, F.col("_vn"))).withColumn("h", every("_qn")).drop("_vn", "_qn")
    right = queries.withColumn("h", own(query_key, F.col("_qn"))).withColumn("g", every("_vn")).drop("_vn", "_qn")
    parts = min(2000, 4 * (total or 1))  # stated, as what a task reads is small beside what it computes
    dealt = lambda df: df.repartition(parts, "c", "g", "h").groupBy("c", "g", "h")
    return dealt(left).cogroup(dealt(right)).applyInArrow(run, schema)


def together(vectors: DataFrame, queries: DataFrame, pairs: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``run(key, rows, pairs)`` on blocks of both tables' rows (``what``, ``k``, ...), with the pairs (``s``, ``k``) that fall into each."""
    g, h = (max(1, -(-df.count() // size)) for df, size in ((vectors, BLOCK_ROWS), (queries, QUERY_ROWS)))
    own = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n).cast("long"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    rows = vectors.select("*", own("k", g).alias("g"), every(h).alias("h")).unionByName(queries.select("*", own("k", h).alias("h"), every(g).alias("g")))
    dealt = lambda df: df.repartition(min(2000, 4 * g * h), "g", "h").groupBy("g", "h")
    return dealt(rows).cogroup(dealt(pairs.select("*", own("k", g).alias("g"), own("s", h).alias("h")))).applyInArrow(run, schema)


def units(column: pa.ChunkedArray, n: int) -> np.ndarray:
    """Rows of unit length; of zeros where a length is zero or not finite."""
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.float64())
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    with np.errstate(all="ignore"):
        length = np.sqrt((x * x).sum(axis=1))
        ok = np.isfinite(length) & (length > 0)
        return np.where(ok[:, None], x / length[:, None], 0.0)


def _best(limit: int, digits: int, scale: float, shift: float, floor: float | None):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        """The best of a block of vectors for each of a block of queries, by rounded score, then key."""
        out: list[list] = [[np.array([], np.int64)], [np.array([], np.int64)], [np.array([])], [np.array([])]]
        if left.num_rows and right.num_rows:
            left = left.sort_by("k")
            keys, qkeys, start, end = (t.column(c).to_numpy() for t, c in ((left, "k"), (right, "q"), (left, "at"), (right, "at")))
            v, q = units(left.column("v"), len(keys)), units(right.column("v"), len(qkeys))
            for at in range(0, len(qkeys), CHUNK):
                s = q[at : at + CHUNK] @ v.T
                s[start[None, :] > end[at : at + CHUNK, None]] = -2
                low = np.full(len(s), 5e-13 if floor is None else (floor - shift) / scale - 1e-9)  # beyond it a score is positive in 12 digits
                if len(keys) > limit:
                    low = np.maximum(low, np.partition(s, len(keys) - limit, axis=1)[:, len(keys) - limit] - 4 * 10.0**-digits)
                i, j = np.nonzero(s > low[:, None])
                score = np.round(np.clip(s[i, j], -1, 1) * scale + shift, 12)
                place = np.round(score, digits)
                order = np.lexsort((j, -place, i))
                i, j, score, place = i[order], j[order], score[order], place[order]
                kept = np.arange(len(i)) - np.searchsorted(i, i) < limit
                for c, x in zip(out, (qkeys[at + i], keys[j], score, place)):
                    c.append(x[kept])
        return pa.table([np.concatenate(c) for c in out], names=["q", "k", "score", "place"])

    return run


def comparable(rows: DataFrame, vector: str, width: int | None) -> DataFrame:
    """Rows whose vector has the width and no nulls."""
    return rows.where(F.col(vector).isNotNull() & (F.size(vector) == F.lit(width or 0)) & ~F.exists(vector, lambda x: x.isNull()))


def _ranked(vectors: DataFrame, queries: DataFrame, key: str, limit: int, digits: int, scale: float = 1.0, shift: float = 0.0, floor: float | None = None) -> DataFrame:
    found = in_blocks(vectors, queries, _best(limit, digits, scale, shift, floor), "q bigint, k bigint, score double, place double")
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("place"), "k"))
    return found.withColumn("rank", best).where(F.col("rank") <= limit).select(F.col("q").alias("query_id"), F.col("k").alias(key), "score", "rank")


def _plain(rows: DataFrame, key: str, vector: str, as_: str, at: Column | None, *more: Column) -> DataFrame:
    place = F.lit(0) if at is None else at
    return rows.select(F.col(key).cast("long").alias(as_), F.col(vector).cast("array<double>").alias("v"), place.cast("long").alias("at"), *more)


def vector_search(
    vectors: DataFrame, queries: DataFrame, key: str, vector: str, limit: int = 10, digits: int = 12, scale: float = 1.0, shift: float = 0.0, floor: float | None = None,
    since: Column | None = None, until: Column | None = None,
) -> DataFrame:
    """Exact cosine of a stated set of queries (``query_id``, ``query``) against all vectors; positive, top ``limit`` each.

    Vectors and queries meet in blocks, each pair of blocks as products of matrices of which only the best ``limit`` of each
    query leave, by their score in ``digits`` digits, then key.  Scores are scaled and shifted, then held against ``floor`` if
    there is one.  With ``since`` of vectors and ``until`` of queries (not null) only pairs where since <= until count.  Vectors
    of another length than the queries', zero ones and nulls match nothing."""
    width = queries.agg(F.max(F.size("query"))).first()[0]
    asked = _plain(comparable(queries, "query", width), "query_id", "query", "q", until)
    return _ranked(_plain(comparable(vectors, vector, width), key, vector, "k", since), asked, key, limit, digits, scale, shift, floor)


def union_evidence(lexical: DataFrame, semantic: DataFrame, key: str) -> DataFrame:
    """Full outer join of both evidences."""
    return lexical.select(key, F.col("score").alias("lexical")).join(semantic.select(key, F.col("score").alias("semantic")), key, "full_outer")


def hybrid(lexical: DataFrame, semantic: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    both = union_evidence(lexical, semantic, key).na.fill(0.0, ["lexical", "semantic"])
    fused = both.withColumn("score", V.combine_hybrid(F.col("lexical"), F.col("semantic"))).where("score > 0")
    return fused if limit is None else fused.orderBy(F.desc("score"), key).limit(limit)


def page(hits: DataFrame, order: list, limit: int) -> DataFrame:
    """``limit`` hits, each with ``truncated``: whether there was one more."""
    head = hits.orderBy(*order).limit(limit + 1)
    w = Window.orderBy(*order)
    numbered = head.withColumns({"_rn": F.row_number().over(w), "_n": F.count("*").over(Window.partitionBy())})
    return numbered.withColumn("truncated", F.col("_n") > limit).where(F.col("_rn") <= limit).drop("_rn", "_n")


def snapshot(memories: DataFrame, bodies: DataFrame, vectors: DataFrame, freshness: DataFrame, key: str, body: str) -> DataFrame:
    """Current, unarchived memories with their bodies; vectors and freshness where there are any."""
    return memories.where("not archived").join(bodies, body).join(vectors, body, "left").join(freshness, key, "left")


def mean_vectors(vectors: DataFrame, group: str | Sequence[str], vector: str) -> DataFrame:
    """Element-wise means by group, combined before the shuffle."""
    keys = [group] if isinstance(group, str) else list(group)
    means = vectors.groupBy(*keys).agg(Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>"))).alias("m"))
    return means.select(*keys, vector_to_array("m").cast("array<float>").alias("mean"))


def community_centroids(vectors: DataFrame, community: str, key: str, vector: str, k: int = 4, rounds: int = 2) -> DataFrame:
    """Up to ``k`` sub-centroids by community: farthest-first seeds from the member nearest the mean, then rounds of
    reassignment by cosine.  Every step is an aggregate over all members, of all communities at once.

    Of equals, the nearest is the last by key, the farthest the first, and a member goes to the last centroid."""
    x = vectors.where(F.col(community).isNotNull()).select(F.col(community).alias("c"), F.col(key).alias("k"), F.col(vector).cast("array<float>").alias("v"))
    near = lambda v, c: F.coalesce(V.cosine(v, c), F.lit(-2.0))
    first = x.join(mean_vectors(x, "c", "v"), "c").groupBy("c").agg(F.max_by(F.struct("k", "v"), F.struct(near(F.col("v"), F.col("mean")), "k")).alias("s"))
    seeds = _cut(first.select("c", F.array("s.k").alias("ids"), F.array("s.v").alias("cents")))
    for _ in range(k - 1):
        left = x.join(seeds, "c").where(~F.array_contains("ids", F.col("k")))
        apart = F.array_max(F.transform("cents", lambda s: near(F.col("v"), s)))
        far = left.groupBy("c").agg(F.min_by(F.struct("k", "v"), F.struct(apart, "k")).alias("s"))
        grown = seeds.join(far, "c", "left")
        more = lambda old, new: F.when(F.col("s").isNull(), F.col(old)).otherwise(F.concat(old, F.array(f"s.{new}"))).alias(old)
        seeds = _cut(grown.select("c", more("ids", "k"), more("cents", "v")))
    cents = seeds.select("c", F.posexplode("cents").alias("no", "cent"))
    for _ in range(rounds):
        whole = cents.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("no", "cent"))).alias("all"))
        own = F.array_max(F.transform("all", lambda s: F.struct(near(F.col("v"), s["cent"]).alias("near"), s["no"].alias("no"))))["no"]
        means = mean_vectors(x.join(whole, "c").select("c", own.alias("no"), "v"), ["c", "no"], "v")
        cents = _cut(cents.join(means, ["c", "no"], "left").select("c", "no", F.coalesce("mean", "cent").alias("cent")))
    return cents.select(F.col("c").alias(community), F.col("no").cast("int").alias("centroid_no"), F.col("cent").alias("centroid"))


def route(centroids: DataFrame, queries: DataFrame, community: str, top: int = 4) -> DataFrame:
    """The communities whose best sub-centroid is nearest to each query."""
    rows = centroids.crossJoin(queries) if centroids.limit(MAX_CENTROIDS + 1).count() > MAX_CENTROIDS else queries.join(F.broadcast(centroids))
    scored = rows.select("query_id", community, V.cosine(F.col("query"), F.col("centroid")).alias("_cos"))
    best = scored.groupBy("query_id", community).agg(F.max("_cos").alias("_cos"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("_cos"), community))
    return best.withColumn("route_rank", rank).where(F.col("route_rank") <= top)


def routed_search(vectors: DataFrame, queries: DataFrame, centroids: DataFrame, key: str, vector: str, community: str, limit: int = 4, top: int = 4) -> DataFrame:
    """Exact cosine over the routed communities and the unassigned; over all, flagged, if there are no communities.

    Each community's vectors meet the queries routed to it, in blocks; the unassigned meet all queries."""
    fallback = centroids.isEmpty()
    width = queries.agg(F.max(F.size("query"))).first()[0]
    asked = comparable(queries, "query", width)
    group = F.lit("") if fallback else F.when(F.col(community).isNull(), "").otherwise(F.concat(F.lit("="), F.col(community).cast("string")))
    v = _plain(comparable(vectors, vector, width), key, vector, "k", None, group.alias("c"))
    q = _plain(asked, "query_id", "query", "q", None, F.lit("").alias("c"))
    if not fallback:
        routes = _cut(route(centroids, asked, community, top).select("query_id", community))  # at most `top` a query
        q = q.unionByName(_plain(routes.join(asked, "query_id"), "query_id", "query", "q", None, group.alias("c")))
    return _ranked(v, q, key, limit, 12).withColumn("global_fallback", F.lit(fallback))


def representatives(members: DataFrame, centroids: DataFrame, community: str, key: str, vector: str, each: int = 2, most: int = 8) -> DataFrame:
    """Up to ``most`` members of each community, sorted: of each centroid in turn the ``each`` nearest not yet taken, then
    the nearest to any centroid, then members without a vector by key.

    Only the ``most`` best of each list leave the ranking, enough whatever the lists before have taken."""
    cos = members.join(centroids, community).select(community, key, "centroid_no", F.round(V.cosine(F.col("centroid"), F.col(vector)), 9).alias("cos")).where("cos is not null")
    place = F.row_number().over(Window.partitionBy(community, "centroid_no").orderBy(F.desc("cos"), key))
    lists = cos.withColumn("at", place).where(F.col("at") <= most).groupBy(community, "centroid_no").agg(_in_order(key)).groupBy(community).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("centroid_no", "ids"))), lambda x: x["ids"]).alias("lists")
    )
    over = F.row_number().over(Window.partitionBy(community).orderBy(F.desc("cos"), key))
    near = cos.groupBy(community, key).agg(F.max("cos").alias("cos")).withColumn("at", over).where(F.col("at") <= 2 * most).groupBy(community).agg(_in_order(key).alias("near"))
    rest = F.row_number().over(Window.partitionBy(community).orderBy(key))
    plain = members.select(community, key).withColumn("at", rest).where(F.col("at") <= 2 * most).groupBy(community).agg(_in_order(key).alias("plain"))
    all_of = plain.join(lists, community, "left").join(near, community, "left")
    take = lambda acc, ids, n: F.concat(acc, F.slice(F.array_except(ids, acc), F.lit(1), F.greatest(F.lit(0), F.least(F.lit(n), most - F.size(acc)))))
    none = F.slice("plain", F.lit(1), F.lit(0))
    chosen = F.aggregate(F.coalesce("lists", F.array(none)), none, lambda acc, ids: take(acc, ids, each))
    chosen = take(chosen, F.coalesce("near", none), most)
    return all_of.select(community, F.array_sort(take(chosen, F.col("plain"), most)).alias("representatives"))


def _in_order(key: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("at", key))), lambda x: x[key]).alias("ids")


def diversify(candidates: DataFrame, overlaps: DataFrame | None, limit: int, pool: int = 1000) -> DataFrame:
    """Greedy ranking per query: score times the product of 1 - overlap with chosen items of the same conversation.

    ``candidates``: query_id, id, conversation, score; ``overlaps``: a, b, overlap in both directions.  Without overlaps the
    candidates' column ``vector`` tells them, by positive cosines within a query's pool.  The pool of a query is its best
    ``pool`` candidates, the operator's bound."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    top = candidates.withColumn("_r", rank).where(F.col("_r") <= pool).drop("_r")

    def greedy(key, items: pd.DataFrame, over) -> pd.DataFrame:
        left = {i: (s, c) for i, s, c in zip(items["id"], items["score"], items["conversation"])}
        factor = dict.fromkeys(left, 1.0)
        out = []
        while left and len(out) < limit:
            best = min(left, key=lambda i: (-left[i][0] * factor[i], i))
            score, conv = left.pop(best)
            out.append((key[0], best, score * factor.pop(best), len(out) + 1))
            for i, (_, c) in left.items():
                if c == conv:
                    factor[i] *= 1 - over(min(i, best), max(i, best))
        return pd.DataFrame(out, columns=["query_id", "id", "score", "rank"])

    schema = "query_id long, id long, score double, rank int"
    if overlaps is None:

        def by_vectors(key, items: pd.DataFrame) -> pd.DataFrame:
            vectors = {i: np.asarray(v, np.float64) for i, v in zip(items["id"], items["vector"])}
            dot = lambda x, y: float(np.cumsum(x * y)[-1])  # noqa: E731, in the order of the expressions' sums
            length = {i: np.sqrt(dot(v, v)) for i, v in vectors.items()}

            def over(a, b) -> float:
                both = length[a] * length[b]
                return max(0.0, min(1.0, dot(vectors[a], vectors[b]) / both)) if 0 < both < np.inf else 0.0

            return greedy(key, items, over)

        return top.groupBy("query_id").applyInPandas(by_vectors, schema)
    a, b = top.alias("a"), top.alias("b")
    near = a.join(b, (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.conversation") == F.col("b.conversation")) & (F.col("a.id") < F.col("b.id")))
    pairs = near.select(F.col("a.query_id").alias("query_id"), F.col("a.id").alias("a"), F.col("b.id").alias("b")).join(overlaps, ["a", "b"])

    def run(key, items: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        told = {(x, y): z for x, y, z in zip(near["a"], near["b"], near["overlap"])}
        return greedy(key, items, lambda x, y: told.get((x, y), 0.0))

    return top.groupBy("query_id").cogroup(pairs.groupBy("query_id")).applyInPandas(run, schema)


def max_merge(scores: DataFrame, key: str) -> DataFrame:
    return scores.groupBy(key).agg(F.max("score").alias("score"))


def best_per_key(scores: DataFrame, key: str, ties: list[str]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("cosine"), *ties))
    return scores.withColumn("_r", rank).where("_r = 1").drop("_r")


def offers(eligible: DataFrame, key: str, batch: int = 10) -> DataFrame:
    """Batches by freshness, then key."""
    placed = with_versions(eligible.withColumn("_cold", -F.col("freshness")), ["_cold", key], "_rn")
    return placed.withColumn("batch", F.floor((F.col("_rn") - 1) / batch).cast("int")).drop("_cold", "_rn")
