"""Near-duplicate detection: one-permutation MinHash with optimal densification, bands, star-shaped candidates.

1. One pass hashes each text's set of 5-word shingles.  The hashes are dealt to ``BINS`` bins by their top bits;
   a bin's value is its least hash; an empty bin borrows the value of a full bin chosen uniformly by a hash of
   (empty bin, full bin), so two sets choose alike.  Bands of ``rows_for(percent)`` values are the buckets.
2. Documents with equal sets form a class at once (by a 128-bit digest of the set); one stands for the class.
3. Each bucket has one hub, and a document is compared with the ``HUBS`` hubs it shares most buckets with: pairs
   grow with the documents, not with the square of a bucket.  Every candidate is confirmed on full sets.
4. Hubs can miss a link between two others.  A bucket whose members, after that, lie in one component has
   nothing left to find; the open ones take other hubs for ``ROUNDS`` rounds.  What is still open is settled by a
   filter that loses no link: small buckets in full, and in larger ones by what each member has apart from the
   bucket's pivot (see ``_rest``), so each pair that shares a bucket is compared, ruled out or already connected.
5. Components: vertices move to their least neighbours, moves are closed by pointer doubling and edges contracted.

Defined results: null or empty texts have no shingles and stay alone; texts of fewer than 5 words have the whole
sequence as their one shingle; rows that repeat an id share its component; rows without an id stay alone; an
empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vecwords as v
from .scratch import among, drop, materialise, packed, python_ready, without

SHINGLE = 5
#: Least similarity of a link, of the stages and of op9.
PERCENT = 80
OP9_PERCENT = 85
BINS = 256
#: Bands miss a pair at the threshold with this probability at most.
MISS = 1e-4
HUBS = 2
#: Buckets of so many members are compared in full.
SMALL = 8
#: Tasks that a pivot's members are dealt to.
SALTS = 16
#: Pairs of one hub that are compared in one place.
PART = 500
ROUNDS = 3
_U = np.uint64


def shingle_set(h: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of the whole sequence where it is shorter."""
    if not len(h):
        return h
    return np.unique(v.ngrams(h, min(k, len(h)), seed=10 + min(k, len(h))))


def _choice() -> np.ndarray:
    i = np.arange(BINS, dtype=_U)
    return v.mix64((i[:, None] << _U(32)) + i[None, :] + _U(0x51ED270B))


_ORDER = _choice()


def signature(s: np.ndarray) -> np.ndarray:
    """The densified one-permutation sketch of a sorted set of hashes."""
    bins = (s >> _U(56)).astype(np.int64)
    full, first = np.unique(bins, return_index=True)
    out = np.empty(BINS, _U)
    out[full] = s[first]
    if len(full) < BINS:
        empty = np.setdiff1d(np.arange(BINS), full, assume_unique=True)
        out[empty] = out[full[_ORDER[np.ix_(empty, full)].argmin(axis=1)]]
    return out


def rows_for(percent: int) -> int:
    """Most values a band whose bands miss a pair at the threshold in ``MISS`` of all cases at most."""
    return max((r for r in range(1, BINS // 2) if (1 - (percent / 100) ** r) ** (BINS // r) <= MISS), default=1)


def bands(sig: np.ndarray, rows: int) -> np.ndarray:
    values = sig[: len(sig) // rows * rows].reshape(-1, rows)
    h = np.arange(len(values), dtype=_U)
    for k in range(rows):
        h = v.mix64(h * _U(0x9E3779B97F4A7C15) + values[:, k])
    return h


def _digest(s: np.ndarray) -> tuple[int, int]:
    a = v.mix64(s + _U(0x1234567)).sum(dtype=_U)
    b = v.mix64(s ^ _U(0x9E3779B97F4A7C15)).sum(dtype=_U)
    return int(a.view(np.int64)), int(b.view(np.int64))


def linkable(n: int, percent: int) -> bool:
    """Sets so small that even a set of one shingle more breaks the threshold are linked only to equal ones."""
    return 100 * n >= percent * (n + 1)


SKETCH = "doc_id bigint, n_shingles bigint, fp1 bigint, fp2 bigint, bands array<bigint>"


def _sketch(percent: int):
    rows = rows_for(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("fp1", pa.int64()), ("fp2", pa.int64()), ("bands", pa.list_(pa.int64()))])
        for batch in batches:
            n, a, b, k = [], [], [], []
            for _, h in v.word_hashes(batch.column("text"), lower=True):
                s = shingle_set(h)
                n.append(len(s))
                x, y = _digest(s)
                a.append(x)
                b.append(y)
                k.append(v.signed(bands(signature(s), rows)) if linkable(len(s), percent) and len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(k, pa.list_(pa.int64()))],
                schema=schema,
            )

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for the way to the pairs that need them."""
    import zstandard

    z = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        texts = [z.compress((t or "").encode()) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(texts, pa.binary())], names=["doc_id", "z"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[int], list[tuple[np.ndarray, np.ndarray]]]]:
    """For each batch of (a, b, za, zb), ordered by a: the ids, and the two sets of each row."""
    import zstandard

    z = zstandard.ZstdDecompressor()
    last: tuple[int | None, np.ndarray | None] = (None, None)
    hashed = lambda texts: v.word_hashes(pa.array(texts, pa.large_string()), lower=True)
    for batch in batches:
        hubs, leaves = batch.column("a").to_numpy(), batch.column("b").to_numpy()
        new = np.flatnonzero(np.concatenate([[True], hubs[1:] != hubs[:-1]])) if len(hubs) else np.zeros(0, int)
        new = [int(i) for i in new if hubs[i] != last[0]]
        zs = batch.column("za")
        sets = {int(hubs[i]): shingle_set(h) for i, (_, h) in zip(new, hashed([z.decompress(zs[i].as_py()).decode() for i in new]))}
        if last[0] is not None:
            sets.setdefault(*last)
        rows = [(sets[int(hubs[i])], shingle_set(h)) for i, h in hashed([z.decompress(x.as_py()).decode() for x in batch.column("zb")])]
        if len(hubs):
            last = (int(hubs[-1]), sets[int(hubs[-1])])
        yield hubs, leaves, rows


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hubs, leaves, rows in _sets(batches):
            ok = []
            for s, t in rows:
                both = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(100 * both >= percent * (len(s) + len(t) - both))
            keep = np.flatnonzero(np.array(ok, bool))
            yield pa.RecordBatch.from_arrays([pa.array(hubs[keep], pa.int64()), pa.array(leaves[keep], pa.int64())], names=["a", "b"])

    return run


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is in one of the sets only, with the sizes of both."""
    for pivots, others, rows in _sets(batches):
        apart = [np.setxor1d(s, t, assume_unique=True) for s, t in rows]
        yield pa.RecordBatch.from_arrays(
            [pa.array(pivots, pa.int64()), pa.array(others, pa.int64()), pa.array([len(t) for _, t in rows], pa.int64()), pa.array([len(s) for s, _ in rows], pa.int64()),
             pa.array([len(x) for x in apart], pa.int64()), pa.array([v.signed(x) for x in apart], pa.list_(pa.int64()))],
            names=["a", "b", "n", "pivot_n", "size", "tokens"],
        )


def _closed(move: DataFrame) -> DataFrame:
    """The moves (u, m) followed to their ends, by pointer doubling."""
    while True:
        then = move.select(F.col("u").alias("m"), F.col("m").alias("further"))
        move = materialise(
            move.select("u", "m").join(then, "m", "left").select("u", F.coalesce("further", "m").alias("m"), F.col("further").isNotNull().alias("went")), "moves"
        )
        if move.where("went").isEmpty():
            return move.select("u", "m")


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) for the ends of the edges (a, b): comp is the least id reachable.

    Each vertex moves to its least neighbour, by id in one round and by a hash in the next, moves are followed to
    their ends, and edges are contracted.  By a hash at least half of the vertices are expected to move, so the
    rounds are logarithmic whatever the shape; a chain of ascending ids takes one."""
    tidy = lambda e: materialise(e.where("a <> b").select(*_ordered("a", "b")).distinct(), "edges")
    edges = tidy(edges)
    ids = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    comps = materialise(ids.select("id", F.col("id").alias("comp")), "components")
    step = 0
    while not edges.isEmpty():
        rank = (lambda c, k=step: F.struct(F.xxhash64(F.lit(k), c), c)) if step % 2 else (lambda c: F.struct(c))
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("w")).union(edges.select("b", "a"))
        least = both.groupBy("u").agg(F.min_by("w", rank(F.col("w"))).alias("m"))
        move = _closed(least.where(rank(F.col("m")) < rank(F.col("u"))))
        to = lambda df, c, m=move: df.join(m, df[c] == m["u"], "left").withColumn(c, F.coalesce("m", c)).drop("u", "m")
        comps = materialise(to(comps, "comp"), "components")
        edges = tidy(to(to(edges, "a"), "b"))
        step += 1
    if step < 2:
        return comps
    return comps.join(comps.groupBy("comp").agg(F.min("id").alias("least")), "comp").select("id", F.col("least").alias("comp"))


def _joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """The components (id, comp) with more links (a, b)."""
    for c in ("a", "b"):
        links = links.join(comps.select(F.col("id").alias(c), "comp"), c, "left").withColumn(c, F.coalesce("comp", c)).drop("comp")
    more = components(links)
    old = comps.join(more.select(F.col("id").alias("comp"), F.col("comp").alias("least")), "comp", "left")
    fresh = more.join(comps, "id", "left_anti")
    return materialise(old.select("id", F.coalesce("least", "comp").alias("comp")).union(fresh.select("id", "comp")), "components")


def _near_size(a: str, b: str, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _stars(members: DataFrame, step: int, percent: int) -> DataFrame:
    """Pairs (a, b): each member with the hubs of other components that it shares most buckets with."""
    order = F.col("doc_id") if step == 0 else F.xxhash64(F.lit(step), "doc_id")
    hubs = members.groupBy("key").agg(
        F.min_by("doc_id", order).alias("hub"), F.min_by("n", order).alias("hub_n"), F.min_by("comp", order).alias("hub_comp"), F.count("*").alias("m")
    ).where("m > 1").drop("m")
    met = members.join(hubs, "key").where((F.col("comp") != F.col("hub_comp")) & _near_size("n", "hub_n", percent))
    votes = met.groupBy("doc_id", "hub").agg(F.count("*").alias("votes"))
    best = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("votes"), "hub"))
    return votes.withColumn("_k", best).where(F.col("_k") <= HUBS).select(*_ordered("doc_id", "hub")).distinct()


def _open(members: DataFrame, comps: DataFrame) -> DataFrame:
    """The members of buckets that hold more than one component, with their components."""
    placed = members.drop("comp").join(comps.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("key", "doc_id", "n", F.coalesce("comp", "doc_id").alias("comp"))
    placed = materialise(placed, "placed")
    split = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    return materialise(placed.join(split, "key", "left_semi"), "open")


def _small(members: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """All pairs of buckets of ``SMALL`` members at most, over components; and the members of larger ones."""
    counted = members.join(members.groupBy("key").agg(F.count("*").alias("m")), "key")
    few = counted.where(F.col("m") <= SMALL)
    other = few.select("key", *[F.col(c).alias(f"other_{c}") for c in ("doc_id", "n", "comp")])
    met = few.join(other, "key").where((F.col("doc_id") < F.col("other_doc_id")) & (F.col("comp") != F.col("other_comp")) & _near_size("n", "other_n", percent))
    return met.select(F.col("doc_id").alias("a"), F.col("other_doc_id").alias("b")).distinct(), counted.where(F.col("m") > SMALL).drop("m")


def _pivoted(members: DataFrame) -> DataFrame:
    """(a, b): the pivot of each bucket, the member that lies in most of them, and each other member."""
    often = members.groupBy("doc_id").agg(F.count("*").alias("k"))
    pivots = members.join(often, "doc_id").groupBy("key").agg(F.max_by("doc_id", F.struct("k", -F.col("doc_id"))).alias("a"))
    return members.join(pivots, "key").where("a <> doc_id").select("a", F.col("doc_id").alias("b")).distinct()


def _rest(differences: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that no shared pivot rules out.

    x and y with a common pivot are linked only if |x ^ y|, the size of their symmetric difference, is at most
    t = (100 - percent) / (100 + percent) * (|x| + |y|); and x ^ y = (x ^ pivot) ^ (y ^ pivot).  So with differences a and
    b from the pivot in size they share at least (a + b - t) / 2 of the elements of these (where that is not positive, both
    are linked to the pivot).  In one order of the elements, rare ones first, their first common element then lies at a
    place p in the one and q in the other with b - a + 2p <= t and a - b + 2q <= t: only such pairs meet.  Members of the
    main component of a pivot are compared with the others only."""
    least, most = 100 - percent, 100 + percent
    placed = differences.join(comps.withColumnRenamed("id", "b"), "b", "left").withColumn("comp", F.coalesce("comp", "b"))
    placed = materialise(placed.select("a", "b", "n", "size", "comp", "tokens"), "placed")
    counted = placed.groupBy("a", "comp").agg(F.count("*").alias("m"), F.min("size").alias("near"))
    main = counted.groupBy("a").agg(F.max_by("comp", F.struct("m", "comp")).alias("main"), F.count("*").alias("comps")).where("comps > 1").drop("comps")
    outer = counted.join(main, "a").where("comp <> main").groupBy("a").agg(F.min("near").alias("near"))
    # a pivot's members are dealt to ``SALTS`` tasks
    known = main.join(outer, "a").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = placed.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    live = salted.join(known, ["a", "salt"]).drop("salt").withColumn("out", F.col("comp") != F.col("main"))
    tokens = live.select("a", "b", F.explode("tokens").alias("token"))
    shared = tokens.groupBy("a", "token").agg(F.count("*").alias("f")).where("f > 1")
    ranked = tokens.join(shared, ["a", "token"]).groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("f", "token"))).alias("ranked"))
    reach = F.floor(least * (F.col("n") + F.floor(100 * F.col("n") / percent)) / most)  # the largest t
    far = F.when(F.col("out"), reach).otherwise(F.least(reach, F.floor((reach + F.col("size") - F.col("near")) / 2)))
    placed = live.drop("tokens").join(ranked, ["a", "b"]).withColumn("before", F.col("size") - F.size("ranked"))  # elements of one member only come first
    firsts = F.slice("ranked", F.lit(1), F.greatest(F.lit(0), far - F.col("before") + 1).cast("int"))
    keyed = materialise(
        placed.select("a", "b", "n", "size", "comp", "out", "before", F.posexplode(firsts).alias("at", "e")).select(
            "a", "b", "n", "size", "comp", "out", F.col("e.token").alias("token"), (F.col("before") + F.col("at")).alias("p")
        ),
        "keyed",
    )
    x = keyed.where("out").drop("out")
    y = keyed.select("a", "token", "out", *[F.col(c).alias(f"other_{c}") for c in ("b", "n", "size", "comp", "p")])
    t = least * (F.col("n") + F.col("other_n"))
    may = (F.col("comp") != F.col("other_comp")) & (~F.col("out") | (F.col("b") < F.col("other_b")))
    may = may & (most * (F.col("other_size") - F.col("size") + 2 * F.col("p")) <= t) & (most * (F.col("size") - F.col("other_size") + 2 * F.col("other_p")) <= t)
    return x.join(y, ["a", "token"]).where(may).select(*_ordered("b", "other_b")).distinct()


def classes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id; links have a similarity of ``percent``."""
    with python_ready(docs.sparkSession):
        return _classes(docs, percent)


def _classes(docs: DataFrame, percent: int) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = materialise(texts.mapInArrow(_sketch(percent), SKETCH), "sketch")
    known = sketch.where("doc_id is not null and n_shingles > 0")
    key = ["n_shingles", "fp1", "fp2"]
    equal = materialise(known.groupBy(*key).agg(F.min("doc_id").alias("rep")), "classes")
    member = materialise(
        sketch.drop("bands").join(equal, key, "left").select(
            "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("rep")
        ),
        "members",
    )
    # (bucket, representative, size of its set), of buckets with two members at least
    whole = known.join(equal.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").where("bands is not null")
    keyed = materialise(whole.select("doc_id", F.explode("bands").alias("key")), "keys")
    shared = keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    sizes = member.where("doc_id = rep").groupBy("doc_id").agg(F.max("n_shingles").alias("n"))
    buckets = materialise(keyed.join(shared.hint("merge"), "key", "left_semi").distinct().join(sizes, "doc_id"), "buckets")
    drop(keyed)
    comps = materialise(buckets.where("false").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("comp")), "components")
    compared = comps.select(F.col("id").alias("a"), F.col("comp").alias("b"))

    def confirm(pairs: DataFrame) -> None:
        nonlocal comps, compared
        pairs = materialise(pairs.join(compared, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            return
        compared = compared.union(pairs)
        comps = _joined(comps, materialise(_confirmed(texts, pairs, percent), "links"))

    members = buckets.withColumn("comp", F.col("doc_id"))
    for step in range(ROUNDS):
        confirm(_stars(members, step, percent))
        members = _open(members, comps)
    pairs, large = _small(members, percent)
    confirm(pairs)
    large = _open(large, comps)
    if not large.isEmpty():
        apart = materialise(_compared(texts, _pivoted(large), _difference, "a bigint, b bigint, n bigint, pivot_n bigint, size bigint, tokens array<bigint>"), "differences")
        linked = apart.where((100 - percent) * (F.col("n") + F.col("pivot_n")) >= (100 + percent) * F.col("size"))
        comps = _joined(comps, linked.select(*_ordered("a", "b")))
        confirm(_rest(apart, comps, percent))
    done = materialise(
        member.join(comps, member["rep"] == comps["id"], "left")
        .select("doc_id", "n_shingles", F.coalesce("comp", "rep", "doc_id").alias("component_id")),
        "near-dedup",
    )
    for table in (sketch, equal, member, buckets):
        drop(table)
    return done


def _compared(texts: DataFrame, pairs: DataFrame, function, schema: str) -> DataFrame:
    """Arrow ``function`` over the pairs (a, b) with both texts."""
    pairs = materialise(pairs, "pairs")
    wanted = among(texts.where("doc_id is not null"), "doc_id", pairs.select(F.explode(F.array("a", "b"))))
    packed = wanted.mapInArrow(_pack, "doc_id bigint, z binary")
    # the pairs of one hub are dealt to as many parts as they need
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(PART)).cast("int").alias("parts"))
    hubs = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    left = hubs.join(packed.select(F.col("doc_id").alias("a"), F.col("z").alias("za")), "a")
    right = packed.select(F.col("doc_id").alias("b"), F.col("z").alias("zb"))
    dealt = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    return dealt.join(right, "b").join(left, ["a", "part"]).select("a", "b", "za", "zb").mapInArrow(function, schema)


def _confirmed(texts: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    return _compared(texts, pairs, _verify(percent), "a bigint, b bigint").distinct()


def digest(docs: DataFrame, percent: int = OP9_PERCENT) -> DataFrame:
    return classes(docs, percent).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_copies(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each component, with the columns it came with; of rows that repeat an id, one."""
    judged = digest(docs, percent)
    whole = packed(docs).withColumn("id", F.col("row.doc_id").cast("long"))
    out = without(whole, "id", judged.where("not kept").select("doc_id"))
    twice = materialise(judged.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("m")).where("m > 1").select("doc_id"), "twice")
    if not twice.isEmpty():
        again = among(out, "id", twice).join(twice, F.col("id") == twice["doc_id"], "left_semi").groupBy("id").agg(F.first("row").alias("row"))
        out = without(out, "id", twice).unionByName(again)
    return out.select("row.*")
