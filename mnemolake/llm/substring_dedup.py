"""Substring deduplication with a log-structured index of fingerprints of word windows.

A window of ``WINDOW`` words is represented in the index by one of its ``ANCHOR``-word hashes, the least one (the
leftmost, if equal): equal windows choose alike, and a window's neighbours mostly share the choice, so the index
holds about one hash for seven windows.

The index is a folder: immutable runs and a manifest.  A run is the table of one batch's hashes, bucketed and sorted by
hash, so it is merge-joined with the runs before it bucket by bucket and none of them is moved.  A hash that an earlier
run holds, or that occurs twice in the run, is a candidate.  When more than ``FANOUT`` runs are live they are compacted
into one.  Each change is a new version of the manifest, written last: a job that is lost leaves the version before, and a
later job opens the index and goes on with its batch (``extend``).

Candidates are then verified: all windows behind candidate hashes are compared by a 96-bit fingerprint of their 20 words,
and the earliest start (earlier batch, then least id, then least place) of each keeps its words.  ``digest`` takes one
table in batches by ascending id, and verifies once at the end.

No step gathers a hot window: hashes are distinct within a document, joins on them split skewed keys, and the
earliest start is a combining aggregate.

Defined results: null or short texts lose nothing; rows that repeat an id are one document; rows without an id are
compared with nothing and keep all words; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vecwords as v
from .near_dedup import _pack
from .scratch import among, drop, materialise, parted, python_ready, scratch_path

WINDOW = 20
ANCHOR = 8
BATCHES = 3
FANOUT = 2
_U = np.uint64


def anchors(h: np.ndarray, window: int = WINDOW, k: int = ANCHOR) -> np.ndarray:
    """The place of each window's representative, ascending; empty for short texts."""
    if len(h) < window:
        return np.zeros(0, np.int64)
    g = v.ngrams(h, k, seed=3)
    wide = window - k + 1
    return np.lib.stride_tricks.sliding_window_view(g, wide).argmin(axis=1) + np.arange(len(h) - window + 1)


def fingerprints(h: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    return v.ngrams(h, window, seed=5), (v.ngrams(h, window, seed=7) >> _U(32)).astype(np.uint32)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, doc_id, whether the document holds it at two places), distinct in each document."""
    for batch in batches:
        ids = batch.column("doc_id").to_numpy()
        hashes, owners, twice = [], [], []
        for i, h in v.word_hashes(batch.column("text")):
            places = np.unique(anchors(h))
            if len(places):
                x, n = np.unique(v.ngrams(h, ANCHOR, seed=3)[places], return_counts=True)
                hashes.append(v.signed(x))
                owners.append(np.full(len(x), ids[i]))
                twice.append(n > 1)
        if hashes:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c)) for c in (hashes, owners, twice)], names=["h", "doc_id", "twice"]
            )


RUN = "h bigint, doc_id bigint, twice boolean"


class FingerprintIndex:
    """Sorted immutable runs; ``add`` merge-joins a batch with them and returns its candidate hashes."""

    def __init__(self, spark: SparkSession, path: str, buckets: int, runs: list[str], version: int, fanout: int = FANOUT):
        self.spark, self.path, self.buckets, self.version, self.fanout = spark, path, buckets, version, fanout
        self.runs = [(run, self._open_run(run)) for run in runs]

    @classmethod
    def create(cls, spark: SparkSession, path: str | None = None, buckets: int | None = None, fanout: int = FANOUT) -> FingerprintIndex:
        """An empty index; ``buckets`` is for good, so choose it for the size that is to come."""
        n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        index = cls(spark, path or scratch_path(spark, "fingerprints"), n, [], 0, fanout)
        index._commit()
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str, fanout: int = FANOUT) -> FingerprintIndex:
        """The index as its latest manifest has it."""
        manifest = spark.read.parquet(f"{path}/manifest")
        version = manifest.agg(F.max("version")).first()[0]
        buckets, runs = manifest.where(F.col("version") == version).select("buckets", "runs").first()
        return cls(spark, path, buckets, list(runs), version, fanout)

    def _open_run(self, run: str) -> str:
        """A run's table in the catalog of this session."""
        table = f"run_{uuid.uuid4().hex}"
        at = f"{self.path}/{run}".replace("'", "\\'")
        self.spark.sql(f"create table {table} ({RUN}) using parquet clustered by (h) sorted by (h) into {self.buckets} buckets location '{at}'")
        return table

    def _commit(self) -> None:
        self.version += 1
        row = self.spark.createDataFrame([(self.buckets, [run for run, _ in self.runs])], "buckets int, runs array<string>")
        row.coalesce(1).write.parquet(f"{self.path}/manifest/version={self.version}")

    def _write_run(self, rows: DataFrame) -> tuple[str, str]:
        run, table = f"run-{uuid.uuid4().hex}", f"run_{uuid.uuid4().hex}"
        dealt = rows.repartition(self.buckets, "h").write.bucketBy(self.buckets, "h").sortBy("h")
        dealt.option("path", f"{self.path}/{run}").saveAsTable(table)
        return run, table

    def add(self, batch: DataFrame) -> DataFrame:
        """Write a batch (doc_id, text) as a run and return the hashes that it shares with itself or with runs before."""
        name, table = self._write_run(batch.mapInArrow(_index, RUN))
        run = self.spark.table(table)
        own = run.groupBy("h").agg((F.max("twice") | (F.count("*") > 1)).alias("again"))
        found = own.where("again").select("h")
        for _, old in self.runs:
            found = found.union(own.select("h").join(self.spark.table(old).select("h").hint("merge"), "h", "left_semi"))
        found = materialise(found.distinct(), "candidates")
        self.runs.append((name, table))
        self._commit()
        if len(self.runs) > self.fanout:
            self.compact()
        return found

    def _live(self) -> DataFrame:
        live = self.spark.table(self.runs[0][1])
        for _, table in self.runs[1:]:
            live = live.union(self.spark.table(table))
        return live

    def compact(self) -> None:
        """One run for all that are live; the old ones go when the manifest no longer names them."""
        old = self.runs
        self.runs = [self._write_run(self._live())]
        self._commit()
        for _, table in old:
            drop(self.spark.table(table))
            self.spark.sql(f"drop table {table}")

    def holders(self, candidates: DataFrame) -> DataFrame:
        """(doc_id, hashes): the documents that hold candidates."""
        return self._live().join(candidates, "h").groupBy("doc_id").agg(F.collect_set("h").alias("hs"))


def _texts(batch: pa.RecordBatch, column: str = "z") -> pa.Array:
    import zstandard

    z = zstandard.ZstdDecompressor()
    return pa.array([z.decompress(x.as_py()) for x in batch.column(column)], pa.large_binary()).cast(pa.large_string())


def _candidate_windows(h: np.ndarray, hs: np.ndarray) -> np.ndarray:
    """Starts of the windows whose representative is one of ``hs``."""
    at = anchors(h)
    if not len(at):
        return at
    return np.flatnonzero(np.isin(v.signed(v.ngrams(h, ANCHOR, seed=3))[at], hs))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fingerprint, generation, doc_id, earliest start in the document) of candidate windows."""
    for batch in batches:
        ids, hs, age = batch.column("doc_id").to_numpy(), batch.column("hs"), batch.column("age").to_numpy()
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        for i, h in v.word_hashes(_texts(batch)):
            starts = _candidate_windows(h, hs[i].values.to_numpy())
            if not len(starts):
                continue
            a, b = fingerprints(h)
            a, b = a[starts], b[starts]
            order = np.lexsort((starts, b, a))
            a, b, starts = a[order], b[order], starts[order]
            first = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            for c, x in zip(out, (v.signed(a[first]), b[first].view(np.int32), np.full(first.sum(), age[i]), np.full(first.sum(), ids[i]), starts[first].astype(np.int32))):
                c.append(x)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["f", "g", "age", "doc_id", "start"])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words that stay, as ``kept`` or only their digest."""
    for batch in batches:
        ids, hs, firsts = batch.column("doc_id"), batch.column("hs"), batch.column("firsts")
        n, gone, sha = [], [], []
        texts = _texts(batch)
        raw = None
        for i, h in v.word_hashes(texts):
            word = texts[i].as_py().encode().split()
            n.append(len(word))
            lost = 0
            if hs[i].is_valid:
                starts = _candidate_windows(h, hs[i].values.to_numpy())
                if firsts[i].is_valid:
                    starts = np.setdiff1d(starts, firsts[i].values.to_numpy())
                if len(starts):
                    mark = np.zeros(len(h) + 1, np.int32)
                    np.add.at(mark, starts, 1)
                    np.add.at(mark, starts + WINDOW, -1)
                    stay = np.cumsum(mark[:-1]) == 0
                    lost = len(h) - int(stay.sum())
                    word = compress(word, stay.tolist())
            gone.append(lost)
            sha.append(hashlib.sha256(b" ".join(word)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256"],
        )


OUT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def _resolved(generations: list[DataFrame], holders: DataFrame | None) -> DataFrame:
    """The digest of the last generation's texts; generations before it, and ids within one, come first."""
    pack = lambda texts: texts.mapInArrow(_pack, "doc_id bigint, z binary")
    unmarked = lambda texts: pack(texts).withColumns({"hs": F.lit(None).cast("array<bigint>"), "firsts": F.lit(None).cast("array<int>")}).mapInArrow(_removed, OUT)
    if holders is None:
        return unmarked(generations[-1])
    holders = materialise(holders, "holders")
    last = len(generations) - 1
    # only the texts that share something are moved
    shared, rest = parted(generations[-1], "doc_id", holders.select("doc_id"))
    asked = pack(shared)
    windows = None
    for age, texts in enumerate(generations):
        some = (asked if age == last else pack(among(texts, "doc_id", holders.select("doc_id")))).join(holders, "doc_id").withColumn("age", F.lit(age))
        found = some.mapInArrow(_windows, "f bigint, g int, age int, doc_id bigint, start int")
        windows = found if windows is None else windows.unionByName(found)
    first = windows.groupBy("f", "g").agg(F.min(F.struct("age", "doc_id", "start")).alias("first")).where(F.col("first.age") == last)
    firsts = materialise(first.groupBy(F.col("first.doc_id").alias("doc_id")).agg(F.collect_list("first.start").alias("firsts")), "firsts")
    marks = holders.join(firsts, "doc_id", "left")
    return asked.join(marks, "doc_id", "left").mapInArrow(_removed, OUT).unionByName(unmarked(rest))


def extend(index: FingerprintIndex, history: DataFrame, batch: DataFrame) -> DataFrame:
    """Add a batch to an index and return its digest, with ``history`` the documents that the index knows.

    Of these only the texts that share a candidate with the batch are read on."""
    with python_ready(index.spark):
        own = _plain(batch)
        known = own.where("doc_id is not null")
        candidates = index.add(known)
        return materialise(_resolved([_plain(history).where("doc_id is not null"), own], index.holders(candidates)), "digest")


def digest(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_removed, kept_sha256."""
    spark = docs.sparkSession
    with python_ready(spark):
        texts = _plain(docs)
        known = texts.where("doc_id is not null")
        low, high = known.agg(F.min("doc_id"), F.max("doc_id")).first()
        if low is None:
            return materialise(_resolved([texts], None), "digest")
        index, candidates = FingerprintIndex.create(spark), None
        step = (high - low) // batches + 1
        for k in range(batches):
            found = index.add(known.where(F.col("doc_id").between(low + k * step, low + (k + 1) * step - 1)))
            candidates = found if candidates is None else candidates.union(found)
        return materialise(_resolved([texts], index.holders(materialise(candidates.distinct(), "candidates"))), "digest")
