"""Intermediate tables in the folder that driver and executors share.

``spark.checkpoint.dir`` names that folder on a cluster.  Where it is unset (tests on one machine) a
temporary folder stands in for it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..deploy import ship

_LOCAL: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="mnemolake-"))
        base = f"file://{_LOCAL[0]}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: its lineage ends there."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packed(df: DataFrame) -> DataFrame:
    """The table as one struct column ``row``: no name of the input can meet a working column's."""
    return df.select(F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("row"))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


#: Ids that go to every task, at most; beyond, a bitmap of so many bits goes there.
FEW_IDS = 50_000
BITS = 1 << 26
PAGE = 32_768


def _flagged(df: DataFrame, key: str, ids: DataFrame, few: int = FEW_IDS) -> DataFrame:
    """``df`` with ``_in``: true where the key is among the ids (column ``_id``) and, if there are more than ``few``, for some others.

    Many ids are set in a bitmap of ``BITS`` bits, by their hash: what is broadcast does not grow with them, and no row
    of ``df`` is moved."""
    if ids.limit(few + 1).count() <= few:
        return df.join(F.broadcast(ids), df[key] == ids["_id"], "left").withColumn("_in", F.col("_id").isNotNull()).drop("_id")
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(BITS))
    page = lambda c: F.call_function("div", at(c), F.lit(PAGE))
    maps = ids.groupBy(page("_id").alias("_page")).agg(F.bitmap_construct_agg(F.pmod(at("_id"), F.lit(PAGE))).alias("_map"))
    place = F.pmod(at(key), F.lit(PAGE)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("_map"), F.call_function("div", place, F.lit(8)).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("div", byte, F.pow(F.lit(2), F.pmod(place, F.lit(8))).cast("int")) % 2 == 1
    found = df.join(F.broadcast(maps), page(F.col(key)) == F.col("_page"), "left")  # at most BITS / 8 bytes
    return found.withColumn("_in", F.coalesce(bit, F.lit(False))).drop("_page", "_map")


def _ids(ids: DataFrame) -> DataFrame:
    return materialise(ids.toDF("_id").where("_id is not null").distinct(), "ids")


def among(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows whose key is among the ids (one column) and, if there are many ids, a few others, for an exact join later."""
    return _flagged(df, key, _ids(ids)).where("_in").drop("_in")


def parted(df: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose key is among the ids (one column) with, at times, a few others, and the rest, null keys included.
    What is broadcast is a bitmap at every size."""
    flagged = _flagged(df, key, _ids(ids), few=0)
    return flagged.where("_in").drop("_in"), flagged.where("not _in").drop("_in")


def without(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows whose key is not among the ids (one column), null keys included.  Of many ids, only rows that may be
    among them are moved."""
    ids = _ids(ids)
    flagged = _flagged(df, key, ids)
    sure = flagged.where("not _in").drop("_in")
    rest = flagged.where("_in").drop("_in")
    return sure.unionByName(rest.join(ids, rest[key] == ids["_id"], "left_anti"))


def drop(df: DataFrame) -> None:
    """Delete the files behind a table that ``materialise`` made and nothing reads any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    parents = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for parent in parents:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Like ``materialise``, as a table bucketed by ``key``: joins and groups by it do not move its rows."""
    spark = df.sparkSession
    path, table = scratch_path(spark, name), f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).option("path", path).saveAsTable(table)
    return spark.table(table)


class python_ready:
    """Send the package to the workers; in a ``with``, also keep Arrow batches of whole texts to a few MB and put the
    session's setting back."""

    KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"

    def __init__(self, spark: SparkSession, rows: int = 1000):
        ship(spark)
        self.spark, self.rows = spark, rows

    def __enter__(self) -> None:
        self.usual = self.spark.conf.get(self.KEY, "10000")
        if not 0 < int(self.usual) <= self.rows:
            self.spark.conf.set(self.KEY, str(self.rows))

    def __exit__(self, *_) -> None:
        self.spark.conf.set(self.KEY, self.usual)
